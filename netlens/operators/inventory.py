"""Inventory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators.filters import client_search
from netlens.operators.topk import top_k


def list_clients(clients: DataFrame, search: str | None = None, limit: int = 200) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = clients.where(client_search(search)) if search else clients
    return top_k(rows, limit, F.desc_nulls_last("last_seen"), F.asc("mac"))


def list_devices(devices: DataFrame) -> DataFrame:
    return devices.orderBy(F.asc_nulls_last("device_name"), F.asc_nulls_last("model"), F.asc("mac"))
