"""Port and service registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.scalars import service_display
from netlens.operators.dims import join_service

# Columns of the registry file that are used, and its transports.
REGISTRY_COLUMNS = ("Service Name", "Port Number", "Transport Protocol", "Description", "Reference")
TRANSPORTS = ("tcp", "udp", "sctp", "dccp")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows in file order. The file has a header and quoted line breaks,
    so it is one split by nature; it holds some 15 000 rows."""
    return (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        .select(*REGISTRY_COLUMNS)
        .withColumn("pos", F.monotonically_increasing_id())
    )


def service_dim(registry: DataFrame) -> DataFrame:
    """(port, protocol) -> service_name, description.

    Of several entries the last one that cites an RFC wins, else the first. A
    port range counts for its first port; the name falls back to the description
    and a description that only repeats the name is NULL.
    """

    def text(name: str):
        return F.coalesce(F.trim(F.col(name)), F.lit(""))

    rows = registry.select(
        "pos", text("Service Name").alias("name"), text("Description").alias("long"),
        F.regexp_extract(text("Port Number"), r"^([0-9]+)(?:-.*)?$", 1).try_cast("int").alias("port"),
        F.lower(text("Transport Protocol")).alias("protocol"),
        F.upper(text("Reference")).contains("RFC").alias("rfc"),
    ).where(
        F.col("port").isNotNull() & F.col("protocol").isin(*TRANSPORTS) & ((F.col("name") != "") | (F.col("long") != ""))
    )
    order = F.struct("rfc", F.when(F.col("rfc"), F.col("pos")).otherwise(-F.col("pos")))
    chosen = rows.groupBy("port", "protocol").agg(F.max_by(F.struct("name", "long"), order).alias("s"))
    name = F.when(F.col("s.name") != "", F.col("s.name")).otherwise(F.col("s.long"))
    longer = F.when((F.col("s.long") != "") & (F.col("s.long") != name), F.col("s.long"))
    return chosen.select("port", "protocol", name.alias("service_name"), longer.alias("description"))


def load_service_dim(spark: SparkSession, path: str) -> DataFrame:
    return service_dim(read_registry(spark, path))


def service_name(df: DataFrame, services: DataFrame, port: str = "dst_port", protocol: str = "protocol") -> DataFrame:
    """Adds the registered service under its display name, and its description."""
    return join_service(df, services, port, protocol).withColumn("iana_service", service_display("iana_service"))
