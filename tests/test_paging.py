"""Pages by ranges of the sort key against a full sort."""

import pytest
from pyspark.sql import functions as F

from netlens.operators import paging, search
from netlens.operators.filters import LogFilter, TimeWindow

NOW = "2024-01-31 00:00:00"
SKEWED = ("log_type", "rule_action", "threat_score", "hostname")


@pytest.fixture(scope="module")
def logs(spark):
    """2 000 rows. Most columns have few values, one of which holds a third of the rows or
    more, and NULLs; addresses are of both families."""
    n = F.col("id")
    scattered = F.pmod(F.xxhash64("id"), F.lit(1000))

    def some(values: int, name: str):
        value = F.when(scattered < 400, F.lit(f"{name}0")).otherwise(F.concat(F.lit(name), F.pmod(scattered, F.lit(values))))
        return F.when(F.pmod(n, F.lit(11)) == 3, None).otherwise(value).alias(name)

    v4 = F.concat(F.lit("10.0."), F.pmod(scattered, F.lit(7)), F.lit("."), F.pmod(n, F.lit(250)))
    address = F.when(scattered < 300, "9.9.9.9").when(scattered < 400, F.concat(F.lit("2001:db8::"), F.hex(n))).when(scattered > 990, None).otherwise(v4)
    rows = spark.range(1, 2001).select(
        n, F.timestamp_seconds(1706000000 + scattered).alias("timestamp"), F.timestamp_seconds(1706000000 - n % 5).alias("created_at"),
        address.alias("src_ip"), F.reverse(F.lit("1.1.1.1")).alias("dst_ip"), F.when(n % 3 > 0, 443).otherwise(n % 90).cast("int").alias("src_port"),
        F.lit(None).cast("int").alias("dst_port"), F.when(n % 4 > 0, scattered % 100).cast("int").alias("threat_score"),
        *[some(9, c) for c in ("log_type", "protocol", "service_name", "direction", "rule_action", "rule_name", "geo_country", "hostname")],
    )
    return rows.cache()


def _sorted(logs, column, descending):
    order = search.sort_order(column, descending, logs.columns)
    return [r["id"] for r in logs.orderBy(*order).select("id").collect()]


def _page(logs, column, descending, page, size, few):
    flt = LogFilter(time=TimeWindow("30d"))
    return [r["id"] for r in search.search_page(logs, flt, NOW, column, descending, page, size, few).collect()]


@pytest.mark.parametrize("column", search.SORT_COLUMNS)
def test_deep_page_of_each_column(logs, column):
    descending = column in SKEWED
    expected = _sorted(logs, column, descending)
    assert _page(logs, column, descending, 9, 150, few=100) == expected[1200:1350]


def test_first_last_and_missing_pages(logs):
    expected = _sorted(logs, "rule_name", False)
    for page in (1, 10, 11):
        assert _page(logs, "rule_name", False, page, 200, few=100) == expected[(page - 1) * 200 : page * 200]


@pytest.mark.parametrize("descending", [False, True])
def test_ranges_are_small_whatever_the_values(logs, descending):
    for column in ("rule_name", "dst_ip", "dst_port"):
        keys = logs.select(paging.sortable(logs, column, search.order_keys(column)).alias("key"))
        part = paging.page_range(keys, 990, 10, descending, few=200)
        assert 10 <= part.count <= 200 and part.skip < part.count


def test_equal_rows_end(spark):
    same = spark.range(500).select(F.lit(1).cast("long").alias("id"), F.lit("x").alias("v"))
    assert paging.page_ids(same, "v", [F.col("v")], 300, 10, False, few=50).count() == 10
    assert paging.page_ids(same.limit(0), "v", [F.col("v")], 300, 10, False, few=50).count() == 0
