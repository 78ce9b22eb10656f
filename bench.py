"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_SCALE    multiply the log rows by this factor (default 1)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from netlens.contract.common import ALL, CFG, FIREWALL, MONTH, NOW, OWN, WEEK  # noqa: E402
from netlens.fixtures import Tables  # noqa: E402
from netlens.operators import aggregate, flows, search, stats, threats  # noqa: E402
from netlens.operators.enrich import EnrichmentTables, enrich  # noqa: E402
from netlens.operators.rangejoin import keyed_blocks, range_join  # noqa: E402
from netlens.plans import maintenance, parse  # noqa: E402
from netlens.session import configure  # noqa: E402


def scaled(logs: DataFrame, factor: int) -> DataFrame:
    """The same log many times over, with new ids and shifted seconds."""
    if factor == 1:
        return logs
    copies = logs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return copies.withColumn("id", F.col("id") * factor + F.col("copy")).withColumn(
        "timestamp", F.col("timestamp") - F.make_dt_interval(secs=(F.col("copy") % 3600).cast("decimal(18,6)"))
    ).drop("copy")


def run(df: DataFrame) -> None:
    """Compute every output row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    factor = int(os.environ.get("BENCH_SCALE", "1"))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("netlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    logs = scaled(t.logs, factor)
    if factor > 1 and t.base("events").rdd.getNumPartitions() < int(cpus):
        logs = scaled(t.logs.repartition(int(cpus)), factor)
    # The test table is one file with one row group; lines come from many files.
    lines = logs.select("id", "raw_log").repartition(int(cpus))
    groups = flows.flow_groups(logs, FIREWALL, NOW)
    tables = EnrichmentTables(asn_blocks=keyed_blocks(t.asn_blocks), rdns_cache=t.rdns_cache, threats=t.threats)
    bare = logs.drop("geo_country", "asn_name", "rdns", "threat_score", "threat_categories", "remote_ip").repartition(int(cpus))
    queries = {
        "f1_overview": lambda: stats.overview(logs, WEEK, NOW),
        "f17_action_over_time": lambda: stats.action_over_time(logs, MONTH, NOW),
        "f18_dashboard": lambda: stats.dashboard(logs, t.clients, MONTH, NOW, OWN),
        "f19_ip_pairs": lambda: aggregate.ip_pairs(logs, t.clients, t.devices, FIREWALL, NOW, CFG),
        "f20_aggregate": lambda: aggregate.aggregate(logs, ALL, NOW, by="asn"),
        "f21_cidr_rollup": lambda: aggregate.aggregate(logs, ALL, NOW, by="src_ip", prefix=24),
        "f24_g5_flow_graph": lambda: flows.sankey_links(flows.adaptive_top_n(groups, 50)),
        "f25_zone_matrix": lambda: flows.zone_matrix(logs, FIREWALL, NOW, CFG),
        "f26_threat_map": lambda: threats.threat_geo(logs, MONTH, NOW),
        "h1_log_page": lambda: search.search_logs(logs, t.clients, t.devices, t.services, ALL, NOW, CFG),
        "e8_block_join": lambda: range_join(logs.select(F.col("remote_ip").alias("ip")), keyed_blocks(t.asn_blocks)),
        "j8_patch_scores": lambda: maintenance.patch_scores(logs, t.threats),
        "k2_enrich": lambda: enrich(bare, tables, CFG, NOW),
        "b_parse": lambda: parse.parse_syslog(lines, CFG, NOW, t.services),
    }
    run(queries["f1_overview"]())  # warm up the session, not the queries
    seconds = {}
    for name, build in queries.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(build())
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name:24} {best:8.3f}s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "netlens_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "scale": factor,
            }
        )
    )


if __name__ == "__main__":
    main()
