"""Registered queries against their SQL on the smallest tables.

``tools/check.py`` runs all of them; here one or two of each family, and all with
NETLENS_ALL=1.
"""

import os
import re

import duckdb
import pytest

from netlens.contract import ORACLES, QUERIES
from tools.check import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = (
    "f1_overview c4_src_negated c7_action_negated_both c8_rule_display_form f12_top_threats f18_tables_bundle f19_ip_pairs"
    " f21_cidr24_having f22_ip_pairs_modal f26_threat_geo_threats g5_adaptive_top_n g8_ip_profiles h1_search_deep_page"
    " h3_log_detail a11_export_logs e8_asn_block e19_name_by_ip_map k2_enrich j2_upsert_feed j6_fail j9_patch_details"
    " j22_droppable_partitions a3_map_dns_query f40_audit_page"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("NETLENS_ALL") else CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_no_nested_loops(spark):
    """Joins of the registered queries run on keys."""
    for name in ("e8_asn_block", "g5_adaptive_top_n", "f26_threat_geo_threats", "k2_enrich", "j8_patch_scores", "h1_search_newest"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_texts_are_hashed_before_they_are_sorted(spark):
    """``max`` over text sorts its input: that is rows already grouped by these texts."""
    for name in ("f10_top_blocked_external", "f12_top_threats", "f13_top_allowed_destinations", "f18_tables_bundle", "f19_ip_pairs", "f28_peers_as_src"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
        assert re.search(r"HashAggregate\(keys=\[[^\]]*asn(_name)?#", plan), name
