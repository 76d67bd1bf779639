import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["boq_trade_rollup", "price_report", "upsert_latest", "import_projects", "region_lookup", "bill_items", "weighted_fusion", "intent_labels", "merged_ranges", "fuzzy_name_match", "estimate_record", "frequent_categories", "split_search"]


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {k for k in queries if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert own - set(oracles) == {"ml_item_price", "ml_unit_price", "multi_output_models"}


@pytest.mark.parametrize("name", QUICK)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["active_items_of_projects"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in plan
    assert "l_shipdate" not in plan and "l_tax" not in plan
