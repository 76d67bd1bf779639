from pyspark.sql import functions as F

from takeoff.operators import prices, rollups


def frames(spark):
    projects = spark.createDataFrame([("PX", 2023), ("PY", None), ("PZ", 2031)], "project_id string, build_year int")
    items = spark.createDataFrame(
        [("I1", "PX", 100.0, 1000.0, 1), ("I2", "PY", 50.0, 500.0, 1), ("I3", "PZ", 7.0, 70.0, 0)],
        "item_id string, project_id string, comp_unit_price double, total_price double, is_active int",
    ).withColumns({c: F.lit(None).cast("double") for c in ("price_adjust_factor", "comp_unit_price_adj", "total_price_adj")}).withColumn(
        "price_base_year", F.lit(None).cast("int"))
    return projects, items


def test_normalise_and_rerun(spark):
    projects, items = frames(spark)
    index = prices.price_index(spark)
    done = prices.normalize_prices(items, projects, index)
    got = {r.item_id: r for r in done.collect()}
    assert (got["I1"].price_adjust_factor, got["I1"].comp_unit_price_adj, got["I1"].total_price_adj) == (0.909091, 90.9091, 909.091)
    assert got["I1"].price_base_year == 2020
    assert (got["I2"].price_adjust_factor, got["I2"].comp_unit_price_adj, got["I2"].total_price_adj) == (1.0, 50.0, 500.0)
    assert got["I3"].price_adjust_factor == 1.0
    again = prices.normalize_prices(done, projects, prices.seeded_price_index(spark))
    assert sorted(map(str, again.select(*done.columns).collect())) == sorted(map(str, done.collect()))


def test_report_and_stats(spark):
    projects, items = frames(spark)
    index = prices.price_index(spark)
    r = prices.price_report(prices.normalize_prices(items, projects, index)).first()
    assert (r.total_items, r.open_items, r.adjusted_items, r.unchanged_items) == (3, 0, 1, 2)
    assert r.avg_unit_price == 75.0 and r.avg_unit_price_adj == 70.4546
    stats = {r.build_year: (r.projects, r["items"]) for r in prices.run_stats(items, projects, index).collect()}
    assert stats == {2023: (1, 1), None: (2, 2)}


def test_ratio_rules(spark):
    cols = "arch_cost double, deco_cost double, inst_cost double"
    high = rollups.global_ratios(spark.createDataFrame([(90.0, 5.0, 5.0)], cols)).first()
    assert abs(high.arch_ratio - 0.75) < 1e-12 and abs(sum(high) - 1) < 1e-12
    split = rollups.global_ratios(spark.createDataFrame([(50.0, 50.0, 0.0)], cols)).first()
    assert tuple(split) == (0.5, 0.25, 0.25)
    assert tuple(rollups.global_ratios(spark.createDataFrame([], cols)).first()) == (0.72, 0.14, 0.14)


def test_steel_unit(spark):
    def factor(xs):
        df = spark.createDataFrame([(x,) for x in xs], "v double")
        return rollups.steel_scale(df, F.col("v")).first().factor

    assert factor([0.05, 0.06, 55.0]) == 1000.0
    assert factor([0.05, 55.0, 60.0]) == 1.0
    assert factor([0.5, 1.2]) == 1000.0 and factor([0.9, 1.2]) == 1.0
    assert factor([0.0, -1.0]) == 1.0


def test_sums_of_large_amounts_lose_nothing(spark):
    from takeoff.functions.numbers import money

    df = spark.createDataFrame([(1.0,), (2e15,), (3.0,), (1e20,), (None,)], "v double")
    assert df.agg(F.sum(money(F.col("v"))).cast("string")).first()[0] == "100002000000000000004.0000"
