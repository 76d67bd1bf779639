"""Exact order statistics of a column without sorting it in one place.

Every round counts the values of a bracket in a fixed number of bins and keeps
the bin that holds the wanted rank, so only bin counts leave the executors.
Brackets wider than a doubling are cut by the logarithm, others evenly: about
seven rounds find any value, however far the values lie apart.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeoff.session import checkpoint_folder

BINS = 4096
#: Size of a group's sketch; a bracket around a wanted rank then holds about a thousandth of the group.
SKETCH_SIZE, RANK_MARGIN = 4096, 0.0015


def exact_quantiles(df: DataFrame, col: Column, probs: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values; nulls and NaN are left out, infinities count."""
    # one number a row is kept (memory, then disk), as every round reads it again
    values = df.select(col.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).persist()
    try:
        v, top = F.col("v"), F.lit(math.inf)
        finite = F.when(F.abs(v) < top, v)
        n, below, above, low, high = values.agg(
            F.count(v), F.count(F.when(v == -top, 1)), F.count(F.when(v == top, 1)), F.min(finite), F.max(finite)).first()
        if not n:
            return [None] * len(probs)
        places = [p * (n - 1) for p in probs]
        ranks = sorted({math.floor(x) for x in places} | {math.ceil(x) for x in places})
        found = {r: -math.inf if r < below else math.inf for r in ranks if r < below or r >= n - above}
        inner = _select(values.select(finite.alias("v")), [r - below for r in ranks if r not in found], low, high)
        found |= {r + below: x for r, x in inner.items()}
    finally:
        values.unpersist()
    out = []
    for x in places:
        a, b, part = found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)
        out.append(a if a == b or not part else a + (b - a) * part)
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], col: Column, probs: list[float], margin: float = RANK_MARGIN) -> DataFrame:
    """Exact interpolated quantiles of every group: keys, n and q0, q1, ...; nulls and NaN are left out.

    One pass makes a mergeable sketch of each group, which gives a bracket of values around every wanted rank. A second one
    counts what lies below each bracket and each value inside of it, and so settles the exact values of all groups at once. A bracket
    that misses its rank (the sketch's bounds hold with a probability) is the group's whole range in one more pass.
    """
    v = F.col("_v")
    rows = df.select(*keys, col.cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.kll_sketch_agg_double("_v", SKETCH_SIZE).alias("_s"))
    whole = F.col("n") * margin < 1  # a bracket of a small group is all of it

    def edge(p: float, d: float) -> Column:
        return F.when(whole, F.col("_min" if d <= 0 else "_max")).otherwise(F.kll_sketch_get_quantile_double("_s", F.lit(min(max(p + d, 0.0), 1.0))))

    place = lambda p, up: F.least(F.floor((F.col("n") - 1) * F.lit(p)).cast("bigint") + up, F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), place(p, up).alias("rank"), F.lit(bool(up)).alias("upper"), edge(p, -margin).alias("lo"), edge(p, margin).alias("hi"))
                       for i, p in enumerate(probs) for up in (0, 1)])
    brackets = sketched.select(*keys, "n", "_min", "_max", F.explode(wanted).alias("w")).select(*keys, "n", "_min", "_max", "w.*")
    checkpoint_folder(df.sparkSession)
    brackets = brackets.checkpoint()  # sketches differ from run to run
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def settle(b: DataFrame) -> DataFrame:
        """value of each bracket's rank, null where the bracket misses it."""
        lo_hi = F.array_sort(F.collect_set(F.struct("lo", "hi")))
        spans = b.groupBy(*keys).agg(lo_hi.alias("spans"))
        near = rows.alias("r").join(spans.alias("b"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", F.explode("spans").alias("span"))
        counted = near.where(v <= F.col("span.hi")).groupBy(*keys, "span", F.when(v >= F.col("span.lo"), v).alias("value")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "span").orderBy(F.col("value").asc_nulls_first()))
        ranked = counted.withColumn("upto", upto)
        on = [F.col(f"k.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys] + [F.col("k.span") == F.struct(F.col("w.lo"), F.col("w.hi")), F.col("k.upto") > F.col("w.rank"), F.col("k.upto") - F.col("k.c") <= F.col("w.rank")]
        return b.alias("w").join(ranked.alias("k"), on, "left").select("w.*", F.col("k.value").alias("value"))

    first = settle(brackets).checkpoint()
    all_found = first.where("value is not null")
    missed = first.where("value is null").drop("value").withColumns({"lo": F.col("_min"), "hi": F.col("_max")})
    if not missed.isEmpty():
        all_found = all_found.union(settle(missed))
    ends = all_found.groupBy(*keys, "n", "i").agg(F.max(F.when(~F.col("upper"), F.col("value"))).alias("a"), F.max(F.when(F.col("upper"), F.col("value"))).alias("b"))
    part = F.get(F.array(*map(F.lit, probs)), F.col("i")) * (F.col("n") - 1)
    part = part - F.floor(part)
    value = F.when((F.col("a") == F.col("b")) | (part == 0), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return ends.withColumn("q", value).groupBy(*keys, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])


def _magnitude(v: float) -> float:
    return 0.0 if v == 0 else math.copysign(math.log2(abs(v)) + 1080, v)


def _bin(a: float, b: float) -> Column:
    """Bin of a value between a and b; a falls into the first and b into the last one."""
    v = F.col("v")
    if a * b > 0 and abs(b / a) <= 2 and abs(a / b) <= 2:
        part = (v - F.lit(a)) / F.lit(b - a)
    else:
        size = F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1080))
        part = (size - F.lit(_magnitude(a))) / F.lit(_magnitude(b) - _magnitude(a))
    return F.greatest(F.least(F.floor(part * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def _select(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """Value at each 0-based rank.  A bracket is (lowest, highest, ranks below it)."""
    open_ranks = {r: (low, high, 0) for r in ranks}
    found: dict[int, float] = {}
    while True:
        for r, (a, b, _) in list(open_ranks.items()):
            if a == b:
                found[r] = a
                del open_ranks[r]
        if not open_ranks:
            return found
        brackets = sorted({(a, b) for a, b, _ in open_ranks.values()})
        pick = F.lit(None).cast("int")
        bin_no = F.lit(None).cast("int")
        for i, (a, b) in reversed(list(enumerate(brackets))):
            inside = F.col("v").between(a, b)
            pick = F.when(inside, F.lit(i)).otherwise(pick)
            bin_no = F.when(inside, _bin(a, b)).otherwise(bin_no)
        counted = (
            values.select("v", pick.alias("bracket"), bin_no.alias("bin"))
            .filter(F.col("bracket").isNotNull())
            .groupBy("bracket", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("bracket", "bin")
            .collect()  # at most BINS rows a bracket, whatever the size of the data
        )
        for r, (a, b, below) in list(open_ranks.items()):
            for row in counted:
                if brackets[row["bracket"]] != (a, b):
                    continue
                if r < below + row["n"]:
                    open_ranks[r] = (row["lo"], row["hi"], below)
                    break
                below += row["n"]


def median(df: DataFrame, col: Column) -> float | None:
    return exact_quantiles(df, col, [0.5])[0]


def in_row_quantile(values: Column, p: float) -> Column:
    """Interpolated quantile of a short array column (nulls ignored)."""
    ordered = F.array_sort(F.array_compact(values))
    place = F.lit(p) * (F.size(ordered) - 1)
    lower = F.get(ordered, F.floor(place).cast("int"))
    upper = F.get(ordered, F.ceil(place).cast("int"))
    return lower + (upper - lower) * (place - F.floor(place))
