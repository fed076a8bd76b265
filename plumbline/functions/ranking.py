"""Global order statistics without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import cut_lineage


def global_row_number(df: DataFrame, order: list[str], name: str = "row_no",
                      total: str | None = None) -> DataFrame:
    """1-based row number in the given order, and the row count as ``total``.

    Rows are range-partitioned by the order columns, the partitions are counted,
    and each row adds the rows of earlier partitions to its place in its own. The
    ranged rows are checkpointed so that counting and numbering see one layout.
    Order columns should be unique together (add a key), which also spreads ties."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = counts.select("_part", before.alias("_before"), every.alias(total or "_total"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before", "_total")


#: Size of the quantile sketches: ranks are right to about a thousandth.
SKETCH = 2000
#: Margin around a wanted rank, as a share of the rows, that the sketch's error stays in.
MARGIN = 0.004
#: Rows of an interval that are few enough to be sorted by value at once.
FEW = 100_000


def values_at_ranks(df: DataFrame, value: str, ranks) -> list[tuple[int, float]]:
    """[(rank, value)] of the sorted non-null column, exact; ``ranks(n)`` gives the wanted
    0-based ranks for n rows.

    A quantile sketch puts an interval around each rank; the next pass counts what is below
    and inside, which proves the interval or widens it again, and sketches only the
    inside. Once few rows are left, or one value, the interval is read off. All ranks
    share a pass, and a pass brings back a few numbers for each, so neither the width of the
    range, nor ties, nor the number of rows matter."""
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    x = F.col("v")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    open_ = {r: {"lo": low, "hi": high, "below": 0, "n": n} for r in sorted({int(r) for r in ranks(n)}) if 0 <= r < n} if n else {}
    done: dict[int, float] = {}
    while open_:
        for r in [r for r, s in open_.items() if s["lo"] == s["hi"]]:
            done[r] = open_.pop(r)["lo"]
        few = {r: s for r, s in open_.items() if s["n"] <= FEW}
        for r, s in few.items():
            del open_[r]
            counts = v.where((x >= s["lo"]) & (x <= s["hi"])).groupBy("v").count()
            upto = F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # FEW rows at most
            done[r] = counts.select("v", upto.alias("upto")).where(F.col("upto") > r - s["below"]).agg(F.min("v")).first()[0]
        if not open_:
            break
        inside = lambda s: (x >= s["lo"]) & (x <= s["hi"])
        sketch = v.agg(*[F.kll_sketch_agg_double(F.when(inside(s), x), F.lit(SKETCH)).alias(f"s{r}") for r, s in open_.items()])
        at = lambda s, r, d: F.lit(min(1.0, max(0.0, (r - s["below"]) / max(1, s["n"] - 1) + d)))
        cut = sketch.select(*[F.kll_sketch_get_quantile_double(f"s{r}", at(s, r, d)).alias(f"{k}{r}") for r, s in open_.items() for k, d in (("a", -MARGIN), ("b", MARGIN))]).first()
        tried = {r: (cut[f"a{r}"], cut[f"b{r}"]) for r in open_}
        counted = v.agg(*[c for r, (a, b) in tried.items() for c in (
            F.count_if(x < a).alias(f"u{r}"), F.count_if((x >= a) & (x <= b)).alias(f"i{r}"))]).first()
        for r, (a, b) in tried.items():
            s, under, here = open_[r], counted[f"u{r}"], counted[f"i{r}"]
            if under <= r < under + here and here < s["n"]:
                open_[r] = {"lo": a, "hi": b, "below": under, "n": here}
            elif r < under:  # the sketch was off: the value is below a
                hi = v.where((x >= s["lo"]) & (x < a)).agg(F.max("v")).first()[0]
                open_[r] = {"lo": s["lo"], "hi": hi, "below": s["below"], "n": under - s["below"]}
            elif r >= under + here:  # or above b
                lo = v.where((x > b) & (x <= s["hi"])).agg(F.min("v")).first()[0]
                open_[r] = {"lo": lo, "hi": s["hi"], "below": under + here, "n": s["below"] + s["n"] - under - here}
            else:  # nothing gained: two values hold nearly all rows; look at them one by one
                first = v.where(x == s["lo"]).count()
                if r < s["below"] + first:
                    done[r] = s["lo"]
                    del open_[r]
                else:
                    nxt = v.where((x > s["lo"]) & (x <= s["hi"])).agg(F.min("v"), F.count("v")).first()
                    open_[r] = {"lo": nxt[0], "hi": s["hi"], "below": s["below"] + first, "n": nxt[1]}
    return sorted(done.items())


#: Buckets that a group's distinct values are dealt to, of about equal numbers.
BUCKETS = 256


def _join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))  # one row
    named = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, on, "left").drop(*[f"_of_{k}" for k in keys])


def counts_below(values: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, value, weight, below): distinct values of each group, the sum of their weights, and
    of the weights strictly below.

    Rows collapse to distinct values; splitters from a sketch of each group's distinct values
    deal them to buckets of about equal size, whatever range they lie in and however often
    one occurs. Bucket totals are running sums over a few rows, and each bucket is a window
    of its own, so a group that holds most rows is ranked in many tasks."""
    distinct = cut_lineage(values.groupBy(*keys, value).agg(F.sum(weight).alias(weight)))
    parts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    splits = distinct.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH)).alias("_s"))
    splits = splits.where("_s IS NOT NULL").select(*keys, F.array_distinct(F.kll_sketch_get_quantile_double("_s", parts)).alias("_splits"))
    dealt = _join_groups(distinct, splits, keys).withColumn("_bucket", F.coalesce(F.size(F.filter("_splits", lambda s: s <= F.col(value))), F.lit(0))).drop("_splits")
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_w"))
    before = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_lower", F.coalesce(F.sum("_w").over(before(*keys).orderBy("_bucket")), F.lit(0))).drop("_w")
    inner = dealt.withColumn("_in", F.coalesce(F.sum(weight).over(before(*keys, "_bucket").orderBy(value)), F.lit(0)))
    return _join_groups(inner, totals, [*keys, "_bucket"]).select(*keys, value, weight, (F.col("_in") + F.col("_lower")).alias("below"))
