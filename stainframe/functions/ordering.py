"""Ranks, running totals, top-n and exact percentiles that never sort a whole group in one task.

A window over a whole table, or over a slide that holds a third of it, is one task. The helpers here
split such a group: rows are range-partitioned on the full sort key (ties included), each partition is
ranked on its own, and the short list of partition totals is added back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stainframe.functions.lineage import cut_lineage

# Spark trims each partition to n rows per group before the shuffle while n is at most this.
GROUP_LIMIT = 1000
# Relative width of a percentile bucket is 1/BUCKETS_PER_E; a bucket holds that share of an e-fold.
BUCKETS_PER_E = 2000


def _range_split(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with `_part`, a number that grows with the sort key; fixed by a checkpoint."""
    split = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return cut_lineage(split)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the key columns are the left side's."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if i == 0 else on & same
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def full_join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join in which a null key meets a null key; one column a key, from whichever side has the row."""
    a, b = left.withColumn("_left", F.lit(True)), right.withColumn("_right", F.lit(True)).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if i == 0 else on & same
    own = [F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys]
    rest = [c for side in (left, right) for c in side.columns if c not in keys]
    return a.join(b, on, "full").select(*own, *rest)


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Adds `<name>` = running sum up to and including the row, and `<name>_total`.

    `order` must be unique per row for a repeatable answer.
    """
    split = _range_split(df.withColumns({f"_v_{k}": v for k, v in totals.items()}), order)
    sums = split.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    # One row per partition of the range split: a short list, whatever the table holds.
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "_part",
        *[(F.sum(f"_s_{k}").over(parts) - F.col(f"_s_{k}")).alias(f"_o_{k}") for k in totals],
        *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_total") for k in totals],
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = split.join(offsets, "_part")
    out = out.withColumns({k: F.sum(f"_v_{k}").over(within) + F.col(f"_o_{k}") for k in totals})
    return out.drop("_part", *[f"_v_{k}" for k in totals], *[f"_o_{k}" for k in totals])


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column],
    rank: str = "rank", size: str = "group_size",
) -> DataFrame:
    """Adds the 0-based `rank` of each row in its group and the group's `size`.

    Groups of any size are ranked by many tasks, so a slide may hold a third of the rows.
    """
    full = [F.col(k) for k in keys] + list(order)
    ranked = running_totals(df, full, {"_pos": F.lit(1).cast("bigint")})
    if not keys:
        return ranked.withColumn(rank, F.col("_pos") - 1).withColumn(size, F.col("_pos_total")).drop(
            "_pos", "_pos_total")
    starts = ranked.groupBy(*keys).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias(size))
    return (join_on(ranked, starts, keys).withColumn(rank, F.col("_pos") - F.col("_start"))
            .drop("_pos", "_pos_total", "_start"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every group by `order`.

    Up to GROUP_LIMIT, Spark keeps n rows per group and map partition before it shuffles. Larger n
    would shuffle whole groups, so groups are first cut to n in hash slices and then as a whole.
    """
    def cut(frame: DataFrame, by: list[Column | str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return frame.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")

    if n > GROUP_LIMIT:
        slices = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(256))
        df = cut(df.withColumn("_slice", slices), [*keys, "_slice"]).drop("_slice")
    return cut(df, list(keys))


def seeded_order(seed: int | str, *keys: str) -> Column:
    """A repeatable shuffle order: the MD5 of seed and key text, the same in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def percentile_batch(
    df: DataFrame, sets: Sequence[Sequence[str]], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Linearly interpolated percentiles of several columns over several groupings, exact, from one pass over `df`.

    `wanted` gives each output its column and probability. One row for each grouping set and group: `_set`, the
    number of the set in `sets`, the keys (null where the set does not group by one) and the outputs, null for a column
    without values in the group; a group without any value gives no row. Null keys are groups too.

    Equal values are counted first, by the finest keys; coarser sets add up counts, not rows. The counts go into
    logarithmic buckets, the short bucket list says which bucket holds each wanted rank, and only the values of those
    buckets are ordered. No group is held in one task.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    measures = list(dict.fromkeys(v for v, _ in wanted.values()))
    number = lambda v: F.col(v).cast("double") + F.lit(0.0)
    if len(measures) == 1:
        long = df.select(*keys, F.lit(0).alias("_m"), number(measures[0]).alias("_v"))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("_m"), number(v).alias("_v")) for i, v in enumerate(measures)])
        long = df.select(*keys, F.inline(each))
    counts = long.filter(F.col("_v").isNotNull()).groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    if len(sets) == 1:
        counts = counts.withColumn("_set", F.lit(0))
    else:
        kinds = dict(df.select(*keys).dtypes)
        each = F.array(*[F.struct(F.lit(i).alias("_set"), *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(f"_k_{k}") for k in keys])
                         for i, s in enumerate(sets)])
        counts = (counts.select("_m", "_v", "_n", F.inline(each)).withColumnsRenamed({f"_k_{k}": k for k in keys})
                  .groupBy("_set", *keys, "_m", "_v").agg(F.sum("_n").alias("_n")))
    log = F.floor(F.log(F.abs(F.col("_v"))) * BUCKETS_PER_E) + F.lit(4_000_000)
    bucket = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * log).cast("bigint")
    counts = counts.withColumn("_b", bucket)

    group = ["_set", *keys, "_m"]
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = counts.groupBy(*group, "_b").agg(F.sum("_n").alias("_nb"))
    hist = hist.withColumns({"_cum": F.sum("_nb").over(upto), "_total": F.sum("_nb").over(Window.partitionBy(*group))})
    each = F.array(*[
        F.struct(F.lit(measures.index(v)).alias("m"), F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
        for name, (v, p) in wanted.items()])
    targets = hist.select(*group, "_b", (F.col("_cum") - F.col("_nb")).alias("_before"), "_cum", F.explode(each).alias("_w"))
    targets = targets.filter(F.col("_w.m") == F.col("_m")).select(
        *group, "_b", "_before", "_cum", F.col("_w.name").alias("_name"),
        (F.col("_w.pos") - F.floor("_w.pos")).alias("_frac"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("hi"), F.floor("_w.pos").alias("rank")),
            F.struct(F.lit(1).alias("hi"), F.ceil("_w.pos").alias("rank")))).alias("_r"))
    targets = targets.filter((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_cum")))

    # Ranks inside the wanted buckets. Two targets in one bucket share its rows through the array.
    targets = targets.groupBy(*group, "_b", "_before").agg(
        F.collect_list(F.struct("_name", "_frac", "_r")).alias("_targets"))
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = join_on(counts, targets, [*group, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    hit = hit.select("_set", *keys, "_v", "_n", "_upto", F.explode("_targets").alias("_t"))
    hit = hit.filter((F.col("_upto") > F.col("_t._r.rank"))
                     & (F.col("_upto") - F.col("_n") <= F.col("_t._r.rank")))
    aggs = []
    for name in wanted:
        end = [F.max(F.when((F.col("_t._name") == name) & (F.col("_t._r.hi") == i), F.col("_v"))) for i in (0, 1)]
        frac = F.max(F.when(F.col("_t._name") == name, F.col("_t._frac")))
        aggs.append((end[0] + (end[1] - end[0]) * frac).alias(name))
    return hit.groupBy("_set", *keys).agg(*aggs)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: Mapping[str, float]
) -> DataFrame:
    """Percentiles of one value per group; see `percentile_batch`. Groups whose values are all null give no row."""
    own = df.select(*keys, (F.col(value) if isinstance(value, str) else value).alias("_value"))
    return percentile_batch(own, [list(keys)], {name: ("_value", p) for name, p in probs.items()}).drop("_set")
