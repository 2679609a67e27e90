"""Overlap of two or more segmentations: IoU, matches, detection metrics, consensus."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainframe.functions import grading as G
from stainframe.functions.lineage import by_merge, cut_lineage
from stainframe.functions.ordering import exact_percentiles
from stainframe.operators.pixels import TILE
from stainframe.operators.rasters import expand_nuclei


def contingency(pixels: DataFrame, pred: str, gt: str) -> DataFrame:
    """Pixels per (tile, predicted id, true id), zeros included: the only pass over pixels."""
    return pixels.groupBy(*TILE, F.col(pred).alias("p"), F.col(gt).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def instance_iou(pixels: DataFrame, pred: str, gt: str) -> DataFrame:
    """IoU of every overlapping pair. Areas are sums over the short contingency list of a tile."""
    c = contingency(pixels, pred, gt).withColumns({
        "area_p": F.sum("n").over(Window.partitionBy(*TILE, "p")),
        "area_g": F.sum("n").over(Window.partitionBy(*TILE, "g"))})
    return c.filter((F.col("p") > 0) & (F.col("g") > 0)).withColumn(
        "iou", F.col("n") / (F.col("area_p") + F.col("area_g") - F.col("n"))).withColumnRenamed("n", "inter")


def match_instances(pairs: DataFrame, threshold: float = 0.5, keys: Sequence[str] = TILE) -> DataFrame:
    """One-to-one matches with IoU of at least `threshold`; `pairs` has `p`, `g`, `iou`.

    From one half up, instances of one raster cannot share a partner except at exactly one half, so a
    filter and two tie-breaks do. Below, predictions choose in order of their best IoU; that order
    is sequential inside a tile, so each tile's few pairs are walked in Python.
    """
    keys = list(keys)
    enough = pairs.filter(F.col("iou") >= threshold)
    if threshold >= 0.5:
        by_g = Window.partitionBy(*keys, "g").orderBy(F.desc("iou"), "p")
        by_p = Window.partitionBy(*keys, "p").orderBy(F.desc("iou"), "g")
        once = enough.withColumn("_r", F.row_number().over(by_g)).filter(F.col("_r") == 1)
        return once.withColumn("_r", F.row_number().over(by_p)).filter(F.col("_r") == 1).drop("_r")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.groupby("p")["iou"].transform("max")
        ordered = pdf.assign(_b=best).sort_values(["_b", "p", "iou", "g"], ascending=[False, True, False, True])
        taken_g, taken_p, keep = set(), set(), []
        for row in ordered.itertuples():
            if row.p not in taken_p and row.g not in taken_g:
                taken_p.add(row.p)
                taken_g.add(row.g)
                keep.append(row.Index)
        return pdf.loc[keep]

    return enough.groupBy(*keys).applyInPandas(choose, enough.schema)


def match_counts(pixels: DataFrame, pred: str, gt: str, thresholds: Sequence[float] = (0.5, 0.75)) -> DataFrame:
    """True and false positives and false negatives per tile and threshold."""
    pairs = instance_iou(pixels, pred, gt)
    ids = pixels.groupBy(*TILE).agg(
        F.count_distinct(F.when(F.col(pred) > 0, F.col(pred))).alias("n_pred"),
        F.count_distinct(F.when(F.col(gt) > 0, F.col(gt))).alias("n_gt"))
    tps = None
    for t in thresholds:
        one = match_instances(pairs, t).groupBy(*TILE).agg(F.count(F.lit(1)).alias("tp")).withColumn("threshold", F.lit(float(t)))
        tps = one if tps is None else tps.unionByName(one)
    grid = ids.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = grid.join(by_merge(tps), [*TILE, "threshold"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})


def detection_metrics(counts: DataFrame, keys: Sequence[str] = ("threshold",)) -> DataFrame:
    """Micro precision, recall, F1 and AP (precision times recall) from summed counts."""
    s = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = G.share(F.col("tp"), F.col("tp") + F.col("fp")), G.share(F.col("tp"), F.col("tp") + F.col("fn"))
    s = s.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    return s.withColumns({"f1": G.share(2 * p * r, p + r), "ap": p * r})


def dice_matched(pixels: DataFrame, pred: str, gt: str) -> DataFrame:
    """Mean Dice of matched pairs per tile, zero without a match."""
    m = match_instances(instance_iou(pixels, pred, gt), 0.5)
    d = m.groupBy(*TILE).agg(F.avg(2 * F.col("inter") / (F.col("area_p") + F.col("area_g"))).alias("dice"))
    return pixels.select(*TILE).distinct().join(by_merge(d), list(TILE), "left").fillna(0.0, ["dice"])


def macro_average(per_tile: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return per_tile.groupBy(*keys).agg(F.count(F.lit(1)).alias("tiles"), *[F.avg(m).alias(m) for m in metrics])


def iou_vs_expansion(pixels: DataFrame, radius: int = 10, limit: float = 0.8) -> DataFrame:
    """Each cell against its own nucleus grown by a disc: mean and median IoU, percent below the limit."""
    same = instance_iou(expand_nuclei(pixels.select(*TILE, "x", "y", "nuc_id", "cell_id"), radius), "cell_id", "expanded").filter(F.col("p") == F.col("g"))
    sums = same.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("iou").alias("mean_iou"),
        (F.lit(100.0) * F.avg((F.col("iou") < limit).cast("int"))).alias("pct_differ"))
    return sums.join(exact_percentiles(same, ["slide_id"], "iou", {"median_iou": 0.5}), "slide_id")


def cells_per_model(labels: DataFrame) -> DataFrame:
    """Highest id per tile, summed over tiles. `labels`: tile, `x, y, model, inst_id`."""
    tops = labels.groupBy(*TILE, "model").agg(F.max("inst_id").alias("n"))
    return tops.groupBy("model").agg(F.sum("n").alias("n_cells"), F.count_if(F.col("n") > 0).alias("n_tiles"))


def consensus_pixels(labels: DataFrame, models: Sequence[str], min_agreement: int = 2) -> DataFrame:
    """Pixels that enough models call cell, with the id of the model that found most in the tile.

    Background of a model neither agrees nor gives an id, so its rows go before anything is joined or grouped.
    """
    place = F.create_map(*[v for i, m in enumerate(models) for v in (F.lit(m), F.lit(i))])[F.col("model")]
    on = labels.filter(F.col("inst_id") > 0)
    tops = on.groupBy(*TILE, "model").agg(F.max("inst_id").alias("_top"))
    best = tops.groupBy(*TILE).agg(
        F.max_by("model", F.struct(F.col("_top"), -place)).alias("_best"), F.count(F.lit(1)).alias("_models"))
    # The list of a tile's best model is short beside its pixels: a hash of it, and pixels are not sorted for it.
    px = on.join(best.filter(F.col("_models") >= min_agreement).hint("shuffle_hash"), list(TILE))
    own = F.max(F.when(F.col("model") == F.col("_best"), F.col("inst_id")))
    out = px.groupBy(*TILE, "x", "y").agg(own.alias("consensus_id"), F.count(F.lit(1)).alias("_agree"))
    return out.filter((F.col("_agree") >= min_agreement) & F.col("consensus_id").isNotNull()).drop("_agree")


def pixel_stacks(labels: DataFrame) -> DataFrame:
    """The sorted list of (model, instance) at every pixel that some model calls cell; a few entries each."""
    on = labels.filter(F.col("inst_id") > 0)
    return on.groupBy(*TILE, "x", "y").agg(F.sort_array(F.collect_list(F.struct("model", "inst_id"))).alias("m"))


def model_pairs(stacks: DataFrame) -> DataFrame:
    """IoU of overlapping instances of every two models. `stacks`: tile, `m`, and `n` pixels that have it."""
    areas = stacks.select(*TILE, "n", F.explode("m").alias("i")).groupBy(*TILE, "i").agg(F.sum("n").alias("area"))
    two = F.flatten(F.transform("m", lambda a: F.transform(
        F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = stacks.select(*TILE, "n", F.explode(two).alias("t")).groupBy(
        *TILE, F.col("t.a").alias("a"), F.col("t.b").alias("b")).agg(F.sum("n").alias("n"))
    pairs = pairs.join(by_merge(areas.withColumnsRenamed({"i": "a", "area": "_a"})), [*TILE, "a"])
    pairs = pairs.join(by_merge(areas.withColumnsRenamed({"i": "b", "area": "_b"})), [*TILE, "b"])
    return pairs.select(
        *TILE, F.col("a.model").alias("ma"), F.col("a.inst_id").alias("p"), F.col("b.model").alias("mb"),
        F.col("b.inst_id").alias("g"), (F.col("n") / (F.col("_a") + F.col("_b") - F.col("n"))).alias("iou"))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node of each node's component as `component`; `nodes`: keys, `node`; `edges`: keys, `a`, `b`.

    Each round a node takes the least label among its neighbours and the label its own label points
    to, so chains shorten by more than one step. Labels only fall, so the rounds end; each ends in a checkpoint.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = cut_lineage(both)
    state = cut_lineage(nodes.select(*keys, "node", F.col("node").alias("component")))
    while True:
        labels = state.select(*keys, F.col("node").alias("other"), F.col("component").alias("_c"))
        around = both.join(by_merge(labels), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("_c").alias("_n"))
        jump = labels.select(*keys, F.col("other").alias("component"), F.col("_c").alias("_j"))
        new = (state.join(by_merge(around), [*keys, "node"], "left").join(by_merge(jump), [*keys, "component"], "left")
               .select(*keys, "node", F.col("component").alias("_old"), F.least("component", "_n", "_j").alias("component")))
        new = cut_lineage(new)
        moved = not new.filter(F.col("component") != F.col("_old")).isEmpty()
        state = new.drop("_old")
        if not moved:
            return state


def consensus_instances(
    labels: DataFrame, threshold: float = 0.3, min_agreement: int = 2
) -> DataFrame:
    """Instances that enough models agree on, with the pixels at least half of their members hold.

    Instances of two models match one-to-one by IoU; matches join into components; a component of
    enough models becomes a consensus cell, numbered per tile by its smallest member. Where two
    cells claim a pixel the later number has it.
    """
    node = lambda m, i: F.struct(F.col(m).alias("model"), F.col(i).alias("inst_id"))
    px = pixel_stacks(labels)
    # Pixels with the same list vote alike, so everything but the last join works on distinct lists.
    stacks = cut_lineage(px.groupBy(*TILE, "m").agg(F.count(F.lit(1)).alias("n")))
    matches = match_instances(model_pairs(stacks), threshold, [*TILE, "ma", "mb"])
    edges = matches.select(*TILE, node("ma", "p").alias("a"), node("mb", "g").alias("b"))
    seats = stacks.select(*TILE, "m", F.explode("m").alias("node"))
    comp = connected_components(seats.select(*TILE, "node").distinct(), edges, TILE)
    agreed = comp.groupBy(*TILE, "component").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_distinct("node.model").alias("n_models")).filter(
        F.col("n_models") >= min_agreement)
    number = F.row_number().over(Window.partitionBy(*TILE).orderBy("component"))
    agreed = agreed.withColumn("consensus_id", number)
    members = comp.join(by_merge(agreed), [*TILE, "component"]).select(*TILE, "node", "consensus_id", "n_members")
    votes = seats.join(by_merge(members), [*TILE, "node"]).groupBy(*TILE, "m", "consensus_id").agg(
        F.count(F.lit(1)).alias("_v"), F.first("n_members").alias("_m"))
    owners = votes.filter(F.col("_v") >= F.col("_m") / 2).groupBy(*TILE, "m").agg(
        F.max("consensus_id").alias("consensus_id"))
    return px.join(by_merge(owners), [*TILE, "m"]).select(*TILE, "x", "y", "consensus_id")
