"""Scores from tile embeddings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainframe.functions import vectors as V
from stainframe.functions.ordering import exact_percentiles

STAINING_WEIGHTS = (0.0, 0.33, 0.67, 1.0)
TEMPERATURE = 0.07
SPLITS = ("Train", "Validation", "Test")


def l2_normalise(tiles: DataFrame, column: str = "embedding", out: str = "unit") -> DataFrame:
    return tiles.withColumn(out, V.l2_normalise(V.as_doubles(F.col(column))))


def soft_cluster_score(unit: Column, epithelial: Column, other: Column) -> Column:
    """1 at the epithelial centre, 0 at the other one."""
    far, near = V.distance(unit, other), V.distance(unit, epithelial)
    return far / (near + far + F.lit(1e-8))


def kmeans_epithelial(tiles: DataFrame, seed: int = 42, iterations: int = 300, min_tiles: int = 4) -> DataFrame:
    """Two clusters of unit embeddings; `epithelial` is the one with the higher mean DAB.

    Only positive, finite DAB counts; without any in one cluster the smaller cluster is taken. Fewer
    than `min_tiles` tiles are not clustered and score 0.5: that is the measure's definition, at any size. The clusters are fitted by Spark; two centres and two counts are all
    that reaches the driver.
    """
    unit = l2_normalise(tiles).withColumn("_f", array_to_vector("unit"))
    if unit.limit(min_tiles).count() < min_tiles:
        return tiles.withColumns({"epithelial": F.lit(None).cast("boolean"), "score": F.lit(0.5)})
    model = KMeans(k=2, seed=seed, maxIter=iterations, featuresCol="_f", predictionCol="_c", initSteps=5).fit(unit)
    marked = model.transform(unit)
    usable = (F.col("dab_mean") > 0) & ~F.isnan("dab_mean") & (F.col("dab_mean") < float("inf"))
    stats = {r["_c"]: r for r in marked.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(usable, F.col("dab_mean"))).alias("dab")).collect()}
    dab = [stats[i]["dab"] if i in stats else None for i in (0, 1)]
    size = [stats[i]["n"] if i in stats else 0 for i in (0, 1)]
    if dab[0] is not None and dab[1] is not None:
        chosen = 0 if dab[0] > dab[1] else 1
    else:
        chosen = 0 if size[0] < size[1] else 1
    centres = [V.literal(c) for c in model.clusterCenters()]
    score = soft_cluster_score(F.col("unit"), centres[chosen], centres[1 - chosen] if len(centres) > 1 else centres[chosen])
    return marked.withColumns({"epithelial": F.col("_c") == chosen, "score": score}).drop("_f", "_c", "unit")


def kmeans_epithelial_by_split(tiles: DataFrame, splits: Sequence[str] = SPLITS, **options) -> DataFrame:
    """`kmeans_epithelial` of each split's tiles by themselves (`split` column); tiles of other splits are left out.

    One clustering for each named split, three as a rule.
    """
    parts = [kmeans_epithelial(tiles.filter(F.col("split") == name), **options) for name in splits]
    return reduce(DataFrame.unionByName, parts)


def zero_shot_binary(tiles: DataFrame, positive: Sequence[float], negative: Sequence[float]) -> DataFrame:
    """Probability of the positive prompt: softmax of two cosine similarities."""
    unit = l2_normalise(tiles)
    sims = [V.dot(F.col("unit"), V.l2_normalise(V.literal(p))) for p in (positive, negative)]
    return unit.withColumn("p_positive", F.get(V.softmax(sims), F.lit(0))).drop("unit")


def zero_shot_staining(
    tiles: DataFrame, prompts: Sequence[Sequence[float]], weights: Sequence[float] = STAINING_WEIGHTS,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """Expected staining weight under a softmax over the absent, weak, moderate and strong prompts."""
    unit = l2_normalise(tiles)
    probs = V.softmax([V.dot(F.col("unit"), V.l2_normalise(V.literal(p))) for p in prompts], temperature)
    score = V.total(F.zip_with(probs, V.literal(weights), lambda p, w: p * w))
    return unit.withColumn("staining", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("unit")


def consensus_score(scores: DataFrame) -> DataFrame:
    """Mean of the scores a tile has. `scores`: `tile_id, model, score`."""
    return scores.groupBy("tile_id").agg(F.avg("score").alias("consensus_score"), F.count("score").alias("n_models"))


def model_score_summary(scores: DataFrame, known: Sequence[str]) -> DataFrame:
    """Mean, median and deviation per model; a known model without scores is marked skipped."""
    sums = scores.groupBy("model").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    sums = sums.join(exact_percentiles(scores, ["model"], "score", {"median": 0.5}), "model", "left")
    # The list of known models is a handful of names.
    names = scores.sparkSession.createDataFrame([(m,) for m in known], "model string")
    return names.join(sums, "model", "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "skipped": F.coalesce(F.col("n") == 0, F.lit(True))})


