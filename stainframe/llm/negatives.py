"""Hard negatives: candidates of another label that score nearly as high as an anchor's positives.

Anchors are clustered by angle. For a cluster, candidates are sorted once by the most that any of its members can score with
them: a member lies within some angle of the centre, so its angle with a candidate is at least the candidate's angle to the
centre less that. Every member walks this one list until the bound certifies that nothing further can matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainframe.llm.common import lengths, products, quantized, written

#: Anchors of the sample on which centres are fitted, anchors wanted for each centre, and most centres.
SAMPLE, SHARE, CENTRES = 2048, 32, 64
#: Slack of the bounds, relative to the largest product of lengths: arc cosines near 1 lose half of a double's digits.
SLACK = 1e-7
#: First step of a walk along a list; steps double.
STEP = 256


def unit(x: np.ndarray) -> np.ndarray:
    size = lengths(x)[..., None]
    return np.divide(x, size, out=np.zeros(x.shape), where=size > 0)


def centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """`n` centres of unit vectors by angle: the first far apart, then means of their nearest."""
    own = unit(sample)
    picked, near = [0], own @ own[0]
    while len(picked) < n and near.min() < 1 - 1e-9:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, own @ own[picked[-1]])
    centre = own[picked]
    for _ in range(rounds):
        nearest = np.argmax(own @ centre.T, axis=1)
        centre = np.stack([m if np.linalg.norm(m := own[nearest == k].sum(axis=0)) > 0 else centre[k] for k in range(len(centre))])
        centre = unit(centre)
    return centre


class Shared:
    """The candidates of a block in the order of one cluster: falling bound on the score with a member of length 1."""

    def __init__(self, centre, members, ids, labels, whole, x, size):
        cosine = np.clip(unit(x) @ centre, -1, 1)
        widest = float(np.arccos(np.clip((unit(members) @ centre).min(), -1, 1)))
        bound = size * np.cos(np.maximum(0.0, np.arccos(cosine) - widest))
        order = np.argsort(-bound, kind="stable")
        self.bound, self.ids, self.labels, self.whole, self.x, self.size = (a[order] for a in (bound, ids, labels, whole, x, size))

    def walk(self, q: np.ndarray, q_whole: np.ndarray, least: float):
        """(rows, scores) of the list piece by piece; `send` raises the score below which nothing matters."""
        at, step, n = 0, STEP, len(self.ids)
        length = float(lengths(q))
        slack = SLACK * length * (float(self.size.max()) if n else 0.0)
        while at < n and self.bound[at] * length + slack >= least:
            rows = slice(at, at + step)
            raised = yield rows, products(self.x[rows], self.size[rows], self.whole[rows], q, q_whole)
            least = least if raised is None else raised
            at, step = at + step, step * 2


class Best:
    """The first k by falling score, then rising id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, np.negative(score.astype(object)) if len(score) and score.min() == -2**63 else -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def worst(self) -> float:
        """The k-th score, or the least there is while there are fewer."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def first_positives(shared: Shared, anchor: int, label, q, q_whole, k: int) -> Best:
    """The first k other rows of the anchor's label in a list."""
    best, walk = Best(k), shared.walk(q, q_whole, -np.inf)
    piece = next(walk, None)
    while piece is not None:
        rows, score = piece
        ok = (shared.labels[rows] == label) & (shared.ids[rows] != anchor) & (score >= best.worst())
        best.add(score[ok], shared.ids[rows][ok])
        try:
            piece = walk.send(best.worst())
        except StopIteration:
            piece = None
    return best


def first_negatives(shared: Shared, anchor: int, label, q, q_whole, positives: list[int], k: int, low: int) -> list[Best]:
    """For each positive score p: the first k rows of other labels with a score between `low` percent of p and p, in a list."""
    best = [Best(k) for _ in positives]
    open_ = [i for i, p in enumerate(positives) if p >= 0]  # under 0 no score is between
    if not open_:
        return best

    def least() -> float:
        return min(max(low * positives[i] / 100, best[i].worst()) for i in open_)

    top, floor = max(positives[i] for i in open_), -(-low * min(positives[i] for i in open_) // 100)
    walk = shared.walk(q, q_whole, least())
    piece = next(walk, None)
    while piece is not None:
        rows, score = piece
        ok = np.flatnonzero((score <= top) & (score >= floor) & (shared.labels[rows] != label) & (shared.ids[rows] != anchor))
        score, ids = score[ok], shared.ids[rows][ok]
        for i in open_ if len(ok) else ():
            p = positives[i]
            fit = (score <= p) & (score >= -(-low * p // 100))
            best[i].add(score[fit], ids[fit])
        try:
            piece = walk.send(least())
        except StopIteration:
            piece = None
    return best


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, every: int = 100, factor: int = 256,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = 16384, group: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to `negatives` rows for each anchor and positive.

    Components are floor(factor * x), a score is their whole inner product with the anchor. Anchors are the rows whose id is divisible
    by `every`; an anchor's positives are its first `positives` rows of the same label and other ids, by falling score, then
    smaller id; a positive's negatives the first rows of other labels (and ids) whose score is from `low` percent of its score up to
    its score. Under a positive score below zero there are none.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Rows that repeat an
    id are rows each, and anchors each. Vectors of other lengths meet as if the shorter ended in zeros; a component or
    score beyond the range of long is the nearest long; an empty table gives no rows; other columns are not looked at.

    Centres are fitted on at most `SAMPLE` anchors; any centres give the same rows. Candidates are dealt by hash into blocks of about
    `block`, anchors by cluster into groups of about `group`, a large cluster into several; each block meets each group once to find
    positives and once to find negatives, and gives at most so many rows an anchor as are asked for.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    own = quantized(rows, [F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label")], embedding, factor)
    points = written(own.where("vec_id is not null and label is not null and size(v) > 0").withColumn("row", F.monotonically_increasing_id()), "points")
    size, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    shape = f"anchor_id {kinds[vec_id]}, positive_id {kinds[vec_id]}, rank int, negative_id {kinds[vec_id]}, positive_score bigint, negative_score bigint"
    asked = points.where(F.col("vec_id") % every == 0)
    n = asked.count()
    if not n:
        return spark.createDataFrame([], shape)
    blocks = max(1, -(-size // block))

    def matrix(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    sample = asked.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toPandas()["v"]
    centre = centres(matrix(sample).astype(float), min(CENTRES, max(1, n // SHARE)))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(unit(matrix(v).astype(float)) @ centre.T, axis=1).astype(np.int32))

    anchors = written(asked.withColumn("cluster", nearest("v")), "anchors")
    # Clusters follow one another through the groups; one of more than a group's anchors is dealt by hash over several.
    sizes, at, dealt = {r["cluster"]: r["n"] for r in anchors.groupBy("cluster").agg(F.count("*").alias("n")).collect()}, 0, {}
    for cluster, m in sorted(sizes.items()):
        dealt[cluster] = (at // group, max(1, -(-m // group)))
        at += m
    groups = max(first + parts for first, parts in dealt.values())
    place = F.create_map(*[F.lit(x) for c, (first, parts) in dealt.items() for x in (c, f"{first} {parts}")])
    spot = F.split(place[F.col("cluster")], " ")
    anchors = anchors.withColumn("g", (spot[0].cast("int") + F.pmod(F.xxhash64("row"), spot[1].cast("int"))).cast("int"))

    candidates = points.select("vec_id", "label", "v", F.pmod(F.xxhash64("row", "vec_id"), F.lit(blocks)).cast("int").alias("c")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")

    def lists(there: pd.DataFrame, members: pd.DataFrame):
        """(member's row, its vector twice, list of its cluster) for each member."""
        whole = matrix(there["v"])
        x = whole.astype(float)
        held = there["vec_id"].to_numpy(), there["label"].to_numpy(), whole, x, lengths(x)
        for cluster, own in members.groupby("cluster", sort=True):
            q_whole = matrix(own["v"])
            q = q_whole.astype(float)
            shared = Shared(centre[cluster], q, *held)
            for i, row in enumerate(own.itertuples(index=False)):
                yield row, q[i], q_whole[i], shared

    def positives_of(there: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(there) and len(members):
            for row, q, q_whole, shared in lists(there, members):
                best = first_positives(shared, row.vec_id, row.label, q, q_whole, positives)
                out += [(row.row, i, s) for i, s in zip(best.id.tolist(), best.score.tolist())]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_score"])

    def negatives_of(there: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(there) and len(members):
            for row, q, q_whole, shared in lists(there, members):
                for j, best in enumerate(first_negatives(shared, row.vec_id, row.label, q, q_whole, [int(p) for p in row.scores], negatives, low)):
                    out += [(row.row, j, i, s) for i, s in zip(best.id.tolist(), best.score.tolist())]
        return pd.DataFrame(out, columns=["row", "nth", "negative_id", "negative_score"])

    there = candidates.groupBy("c", "g")
    found = there.cogroup(anchors.select("row", "vec_id", "label", "v", "cluster", "g", everywhere).groupBy("c", "g")).applyInPandas(
        positives_of, "row bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    first = (found.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < positives)
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("first")))
    known = written(anchors.join(first, "row"), "positives")
    asking = known.select("row", "vec_id", "label", "v", "cluster", "g", F.col("first.positive_score").alias("scores"), everywhere)
    hard = there.cogroup(asking.groupBy("c", "g")).applyInPandas(negatives_of, "row bigint, nth int, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = known.select("row", F.col("vec_id").alias("anchor_id"), F.inline("first"))
    return pairs.join(hard, ["row", "nth"]).select(
        F.col("anchor_id").cast(kinds[vec_id]), F.col("positive_id").cast(kinds[vec_id]), "rank", F.col("negative_id").cast(kinds[vec_id]),
        "positive_score", "negative_score")


#: DuckDB twin over `embeddings`, for the query's parameters.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
                   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
