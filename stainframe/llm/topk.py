"""Exact top-k by inner product: best-first search in M-trees, one tree for each block of candidates."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stainframe.llm.common import lengths, products, quantized, written

#: Entries of a page: enough that measuring a page outweighs opening it.
PAGE = 512
#: Slack, relative to the largest distance, that makes bounds from rounded square roots safe.
SLACK = 1e-9
#: The same where squares are rounded: the root of what two of them leave has half of a double's digits.
ROUGH = 1e-6


@dataclass
class Node:
    """A page: a routing object with its covering radius, and either child nodes or vectors with parent distances."""

    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)
    rows: np.ndarray | None = None  # of the tree's vectors
    vectors: np.ndarray | None = None  # theirs, side by side, as doubles
    to_parent: np.ndarray | None = None  # of each entry: its distance to `centre`
    whole: np.ndarray | None = None  # the vectors as whole numbers, where doubles may not be exact
    sizes: np.ndarray | None = None  # and their lengths


def dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(a - b).sum(axis=-1))


def build(x: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, whole: np.ndarray | None = None) -> Node:
    """An M-tree over the points `x`: rows go to the nearest of a few routing objects, chosen far apart, and so on below.

    Rows that cannot be told apart are cut by count, so that a crowd of equal vectors is pages too. `whole` holds the
    vectors as whole numbers where products of doubles may not be exact.
    """
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    centre = own[np.argmin(dist(own, own.mean(axis=0)))]
    d = dist(own, centre)
    if len(rows) <= PAGE:
        exact = {} if whole is None else {"whole": whole[rows], "sizes": lengths(vectors[rows])}
        return Node(centre, float(d.max()), rows=rows, vectors=np.ascontiguousarray(vectors[rows]), to_parent=d, **exact)
    want = min(PAGE, -(-len(rows) // (PAGE // 2)))
    routes, near = [int(np.argmax(d))], np.full(len(rows), np.inf)
    owner = np.zeros(len(rows), np.int64)
    while True:
        now = dist(own, own[routes[-1]])
        closer = now < near
        owner[closer], near[closer] = len(routes) - 1, now[closer]
        if len(routes) == want or near.max() == 0:
            break
        routes.append(int(np.argmax(near)))
    parts = [rows[owner == k] for k in range(len(routes))]
    if len(routes) == 1:
        parts = np.array_split(rows, want)
    children = [build(x, vectors, p, whole) for p in parts if len(p)]
    return Node(centre, float(d.max()), children, to_parent=np.array([dist(c.centre, centre) for c in children]))


def search(tree: Node, ids: np.ndarray, q: np.ndarray, k: int, skip: int, scale: float, q_whole: np.ndarray | None = None,
           known: int | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of one query: highest score, ties to the smaller id; none under `known`, a score that k rows elsewhere have.

    The distance from point `q` falls as the score rises; the score of a row is the exact product of its vector with q's.
    Pages are taken in order of their least possible distance; an entry is measured only if its stored parent distance does not
    already rule it out, and a page is opened only if it can still hold one of the k best.
    """
    best: list[tuple[int, int]] = []  # a heap, worst first: (score, -id)
    v = q[:-1]
    slack = (SLACK if scale * scale < 2.0**53 else ROUGH) * scale

    def distance(score: int) -> float:
        """The distance that goes with a score; a score at the end of long may be any below."""
        return np.inf if score == -2**63 else float(np.sqrt(max(0.0, scale * scale + float(q @ q) - 2 * score)))

    worst = np.inf if known is None else distance(known)  # distance of the k-th best
    queue, n = [(0.0, 0, tree, float(dist(tree.centre, q)))], 0
    while queue:
        least, _, node, d = heapq.heappop(queue)
        if least > worst + slack:
            break
        # Triangle inequality with the stored distance: |d(q, page) - d(entry, page)| is at most d(q, entry).
        apart = np.abs(d - node.to_parent)
        if node.rows is None:
            radii = np.array([c.radius for c in node.children])
            may = np.flatnonzero(apart - radii <= worst + slack)
            if len(may):
                near = dist(np.stack([node.children[i].centre for i in may]), q)
                for i, e in zip(may.tolist(), near.tolist()):
                    child = node.children[i]
                    if (bound := max(0.0, e - child.radius)) <= worst + slack:
                        n += 1
                        heapq.heappush(queue, (bound, n, child, e))
            continue
        may = apart <= worst + slack
        if not may.any():
            continue
        rows, vectors = (node.rows, node.vectors) if may.all() else (node.rows[may], node.vectors[may])
        if node.whole is None:
            values = (vectors @ v).astype(np.int64)
        else:
            values = products(vectors, node.sizes if may.all() else node.sizes[may], node.whole if may.all() else node.whole[may], v, q_whole)
        floor = best[0][0] if len(best) == k and (known is None or best[0][0] > known) else known
        if floor is not None:
            rows, values = rows[values >= floor], values[values >= floor]
        for r, s in zip(rows.tolist(), values.tolist()):
            if ids[r] == skip:
                continue
            item = (s, -int(ids[r]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            worst = min(worst, distance(best[0][0]))
    return [(s, -i) for s, i in sorted(best, key=lambda t: (-t[0], -t[1]))]


def top_k(rows: DataFrame, k: int = 20, every: int = 20, factor: int = 64, vec_id: str = "vec_id", embedding: str = "embedding",
          block: int = 4096, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the other rows, all if fewer.

    Queries are the rows whose id is divisible by `every`; candidates all rows but those with the query's own id.
    Scores are whole numbers and exact at any size; a component or a score beyond the range of long is the nearest long. An inner
    product is turned into a metric by one more coordinate: with (v, sqrt(M - |v|^2)) for candidates and (q, 0) for queries the
    squared distance is M + |q|^2 - 2 q.v. Distances are doubles; from 2**53 on their bounds get more slack.

    Candidates are dealt by hash into blocks of about `block` rows, each one M-tree, built once in one task and stored. A query
    first searches the tree of its own block; with the k-th score found there, it visits the other trees, in blocks of
    about `query_block` queries. The k best of each tree meet in a window by query. Rows repeated with one
    id are candidates each. Vectors of other lengths meet as if the shorter ended in zeros. Null ids, null or empty vectors and null or
    non-finite components take no part; ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
    """
    kind = dict(rows.dtypes)[vec_id]
    own = quantized(rows, [F.col(vec_id).alias("vec_id")], embedding, factor).where("vec_id is not null and size(v) > 0")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    points = written(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size, most, width = points.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    if not size:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    blocks, scale, exact = max(1, -(-size // block)), float(np.sqrt(most)), most < 2.0**52
    points = points.withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int"))
    asked = points.where(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-asked.count() // query_block))

    def matrix(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def planted(own: pd.DataFrame) -> pd.DataFrame:
        whole = matrix(own["v"])
        x = np.c_[whole.astype(float), np.zeros(len(whole))]
        x[:, -1] = np.sqrt(np.maximum(0.0, most - np.square(x).sum(axis=1)))
        tree = build(x, x[:, :-1], whole=None if exact else whole)
        return pd.DataFrame({"c": own["c"].iloc[:1], "tree": [pickle.dumps((tree, own["vec_id"].to_numpy()))]})

    trees = written(points.groupBy("c").applyInPandas(planted, "c int, tree binary"), "trees")

    def searched(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            tree, ids = pickle.loads(held["tree"].iloc[0])
            whole = matrix(queries["v"])
            x = np.c_[whole.astype(float), np.zeros(len(whole))]
            for i, q in enumerate(queries.itertuples(index=False)):
                least = None if pd.isna(q.least) else int(q.least)
                out += [(q.row, q.vec_id, j, s) for s, j in search(tree, ids, x[i], k, q.vec_id, scale, whole[i], least)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    # The k-th score goes as text, for a missing one would turn the others into floats.
    shape, none = f"row bigint, query_id {kind}, vec_id {kind}, score bigint", F.lit(None).cast("string").alias("least")
    first = written(trees.groupBy("c").cogroup(asked.select("row", "vec_id", "v", "c", none).groupBy("c")).applyInPandas(searched, shape), "found")
    floor = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).cast("string").alias("least"))
    others = asked.join(floor, "row", "left").withColumn("q", F.pmod(F.xxhash64("row"), query_blocks).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("b != c").select("row", "vec_id", "v", "q", F.col("b").alias("c"), "least")
    there = trees.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    rest = there.groupBy("c", "q").cogroup(others.groupBy("c", "q")).applyInPandas(searched, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: DuckDB twin over `embeddings`.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
