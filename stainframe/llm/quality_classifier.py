"""Quality by pairwise ranking: a Bradley-Terry model on differences of text features, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stainframe.functions.ordering import exact_percentiles
from stainframe.llm.common import held_out, written

#: Byte classes: lower case, upper case, digit, space, line end, sign (#*$%&|<>), loud (!?), other mark, not ASCII.
CLASSES = 9
_TABLE = np.full(256, 7, np.uint8)
_TABLE[97:123], _TABLE[65:91], _TABLE[48:58], _TABLE[128:] = 0, 1, 2, 8
_TABLE[[32, 9, 11, 12, 13]], _TABLE[10] = 3, 4
_TABLE[list(b"#*$%&|<>")], _TABLE[list(b"!?")] = 5, 6
NAMES = ("letters", "upper", "digits", "blanks", "lines", "signs", "loud", "marks", "other", "upper_words", "same_word",
         "same_pair", "few_words", "few_pairs", "word_length", "length", "root_upper", "root_signs", "root_loud", "root_same", "empty")


#: Texts of a block, at least and at most.
SMALLEST, LARGEST = 256, 8192


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text, one number for each of `NAMES`; an empty text has only `empty`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    n = len(words)
    share = (np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=CLASSES) / len(raw)).tolist()
    upper = sum(map(str.isupper, words)) / n
    same = sum(map(str.__eq__, words, words[1:])) / n
    skip = sum(map(str.__eq__, words, words[2:])) / n
    # Distinct words fall with length even in good text, as a power of it.
    few = 1 - len(set(words)) / n
    pairs = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
    return [*share, upper, same, skip, few, pairs, len(raw) / n / 10, np.log1p(n) / 10,
            share[1] ** 0.5, share[5] ** 0.5, share[6] ** 0.5, same ** 0.5, 0.0]


def table(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def block_rows(n: int, rare: int) -> int:
    """Texts of a block whose good and bad ones are all compared: so many that some eight of the rarer class are among them."""
    return min(LARGEST, max(SMALLEST, -(-8 * n // max(rare, 1))))


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of log sigmoid(w . (good - bad)) over all pairs of a block, its curvature, and the number of pairs, in one vector."""
    good, bad = z[y == 1], z[y == 0]
    d = len(w)
    if not len(good) or not len(bad):
        return np.zeros(d + d * d + 1)
    q = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    h = q * (1 - q)
    cross = good.T @ h @ bad
    curve = (good.T * h.sum(axis=1)) @ good + (bad.T * h.sum(axis=0)) @ bad - cross - cross.T
    return np.concatenate([q.sum(axis=1) @ good - q.sum(axis=0) @ bad, curve.ravel(), [q.size]])


def climb(sums: Callable[[np.ndarray], np.ndarray], ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method on the mean over all pairs; `sums` adds up `pair_sums` of all blocks at given weights."""
    d = len(NAMES)
    w = np.zeros(d)
    for _ in range(steps):
        total = sums(w)
        pairs = max(total[-1], 1.0)
        grad = ridge * w - total[:d] / pairs
        move = np.linalg.solve(total[d:-1].reshape(d, d) / pairs + ridge * np.eye(d), grad)
        w = w - move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def model_of(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, cut: float) -> dict:
    return {"w": w / scale, "shift": float(-(mean / scale) @ w), "cut": cut}


def scaled(std: np.ndarray) -> np.ndarray:
    return np.where(std < 1e-9, 1.0, std)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights from preference pairs, each a good and a bad text: maximises log sigmoid(w . (good - bad)).

    Every text counts: the rows are taken in blocks as they come, and in a block every good text is compared with every
    bad one. The cut is the quantile of all scores that leaves the share of bad texts below, midway to the next score; a
    score is the sigmoid of the distance from it, placed so that the cut has 0.7. With one class only the score is that
    class, and with no text at all 0. `train` does the same on a table.
    """
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return {"constant": float(good > 0)}
    mean, scale = x.mean(axis=0), scaled(x.std(axis=0))
    z, size = (x - mean) / scale, block_rows(len(x), min(good, bad))
    w = climb(lambda w: sum(pair_sums(z[k:k + size], y[k:k + size], w) for k in range(0, len(z), size)))
    s = np.sort(z @ w)
    k = min(max(bad, 1), len(s) - 1)
    return model_of(w, mean, scale, float((s[k - 1] + s[k]) / 2))


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    far = x @ model["w"] + model["shift"] - model["cut"]
    return 1 / (1 + np.exp(np.clip(-far - np.log(0.7 / 0.3), -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, doc_id: str, text: str, target: str) -> DataFrame:
    """(_id, y, x) of every labelled document that is not held out: its features, so that no text moves.

    Rows without an id, a label or a text do not count; a label given twice counts once. Of an id that stands over several
    texts the one that hashes lowest counts. Ids are text.
    """
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "h": batch["h"], "x": list(table(batch["text"]))})

    y = F.col(target).cast("int")
    known = (labels.select(F.col(doc_id).cast("string").alias("_id"), y.alias("y")).where("_id is not null and y in (0, 1)")
             .where(~held_out(F.col("_id"), modulus, remainder)).distinct())
    texts = docs.select(F.col(doc_id).cast("string").alias("_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    texts = texts.where("_id is not null and text is not null").where(~held_out(F.col("_id"), modulus, remainder))
    return (texts.mapInPandas(measured, "_id string, h bigint, x array<double>").join(known, "_id")
            .groupBy("_id", "y").agg(F.min_by("x", "h").alias("x")))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2,
          doc_id: str = "doc_id", text: str = "text", target: str = "quality") -> dict:
    """The model of `fit` from all labelled texts that are not held out.

    Texts are dealt into blocks by hash of their id, written once; each step of the climb is a pass over the blocks, from
    which every task gives one vector. The cut is an exact percentile of all scores.
    """
    rows = written(labelled(docs, labels, modulus, remainder, doc_id, text, target), "features")
    each = range(len(NAMES))
    seen = rows.agg(F.count("*"), F.count_if(F.col("y") == 1), *[F.avg(F.get("x", F.lit(i))) for i in each],
                    *[F.stddev_pop(F.get("x", F.lit(i))) for i in each]).first()
    n, good = seen[0], seen[1]
    if not good or good == n:
        return {"constant": float(good > 0)}
    mean, scale = np.array(seen[2:2 + len(NAMES)]), scaled(np.array(seen[2 + len(NAMES):]))
    number = -(-n // block_rows(n, min(good, n - good)))
    blocks = written(rows.groupBy(F.pmod(F.xxhash64("_id"), F.lit(number)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("_id", "y", "x"))).alias("of")).select("of.y", "of.x"), "blocks")

    def read(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for y, x in zip(batch["y"], batch["x"]):
            yield (np.stack(x) - mean) / scale, np.asarray(y)

    def sums(w: np.ndarray) -> np.ndarray:
        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum((pair_sums(z, y, w) for batch in batches for z, y in read(batch)), np.zeros(len(w) + len(w) ** 2 + 1))
            yield pd.DataFrame({"v": [total]})

        return np.sum(np.stack(blocks.mapInPandas(added, "v array<double>").toPandas()["v"].tolist()), axis=0)

    w = climb(sums)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for z, _ in read(batch):
                yield pd.DataFrame({"s": z @ w})

    # Between the k-th score and the next.
    k = min(max(n - good, 1), n - 1)
    found = exact_percentiles(blocks.mapInPandas(scored, "s double").withColumn("all", F.lit(1)), ["all"], "s", {"cut": (k - 0.5) / (n - 1)})
    return model_of(w, mean, scale, float(found.first()["cut"]))


def with_score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the quality of each whole text, 0 to 1; 0.7 and more is above the cut.

    Null text is empty. Every row is scored from its text alone, repeated ones too; an empty table gives no rows;
    a column called `name` would be replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(shared.value, table(texts)), dtype="float64")

    return docs.withColumn(name, scored(F.col(text)))
