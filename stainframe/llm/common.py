"""What several operators of this folder share: the shared folder, labelled samples, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as a character class body: the space and 0x09 to 0x0D.
BLANK = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="stainframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back.

    What follows may then use it several times, and a lost executor costs a re-read. Like checkpoint
    files, the tables stay until the owner of the folder clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(key: str) -> Column:
    """A key on its way through pandas, where whole numbers beside nulls would become floats; cast it back behind."""
    return F.col(key).cast("string")


def words(text: Column) -> Column:
    """Maximal runs of characters that are not blank; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")


def quantized(rows: DataFrame, keep: list[Column], embedding: str, factor: int) -> DataFrame:
    """`keep` and `v`, each component as floor(factor * x); rows with a null vector or a component that is null or not finite go.

    A value beyond the range of long is the nearest long.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (rows.select(*keep, F.col(embedding).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False))))
            .withColumn("v", F.transform("v", lambda x: F.floor(x * factor))))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of the rows of `x`, as doubles."""
    return np.sqrt(np.square(x.astype(float)).sum(axis=-1))


def products(x: np.ndarray, length: np.ndarray, whole: np.ndarray, q: np.ndarray, q_whole: np.ndarray) -> np.ndarray:
    """Inner products of the rows of whole numbers `whole` with `q_whole`, exact; `x`, `q` are the same as doubles, `length` the rows'.

    No partial sum is over the product of the lengths, so doubles are exact below 2**53; above it, Python's whole
    numbers count. A product beyond the range of long is the nearest long.
    """
    large = length * float(lengths(q)) >= 2.0**52
    if not large.any():
        return (x @ q).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    out[~large] = (x[~large] @ q).astype(np.int64)
    own = [int(b) for b in q_whole]
    for i in np.flatnonzero(large).tolist():
        out[i] = min(max(sum(int(a) * b for a, b in zip(whole[i], own)), -2**63), 2**63 - 1)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves `remainder`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, bound: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, text, y) of at most `bound` labelled documents that are not held out, half of each class if there are as many.

    The sample takes the smallest hashes of the id, so it is the same at every run. Rows without an id, a label or
    a text do not count; a label given twice counts once. Of an id that stands over several texts the one that hashes
    lowest counts. `bound` ids are the most that is ever broadcast, and `bound` rows the most that is given.
    """
    y = F.col(target).cast("int")
    known = (labels.select(F.col(doc_id).alias("_id"), y.alias("y")).where("_id is not null and y in (0, 1)")
             .where(~held_out(F.col("_id"), modulus, remainder)).distinct())
    order = [F.xxhash64("_id"), F.col("_id")]
    half = bound // 2
    chosen = known.where("y = 1").orderBy(*order).limit(half).union(known.where("y = 0").orderBy(*order).limit(half))
    return (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
            .join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            .select("_id", "text", "y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it can reach.

    `edges` has long columns `u`, `v`. Alternates large-star and small-star until the edges stand still: every
    neighbour of a node is tied to the least of them. Minima are partial aggregates and a hub's edges meet its
    minimum in a join whose large side Spark may split, so no neighbourhood is gathered in one task.
    Only a count and a sum of hashes of the edges reach the driver.
    """
    def mark(e):
        return e.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 2**40).cast("decimal(38,0)"))).first()

    def tied(e):
        """Every edge (u, v) beside the least m of u and its neighbours."""
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least.select("u", F.least("u", "m").alias("m")), "u")

    edge = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    seen = mark(edge)
    while seen[0]:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tied(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = tied(large)
        edge = written(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(edge)
        if now == seen:
            break
        seen = now
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
