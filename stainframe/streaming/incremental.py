"""Picking up new slides as they land.

The resume rule of the batch jobs - a finished slide is not done again - is what a file stream's own
checkpoint keeps, so a cohort folder can be followed with the same measurement code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stainframe.functions import grading as G
from stainframe.operators.scoring import score_by
from stainframe.schema import CELLS, nan_to_null


def follow_cells(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Cell tables as a stream, one row batch per new files; `folder` is partitioned by `slide_id`."""
    schema = T.StructType([*CELLS.fields, T.StructField("slide_id", T.StringType())])
    return nan_to_null(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def append_slide_scores(
    cells: DataFrame, out: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Scores of each batch's slides, appended; a batch that is run again writes to the same place.

    A slide whose files come in several batches has a row in each, with the counts of that batch:
    `read_slide_scores` adds them up.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = (measure or (lambda df: score_by(df, ["slide_id"])))(batch)
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_slide_scores(spark: SparkSession, out: str) -> DataFrame:
    """Scores of each slide over all batches in `out`, from the counts by grade that the batches appended."""
    counts = ("n_cells", "negative", "weak_1plus", "moderate_2plus", "strong_3plus")
    sums = spark.read.parquet(out).groupBy("slide_id").agg(*[F.sum(c).alias(c) for c in counts])
    weak, moderate, strong, n = (F.col(c) for c in ("weak_1plus", "moderate_2plus", "strong_3plus", "n_cells"))
    share = lambda part: G.share(part, n) * 100
    least = {1: weak + moderate + strong, 2: moderate + strong, 3: strong}
    out_ = sums.withColumns({
        "h_score": share(weak + 2 * moderate + 3 * strong), "pct_positive": share(least[G.POSITIVE_GRADE]), "pct_3plus": share(least[3])})
    return out_.withColumn("eligible", G.eligible("pct_positive"))
