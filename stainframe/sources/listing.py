"""File listings as a source: directories are partitions, listed in tasks; no file is opened.

    spark.dataSource.register(Listing)
    spark.read.format("listing").option("extensions", ".svs,.tif").load("/slides/a,/slides/b")
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns of a listing: the whole path, the folder relative to the root, the file's name without and with its extension, its
#: size, and the place of its root among the roots given.
SCHEMA = "path string, folder string, stem string, name string, ext string, size bigint, priority int"
#: Partitions that the subdirectories of a root are dealt to, and files of one batch.
SHARES, BATCH = 256, 10_000


def _opened(path: str):
    """(file system, path on it) of a path or URI; local paths, and whatever stores pyarrow reaches."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


def _entries(path: str, recursive: bool) -> list:
    from pyarrow import fs

    system, own = _opened(path)
    return system.get_file_info(fs.FileSelector(own, allow_not_found=True, recursive=recursive))


@dataclass
class Share(InputPartition):
    """Some directories of one root; of those marked flat only their own files."""

    root: str
    priority: int
    folders: tuple[tuple[str, bool], ...]


class Listing(DataSource):
    """Options: `extensions`, comma separated with their dots and in any case (all files if empty), and `paths`, comma separated roots in order of
    priority, if they are not given to `load`. A root that is missing has no files."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.roots = [p.strip().rstrip("/") for p in (options.get("path") or options.get("paths") or "").split(",") if p.strip()]
        self.extensions = {e.strip().lower() for e in (options.get("extensions") or "").split(",") if e.strip()}

    def partitions(self) -> list[Share]:
        """A root's own files are one partition, its subdirectories others; only the top level of a root is listed here."""
        from pyarrow import fs

        out = []
        for priority, root in enumerate(self.roots):
            below = sorted(e.path for e in _entries(root, False) if e.type == fs.FileType.Directory)
            out.append(Share(root, priority, ((_opened(root)[1], True),)))
            own = -(-len(below) // SHARES) or 1
            out += [Share(root, priority, tuple((p, False) for p in below[k:k + own])) for k in range(0, len(below), own)]
        return out or [Share("", 0, ())]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
        files = self.files(partition)
        while batch := list(islice(files, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), schema, strict=True)], schema=schema)

    def files(self, partition: Share) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.folders:
            return
        system, top = _opened(partition.root)
        for folder, flat in partition.folders:
            for e in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=not flat)):
                if e.type != fs.FileType.File:
                    continue
                stem, dot, ext = e.base_name.rpartition(".")
                stem, ext = (stem, f".{ext}") if dot and stem else (e.base_name, "")
                if not self.extensions or ext.lower() in self.extensions:
                    below = e.path[len(top):].lstrip("/").rpartition("/")[0]
                    yield e.path, below, stem, e.base_name, ext.lower(), e.size, partition.priority


def list_files(spark: SparkSession, roots: list[str], extensions: list[str] | None = None) -> DataFrame:
    """The files under `roots`, whose order is their priority, with one of `extensions` or any."""
    spark.dataSource.register(Listing)
    return spark.read.format("listing").option("paths", ",".join(roots)).option("extensions", ",".join(extensions or [])).load()


def touch(paths: DataFrame, root: str, path: str = "path") -> int:
    """Makes an empty file under `root` for each relative path of `paths`; gives how many. A listing's fixture and a marker's sink.

    A list of many paths is a small table, often of one task, so it is dealt out before files are made.
    """
    def made(batches):
        import pandas as pd

        system, top = _opened(root)
        known = set()
        for batch in batches:
            for folder in set(batch[path].str.rpartition("/")[0].unique()) - known:
                system.create_dir(f"{top}/{folder}", recursive=True)
                known.add(folder)
            for p in batch[path]:
                with system.open_output_stream(f"{top}/{p}"):
                    pass
            yield pd.DataFrame({"n": [len(batch)]})

    spark = paths.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths.select(path).repartition(n).mapInPandas(made, "n bigint").groupBy().sum("n").first()[0] or 0
