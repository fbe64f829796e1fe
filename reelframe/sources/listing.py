"""Folders listed by tasks: what lies below an address as a table, however many files there are.

Spark's own file sources keep the status of every file on the driver.  Here each level of folders is dealt to tasks, which write what they find as a table; the next
level is the folders in it.  The driver holds the number of folders of a level and no name of a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.session import shared_folder

#: What a listing holds: the path, the path below the address, bytes, and the time of the last change to the millisecond as Spark's file sources tell it.
ENTRIES = "path string, below string, is_dir boolean, length long, mtime_us long"
_SCHEMA = pa.schema([("path", pa.string()), ("below", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("mtime_us", pa.int64())])

#: Rows of a batch, its bytes of content at most, and tasks for each core at most.
ROWS, CONTENT, TASKS = 10_000, 32 << 20, 8


def located(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path there."""
    if "://" not in address and not address.startswith(("file:", "/")):
        raise ValueError(f"an absolute path or an address: {address}")
    return fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def inside(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(name, is a folder, bytes, mtime in ns) of each entry of a folder.  A local folder is gone through entry by entry, others are told whole by their file system."""
    if not isinstance(system, fs.LocalFileSystem):
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.type in (fs.FileType.File, fs.FileType.Directory):
                yield x.base_name, not x.is_file, x.size if x.is_file else None, x.mtime_ns if x.is_file else None
        return
    with os.scandir(folder) as entries:
        for x in entries:
            try:
                if x.is_dir():
                    yield x.name, True, None, None
                elif x.is_file():
                    stat = x.stat()
                    yield x.name, False, stat.st_size, stat.st_mtime_ns
            except FileNotFoundError:  # gone since, as a draft that was moved to its place
                continue


def tasks_for(spark: SparkSession, n: int) -> int:
    """Tasks for n pieces of work."""
    return max(1, min(n, TASKS * spark.sparkContext.defaultParallelism))


def listing(spark: SparkSession, address: str, *, hidden_folders: bool = False) -> DataFrame:
    """path, below, is_dir, length and mtime_us of every file below an address (or of the file there); hidden files, and what lies in hidden folders unless asked for, are left out.

    The entries of one folder are found by one task, and folders of a level by as many as there are.
    """
    system, root = located(address)
    root = root.rstrip("/") or "/"
    top = system.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if top.is_file:
        return spark.createDataFrame([(root, top.base_name, False, top.size, top.mtime_ns // 1_000_000 * 1000)], ENTRIES)
    prefix = root.rstrip("/") + "/"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(address)
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, is_dir, size, mtime in inside(system, folder):
                    if hidden(name) and not (is_dir and hidden_folders):
                        continue
                    path = f"{folder.rstrip('/')}/{name}"
                    rows.append((path, path[len(prefix) :], is_dir, size, None if mtime is None else mtime // 1_000_000 * 1000))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    base, level, folders, n = shared_folder(spark, "listing"), 0, spark.createDataFrame([(root,)], "path string"), 1
    read = lambda *levels: spark.read.schema(ENTRIES).parquet(*levels)
    while n:
        folders.repartition(tasks_for(spark, n)).mapInArrow(run, ENTRIES).write.parquet(f"{base}/{level}")
        folders = read(f"{base}/{level}").where("is_dir").select("path")
        level, n = level + 1, folders.count()
    return read(*(f"{base}/{k}" for k in range(level))).where("NOT is_dir")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def contents(files: DataFrame, address: str) -> DataFrame:
    """path and content (binary) of the files in column path, read by tasks, the same number for each."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(address)
        paths, held, size = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as file:
                    held.append(file.read())
                paths.append(path)
                size += len(held[-1])
                if len(held) == ROWS or size >= CONTENT:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
                    paths, held, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    return files.select("path").repartition(tasks_for(spark, 1 << 20)).mapInArrow(run, "path string, content binary")
