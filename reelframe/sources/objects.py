"""An object store of attachment bodies: one file for each hash, published whole and once.

Tasks write a body beside the store first and move it to its place when it is whole and its hash and size are right.  The place is named by the hash, so runs at the
same time, tasks that are run again and runs that failed halfway all lead to the same one file: whoever comes second finds it there.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from reelframe.sources.listing import listing, located

STAGING = "_staging"


@dataclass
class Published(WriterCommitMessage):
    """What a task did; hashes stay where they are, only counts reach the driver."""

    new: int
    known: int
    refused: int


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.address, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Published:
        system, root = located(self.address)
        staging = f"{root}/{STAGING}/{self.run}"
        system.create_dir(staging, recursive=True)
        told = Published(0, 0, 0)
        for batch in iterator:
            for row in batch.to_pylist():
                digest, data = row["sha256"], row["data"]
                if data is None or row["size"] != len(data) or digest != hashlib.sha256(data).hexdigest():
                    told.refused += 1
                    continue
                place = f"{root}/{digest[:2]}/{digest}"
                if system.get_file_info(place).type == fs.FileType.File:
                    told.known += 1
                    continue
                draft = f"{staging}/{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.create_dir(f"{root}/{digest[:2]}", recursive=True)
                system.move(draft, place)  # over an equal file, if another task was faster
                told.new += 1
        return told

    def _clean(self) -> None:
        system, root = located(self.address)
        if system.get_file_info(f"{root}/{STAGING}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGING}/{self.run}")

    def commit(self, messages: list[Published | None]) -> None:
        self._clean()

    def abort(self, messages: list[Published | None]) -> None:
        """What was published stays, as it is whole; drafts of this run go."""
        self._clean()


class ObjectStore(DataSource):
    """df.write.format("object_store").mode("append").save(path) for columns sha256, size and data."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("an object store is appended to")
        return ObjectWriter(dict(self.options))


def read_store(spark: SparkSession, address: str) -> DataFrame:
    """sha256 and size of every published object; bodies are not read."""
    name = F.substring_index("path", "/", -1)
    return listing(spark, address).where(name.rlike("^[0-9a-f]{64}$")).select(name.alias("sha256"), F.col("length").alias("size"))


_REGISTER = threading.Lock()  # Spark's registry takes two threads that name the same source at once for a clash


def publish(bodies: DataFrame, address: str, *, store: DataFrame | None = None) -> None:
    """Publish the bodies (sha256, size, data) whose hash and size are right; `store` spares what it holds from being sent to the tasks at all.

    A second run adds nothing, two runs at once publish each hash once, and a run that fails leaves only whole objects.
    """
    spark = bodies.sparkSession
    fine = bodies.where((F.sha2("data", 256) == F.col("sha256")) & (F.octet_length("data") == F.col("size")))
    if store is not None:
        fine = fine.join(store.select("sha256"), "sha256", "left_anti")
    with _REGISTER:
        spark.dataSource.register(ObjectStore)
    fine.dropDuplicates(["sha256"]).select("sha256", "size", "data").write.format("object_store").mode("append").save(address)


def sink_object_store(bodies: DataFrame, address: str, *, store: DataFrame | None = None) -> DataFrame:
    """Publish the bodies as `publish` does, and return the store."""
    publish(bodies, address, store=store)
    return read_store(bodies.sparkSession, address)
