"""Session helpers: table reading, scratch tables in the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder, for tasks that write files of their own."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def put_file(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file whole; a task that runs twice leaves the same file."""
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(f"{path}.part") as out:
        out.write(content)
    files.move(f"{path}.part", path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set, else (local mode only) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables of one run. Each put() cuts the lineage and lets Spark drop the shuffle files behind it.

    The tables survive the loss of executors. drop() removes tables that nothing reads any more; what is left, as a result
    may still read it, is removed by close(), at the end of a with block or when the driver ends.
    """

    _open: set[Scratch] = set()

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        Scratch._open.add(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        # shuffle files go when the plans that made them are collected; Spark by itself does that every half hour
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        Scratch._open.discard(self)
        self._delete(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


@atexit.register
def _close_all() -> None:
    for scratch in list(Scratch._open):
        try:
            scratch.close()
        except Exception:  # noqa: BLE001  the session is gone, and its folder is the cluster's to clean
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
