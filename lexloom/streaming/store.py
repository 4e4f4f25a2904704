"""A table in hash buckets that micro-batches keep up to date: each writes only the buckets its rows fall in.

Layout: data/<batch>/bucket=<b> and manifest/<batch>, which names for every bucket the batch that wrote it last. A manifest
is written after its data, so readers see whole batches; a batch that is run again starts from the manifest before it and
writes the same again. Data that neither the last manifest nor the one before names is removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = 32) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(path)] if self._files.exists(path) else []

    def batches(self) -> list[int]:
        """Finished batches, in order."""
        return sorted(int(n) for n in self._names("manifest") if n.isdigit() and self._files.exists(self._path(f"{self.folder}/manifest/{n}/_SUCCESS")))

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The batch that wrote each bucket last, as of the last batch (below a number)."""
        done = [n for n in self.batches() if below is None or n < below]
        if not done:
            return {}
        return {int(b): n for b, n in json.loads(self.spark.read.text(f"{self.folder}/manifest/{done[-1]}").first()[0]).items()}

    def read(self, below: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table, or these buckets of it."""
        held: dict[int, list[int]] = {}
        for bucket, batch in self.versions(below).items():
            if only is None or bucket in only:
                held.setdefault(batch, []).append(bucket)
        out = self.spark.createDataFrame([], self.schema)
        for batch, buckets in sorted(held.items()):
            part = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.folder}/data/{batch}")
            out = out.unionByName(part.where(F.col("bucket").isin(buckets)).drop("bucket"))
        return out

    def merge(self, batch: int, new: DataFrame, into: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``into(rows of the buckets hit, new)`` in place of what they held."""
        hit = {r[0] for r in new.select(self.bucket()).distinct().collect()}
        if not hit:
            return
        rows = into(self.read(batch, hit), new).select(*self.schema.names)
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{batch}")
        before = self.versions(batch)
        after = json.dumps({**before, **dict.fromkeys(sorted(hit), batch)})
        self.spark.createDataFrame([(after,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{batch}")
        self._sweep(set(before.items()) | {(b, batch) for b in hit}, batch)

    def _sweep(self, needed: set[tuple[int, int]], batch: int) -> None:
        for number in (int(n) for n in self._names("data") if n.isdigit() and int(n) <= batch):
            buckets = {int(x.split("=")[1]) for x in self._names(f"data/{number}") if x.startswith("bucket=")}
            kept = {b for b in buckets if (b, number) in needed}
            for bucket in buckets - kept if kept else ():
                self._files.delete(self._path(f"{self.folder}/data/{number}/bucket={bucket}"), True)
            if not kept:
                self._files.delete(self._path(f"{self.folder}/data/{number}"), True)
