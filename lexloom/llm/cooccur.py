"""Items that appear together: a pair table kept up to date by signed changes.

The state lives in a folder and can be opened again: distinct (basket, item) rows, item counts and pair counts, each in hash
buckets, and a manifest of which update wrote each bucket last. An update names whole baskets by their new content, or
baskets that are gone. The old content of just these baskets is read from their buckets; their old pairs are emitted with
-1, their new ones with +1, both summed before the shuffle, and the sums are merged into the buckets they fall in. All other
buckets stay as they are. ``affected`` holds the association of the pairs that an update touched: those with another count
and those of an item with another count; ``associations`` that of all pairs. The number of baskets is one number for all.

A manifest is written after the tables it names, so an update that fails leaves the state before it.

Skew: a basket's rows are made distinct with a partial aggregate, keyed by basket and item, before the pairs are formed,
so a basket repeated a million times costs one row per item; pairs are summed map-side, so a hot item makes no hot task;
baskets of more than ``CHUNK`` items are cut into chunks, and every two chunks meet in a task of their own. Buckets larger
than a partition should be are split by the writer.

Defined results: rows with a null basket or item are ignored; repeated rows count once; an empty update changes nothing;
a basket of one item counts for the marginals and for the number of baskets only; a basket that is both changed and gone
has its new content; columns other than the two are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.runtime import Scratch

#: Items of a basket that are paired in one task at most, about twice as many rows.
CHUNK = 2_000


def distinct_rows(df: DataFrame, basket: str, item: str) -> DataFrame:
    return df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    other = rows.select(*keys, F.col("item").alias("b"), *([F.col("_right")] if "_right" in rows.columns else []))
    return rows.withColumnRenamed("item", "a").drop("_right").join(other, keys).where("a < b")


def signed_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, n): summed signs of the pairs within each basket (basket, sign, item), a < b."""
    keys = ["basket", "sign"]
    large = rows.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > CHUNK)
    if large.isEmpty():
        pairs = _joined(rows, keys).select("a", "b", "sign")
    else:
        chunks = F.ceil(F.col("_size") / CHUNK).cast("int")
        hot = rows.join(large, keys).withColumn("_own", F.pmod(F.xxhash64("item"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        # the two chunks of a task, by number; a pair within a chunk is formed where both are the same
        placed = hot.select(*keys, "item", "_own", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"))
        met = _joined(placed.withColumn("_right", F.col("_own")), [*keys, "_x", "_y"]).where("_own <> _right or _x = _y")
        pairs = _joined(rows.join(large, keys, "left_anti"), keys).select("a", "b", "sign").unionByName(met.select("a", "b", "sign"))
    return pairs.groupBy("a", "b").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0")


def _files(spark: SparkSession, folder: str) -> tuple:
    """(file system, path) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _listed(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []


@dataclass
class Buckets:
    """A table in hash buckets, of which each update writes some again."""

    spark: SparkSession
    folder: str
    name: str
    schema: str
    key: tuple[str, ...]
    number: int
    #: The update that wrote each bucket last; None where it is empty.
    written: dict[int, int | None] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.number)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows of these buckets, or of all."""
        out, held = self.spark.createDataFrame([], self.schema), {}
        for bucket, update in sorted(self.written.items()):
            if update is not None and (only is None or bucket in only):
                held.setdefault(update, []).append(bucket)
        for update, buckets in held.items():
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/{self.name}/{update}").where(F.col("bucket").isin(buckets))
            out = out.unionByName(part.drop("bucket"))
        return out

    def hit(self, rows: DataFrame) -> set[int]:
        """The buckets that rows fall in; all of an empty table, as there is nothing to spare."""
        if all(update is None for update in self.written.values()):
            return set(range(self.number))
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def write(self, rows: DataFrame, hit: set[int], update: int) -> None:
        """``rows`` in place of what the buckets ``hit`` held."""
        if not hit:
            return
        path = f"{self.folder}/{self.name}/{update}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {int(x.split("=")[1]) for x in _listed(self.spark, path) if x.startswith("bucket=")}
        self.written |= {b: update if b in there else None for b in hit}


class PairTable:
    """The persistent counts of one collection of baskets."""

    def __init__(self, spark: SparkSession, place: Scratch | str, basket_type: str = "long", item_type: str = "long", buckets: int = 16) -> None:
        self.spark, self.folder, self.generation, self.n = spark, place if isinstance(place, str) else place.root, 0, 0
        self.types, self.number = (basket_type, item_type), buckets
        table = lambda name, schema, *key: Buckets(spark, self.folder, name, schema, key, buckets)
        self.baskets = table("baskets", f"basket {basket_type}, item {item_type}", "basket")
        self.items = table("items", f"item {item_type}, n long", "item")
        self.pairs = table("pairs", f"a {item_type}, b {item_type}, n long", "a", "b")
        self._changed: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PairTable:
        """The state that the last finished update left in a folder."""
        done = max(int(x.removesuffix(".json")) for x in _listed(spark, f"{folder}/manifest") if x.endswith(".json"))
        held = json.loads(spark.read.text(f"{folder}/manifest/{done}.json").first()[0])
        out = cls(spark, folder, *held["types"], held["buckets"])
        out.generation, out.n = held["generation"], held["n"]
        for table in (out.baskets, out.items, out.pairs):
            table.written = {int(k): v for k, v in held[table.name].items()}
        return out

    def _save(self) -> None:
        tables = {t.name: t.written for t in (self.baskets, self.items, self.pairs)}
        held = json.dumps({"generation": self.generation, "n": self.n, "types": self.types, "buckets": self.number, **tables})
        files, path = _files(self.spark, f"{self.folder}/manifest/{self.generation}.part")
        out = files.create(path, True)
        out.write(bytearray(held.encode()))
        out.close()
        _, final = _files(self.spark, f"{self.folder}/manifest/{self.generation}.json")
        files.delete(final, False)
        files.rename(path, final)

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/steps/{self.generation}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _merge(self, table: Buckets, delta: DataFrame) -> DataFrame:
        """Adds ``delta`` (keys, n) to a table of counts; the delta, written."""
        delta = self._step(delta, table.name)
        if hit := table.hit(delta):
            merged = table.read(hit).unionByName(delta).groupBy(*table.key).agg(F.sum("n").alias("n")).where("n <> 0")
            table.write(merged, hit, self.generation)
        return delta

    def update(self, changed: DataFrame, basket: str, item: str, gone: DataFrame | None = None) -> PairTable:
        """Replace the content of the baskets in ``changed``, and remove those of ``gone`` (its first column)."""
        self.generation += 1
        new = self._step(distinct_rows(changed, basket, item), "new")
        touched = new.select("basket").distinct()
        if gone is not None:
            touched = touched.unionByName(gone.select(F.col(gone.columns[0]).cast(self.types[0]).alias("basket")).where("basket is not null")).distinct()
            touched = self._step(touched, "touched")
        first = all(u is None for u in self.baskets.written.values())
        hit, before = self.baskets.hit(touched), self.spark.createDataFrame([], self.baskets.schema)
        old = before
        if not first:
            before = self.baskets.read(hit)
            old = self._step(before.join(touched, "basket", "left_semi"), "old")
        signed = new.withColumn("sign", F.lit(1)) if first else new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        # what a basket keeps cancels out for its items, and for the pairs of what it keeps
        items = self._merge(self.items, signed.groupBy("item").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0"))
        pairs = self._merge(self.pairs, signed_pairs(signed))
        self.baskets.write(new if first else before.join(touched, "basket", "left_anti").unionByName(new), hit, self.generation)
        self.n += new.select("basket").distinct().count() - (0 if first else old.select("basket").distinct().count())
        self._changed = (items, pairs)
        self._save()
        return self

    def _scored(self, pairs: DataFrame) -> DataFrame:
        left = self.items.read().select(F.col("item").alias("a"), F.col("n").alias("n_a"))
        right = self.items.read().select(F.col("item").alias("b"), F.col("n").alias("n_b"))
        out = pairs.withColumnRenamed("n", "n_ab").join(left, "a").join(right, "b").withColumn("n", F.lit(self.n).cast("long"))
        lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
        rare = -F.log(F.col("n_ab") / F.col("n").cast("double"))
        return out.withColumn("lift", lift).withColumn("pmi", F.log("lift")).withColumn("npmi", F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(F.col("pmi") / rare))

    def associations(self) -> DataFrame:
        """(a, b, n_ab, n_a, n_b, n, lift, pmi, npmi): how much more often than chance each pair is together.

        lift = n_ab * n / (n_a * n_b); pmi = ln(lift); npmi = pmi / -ln(n_ab / n), 1 where a pair is in every basket.
        """
        return self._scored(self.pairs.read())

    @property
    def affected(self) -> DataFrame:
        """The associations of the pairs that the last update of this object touched, by their own count or by an item's."""
        if self._changed is None:
            return self._scored(self.pairs.read(set()))
        items, pairs = self._changed
        by_count = self.pairs.read(self.pairs.hit(pairs)).join(pairs.select("a", "b"), ["a", "b"], "left_semi")
        every, items = self.pairs.read(), items.select("item")
        by_item = every.join(items.withColumnRenamed("item", "a"), "a", "left_semi").select("a", "b", "n").unionByName(every.join(items.withColumnRenamed("item", "b"), "b", "left_semi").select("a", "b", "n"))
        return self._scored(by_count.unionByName(by_item).distinct())
