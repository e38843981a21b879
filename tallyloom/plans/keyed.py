"""A table kept by key: upserts rewrite the buckets they touch, look-ups read one.

Rows lie in buckets by a hash of their key. A manifest names the folder of every bucket; an upsert reads the touched
buckets, merges them with the batch, writes them to folders of its own and commits a manifest that names these and
leaves the others as they are. A manifest becomes current by claiming its number, which fails if another writer came
first: then the batch is merged anew with what that writer left, so no update is lost. A crash before the commit
leaves the table as it was. Readers keep the folders of the manifest before the current one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .envelope import exists, lines, take_number
from .staging import delete

MANIFEST = "number long, buckets string"
Merge = Callable[[str], Column]


class KeyedTable:
    """keys: columns that name a row. buckets: fixed when the table is made; some 100 MB each at the size expected."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema
        layout = f"{path}/layout"
        if not exists(spark, f"{layout}/_SUCCESS"):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(layout)
        self.buckets = spark.read.schema("buckets int").json(layout).first()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The current number and the folder of each bucket: one row, of as many entries as buckets."""
        if not exists(self.spark, f"{self.path}/manifests"):
            return 0, {}
        found = lines(self.spark, f"{self.path}/manifests", MANIFEST).where("buckets is not null").orderBy(F.desc("number")).first()
        return (0, {}) if found is None else (found[0], {int(b): f for b, f in json.loads(found[1]).items()})

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._rows(list(self.manifest()[1].values()))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys; only their buckets are read. At most as many bucket numbers as buckets are collected."""
        _, folders = self.manifest()
        met = [r[0] for r in wanted.select(self.bucket().alias("b")).distinct().collect()]
        rows = self._rows([folders[b] for b in met if b in folders])
        return rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def get(self, *key) -> DataFrame:
        """The row of one key: one bucket is read, and the key is pushed to its scan."""
        one = self.spark.range(1).select(*[F.lit(v).cast(self._type(k)).alias(k) for k, v in zip(self.keys, key)])
        _, folders = self.manifest()
        bucket = one.select(self.bucket()).first()[0]
        same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(self.keys, key)])
        return self._rows([folders[bucket]] if bucket in folders else []).where(same)

    def _type(self, column: str):
        return self.spark.createDataFrame([], self.schema).schema[column].dataType

    def upsert(self, batch: DataFrame, merge: dict[str, Merge] | None = None, attempts: int = 20) -> list[int]:
        """Merge a batch of one row a key; returns the buckets rewritten.

        merge: for a column, what it becomes where the table has the key, from `old` and `new` (structs of the row's
        columns); other columns take the new value. Rows with a null in their key are left out.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        new = batch.where(known).select(*self.keys, F.struct(*columns).alias("new"))
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())
        for _ in range(attempts):
            number, folders = self.manifest()
            held = self._rows([folders[b] for b in touched if b in folders]).select(*self.keys, F.struct(*columns).alias("old"))
            both = held.join(new, self.keys, "full_outer")

            def value(c: str) -> Column:
                if merge and c in merge:
                    both_known = F.col("old").isNotNull() & F.col("new").isNotNull()
                    return F.when(both_known, merge[c](c)).otherwise(F.coalesce("new", "old")[c])
                return F.coalesce("new", "old")[c]

            rows = both.select(*[F.col(c) if c in self.keys else value(c).alias(c) for c in columns], self.bucket().alias("_bucket"))
            version = f"{self.path}/rows/{uuid.uuid4().hex}"
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(version)
            now = folders | {b: f"{version}/_bucket={b}" for b in touched}
            if take_number(self.spark, f"{self.path}/claims", number + 1):
                told = self.spark.createDataFrame([(number + 1, json.dumps(now))], MANIFEST)
                told.coalesce(1).write.json(f"{self.path}/manifests/{number + 1:012d}")
                self._forget(number, folders, now)
                return touched
            delete(self.spark, version)
        raise RuntimeError(f"{attempts} attempts to commit to {self.path} met other writers")

    def _forget(self, number: int, before: dict[int, str], now: dict[int, str]) -> None:
        """Delete folders that neither this manifest nor the one before it names."""
        older = lines(self.spark, f"{self.path}/manifests", MANIFEST).where(F.col("number") == number - 1).first() if number > 1 else None
        for folder in set(json.loads(older[1]).values()) - set(before.values()) - set(now.values()) if older else ():
            delete(self.spark, folder)


def appended(column: str) -> Column:
    """For arrays: what the table holds, then what the batch brings."""
    return F.concat(F.coalesce(F.col("old")[column], F.array()), F.coalesce(F.col("new")[column], F.array()))


def earlier(column: str) -> Column:
    return F.least(F.col("old")[column], F.col("new")[column])
