"""The key-value store as tables: one Parquet folder a group, JSON values, last write wins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut

SCHEMA = "key string, value string"


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The last value of each key by `order`."""
    last = Window.partitionBy("key").orderBy(F.desc(order), F.desc("value"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of `new` and those rows of `old` whose key it doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, values): old lists, or scalars as lists of one, followed by the new values."""
    tagged = old.select(key, "value", F.lit(0).alias("_w")).unionByName(new.select(key, "value", F.lit(1).alias("_w")))
    listed = F.sort_array(F.collect_list(F.struct("_w", "value")))
    return tagged.groupBy(key).agg(F.transform(listed, lambda v: v["value"]).alias("values"))


def delete(old: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


class Store:
    """Groups under a folder. A write makes a new version next to the old one and then points to it,
    so that a lost job leaves the old version whole."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, group: str) -> str:
        return f"{self.folder}/{group}/_current"

    def _path(self, group: str) -> str | None:
        fs, path = self._fs(self._versions(group))
        if not fs.exists(path):
            return None
        return f"{self.folder}/{group}/{self.spark.read.text(self._versions(group)).first()['value']}"

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, group: str) -> DataFrame:
        """All rows of a group, empty if it doesn't exist."""
        path = self._path(group)
        return self.spark.createDataFrame([], SCHEMA) if path is None else self.spark.read.parquet(path)

    def keys(self, group: str) -> DataFrame:
        return self.table(group).select("key").distinct()

    def all_keys(self, groups: list[str]) -> DataFrame:
        """The keys of several groups one after the other; a key of two groups comes twice."""
        out = self.spark.createDataFrame([], "key string")
        for group in groups:
            out = out.unionAll(self.table(group).select("key"))
        return out

    def get(self, group: str, key: str) -> str:
        row = self.table(group).filter(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        return row["value"]

    def replace(self, group: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{group}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(self._versions(group))

    def put(self, group: str, rows: DataFrame) -> None:
        self.replace(group, upsert(self.table(group), rows))

    def append(self, group: str, rows: DataFrame) -> None:
        """Append to JSON lists; a scalar that is there becomes the first element."""
        old = self.table(group)
        items = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
        listed = append(old.select("key", F.explode(items).alias("value")), rows)
        kept = delete(old, rows)
        self.replace(group, kept.unionByName(listed.join(rows.select("key").distinct(), "key", "left_semi").select("key", F.to_json("values").alias("value"))))

    def delete(self, group: str, key: str) -> str:
        value = self.get(group, key)
        self.replace(group, self.table(group).filter(F.col("key") != key))
        return value


class Memory(Store):
    """The same groups held in executor memory for a session; a lost executor's part is read again from the table before."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark, "memory")
        self._groups: dict[str, DataFrame] = {}

    def table(self, group: str) -> DataFrame:
        return self._groups.get(group, self.spark.createDataFrame([], SCHEMA))

    def replace(self, group: str, rows: DataFrame) -> None:
        before, kept = self._groups.get(group), cut(rows).cache()
        self._groups[group] = kept
        if before is not None:
            before.unpersist()
