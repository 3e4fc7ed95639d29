"""Tables that a run writes for itself, in the folder that driver and executors share: a lost executor changes nothing in them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and everything runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="veritally-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Scratch:
    """What one run has written; `release` deletes it all. Columns are stored by number, so that names may hold any character."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def _place(self) -> str:
        self.paths.append(f"{folder(self.spark)}/run-{uuid.uuid4().hex}")
        return self.paths[-1]

    def written(self, df: DataFrame) -> DataFrame:
        """The same rows, read from files."""
        at, plain = self._place(), df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        plain.write.parquet(at)
        return self.spark.read.schema(plain.schema).parquet(at).toDF(*df.columns)

    def bucketed(self, df: DataFrame, keys: Sequence[str], ordered: bool = True) -> DataFrame:
        """The same rows as a table bucketed by keys, one file a bucket where df is dealt by them already: joins and groups by these keys need no exchange.

        Files are sorted by keys for those who look for some of them, if `ordered`; joins sort anew all the same.
        """
        at, plain = self._place(), df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        by, name = [f"c{df.columns.index(k)}" for k in keys], f"veritally_{uuid.uuid4().hex}"
        dealt = plain.write.format("parquet").option("path", at).bucketBy(partitions(self.spark), *by)
        (dealt.sortBy(*by) if ordered else dealt).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name).toDF(*df.columns)

    def drop(self, df: DataFrame) -> None:
        """Deletes one written table early."""
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(self.spark, at)
            self.paths = [p for p in self.paths if not at.endswith(p.split(":", 1)[-1])]

    def release(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for at in self.paths:
            _delete(self.spark, at)
        self.tables, self.paths = [], []


def hashable(df: DataFrame) -> list[str]:
    """Columns that a hash takes: all that hold no map."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def pinned(df: DataFrame) -> DataFrame:
    """The same rows; filters above stay above. Pushed below, they would repeat the expressions of df's columns in each of their terms.

    The pin is a function that Spark interprets, so df's last step is compiled by itself and in small methods. Fused with others, steps of many expressions are one method
    beyond the 8,000 bytes that Java compiles, and run some times slower.
    """
    return df.withColumn("_pin", F.exists(F.array(F.spark_partition_id()), lambda p: p >= 0)).where("_pin").drop("_pin")
