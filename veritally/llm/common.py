"""What the training-data operators share: the shared folder, stashes, folds and gapless ranks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="veritally-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def exchanged(df: DataFrame) -> DataFrame:
    """The same rows, for a join that broadcasts neither side: Spark takes an exploded table to be as large as the table before, and would collect it."""
    return df.hint("merge")


def discard(stashed: DataFrame) -> None:
    """Deletes a stash that nothing reads any more: all that came from it is written elsewhere."""
    spark = stashed.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stashed.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system, where its C library can; else an idle worker would hold it."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Adds the columns of facts, one row a key (null is one) with its number of rows in `count`, to rows (a stash or a cheap scan).

    Keys with more than a share of 1 / (4 x partitions) of all rows, of which there are fewer than that many, are broadcast, so that
    no task gets a hot key; all others are joined by exchange.
    """
    parts = 4 * partitions(rows.sparkSession)
    total = facts.agg(F.sum(count)).first()[0] or 0
    named = facts.withColumnRenamed(key, "_key")
    hot, cold = named.where(F.col(count) > total / parts), named.where(F.col(count) <= total / parts)
    same = rows[key].eqNullSafe(named["_key"])
    first = rows.join(F.broadcast(hot), same).drop("_key")
    rest = rows.join(F.broadcast(hot.select("_key")), same, "left_anti")
    return first.unionByName(rest.join(cold, same).drop("_key"))


def ordered_rank(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Adds rank `into` (long, from 0, no gaps) in the order of columns whose values are distinct; no task sorts more than its range."""
    n = partitions(df.sparkSession)
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = stash(ranges.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_own")))
    counts = marked.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_of", before.alias("_start")))
    return marked.join(starts, F.col("_part") == F.col("_of")).withColumn(into, F.col("_start") + F.col("_own")).drop("_part", "_own", "_of", "_start")


def gapless_rank(df: DataFrame, group: str, order: list[str], into: str, buckets: int | None = None) -> DataFrame:
    """Adds rank `into` (long, from 0, no gaps) within each value of `group`, however large a group is.

    A hash of the order columns deals each group over `buckets` parts; parts are ranked on their own and the
    parts before them are added from a table of counts (at most groups x buckets rows). df is read twice, so
    it should be a stash or a cheap scan. Rows that agree in all order columns get any of their ranks.
    """
    n = buckets or 4 * partitions(df.sparkSession)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    ranked = dealt.withColumn("_own", own.cast("long"))
    on = ranked[group].eqNullSafe(starts["_group"]) & (ranked["_part"] == starts["_of"])
    return ranked.join(starts, on).withColumn(into, F.col("_start") + F.col("_own")).drop("_part", "_own", "_group", "_of", "_start")
