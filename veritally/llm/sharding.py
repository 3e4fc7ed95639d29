"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard; at each level every child draws -ln(u) / weight from a hash of the row's
key and the child's path, and the smallest draw wins. A weight that changes moves rows only into or out of the
child that has it, so movement stays inside the subtrees whose weights change. `Tree.grown()` adds a shard as a region of
its own: no other weight changes, so the new shard takes rows and none moves between old shards.

Everything is a column expression over the key; only slots need an exchange, of rows without texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, stash, table, text_of

SHARDS = 24


@dataclass(frozen=True)
class Tree:
    """Weights of shards, by rack, by region; shards are numbered in this order from 0."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
        """Regions of `racks` racks of `per_rack` shards of weight 1; the last ones take what is left."""
        if shards < 1:
            raise ValueError("at least one shard is needed")
        rows = [(1.0,) * min(per_rack, shards - at) for at in range(0, shards, per_rack)]
        return Tree(tuple(tuple(rows[at : at + racks]) for at in range(0, len(rows), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))

    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _draw(key: Column, path: str, weight: float) -> Column:
    if weight <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float]]) -> Column:
    draws = [F.struct(_draw(key, path, w).alias("d"), F.lit(i).alias("i")) for i, (path, w) in enumerate(children)]
    return draws[0]["i"] if len(draws) == 1 else F.array_min(F.array(*draws))["i"]


def place(df: DataFrame, key: str, tree: Tree, into: str) -> DataFrame:
    """Adds the shard of each row as int column `into`. Rows with equal keys (null is a key) share a shard."""
    k, levels = F.col(key), tree.regions
    region, rack = f"_{into}_region", f"_{into}_rack"
    out = df.withColumn(region, _winner(k, [(f"{r}", sum(map(sum, racks))) for r, racks in enumerate(levels)]))
    pick = F.lit(None).cast("int")
    for r, racks in enumerate(levels):
        pick = F.when(F.col(region) == r, _winner(k, [(f"{r}/{x}", sum(shards)) for x, shards in enumerate(racks)])).otherwise(pick)
    out = out.withColumn(rack, pick)
    pick, first = F.lit(None).cast("int"), 0
    for r, racks in enumerate(levels):
        for x, shards in enumerate(racks):
            here = (F.col(region) == r) & (F.col(rack) == x)
            pick = F.when(here, first + _winner(k, [(f"{r}/{x}/{s}", w) for s, w in enumerate(shards)])).otherwise(pick)
            first += len(shards)
    return out.withColumn(into, pick.cast("int")).drop(region, rack)


def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of each row, by law `key`.

    Null text counts as empty (size 8, crc 0); rows with a null doc_id share one shard; repeated rows each get a
    slot; an empty table gives no rows; other columns are ignored.
    """
    raw = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = place(place(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    return gapless_rank(stash(placed), "shard", ["doc_id", "text_crc32", "size"], "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), Tree.even(SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
