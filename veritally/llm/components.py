"""Connected components of a table of links, each named by its smallest member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

EDGES = "u long, v long"
#: Links that one step of a task's own union-find holds.
BLOCK = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (u, v): its members but the smallest, and the smallest."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # the labels' own nodes
        np.minimum.at(new, label[b], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(names))
    return names[out], names[label[out]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        a, b = forest(np.concatenate(u), np.concatenate(v))
        u[:], v[:] = [], []
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            if sum(map(len, u)) >= BLOCK:
                yield flush()
    if u:
        yield flush()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v), component being the smallest node that it reaches.

    Each task first replaces its links by stars. Then large-star and small-star steps alternate, each a minimum over
    neighbours and a join, until nothing changes: O(log^2 n) rounds, whatever the shape. Every round is a table in the
    shared folder. Loops and repeated links do no harm.
    """
    edges = stash(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(_local, EDGES).where("u <> v").distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stash(small)
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError("components didn't settle")
