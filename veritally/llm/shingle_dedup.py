"""Similarity of word shingles, which SimHash fingerprints of 64 bits can't find at 0.8: candidates and their check for simhash.deduplicate.

Two documents link where the sets of their shingles of WIDTH words have a Jaccard similarity of 0.8 or more (the sets are of 64-bit
hashes; a text of fewer words is one shingle). Candidates share one of BANDS bands of ROWS minhashes, which misses a pair at
exactly 0.8 with probability (1 - 0.8^4)^20 = 0.00003, and fewer above; every candidate is verified on the whole sets.

Groups are what counts, so each bucket's documents are first verified against its smallest one, and only documents of a bucket
that this leaves in different groups are compared with each other, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exchanged, stash
from .components import EDGES, components, forest

WIDTH, BANDS, ROWS, BLOCK = 5, 20, 4, 256
_CHUNK = 1 << 15
_R = np.random.default_rng(5)
_A, _B = _R.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_A = _A * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's shingles; none where it has no word. `seen` keeps hashes of words."""
    import xxhash

    seen = {} if seen is None else seen
    of, words = xxhash.xxh3_64_intdigest, (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([seen[w] if w in seen else seen.setdefault(w, of(w)) for w in words], np.uint64)
    width = min(WIDTH, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, np.uint64)
    for j in range(width):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minhashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _CHUNK):
        least = np.minimum(least, (found[None, at : at + _CHUNK] * _A + _B).min(axis=1))
    least, key = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ least[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def signature(text: bytes | None, seen: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """The key of a text's set of shingles, and its bands."""
    found = shingles(text, seen)
    return _key(found), bands(found)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bytes, int] = {}
        sets = [shingles(x, seen) for x in batch.column(1).to_pylist()]
        same = pa.array([_key(x) == k for x, k in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "set"]).filter(same)


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """A star for each group of links between the documents of a pair of blocks that lie in different groups so far."""
    node, group, block = rows["node"].to_numpy(), rows["group"].to_numpy(), rows["block"].to_numpy()
    sets = [x.values.to_numpy() for x in rows["set"].combine_chunks()]
    size, i, j = np.array([len(x) for x in sets]), key[1].as_py(), key[2].as_py()
    mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
    held, owner = np.concatenate([sets[k] for k in other]) if len(other) else np.zeros(0, np.int64), np.repeat(other, size[other])
    order = np.argsort(held, kind="stable")
    held, owner, u, v = held[order], owner[order], [], []
    for k in mine:
        low, high = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
        n = high - low
        hits = owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(node))
        near = np.flatnonzero((5 * both >= 4 * (size + size[k] - both)) & (both > 0) & (group != group[k]))
        u += [node[k]] * len(near)
        v += node[near].tolist()
    a, b = forest(np.array(u, np.int64), np.array(v, np.int64))
    return pa.table({"u": a, "v": b})


def groups(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """(key, component): the set of shingles with each key, and the smallest number of a text in its group.

    rows: node long, text binary; signed (a stash): node, key and bands of these rows, nodes being unique. Texts without words are one group.
    """
    nodes = stash(signed.groupBy("key").agg(F.min("node").alias("node"), F.first("bands").alias("bands")))
    own = nodes.select("node", F.explode("bands").alias("band"))
    sizes = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    buckets = stash(exchanged(own).join(sizes, "band").select("band", "node", "hub"))
    wanted = buckets.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = rows.select(F.col("node").alias("of"), "text").join(wanted, F.col("of") == F.col("node")).select("node", "text", "key")
    sets = stash(texts.mapInArrow(_sets, "node long, set array<long>"))

    pairs = buckets.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(256)))  # many documents may have one smallest one
    hubs = pairs.select("v", "part").distinct().join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(hubs, ["v", "part"])
    pairs = pairs.withColumn("both", F.size(F.array_intersect("a", "b"))).where(5 * F.col("both") >= 4 * (F.size("a") + F.size("b") - F.col("both")))
    first = stash(pairs.select("u", "v"))
    so_far = components(first)

    left = buckets.join(so_far, "node", "left").select("band", "node", F.coalesce("component", "node").alias("group"))
    several = left.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    left = left.join(several.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    left = left.select("band", "node", "group", "block", other).join(sets, "node")
    left = left.select("band", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "group", "block", "set")
    more = stash(left.groupBy("band", "i", "j").applyInArrow(_compare, EDGES))  # the next step runs Python too: in one task that would be a second worker
    found = components(first.unionByName(more))
    return nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
