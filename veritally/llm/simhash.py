"""SimHash near-duplicates by multi-index hashing.

Fingerprints link at RADIUS or fewer differing bits. Three segments of 21 or 22 bits: of two such fingerprints at least one
segment differs in at most one bit. The distinct fingerprints lie in one table for each segment, and each looks up its
own segment and that segment with one 0 bit set (so of two segments that differ in one bit exactly one finds the
other); what a look-up fetches is verified over all 64 bits.

Segments that many fingerprints share are not joined row by row: they are cut into blocks, each pair of blocks is
compared in one step, and only a star for each group of links leaves it, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exchanged, stash, table
from .components import EDGES, components, forest
from .shingle_dedup import groups as shingle_groups
from .shingle_dedup import signature

RADIUS, SHINGLE, SEED = 4, 4, 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints in a segment's bucket from which it is compared in blocks, and rows in a block.
CROWDED, BLOCK = 16, 1024
_HASHES = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 where it has no word."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    first, last, of = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        h = np.array([of(joined[s:e], seed) for s, e in zip(first[at : at + _HASHES], last[at : at + _HASHES], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """A star for each group of links between the table's and the look-ups' rows of a pair of blocks."""
    probe = rows["probe"].to_numpy().astype(bool)
    node, fp = rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    a, b = np.flatnonzero(probe), np.flatnonzero(~probe)
    near = [np.nonzero(np.bitwise_count(fp[a[i : i + 256], None] ^ fp[None, b]) <= RADIUS) for i in range(0, len(a), 256)]
    u = node[a[np.concatenate([x[0] + 256 * i for i, x in enumerate(near)])]] if near else node[:0]
    v = node[b[np.concatenate([x[1] for x in near])]] if near else node[:0]
    u, v = forest(u, v)
    return pa.table({"u": u, "v": v})


def link(nodes: DataFrame) -> DataFrame:
    """Links (u, v) between distinct nodes (node, fp) that have the components of all pairs within RADIUS bits.

    nodes should be a stash; node and fp are each unique and not null.
    """
    parts = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in SEGMENTS]
    keyed = [F.lit(i << 24).cast("long").bitwiseOR(p) for i, p in enumerate(parts)]
    own = nodes.select("node", "fp", F.explode(F.array(*keyed)).alias("key"))
    flips = [
        F.when(p.bitwiseAND(F.lit(1 << j).cast("long")) == 0, k.bitwiseOR(F.lit(1 << j).cast("long")))
        for p, k, (_, n) in zip(parts, keyed, SEGMENTS, strict=True)
        for j in range(n)
    ]
    asks = [F.struct(k.alias("key"), F.lit(True).alias("same")) for k in keyed] + [F.struct(k.alias("key"), F.lit(False).alias("same")) for k in flips]
    asked = nodes.select("node", "fp", F.explode(F.filter(F.array(*asks), lambda a: a["key"].isNotNull())).alias("a")).select("node", "fp", "a.*")
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = stash(exchanged(asked).join(sizes, "key").where("NOT same OR n > 1"))
    # buckets of few: rows against rows
    few = exchanged(asked.where(F.col("n") < CROWDED)).alias("q").join(own.alias("t"), F.col("q.key") == F.col("t.key"))
    few = few.where((~F.col("q.same") | (F.col("q.node") < F.col("t.node"))) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("t.fp"))) <= RADIUS))
    few = few.select(F.greatest("q.node", "t.node").alias("u"), F.least("q.node", "t.node").alias("v"))
    # buckets of many: blocks against blocks
    crowds = asked.where(F.col("n") >= CROWDED)
    shape = crowds.groupBy("key").agg(F.ceil(F.first("n") / BLOCK).cast("int").alias("tables"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lookups"))
    shape = stash(shape)

    def dealt(df: DataFrame, probe: bool) -> DataFrame:
        mine, other = ("lookups", "tables") if probe else ("tables", "lookups")
        block = F.pmod(F.xxhash64("node", "fp"), F.col(mine)).cast("int")
        out = df.select("key", "node", "fp").join(shape, "key").select("key", "node", "fp", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("o"))
        i, j = ("o", "b") if probe else ("b", "o")
        return out.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(int(probe)).alias("probe"), "node", "fp")

    many = dealt(own, False).unionByName(dealt(crowds, True)).groupBy("key", "i", "j").applyInArrow(_compare, EDGES)
    return few.unionByName(stash(many))  # the next step runs Python too: in one task that would be a second worker


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(of, component): each fingerprint in column fp, and the smallest one (as a signed long) that it reaches. fps should be a stash."""
    nodes = stash(fps.select(F.col("fp").alias("node"), "fp").distinct())
    found = components(link(nodes))
    return nodes.join(found, "node", "left").select(F.col("node").alias("of"), F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id of each row.

    Texts without words (null ones too) have fingerprint 0 and link like any other. Rows with a null doc_id take part through
    their text but never name a component; a group with no other id has a null component_id. Repeated rows are returned each, as are
    rows of one doc_id with different texts, each in the group of its own text. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    fps = stash(fingerprints(docs))
    groups = fingerprint_groups(fps)
    named = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, F.col("fp") == F.col("of"))
    first = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    told = named.select("of", "component").join(first, F.col("component") == F.col("c")).select("of", "component_id")
    return fps.join(told, fps["fp"] == told["of"]).select("doc_id", "fp", "component_id")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bytes, int] = {}
        texts = batch.column(1).to_pylist()
        found = [signature(x, seen) for x in texts]
        fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
        columns = [pa.array(fps, pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "fp", "key", "bands"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group, the one with the smallest doc_id (rows without one come last), all columns as they were.

    Rows belong together whose fingerprints link, or whose sets of 5-word shingles have a similarity of 0.8 or more, which 4 of 64 bits don't reach:
    a pair at 0.8 differs in ten bits on average. Repeated rows are one, and so are copies without doc_id. Of rows that agree in doc_id
    and text but not in other columns any one stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.xxhash64(text)  # equal texts have equal names
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("node"), text.cast("binary").alias("text"))
    owners = stash(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    several = owners.where("n > 1").select(F.col("node").alias("of"))
    once = rows.join(several, F.col("node") == F.col("of"), "left_anti").select("node", "text")
    again = rows.join(several, F.col("node") == F.col("of"), "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    distinct = once.unionByName(again)
    signed = stash(distinct.mapInArrow(_signed, "node long, fp long, key long, bands array<long>"))
    by_bits, by_sets = fingerprint_groups(signed.select("fp")), shingle_groups(distinct, signed)
    joined = signed.select("node", "fp", "key").join(by_bits, F.col("fp") == F.col("of")).select("node", "key", F.col("component").alias("bits"))
    joined = stash(joined.join(by_sets, "key").select("node", "bits", F.col("component").alias("sets")))
    hub = joined.groupBy("bits").agg(F.min("node").alias("hub"))
    edges = joined.select(F.col("node").alias("u"), F.col("sets").alias("v")).unionByName(joined.join(hub, "bits").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    group = components(edges).select(F.col("node").alias("of"), "component")
    owned = owners.join(group, F.col("node") == F.col("of"), "left").select("node", F.coalesce("component", "node").alias("component"), "least", "n")
    first = owned.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("f")).select(F.col("f.node").alias("first"), "component")
    # texts that go, and texts that stay but stand in several rows
    judged = stash(owned.join(first, "component").where("node <> first OR n > 1").select(F.col("node").alias("_of"), (F.col("node") == F.col("first")).alias("_stays"), F.col("least").alias("_least")))
    named = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), F.col("doc_id").cast("long").alias("id"))
    plain = named.join(judged.select("_of"), F.col("name") == F.col("_of"), "left_anti")
    repeated = named.join(judged.where("_stays"), (F.col("name") == F.col("_of")) & F.col("id").eqNullSafe(F.col("_least"))).dropDuplicates(["name"])
    return plain.select("row.*").unionByName(repeated.select("row.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
