"""Vector compression by product codebooks: four parts a vector, one byte a part.

Vectors are packed into blocks of columns: one binary value holds dimension after dimension of some thousand vectors, as
the smallest integers that fit. A round is one treeAggregate over these blocks: each block's task adds up squared distances
to all entries dimension by dimension, takes the nearest entry, adds the parts into int64 sums and counts with np.add.at, and these tensors,
which have the size of the codebooks, merge through a tree of executors. Only the merged tensors reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, stash, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bytes of a block's integers, and vectors whose distances are held at once.
BLOCK, AT_ONCE = 4 << 20, 1024


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (array<long>) of the rows that have a vector without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select("vec_id", "label", F.when(fine, v).alias("v")).where("v IS NOT NULL")
    return kept.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def _narrow(x: np.ndarray) -> np.ndarray:
    for t in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max):
            return x.astype(t)
    return x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        dims = np.diff(v.offsets.to_numpy())
        for dim in np.unique(dims).tolist():
            own = batch.take(pa.array(np.flatnonzero(dims == dim)))
            step = max(1, BLOCK // (8 * max(1, dim)))
            for at in range(0, own.num_rows, step):
                piece = own.slice(at, step)
                n, wide = piece.num_rows, -(-dim // PARTS) * PARTS
                x = np.zeros((wide, n), np.int64)
                x[:dim] = piece.column("v").flatten().to_numpy().reshape(n, dim).T
                small = _narrow(x)
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)  # noqa: B023, E731
                ends = (int(x.min()), int(x.max())) if x.size else (0, 0)
                yield pa.record_batch(
                    [pa.array([dim], pa.int32()), pa.array([n]), pa.array([small.dtype.str]), pa.array([small.tobytes()], pa.binary()), pa.array([ends[0]]), pa.array([ends[1]]), one(piece.column("vec_id")), one(piece.column("label"))],
                    names=["dim", "n", "kind", "columns", "least", "most", "vec_ids", "labels"],
                )


def columns_of(data: bytes, kind: str, n: int) -> np.ndarray:
    """One row a dimension, one column a vector."""
    return np.frombuffer(data, kind).reshape(-1, n)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of entries (a row each) for each column of x, the lowest of ties, and its squared distance."""
    span = max(int(x.max(initial=0)), int(entries.max(initial=0))) - min(int(x.min(initial=0)), int(entries.min(initial=0)))
    t = np.int32 if span * span * max(1, len(x)) < 1 << 31 else np.int64
    book = np.ascontiguousarray(entries.T.astype(t))[:, :, None]
    code, error = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
    for at in range(0, x.shape[1], AT_ONCE):
        part = x[:, at : at + AT_ONCE].astype(t)
        far = np.zeros((len(entries), part.shape[1]), t)
        gap = np.empty_like(far)
        for d in range(len(part)):
            np.subtract(part[d], book[d], out=gap)
            np.multiply(gap, gap, out=gap)
            far += gap
        best = far.argmin(axis=0)
        code[at : at + AT_ONCE], error[at : at + AT_ONCE] = best, far[best, np.arange(len(best))]
    return code, error


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row a part) and the summed error of every vector."""
    got = [nearest(x[p * books.shape[2] : (p + 1) * books.shape[2]], books[p]) for p in range(len(books))]
    return np.array([c for c, _ in got]), sum(e for _, e in got)


def _gathered(books: np.ndarray):
    """seqOp: a block's parts added to the sums and counts of their entries."""

    def add(acc, block):
        sums, counts = acc or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        x = columns_of(block["columns"], block["kind"], block["n"])
        codes, _ = _coded(x, books)
        width = books.shape[2]
        for p, code in enumerate(codes):
            np.add.at(counts[p], code, 1)
            np.add.at(sums[p], code, x[p * width : (p + 1) * width].T.astype(np.int64))
        return sums, counts

    return add


def _merged(a, b):
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def trained(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) after some rounds over blocks."""
    rdd = blocks.select("n", "kind", "columns").rdd
    depth = 2
    while 32**depth < rdd.getNumPartitions():
        depth += 1
    for _ in range(rounds):
        sums, counts = rdd.treeAggregate(None, _gathered(books), _merged, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def _assign(books: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in ("columns", "kind", "n")}
                codes, error = _coded(columns_of(**{"data": block["columns"], "kind": block["kind"], "n": block["n"]}), books)
                hexes = [c.astype(np.uint8).tobytes().hex() for c in codes.T]
                yield pa.record_batch([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(hexes), pa.array(error)], names=names)

    return run


def first_books(kept: DataFrame) -> np.ndarray:
    """The parts of the vectors of the smallest vec_ids; a null one is the largest. At most ENTRIES vectors come to the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % PARTS)))
    return v.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of vec_id, embedding and label that holds a whole vector.

    Rows whose vector is null or holds null or non-finite components go. Vectors of different dimensions are compressed apart,
    each with codebooks of its own; a dimension that isn't a multiple of 4 is filled up with zeros. A null vec_id is the largest; repeated
    rows count and are returned each; null labels are one label; an empty table gives no rows; other columns are ignored. Components too large for
    exact 64-bit distances and sums are an error.
    """
    kept = whole_numbers(rows)
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    blocks = stash(kept.mapInArrow(_pack, f"dim int, n long, kind string, columns binary, least long, most long, vec_ids array<{types['vec_id']}>, labels array<{types['label']}>"), "none")
    out, names = None, ["vec_id", "label", "code", "error"]
    for d in blocks.groupBy("dim").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.sum("n").alias("n")).orderBy("dim").collect():
        if (d["hi"] - d["lo"]) ** 2 * max(1, d["dim"]) >= 1 << 63 or max(-d["lo"], d["hi"]) * d["n"] >= 1 << 63:
            raise ValueError(f"components from {d['lo'] / SCALE} to {d['hi'] / SCALE} don't fit exact 64-bit sums")
        own = blocks.where(F.col("dim") == d["dim"])
        books = trained(own, first_books(kept.where(F.size("v") == d["dim"])))
        coded = own.select("n", "kind", "columns", "vec_ids", "labels").mapInArrow(_assign(books, names), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
        coded = coded.withColumn("codebooks_sha256", F.lit(digest(books)))
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {types['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    done = stash(out)
    labels = done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return attach(done, labels, "label", "_n").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(far * 256 + entry) AS best
  FROM (SELECT vec_id, part, entry, sum((x - c) * (x - c))::BIGINT AS far FROM xs JOIN book{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL
)""")
        if r < rounds:
            parts.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
    SELECT part, best % 256 AS entry, pos, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM xs JOIN near{r} USING (vec_id, part) GROUP BY ALL
  ) USING (part, entry, pos)
)""")
    return ",\n".join(parts)


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {
    "op13_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), xs AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // 4) AS part, (i - 1) % (len(v) // 4) AS pos, v[i] AS x FROM kept, generate_series(1, len(v)) AS g(i)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
), book0 AS MATERIALIZED (
  SELECT part, entry, pos, x AS c FROM xs JOIN firsts USING (vec_id)
), {_rounds_sql(ROUNDS)}, own AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id
), labelled AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM own JOIN kept USING (vec_id) GROUP BY label
)
SELECT own.vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM own JOIN kept USING (vec_id) JOIN labelled ON kept.label IS NOT DISTINCT FROM labelled.label
"""
}
