"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Every distinct vector is normed and quantised to int8 with a scale of its own, and what that drops is quantised to int8 once more; the length
of what is left by each step is kept. With u = a + d (a the quantised vector, d the rest), u.v lies within |a||e| + |d| of a.b. Tiles of TILE
vectors, which carry their quantised forms only, are multiplied in integers (exact in float32 up to 1,000 dimensions). Pairs that may reach the
threshold by the first bound are computed again from both int8 steps; those that even the second, some 250 times narrower bound
leaves open are recomputed from their vectors in double precision, which are fetched for these pairs alone. Only counts
and stars of settled links leave a pair of tiles, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .components import components, forest

THRESHOLD, TILE, STEP = 0.95, 16384, 256
_ARRAYS = {"node": "<i8", "copies": "<i8", "q": "i1", "scale": "<f8", "size": "<f8", "rest": "<f8", "q2": "i1", "scale2": "<f8", "rest2": "<f8"}
_PACKED = "dim int, tile int, " + ", ".join(f"{n} binary" for n in _ARRAYS)
#: Beyond every bound, for the rounding of double precision.
_SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normed rows; int8 rows; scales; lengths of the quantised rows; lengths of what is left."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    a = q * scale[:, None]
    return u, q, scale, np.linalg.norm(a, axis=1), np.linalg.norm(u - a, axis=1)


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    dim, tile = key[0].as_py(), key[1].as_py()
    x = rows["vector"].combine_chunks().values.to_numpy().reshape(-1, dim)
    u, q, scale, size, rest = quantise(x)
    left = u - q * scale[:, None]
    scale2 = np.maximum(np.abs(left).max(axis=1), 1e-300) / 127
    q2 = np.rint(left / scale2[:, None]).astype(np.int8)
    rest2 = np.linalg.norm(left - q2 * scale2[:, None], axis=1)
    blobs = [rows["node"].to_numpy(), rows["copies"].to_numpy(), q, scale, size, rest, q2, scale2, rest2]
    columns = {n: pa.array([np.ascontiguousarray(b, k).tobytes()], pa.binary()) for (n, k), b in zip(_ARRAYS.items(), blobs, strict=True)}
    return pa.table({"dim": pa.array([dim], pa.int32()), "tile": pa.array([tile], pa.int32()), **columns})


def _finer(t: dict, at: np.ndarray) -> np.ndarray:
    return t["q"][at] * t["scale"][at, None] + t["q2"][at] * t["scale2"][at, None]


#: Dimensions up to which products of int8 rows are whole in 32-bit floats (127 * 127 * EXACT < 2**24).
EXACT = 1024


def products(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows with rows that stand in the columns of a float32 matrix; longer rows go slice by slice into doubles."""
    if len(columns) <= EXACT:
        return q.astype(np.float32) @ columns
    return sum((q[:, k : k + EXACT].astype(np.float32) @ columns[k : k + EXACT]).astype(np.float64) for k in range(0, len(columns), EXACT))


def links_between(a: dict, b: dict, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of pairs of tiles a and b, step by step, and whether their cosine is at least threshold for sure; pairs that are below for sure are left out."""
    bq, e, most = b["q"].astype(np.float32).T, b["rest"].max(), b["scale"].max()
    for at in range(0, len(a["q"]), STEP):
        s = slice(at, at + STEP)
        product = products(a["q"][s], bq)
        # first by the tile's largest scale and rest, then by the pair's own
        floor = (threshold - _SLACK - a["size"][s] * e - a["rest"][s]) / a["scale"][s]
        i, j = np.nonzero(product >= np.minimum(floor / most, floor / b["scale"].min())[:, None])
        near = product[i, j].astype(np.float64) * a["scale"][s][i] * b["scale"][j]
        bound = a["size"][s][i] * b["rest"][j] + a["rest"][s][i] + _SLACK
        may = near >= threshold - bound
        i, j, sure = i[may] + at, j[may], (near >= threshold + bound)[may]
        for k in range(0, len(i), 65536):
            m, n, done = i[k : k + 65536], j[k : k + 65536], sure[k : k + 65536].copy()
            open_ = np.flatnonzero(~done)
            kept = np.ones(len(m), bool)
            if len(open_):
                x, y = m[open_], n[open_]
                near = np.einsum("ij,ij->i", _finer(a, x), _finer(b, y))
                bound = (1 + a["rest2"][x]) * b["rest2"][y] + a["rest2"][x] + _SLACK
                done[open_], kept[open_] = near >= threshold + bound, near >= threshold - bound
            yield m[kept], n[kept], done[kept]


def _tile_pair(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """Rows of kind 0: a vector, how many it is linked with in this pair of tiles, and the root of its star; of kind 1: two vectors that are still open."""
    dim, tiles = key[0].as_py(), []
    for row in sorted(rows.to_pylist(), key=lambda r: r["tile"]):
        t = {n: np.frombuffer(row[n], k) for n, k in _ARRAYS.items()}
        tiles.append(t | {n: t[n].reshape(-1, dim) for n in ("q", "q2")})
    a, b = tiles[0], tiles[-1]
    links = [np.zeros(len(t["node"]), np.int64) for t in (a, b)]
    u, v, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros((2, 0), np.int64)]
    for i, j, sure in links_between(a, b, threshold):
        if a is b:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        open_.append(np.stack([a["node"][i[~sure]], b["node"][j[~sure]]]))
        i, j = i[sure], j[sure]
        for n, x, y, other in ((0, i, j, b), (0 if a is b else 1, j, i, a)):
            links[n] += np.bincount(x, other["copies"][y], len(links[n])).astype(np.int64)
        u, v = forest(np.concatenate([u, a["node"][i]]), np.concatenate([v, b["node"][j]]))
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    node = np.concatenate([t["node"][k > 0] for t, k in zip((a, b), links, strict=True)][: 1 if a is b else 2])
    n, left = np.concatenate([k[k > 0] for k in links]), np.concatenate(open_, axis=1)
    kind = np.repeat([0, 1], [len(node), left.shape[1]])
    to = np.concatenate([np.fromiter((root.get(x, x) for x in node.tolist()), np.int64, len(node)), left[1]])
    return pa.table({"kind": pa.array(kind, pa.int32()), "node": np.concatenate([node, left[0]]), "links": np.concatenate([n, 0 * left[0]]), "root": to})


def _recomputed(threshold: float):
    """The open pairs that reach the threshold in double precision, as links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array(batch.column(n).to_pylist(), np.float64) if len({len(v) for v in batch.column(n)}) == 1 else None for n in ("x", "y"))
            if x is None:  # vectors of several dimensions
                hit = np.array([quantise(np.array([p.as_py()]))[0][0] @ quantise(np.array([q.as_py()]))[0][0] for p, q in zip(batch.column("x"), batch.column("y"), strict=True)]) >= threshold
            else:
                hit = np.einsum("ij,ij->i", quantise(x)[0], quantise(y)[0]) >= threshold
            yield batch.select(["u", "v", "cu", "cv"]).filter(pa.array(hit))

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row, over the vectors in column embedding.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and stand alone, as do vectors of
    another dimension. Equal vectors are compared once, with their number. Rows with a null vec_id have no links and a null component_id;
    repeated rows are returned each and link with one another; so do different vectors of one vec_id, each by its own vector;
    an empty table gives no rows; other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), v).alias("vector"))
    nodes = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stash(nodes.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))  # numbered once: the stash keeps the numbers
    counts = nodes.groupBy("dim").count().collect()
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    tiles = F.create_map(*(F.lit(x) for r in counts for x in (r["dim"], -(-r["count"] // tile))))
    dealt = nodes.withColumn("tiles", tiles[F.col("dim")]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = stash(dealt.select("dim", "tile", "node", "copies", "vector").groupBy("dim", "tile").applyInArrow(_pack, _PACKED))
    meets = packed.withColumn("other", F.explode(F.sequence(F.lit(0), tiles[F.col("dim")].cast("int") - 1)))
    meets = meets.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    pair = lambda key, t: _tile_pair(key, t, threshold)
    found = stash(meets.groupBy("dim", "i", "j").applyInArrow(pair, "kind int, node long, links long, root long"))
    ends = [nodes.select(F.col("node").alias(n), F.col("vector").alias(x), F.col("copies").alias(f"c{n}")) for n, x in (("u", "x"), ("v", "y"))]
    left = found.where("kind = 1").select(F.col("node").alias("u"), F.col("root").alias("v")).join(ends[0], "u").join(ends[1], "v")
    more = stash(left.select("u", "v", "cu", "cv", "x", "y").mapInArrow(_recomputed(threshold), "u long, v long, cu long, cv long"))
    settled = found.where("kind = 0")
    links = settled.select("node", "links").unionByName(more.select(F.col("u").alias("node"), F.col("cv").alias("links"))).unionByName(more.select(F.col("v").alias("node"), F.col("cu").alias("links")))
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(settled.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more.select("u", "v")))
    own = nodes.join(named, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = own.groupBy("component").agg(F.min("least").alias("c"))
    of = nodes.select("node", "vector", "copies").join(links, "node", "left").join(own.select("node", "component").join(first, "component"), "node").select(
        F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "c"
    )
    out = rows.join(of, rows["vector"] == of["of"], "left")
    name = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(name == F.col("vec_id"), F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLE_SQL = {
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM u UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
)
SELECT u.vec_id, (SELECT count(*) FROM pairs p WHERE p.x = u.vec_id) AS n_links,
  (SELECT min(r.y) FROM reach r WHERE r.x = u.vec_id) AS component_id,
  (SELECT min(r.y) FROM reach r WHERE r.x = u.vec_id) = u.vec_id AS kept
FROM u
"""
}
