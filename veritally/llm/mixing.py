"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source of size S and target T takes every document T / S times on average: the whole part of that is given to all, the fractional
part is a probability p of one copy more. Two fractional documents of a source trade: the words that one gains the other loses, by
a draw that keeps each expectation, until one of them is decided (p is 0 or 1). A group of about 32 documents trades
down to one document, the ones left of 32 groups trade in the next level, and so on up a tree, each level an exchange
of a 32nd of the rows of the level below. As words are conserved, a source ends within one document of its target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, attach, ordered_rank, stash, table, text_of

FAN_IN = 32
#: Equal rows of one row each are written out in runs of this many.
RUN = 10_000


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code point order, repeating; share: of all words; most: copies of one document."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: int = 11


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words): all that the rest needs, written once."""
    words = F.size(F.array_remove(F.split(text_of(), SPACES), "")).cast("long")
    return stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size")))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, n_docs, source_size and target of each source.

    The target of an open source is its weight times one level, that of a capped one `most` times its size. Every pass
    caps the open sources that the level lifts above their cap and takes a new level from what is left, one aggregate a pass; the
    level only rises, so that it ends.
    """
    own = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = ordered_rank(own, [F.col("source").asc_nulls_last()], "rank")
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    placed = stash(ranked.withColumn("weight", F.get(weights, (F.col("rank") % len(mix.weights)).cast("int"))).withColumn("cap", mix.most * F.col("source_size")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    goal, level, capped = min(mix.share, mix.most) * total, 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        now = placed.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("n")
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        level, capped = max(level, (goal - now["held"]) / now["open"]), now["n"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double"))
    return placed.select("source", "n_docs", "source_size", target.alias("target"))


def _trade(level: int, seed: int) -> str:
    """SQL of one trade between held document a.held and the next one x: (held, done) after it.

    up and down are the words' worth of probability that the held one can gain or lose before one of the two is decided;
    it gains with probability down / (up + down), which keeps both expectations.
    """
    decided = "array_append(a.done, struct({0}.doc_id, {0}.size, {1} AS bit))"
    keep = "struct({0}.h, {0}.doc_id, {0}.size, least(1D, greatest(0D, {1})) AS p)"
    cases = (
        ("v.gains AND 1 - a.held.p <= x.p * v.r", keep.format("x", "x.p - (1 - a.held.p) / v.r"), decided.format("a.held", "1L")),
        ("v.gains", keep.format("a.held", "a.held.p + x.p * v.r"), decided.format("x", "0L")),
        ("a.held.p <= (1 - x.p) * v.r", keep.format("x", "x.p + a.held.p / v.r"), decided.format("a.held", "0L")),
        ("true", keep.format("a.held", "a.held.p - (1 - x.p) * v.r"), decided.format("x", "1L")),
    )
    settled = "CASE " + " ".join(f"WHEN {c} THEN struct({held} AS held, {done} AS done)" for c, held, done in cases) + " END"
    draw = f"(shiftrightunsigned(xxhash64(a.held.h, x.h, {level}, {seed}), 11) + 0.5D) / {float(1 << 53)}D"
    ratio = "transform(array(x.size / a.held.size), r -> struct(r, least(1 - a.held.p, x.p * r) AS up, least(a.held.p, (1 - x.p) * r) AS down))"
    gains = f"transform({ratio}, w -> struct(w.r, {draw} * (w.up + w.down) < w.down AS gains))"
    return f"transform({gains}, v -> {settled})[0]"


def rounded(units: DataFrame, levels: int, seed: int) -> DataFrame:
    """doc_id, size, bit and the columns of its source for documents with h, size > 0, p and bucket (their group of the first level).

    Every level writes what it decided with the one document left of each group, so that no level is computed twice.
    """
    key, out = ["source_size", "target", "s", "bucket"], None
    for level in range(levels + 1):
        groups = units.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "size", "p"))).alias("docs"))
        start = "struct(docs[0] AS held, filter(array(struct(docs[0].doc_id, docs[0].size, 0L AS bit)), x -> false) AS done)"
        traded = F.expr(f"aggregate(slice(docs, 2, size(docs)), {start}, (a, x) -> {_trade(level, seed)})")
        step = stash(groups.select(*key, traded.alias("t")))
        done = step.select("source_size", "target", F.explode("t.done").alias("d")).select("source_size", "target", "d.*")
        out = done if out is None else out.unionByName(done)
        units = step.select("source_size", "target", "s", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "t.held.*")
    u = (F.shiftrightunsigned(F.xxhash64("h", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return out.unionByName(units.select("source_size", "target", "doc_id", "size", (u < F.col("p")).cast("long").alias("bit")))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row; source and text are its inputs.

    Null text: size 0, which takes nothing. Null source: a source of its own, the last. Null doc_ids count like others. Equal rows
    (doc_id, source and size) trade with each other at once: m of them with probability p are m * p whole copies and one
    document with the rest. An empty table gives no rows; where all sizes are 0 every target is 0; other columns are ignored.
    """
    sizes = measured(docs)
    sources = stash(targets(sizes, mix).withColumn("s", F.monotonically_increasing_id()))
    most = sources.agg(F.max("n_docs")).first()[0] or 0
    levels, width = 0, max(1, -(-most // FAN_IN))
    while width > 1:
        levels, width = levels + 1, -(-width // FAN_IN)
    rows = attach(sizes, sources, "source", "n_docs").groupBy("s", "n_docs", "source_size", "target", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    mean = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(mix.most)))).otherwise(0.0)
    parted = rows.withColumn("base", F.floor(mean)).withColumn("p", F.when(F.col("size") > 0, mean - F.floor(mean)).otherwise(0.0))
    ones = F.floor(F.col("m") * F.col("p"))
    shared = parted.withColumn("ones", ones).withColumn("rest", F.col("m") * F.col("p") - ones)
    shared = stash(shared.withColumn("open", (F.col("rest") > 0).cast("long")))
    h = F.xxhash64(F.lit(mix.seed), "doc_id", "size")
    bucket = F.pmod(h, F.greatest(F.lit(1), F.ceil(F.col("n_docs") / FAN_IN)))
    units = shared.where("open = 1").select("source_size", "target", "s", bucket.alias("bucket"), h.alias("h"), "doc_id", "size", F.col("rest").alias("p"))
    traded = rounded(units, levels, mix.seed).withColumn("n", F.lit(1).cast("long"))
    sure = F.array(F.struct(F.lit(1).cast("long").alias("bit"), F.col("ones").alias("n")), F.struct(F.lit(0).cast("long").alias("bit"), (F.col("m") - F.col("ones") - F.col("open")).alias("n")))
    plain = shared.select("source_size", "target", "doc_id", "size", F.explode(F.filter(sure, lambda x: x["n"] > 0)).alias("c")).select("source_size", "target", "doc_id", "size", "c.*")
    runs = traded.unionByName(plain).withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    each = runs.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({RUN}L, n - run * {RUN}))")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(mix.most))))).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * (whole + F.col("bit"))).cast("long").alias("taken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op11_mixing": op11_mixing}
#: Draws come from Spark's hash: SQL elsewhere can't give the same ones.
ORACLE_SQL: dict[str, str] = {}
