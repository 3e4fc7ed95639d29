"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; its measurement and one failure bit are kept. A policy is a version and
a mask of the rules that reject: applying one, or asking what a rule alone would change (an ablation), is bit
arithmetic over the ledger and never touches the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stash, table, text_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurement columns, true where a document fails."""

    name: str
    fails: str


#: Bit i of `failed` is rule i. New rules go at the end, so that old ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_letters >= 40 AND 100 * n_upper > 30 * n_letters"),
    Rule("exclamation", "100 * n_exclaim > 25 * n_words"),
    Rule("long_words", "n_words >= 20 AND word_chars > 25 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rejects: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << i for i, r in enumerate(rules) if r.name in self.rejects)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", tuple(r.name for r in RULES)),
}


def _left(c: Column, drop: str) -> Column:
    """Code points of c without the runs that match `drop`."""
    return F.length(F.regexp_replace(c, drop, "")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row. Null text: no words. Repeated rows are measured each; extra columns go.

    Windows are compared by their 64-bit hash inside their own document; nothing is exchanged.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    split = rows.select(
        "doc_id",
        F.array_remove(F.split("text", SPACES), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _left(F.col("text"), SPACES).alias("word_chars"),
        _left(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _left(F.col("text"), r"[^!]+").alias("n_exclaim"),
        _left(F.col("text"), r"\P{L}+").alias("n_letters"),
        _left(F.col("text"), r"\P{Lu}+").alias("n_upper"),
    )
    hashed = split.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"if(size(words) < {WINDOW}, cast(array() AS array<bigint>), "
            f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))"
        ).alias("windows"),
    ).drop("words", "lines")
    ordered = hashed.withColumn(
        "by_hash",
        F.expr("if(size(array_distinct(windows)) = size(windows), NULL, array_sort(transform(windows, (h, i) -> struct(h, i))))"),
    ).drop("windows")
    repeated = ordered.withColumn(
        "at",
        F.expr("array_sort(transform(filter(by_hash, (x, k) -> coalesce(x.h = get(by_hash, k - 1).h, false) OR coalesce(x.h = get(by_hash, k + 1).h, false)), x -> x.i))"),
    ).drop("by_hash")
    covered = F.expr(
        "if(at IS NULL OR size(at) = 0, 0L, aggregate(sequence(0, size(at) - 1), 0L, "
        f"(n, k) -> n + least({WINDOW}, coalesce(get(at, k + 1) - at[k], {WINDOW}))))"
    )
    return repeated.withColumn("n_repeat_words", covered).drop("at")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and `failed`, a long with bit i set where rule i fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def kept(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule: how many documents fail it, and how many the policy rejects for it alone. Reads a ledger only."""
    mask = policy.mask(rules)
    hits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in each))).alias("r")
    return (
        hits.select("bits", "n", named)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("only_this"),
        )
    )


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of docs, all columns as they were, that the policy keeps; no exchange."""
    held = docs.select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    rows = held.select(F.struct("_id", "_row").alias("doc_id"), "text")
    # the partition's number keeps the filter above the measurements: pushed below, it would repeat them in each of its terms
    pinned = ledger(rows).withColumn("_pin", F.spark_partition_id())
    return pinned.filter(kept(policy) & (F.col("_pin") >= 0)).select("doc_id._row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept(POLICIES["base"])).alias("base_failed"), kept(POLICIES["v1"]).alias("kept"), "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with others, from a stored ledger: the texts are read once, for the ledger."""
    stored = stash(ledger(table(spark, sf_dir, "documents")))
    return ablations(stored, POLICIES["v1"])


_WORD = r"[^\x20\x09-\x0D]+"
QUERIES = {"op3_quality_rules": op3_quality_rules, "quality_ablations": quality_ablations}
ORACLE_SQL = {
    "op3_quality_rules": rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), runs AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS run FROM d, generate_series(1, len(w) - {WINDOW - 1}) AS g(i)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM again, range({WINDOW}) AS g(j) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim,
    length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper
  FROM d LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(f"({r.fails})" for r in RULES if r.name in BASE)}) AS base_failed, failed = 0 AS kept, failed
FROM (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))})::BIGINT AS failed FROM m)
"""
}
_EACH = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(RULES) if r.name in POLICIES["v1"].rejects)
ORACLE_SQL["quality_ablations"] = f"""
SELECT rule, count(*) FILTER (failed & bit <> 0) AS failing, count(*) FILTER (failed = bit) AS only_this
FROM ({ORACLE_SQL["op3_quality_rules"]}) l, (VALUES {_EACH}) AS e(rule, bit) GROUP BY rule
"""
