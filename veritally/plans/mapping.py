"""Suggesting which columns of two tables belong together: names meet on their words, scores come from a table of rules, and
the columns take each other by the same assignment as rows do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import quoted
from ..operators.match import assign_edges
from ..sources.shared import Scratch

# Short words and their long forms; words that make a shared word weigh more; the score of each rule, the first that
# holds counts; the score of a full share of words where none holds; the least score of a suggestion.
ALIASES = {"emp": "employee", "empl": "employee", "dept": "department", "gross": "salary", "amt": "amount", "no": "number", "num": "number"}
KEY_WORDS = ("id", "name", "salary", "amount", "date", "department")
SCORES = (("joined_1 = joined_2", 100), ("shared = least(n_1, n_2)", 94), ("key_words > 0", 88))
SHARE = 90
LEAST = 85


def names_of(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """id, name, words and joined words of a table's columns, in order."""
    rows = spark.createDataFrame(list(enumerate(columns)), "id long, name string")
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    split = F.filter(F.split(F.regexp_replace(F.lower("name"), r"[_\-/.]+", " "), r"\s+"), lambda w: w != "")
    return rows.withColumn("words", F.transform(split, lambda w: F.coalesce(F.try_element_at(table, w), w))).withColumn("joined", F.concat_ws("", "words"))


def scored(left: DataFrame, right: DataFrame) -> DataFrame:
    """id1, id2, name_1, name_2 and confidence of the names that share a word or are the same when joined; others score 0."""
    one, two = (n.select(F.col("id").alias(f"id{i}"), F.col("name").alias(f"name_{i}"), F.col("words").alias(f"words_{i}"), F.col("joined").alias(f"joined_{i}")) for i, n in enumerate((left, right), 1))
    by_word = one.withColumn("w", F.explode(F.array_distinct("words_1"))).join(two.withColumn("w", F.explode(F.array_distinct("words_2"))), "w").drop("w")
    met = by_word.unionByName(one.join(two, F.col("joined_1") == F.col("joined_2"))).dropDuplicates(["id1", "id2"])
    both = F.filter("words_1", lambda w: F.array_contains(F.col("words_2"), w))
    sized = met.withColumns({
        "shared": F.size(both), "n_1": F.size("words_1"), "n_2": F.size("words_2"),
        "key_words": F.size(F.array_intersect(both, F.array(*map(F.lit, KEY_WORDS)))),
    })
    rules = " ".join(f"WHEN {test} THEN {score}" for test, score in SCORES)
    return sized.select("id1", "id2", "name_1", "name_2", F.expr(f"CASE {rules} ELSE int(floor(shared / greatest(n_1, n_2) * {SHARE} + 0.5)) END").alias("confidence"))


def suggest(spark: SparkSession, left: Sequence[str], right: Sequence[str], least: int = LEAST) -> DataFrame:
    """source, destination, confidence: in the order of the left columns each takes the best right one that is left, the first of equals."""
    found = scored(names_of(spark, left), names_of(spark, right)).where(F.col("confidence") >= least)
    edges = found.withColumns({"stage": F.lit(0), "priority": F.lit(0)})
    scratch = Scratch(spark)
    taken = [tuple(r) for r in assign_edges(edges, scratch).collect()]  # a pair a column at most
    scratch.release()
    pairs = spark.createDataFrame(taken, "id1 long, id2 long")
    return pairs.join(found, ["id1", "id2"]).orderBy("id1").select(F.col("name_1").alias("source"), F.col("name_2").alias("destination"), "confidence")


def evidence(left: DataFrame, right: DataFrame, suggestions: Sequence[tuple[str, str, int]]) -> DataFrame:
    """source, destination, confidence and common: how many values, printed, both columns of a suggestion hold."""
    out = None
    for source, destination, confidence in suggestions:
        a, b = (df.select(df[quoted(c)].cast("string").alias("v")).where("v IS NOT NULL").distinct() for df, c in ((left, source), (right, destination)))
        row = a.join(b, "v").agg(F.count(F.lit(1)).alias("common")).select(F.lit(source).alias("source"), F.lit(destination).alias("destination"), F.lit(confidence).alias("confidence"), "common")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else left.sparkSession.createDataFrame([], "source string, destination string, confidence int, common long")


def missing_required(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    have = {c.upper().strip() for c in columns}
    return [r for r in required if r not in have]
