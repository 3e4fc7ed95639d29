"""Exceptions, field differences and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.reconcile import Result

# Absolute differences above which an exception is critical or high.
CRITICAL, HIGH = 1000.0, 100.0
#: Statuses that are exceptions; a percentage is one too.
OPEN = ("Mismatch", "Partial Match")


def severity(difference: Column) -> Column:
    return F.when(F.abs(difference) > CRITICAL, "Critical").when(F.abs(difference) > HIGH, "High").otherwise("Medium")


def numbered(pairs: DataFrame) -> DataFrame:
    """Adds `ordinal`, the place among reported pairs in file-1 order, and its exception id. Ranks are two-level, so no task sorts all rows."""
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = pairs.agg(F.min("row_1"), F.max("row_1")).first()
    width = max(1, ((bounds[1] or 0) - (bounds[0] or 0)) // (4 * n) + 1)
    dealt = pairs.withColumn("_b", F.floor((F.col("row_1") - F.lit(bounds[0] or 0)) / width))
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_b").alias("_of"), before.alias("_s"))  # at most 4 * n + 1 rows
    own = F.row_number().over(Window.partitionBy("_b").orderBy("row_1"))
    out = dealt.withColumn("_own", own).join(F.broadcast(starts), F.col("_b") == F.col("_of"))
    return out.withColumn("ordinal", (F.col("_s") + F.col("_own")).cast("long")).withColumn("exception_id", F.format_string("EX-%06d", F.col("ordinal"))).drop("_b", "_own", "_of", "_s")


def is_open(status: Column) -> Column:
    return status.isin(*OPEN) | status.endswith("%")


def exploded(result: Result) -> DataFrame:
    """One row for each difference of a reported pair."""
    return numbered(result.reported).select("ordinal", "exception_id", F.col("key_1").alias("match_key"), F.explode("differences").alias("d"))


def exceptions(result: Result) -> DataFrame:
    """The exception rows; in the tax mode every difference counts, whatever its status says."""
    rows = exploded(result)
    if result.mode == "generic":
        rows = rows.where(is_open(F.col("d.status")))
    two = F.col("d.file_2").try_cast("double")
    return rows.select(
        "ordinal", "exception_id", "match_key", F.col("d.field").alias("field"), F.col("d.file_1").alias("file_1_value"), F.col("d.file_2").alias("file_2_value"),
        F.col("d.difference").alias("difference"),
        F.when((two != 0) & F.col("d.difference").isNotNull(), F.try_divide(F.col("d.difference"), two)).alias("difference_pct"),
        F.when(F.col("d.difference").isNotNull(), "Value Difference").otherwise("Text Difference").alias("exception_type"),
        severity(F.col("d.difference")).alias("severity"), F.lit("Open").alias("status"), F.lit("").alias("action"),
    )


def field_differences(result: Result) -> DataFrame:
    return exceptions(result).select("match_key", "field", "file_1_value", "file_2_value", "difference", "difference_pct", F.lit("Mismatch").alias("result"))


def exception_summary(result: Result) -> DataFrame:
    """Counts by type, with a row for each side's missing records if there are any."""
    types = exceptions(result).groupBy("exception_type").agg(F.count(F.lit(1)).alias("n"))
    for df, name in ((result.only_in_1, "Missing in File 2"), (result.only_in_2, "Missing in File 1")):
        types = types.unionByName(df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("exception_type"), "n"))
    return types


def field_summary(result: Result) -> DataFrame:
    """Matches and mismatches of each field that some reported pair differs in, fully matched pairs counting for all."""
    rows = exploded(result).select(F.col("d.field").alias("field"), (is_open(F.col("d.status")) | F.lit(result.mode == "tax")).alias("bad"))
    by = rows.groupBy("field").agg(F.count_if("bad").alias("mismatched"), F.count_if(~F.col("bad")).alias("near"))
    whole = result.matched.agg(F.count(F.lit(1)).alias("whole"))
    out = by.crossJoin(whole).select("field", (F.col("near") + F.col("whole")).alias("matched"), "mismatched")  # one row a field, one row
    return out.withColumn("match_share", F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col("mismatched")), F.lit(0.0)))


def overall_status(result: Result) -> DataFrame:
    found = exceptions(result).agg(F.coalesce(F.bool_or(F.col("severity") == "Critical"), F.lit(False)).alias("critical"), (F.count(F.lit(1)) > 0).alias("any"))
    missing = result.summary().select((F.col("only_in_file_1") + F.col("only_in_file_2") > 0).alias("missing"))
    status = F.when(F.col("critical"), "CRITICAL EXCEPTIONS").when(F.col("any") | F.col("missing"), "EXCEPTIONS FOUND").otherwise("PASSED")
    return found.crossJoin(missing).select(status.alias("overall_status"))


def statistics(result: Result) -> DataFrame:
    return result.summary().select(
        F.col("source_records_1").alias("total_file_1"), F.col("source_records_2").alias("total_file_2"), F.col("fully_matched_records").alias("matched"),
        F.col("report_rows").alias("mismatched"), F.col("only_in_file_2").alias("missing_in_file_1"), F.col("only_in_file_1").alias("missing_in_file_2"),
    )


def accuracy(result: Result) -> DataFrame:
    """One row: fully matched pairs in percent of the records of file 1, 0 of none."""
    share = F.try_divide(100 * F.col("fully_matched_records"), F.col("source_records_1"))
    return result.summary().select(F.coalesce(share, F.lit(0.0)).alias("accuracy"))


def control_checks(result: Result) -> DataFrame:
    """Three checks: equal record counts, and no missing records either way."""
    s = F.struct
    row = lambda c, a, b, ok: s(F.lit(c).alias("control"), a.cast("string").alias("file_1"), b.cast("string").alias("file_2"), F.when(ok, "Pass").otherwise("Exception").alias("result"))
    one, two, m1, m2 = (F.col(c) for c in ("total_file_1", "total_file_2", "missing_in_file_1", "missing_in_file_2"))
    rows = F.array(row("Record Count", one, two, one == two), row("Missing Records (File 1)", m1, F.lit("-"), m1 == 0), row("Missing Records (File 2)", F.lit("-"), m2, m2 == 0))
    return statistics(result).select(F.explode(rows).alias("r")).select("r.*")
