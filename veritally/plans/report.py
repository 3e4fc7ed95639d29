"""Report measures and sections as tables: what a workbook would compute in its cells."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import exceptions as X
from ..operators.prepare import TAX_COLUMNS
from .reconcile import Result

SECTIONS = ("executive_summary", "exceptions", "matched", "missing_1", "missing_2", "field_differences", "control_checks")


def distinct_flags(exceptions: DataFrame, key: str = "match_key", order: Sequence[str] = ("ordinal", "field")) -> DataFrame:
    """Adds `distinct_record`: 1 on the first row of each key in the order, else 0."""
    return exceptions.withColumn("distinct_record", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1).cast("int"))


def scalars(result: Result) -> DataFrame:
    """One row: matched, exceptions (distinct keys), mismatches (rows), missing_1, missing_2."""
    found = X.exceptions(result).agg(F.count_distinct("match_key").alias("exceptions"), F.count(F.lit(1)).alias("mismatches"))
    stats = X.statistics(result).select("matched", "missing_in_file_1", "missing_in_file_2", "total_file_1", "total_file_2")
    return stats.crossJoin(found)  # single rows


def kpis(result: Result) -> DataFrame:
    """Total in scope, matched, exceptions, missing, and the two rates (0 of an empty total)."""
    missing = F.col("missing_in_file_1") + F.col("missing_in_file_2")
    out = scalars(result).select((F.col("matched") + F.col("exceptions") + missing).alias("total"), "matched", "exceptions", missing.alias("missing"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0))
    return out.withColumns({"match_rate": rate("matched"), "exception_rate": rate("exceptions")})


def _shares(df: DataFrame, rows: Sequence[tuple[str, str]], label: str) -> DataFrame:
    every = sum((F.col(c) for _, c in rows[1:]), F.col(rows[0][1]))
    part = [F.struct(F.lit(n).alias(label), F.col(c).alias("n"), F.coalesce(F.try_divide(F.col(c), every), F.lit(0.0)).alias("share")) for n, c in rows]
    part.append(F.struct(F.lit("Total").alias(label), every.alias("n"), F.when(every > 0, 1.0).otherwise(0.0).alias("share")))
    return df.select(F.explode(F.array(*part)).alias("r")).select("r.*")


def outcomes(result: Result) -> DataFrame:
    one, two = result.names
    return _shares(scalars(result), (("Matched", "matched"), ("Exceptions", "exceptions"), (f"Missing - {one}", "missing_in_file_1"), (f"Missing - {two}", "missing_in_file_2")), "outcome")


def exception_breakdown(result: Result) -> DataFrame:
    one, two = result.names
    kinds = X.exceptions(result).agg(F.count_if(F.col("exception_type") == "Value Difference").alias("by_value"), F.count_if(F.col("exception_type") == "Text Difference").alias("by_text"))
    rows = (("Value Difference", "by_value"), ("Text Difference", "by_text"), (f"Missing in {one}", "missing_in_file_1"), (f"Missing in {two}", "missing_in_file_2"))
    return _shares(scalars(result).crossJoin(kinds), rows, "exception")


def field_performance(result: Result) -> DataFrame:
    """For each field with exceptions: all matched records, its mismatches, and the rate of the first."""
    by = X.exceptions(result).groupBy("field").agg(F.count(F.lit(1)).alias("mismatches"))
    out = by.crossJoin(X.statistics(result).select("matched")).select("field", "matched", "mismatches")
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col("mismatches")), F.lit(0.0)))


def top_field(result: Result) -> DataFrame:
    """The field with most mismatches, the first by name of equals."""
    return field_performance(result).orderBy(F.desc("mismatches"), "field").limit(1).select("field", "mismatches")


# The sentences of the summary sheet and the labels and results of its control checks, as printed. Braces hold measures and file names.
INSIGHTS = (
    "{match_percent} of records matched perfectly ({matched} of {total}).",
    "{exceptions} discrepant record(s) identified ({mismatches} field mismatches) - review required.",
    "{missing} record(s) missing from one or both sources ({missing_in_file_1} {name_1}, {missing_in_file_2} {name_2}).",
    "Field '{field}' has the highest exception count ({most}).",
)
# label, count of file 1, count of file 2, what passes, result of what doesn't
CHECKS = (
    ("Total records in scope", "matched + exceptions + missing_in_file_2", "matched + exceptions + missing_in_file_1", "missing_in_file_1 = missing_in_file_2", "Review"),
    ("Matched records (no differences)", "matched", "matched", "true", "Review"),
    ("Exception records (1+ field mismatch)", "exceptions", "exceptions", "exceptions = 0", "Review Required"),
    ("Records missing from {name_1}", "missing_in_file_1", None, "missing_in_file_1 = 0", "Review Required"),
    ("Records missing from {name_2}", None, "missing_in_file_2", "missing_in_file_2 = 0", "Review Required"),
)


def _printed(text: str, names: tuple[str, str]) -> Column:
    """A fixed text with its measures, which are columns, and file names put in."""
    known = {"name_1": F.lit(names[0]), "name_2": F.lit(names[1])}
    parts = []
    for plain, name, _, _ in Formatter().parse(text):
        parts.append(F.lit(plain))
        if name:
            parts.append(known.get(name, F.col(name).cast("string")))
    return F.concat(*parts)


def insights(result: Result) -> DataFrame:
    """The sentences of INSIGHTS in order."""
    top = top_field(result).agg(F.coalesce(F.first("field"), F.lit("-")).alias("field"), F.coalesce(F.first("mismatches"), F.lit(0)).alias("most"))
    rates = kpis(result).select("total", "missing", F.format_string("%.1f%%", F.col("match_rate") * 100).alias("match_percent"))
    measures = scalars(result).crossJoin(rates).crossJoin(top)  # single rows
    return measures.select(F.posexplode(F.array(*(_printed(t, result.names) for t in INSIGHTS))).alias("at", "insight"))


def control_checks(result: Result) -> DataFrame:
    """The rows of CHECKS: what each side counts, and Pass, Review or Review Required."""
    count = lambda sql: F.expr(f"string({sql})") if sql else F.lit("-")
    rows = [
        F.struct(_printed(label, result.names).alias("control"), count(one).alias("file_1"), count(two).alias("file_2"), F.when(F.expr(passes), "Pass").otherwise(other).alias("result"))
        for label, one, two, passes, other in CHECKS
    ]
    return scalars(result).select(F.inline(F.array(*rows)))


def display_percent(c, as_printed: bool = False):
    """A share as shown; `as_printed` divides values above 1 by 100, as the workbook did."""
    return F.when(c > 1.0, c / 100).otherwise(c) if as_printed else c


def widths(df: DataFrame, order: str, rows: int = 500, most: int = 60) -> DataFrame:
    """Column widths that fit the first rows: longest text or name, plus 2, at most 60."""
    head = df.orderBy(order).limit(rows)
    longest = [F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))).alias(c) for c in df.columns]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.least(F.col(f"`{c}`") + 2, F.lit(most)).cast("int").alias("width")) for c in df.columns)))
    return head.agg(*longest).select(cells.alias("r")).select("r.*")


def sections(result: Result, wanted: Sequence[str] = SECTIONS) -> dict[str, DataFrame]:
    """The report's tables by sheet, those that are wanted; with none, a single empty one."""
    from ..functions.normalise import missing_sheet_name

    one, two = result.names
    found = {
        "executive_summary": ("01 Executive Summary", lambda: kpis(result)),
        "exceptions": ("02 Exceptions", lambda: distinct_flags(X.exceptions(result))),
        "matched": ("03 Matched Records", lambda: result.matched.drop("differences")),
        "missing_1": (missing_sheet_name(1, one), lambda: result.only_in_2),
        "missing_2": (missing_sheet_name(2, two), lambda: result.only_in_1),
        "field_differences": ("06 Field Differences", lambda: X.field_differences(result)),
        "control_checks": ("07 Control Checks", lambda: control_checks(result)),
    }
    out = {found[s][0]: found[s][1]() for s in SECTIONS if s in wanted}
    return out or {"Empty": result.left.sparkSession.createDataFrame([], "empty string")}


# The sheets of the older layouts.
LEGACY = ("Results", "Only in File 1", "Only in File 2")
LEGACY_TAX = ("Mismatched Invoices", "{0} Missing in {1}", "{1} Missing in {0}", "Match Confidence Review")


def _days(df: DataFrame) -> DataFrame:
    """Times as ISO days."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    return df.withColumns({c: F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd") for c in times}) if times else df


def _flat(pairs: DataFrame) -> DataFrame:
    """Pairs of the tax mode with both records' columns beside each other, each named after its side."""
    both = [F.col(f"record_{n}").getField(c).alias(f"{c} {n}") for c in TAX_COLUMNS for n in (1, 2)]
    return _days(pairs.select(*both, "match_type", "confidence", "status", "differences", "notes"))


def legacy_sections(result: Result) -> dict[str, DataFrame]:
    """The older layouts: three sheets, or in the tax mode four, with whole records, ISO days and the review of key confidence."""
    if result.mode == "tax":
        tables = (_flat(result.pairs.where("outcome = 'mismatched'")), _days(result.only_in_1), _days(result.only_in_2), _flat(result.pairs.where("outcome = 'confidence_review'")))
        return {n.format(*result.names): t for n, t in zip(LEGACY_TAX, tables, strict=True)}
    return dict(zip(LEGACY, (result.reported, result.only_in_1, result.only_in_2), strict=True))
