"""Reconciliation of two tables: each side is keyed and written once, then pairs are joined from the written sides.

What reaches the driver is bounded: column typing (one aggregate a side) and key detection (a top-100 sample). A side is written with its
keys, rule values and place in its block, bucketed by block, so that pairing and comparing identifier keys exchanges nothing
but the rows of blocks that hold several. Pairs are written once too. All of it lies in the shared folder until `release`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import compare as C
from ..operators import detect as D
from ..operators import match as M
from ..operators import prepare as P
from ..functions.udfs import SCORER
from ..sources.shared import Scratch, pinned

Progress = Callable[[int, str], None]


class Cancelled(Exception):
    pass


@dataclass(frozen=True)
class Spec:
    """What to reconcile: key columns, rules, extra columns of each side, and how."""

    key_1: str
    key_2: str
    rules: Sequence[C.Rule] = ()
    extras_1: Sequence[str] = ()
    extras_2: Sequence[str] = ()
    kind: str | None = None
    orientation: str = "vertical"
    scorer: str | None = SCORER
    tolerance: float = C.TOLERANCE
    strict_hints: bool = False
    name_1: str = "File 1"
    name_2: str = "File 2"


@dataclass
class Result:
    """Named tables of a run. `pairs` is long: one row a pair with its differences as an array, so no column set depends on data."""

    mode: str
    kind: str
    keys: list[str]
    names: tuple[str, str]
    left: DataFrame
    right: DataFrame
    pairs: DataFrame
    fields: list[str] = field(default_factory=list)
    scratch: Scratch | None = None

    @cached_property
    def matched(self) -> DataFrame:
        return self.pairs.where("outcome = 'matched'")

    @cached_property
    def reported(self) -> DataFrame:
        """Pairs with an issue: differences, and in the tax mode also those under review."""
        return self.pairs.where("outcome <> 'matched'")

    @cached_property
    def needs_review(self) -> DataFrame:
        return self.pairs.where("confidence < 100 OR outcome = 'confidence_review'")

    @cached_property
    def only_in_1(self) -> DataFrame:
        return _without(self.left, self.pairs, "row_1")

    @cached_property
    def only_in_2(self) -> DataFrame:
        return _without(self.right, self.pairs, "row_2")

    def release(self) -> None:
        """Deletes all that the run has written; its tables can't be read any more."""
        if self.scratch:
            self.scratch.release()

    def summary(self) -> DataFrame:
        """One row of counters, by one aggregation over pairs and one count of each side."""
        p = self.pairs.agg(
            F.count(F.lit(1)).alias("matched_records"),
            F.count_if(F.col("outcome") != "matched").alias("report_rows"),
            F.count_if(F.col("outcome") == "matched").alias("fully_matched_records"),
            F.count_if((F.col("outcome") == "confidence_review") if self.mode == "tax" else (F.col("confidence") < 100)).alias("confidence_review"),
        )
        one, two = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((self.left, "source_records_1"), (self.right, "source_records_2")))
        out = p.crossJoin(one).crossJoin(two)  # single rows
        return out.withColumns({"only_in_file_1": F.col("source_records_1") - F.col("matched_records"), "only_in_file_2": F.col("source_records_2") - F.col("matched_records")})


def _without(side: DataFrame, pairs: DataFrame, row: str) -> DataFrame:
    """Rows of a side that no pair has, with the side's columns in their order."""
    return side.join(pairs.select(row), side[P.ROW] == pairs[row], "left_anti")


def _owning(run: Callable[..., Result]) -> Callable[..., Result]:
    """A run with a Scratch of its own as first argument, released if the run fails; jobs that were cancelled make it Cancelled."""

    @wraps(run)
    def outer(file_1: DataFrame, *args: object, **named: object) -> Result:
        scratch = Scratch(file_1.sparkSession)
        try:
            return run(scratch, file_1, *args, **named)
        except BaseException as e:
            scratch.release()
            if "SPARK_JOB_CANCELLED" in str(e) or "cancelled job tag" in str(e):
                raise Cancelled("Reconciliation cancelled by user") from e
            raise

    return outer


def _check(progress: Progress | None, cancelled: Callable[[], bool] | None, percent: int, step: str) -> None:
    if cancelled and cancelled():
        raise Cancelled("Reconciliation cancelled by user")
    if progress:
        progress(percent, step)


def _numbered(df: DataFrame, order: Sequence[str | Column] | None, scratch: Scratch) -> DataFrame:
    if P.ROW in df.columns:
        return df
    return P.number_rows(df, list(order or df.columns), scratch)


def _own(names: Sequence[str]) -> list[str]:
    """Names of a side's own columns in its written table, where nothing may clash with them."""
    return [f"own {i}" for i in range(len(names))]


def _with_forms(side: DataFrame, n: int) -> DataFrame:
    return side.withColumns({f"norm_{n}": F.col("norm"), f"compact_{n}": F.col("compact")})


def _table(side: DataFrame, names: Sequence[str]) -> DataFrame:
    """The side's rows as they were, read back."""
    return side.select(*(F.col(f"`{o}`").alias(n) for o, n in zip(_own(names), names, strict=True)))


@_owning
def reconcile(
    scratch: Scratch, file_1: DataFrame, file_2: DataFrame, spec: Spec, order_1: Sequence[str] | None = None, order_2: Sequence[str] | None = None,
    progress: Progress | None = None, cancelled: Callable[[], bool] | None = None,
) -> Result:
    """Pairs rows of two tables by a key and compares mapped columns.

    Tables without _ROW_NO are numbered in the order of `order_1` and `order_2` (all columns if not given).
    """
    _check(progress, cancelled, 10, "reading")
    if P.is_horizontal(spec.orientation):
        file_1, file_2 = (P.transpose(df, P.ROW if P.ROW in df.columns else None) for df in (file_1, file_2))
        order_1 = order_2 = None
    one, two = (_numbered(df, o, scratch) for df, o in ((file_1, order_1), (file_2, order_2)))
    one, two = N.with_canonical_headers(one), N.with_canonical_headers(two)
    keys = [N.field(spec.key_1), N.field(spec.key_2)]
    rules = [r.canonical() for r in spec.rules]
    extras = [[N.field(c) for c in e] for e in (spec.extras_1, spec.extras_2)]
    D.require_columns(one, [keys[0], *(c for r in rules for c in r.file_1), *extras[0]], "File 1")
    D.require_columns(two, [keys[1], *(c for r in rules for c in r.file_2), *extras[1]], "File 2")
    D.require_numeric_rules(one, two, [(list(r.file_1), list(r.file_2)) for r in rules])
    used = [{keys[0], *(c for r in rules for c in r.file_1)}, {keys[1], *(c for r in rules for c in r.file_2)}]
    _check(progress, cancelled, 20, "normalising")
    unicode = D.has_unicode(one, sorted(used[0])) or D.has_unicode(two, sorted(used[1]))
    sides, names, shown = [], [], []
    for n, df, key, extra in ((1, one, keys[0], extras[0]), (2, two, keys[1], extras[1])):
        df = P.aggregate_by_key(df, key)
        payload = [F.col(P.ROW).alias(f"row_{n}"), N.cell(df, key).alias(f"key_{n}")]
        for i, r in enumerate(rules):
            payload += C.rule_columns(df, r.file_1 if n == 1 else r.file_2, f"r{i}_{n}")
        payload.append(F.struct(*(df[N.quoted(c)].alias(c) for c in extra)).alias(f"extra_{n}") if extra else F.lit(None).cast("string").alias(f"extra_{n}"))
        names.append(df.columns)
        shown.append([f"row_{n}", f"key_{n}", f"norm_{n}", f"compact_{n}", *(f"r{i}_{n}_{x}" for i in range(len(rules)) for x in ("value", "numeric")), f"extra_{n}"])
        payload += [df[N.quoted(c)].alias(o) for c, o in zip(df.columns, _own(df.columns), strict=True)]
        sides.append(_with_forms(M.side(df, P.ROW, N.cell(df, key), scratch, unicode=unicode, payload=payload), n))
    left, right = (_table(s, n) for s, n in zip(sides, names, strict=True))
    _check(progress, cancelled, 35, "matching")
    kind = spec.kind or D.detect(left, keys[0], right, keys[1], spec.strict_hints)
    met = M.match(*sides, kind, scratch, *shown, unicode, spec.scorer)
    _check(progress, cancelled, 55, "comparing")
    if kind in D.IDENTIFIERS:
        told = met.withColumn("_v", C.identifier_of_sides(kind))
    else:
        told = C.with_verdict(met, F.col("key_1"), F.col("key_2"), kind, "_v", unicode, spec.scorer, spec.tolerance)
    for i, r in enumerate(rules):
        told = C.with_rule(told, r, f"r{i}", f"_d{i}", unicode, spec.scorer, spec.tolerance)
    differences = F.filter(F.array(*(f"_d{i}" for i in range(len(rules)))), lambda x: x["differs"]) if rules else F.array().cast(f"array<{C.DIFFERENCE}>")
    told = told.withColumn("differences", differences)
    told = told.select(
        "row_1", "row_2", "key_1", "key_2", F.col("_v.matcher_type").alias("match_type"), F.col("_v.confidence").alias("confidence"),
        F.col("_v.status").alias("status"), "differences", "extra_1", "extra_2",
    )
    pairs = scratch.written(told.withColumn("outcome", C.outcome(F.col("confidence"), F.col("differences"))))
    _check(progress, cancelled, 75, "classifying")
    return Result("generic", kind, keys, (spec.name_1, spec.name_2), left, right, pairs, fields=[r.name() for r in rules], scratch=scratch)


@_owning
def reconcile_tax(
    scratch: Scratch, file_1: DataFrame, file_2: DataFrame, threshold: int = 85, order_1: Sequence[str] | None = None, order_2: Sequence[str] | None = None,
    scorer: str | None = SCORER, names: tuple[str, str] = ("File 1", "File 2"), progress: Progress | None = None, cancelled: Callable[[], bool] | None = None,
) -> Result:
    """The tax-invoice mode: fixed columns, duplicates merged, invoices paired inside each registration, names, dates and amounts compared."""
    _check(progress, cancelled, 10, "reading")
    one, two = (_numbered(df, o, scratch) for df, o in ((file_1, order_1), (file_2, order_2)))
    one, two = P.normalise_tax(one), P.normalise_tax(two)
    P.require_tax_columns(one, two)
    _check(progress, cancelled, 35, "matching")
    sides, tables = [], []
    held = {P.ROW: "id", "INVOICE NO.": "key", "GSTR": "grp"}  # what a side has anyway
    # a pair's columns of either side: records are put together from them where they are read
    flat = {c: ("key_1", "key_2") if c == "INVOICE NO." else (f"rec{i}_1", f"rec{i}_2") for i, c in enumerate(P.TAX_COLUMNS)}
    for n, df in ((1, one), (2, two)):
        df = P.merge_duplicate_invoices(df)
        at = {c: held.get(c, o) for c, o in zip(df.columns, _own(df.columns), strict=True)}
        payload = [df[N.quoted(c)].alias(o) for c, o in at.items() if c not in held]
        side = M.side(df, P.ROW, F.col("`INVOICE NO.`"), scratch, F.col("GSTR"), payload=payload, words=False)
        tables.append(side.select(*(F.col(f"`{o}`").alias(c) for c, o in at.items())))
        sides.append(_with_forms(side, n).withColumns({f"row_{n}": F.col("id")} | {flat[c][n - 1]: F.col(f"`{at[c]}`") for c in P.TAX_COLUMNS}))
    left, right = tables
    met = M.pair_blocks(*sides, scratch, *([f"row_{n}", f"norm_{n}", f"compact_{n}", *(c[n - 1] for c in flat.values())] for n in (1, 2)))
    _check(progress, cancelled, 55, "comparing")
    of = [{c: F.col(own[n]) for c, own in flat.items()} for n in (0, 1)]
    name = "NAME OF TRADER/FIRM/COMPANY"
    told = met.withColumns(C.told_of_sides("invoice")).drop("norm_1", "norm_2", "compact_1", "compact_2")
    differ = ~of[0][name].eqNullSafe(of[1][name]) if threshold <= 100 else None  # equal names are a match at 100
    told = pinned(C.with_verdict(told, of[0][name], of[1][name], "company_name", "_n", scorer=scorer, where=differ).drop("_n_forms"))
    differences, notes = C.tax_differences(of[0], of[1], F.col("_n"), threshold)
    told = pinned(told.withColumn("differences", differences).withColumn("notes", notes))
    once = list(dict.fromkeys(x for c, own in flat.items() for x in (own[:1] if c == "GSTR" else own)))  # both have one GSTR
    told = told.select("row_1", "row_2", *once, "match_type", "confidence", "status", "differences", "notes")
    told = scratch.written(told.withColumn("outcome", C.tax_outcome(F.col("confidence"), F.col("differences"), F.col("notes"))))
    of[1]["GSTR"] = of[0]["GSTR"]
    records = [F.struct(*(x[c].alias(c) for c in P.TAX_COLUMNS)).alias(f"record_{n}") for n, x in enumerate(of, 1)]
    pairs = told.select(
        "row_1", "row_2", of[0]["GSTR"].alias("gstr"), "key_1", "key_2", of[0][name].alias("name_1"), of[1][name].alias("name_2"),
        "match_type", "confidence", "status", "differences", "notes", *records, "outcome",
    )
    _check(progress, cancelled, 75, "classifying")
    return Result("tax", "invoice", ["INVOICE NO.", "INVOICE NO."], names, left, right, pairs, fields=["NAME", "DATE", *P.TAX_AMOUNTS], scratch=scratch)


def compare_values(spark, a: object, b: object, name_1: str = "", name_2: str = "", kind: str | None = None, scorer: str = SCORER) -> dict:
    """The verdict on a single pair of values."""
    row = spark.range(1).select(F.lit(None if a is None else str(a)).cast("string").alias("a"), F.lit(None if b is None else str(b)).cast("string").alias("b"))
    row = row.withColumn("kind", F.lit(kind or D.kind_by_name(name_1, name_2)) if kind or D.kind_by_name(name_1, name_2) else D.kind_of_values(F.col("a"), F.col("b")))
    return C.with_verdict(row, F.col("a"), F.col("b"), F.col("kind"), "v", True, scorer).select("v").first()["v"].asDict()
