"""Verdicts on pairs of values, of rules and of records, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.udfs import SCORER, similarity
from .detect import IDENTIFIERS, kind_by_name, kind_of_values
from .prepare import TAX_AMOUNTS, rule_value

TOLERANCE = 0.005
VERDICT = "struct<matched:boolean,confidence:int,matcher_type:string,status:string,detail:string,value1_normalized:string,value2_normalized:string>"


def _verdict(matched: bool | Column, confidence: int | Column, kind: str | Column, status: str | Column, detail: str | Column = "", a: str | Column = "", b: str | Column = "") -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (matched, confidence, kind, status, detail, a, b)]
    return F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts))).cast(VERDICT)


def _both(a: Column, b: Column) -> Column:
    return F.concat(F.lit("File1: "), F.coalesce(a, F.lit("None")), F.lit(" | File2: "), F.coalesce(b, F.lit("None")))


def numeric(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Null where either is no number."""
    return N.let(F.struct(N.to_number(a).alias("n1"), N.to_number(b).alias("n2")), lambda f: _numeric(f, tolerance))


def _numeric(f: Column, tolerance: float) -> Column:
    x, y = f["n1"], f["n2"]
    diff = F.round(x - y, 2)
    s, t = x.cast("string"), y.cast("string")
    off = _verdict(False, 0, "numeric", "Numeric difference", F.concat(F.lit("Difference: "), diff.cast("string")), s, t)
    return F.when(x.isNull() | y.isNull(), None).when(F.abs(diff) <= tolerance, _verdict(True, 100, "numeric", "Exact numeric match", "", s, t)).otherwise(off)


def dates(a: Column, b: Column) -> Column:
    """Null where either is no date."""
    return N.let(F.struct(N.parse_date(a).alias("d1"), N.parse_date(b).alias("d2")), _dates)


def _dates(f: Column) -> Column:
    x, y = f["d1"], f["d2"]
    s, t = x.cast("string"), y.cast("string")
    return F.when(x.isNull() | y.isNull(), None).when(x == y, _verdict(True, 100, "date", "Exact date match", "", s, t)).otherwise(_verdict(False, 0, "date", "Date mismatch", _both(s, t), s, t))


def identifier(a: Column, b: Column, kind: str | Column, unicode: bool = False) -> Column:
    return N.let(forms(a, b, unicode), lambda f: _identifier(f, kind))


def identifier_of_sides(kind: str) -> Column:
    """The verdict on the keys of two sides, from the forms that the sides were written with (key_1, norm_1, compact_1 and those of side 2)."""
    return _identifier(_of_sides(), kind)


def told_of_sides(kind: str) -> dict[str, Column]:
    """What a pair tells of identifier_of_sides, without the rest of the verdict."""
    steps = _identifier_steps(_of_sides())
    by = lambda i, last: F.coalesce(*(F.when(s[0], F.lit(s[i])) for s in steps), F.lit(last))
    return {"match_type": F.lit(kind), "confidence": by(1, 0), "status": by(2, _MISMATCH)}


def _of_sides() -> dict[str, Column]:
    return {"a": F.col("key_1"), "b": F.col("key_2"), "x": F.col("norm_1"), "y": F.col("norm_2"), "c1": F.col("compact_1"), "c2": F.col("compact_2")}


_MISMATCH = "Identifier mismatch"


def _identifier_steps(f: Column | dict[str, Column]) -> list[tuple[Column, int, str]]:
    """(condition, confidence, status) of matches, the first of which counts."""
    x, y = f["c1"], f["c2"]
    return [
        ((x == "") & (y == ""), 100, "Both values blank"),
        ((x == y) & (f["x"] == f["y"]), 100, "Exact identifier match"),
        (x == y, 97, "Identifier formatting difference only"),
    ]


def _identifier(f: Column | dict[str, Column], kind: str | Column) -> Column:
    x, y = f["c1"], f["c2"]
    out = F.when(F.lit(False), None)
    for i, (same, confidence, status) in enumerate(_identifier_steps(f)):
        out = out.when(same, _verdict(True, confidence, kind, status, *(("", x, y) if i else ())))
    return out.otherwise(_verdict(False, 0, kind, _MISMATCH, _both(f["a"], f["b"]), x, y))


def forms(a: Column, b: Column, unicode: bool = False, kind: str | Column | None = None) -> Column:
    """Everything that a verdict looks at, each computed once: texts, compact keys, numbers, dates, long forms and word keys.

    Numbers and dates are read only where the kind, a name or a column, asks for them.
    """

    def only(of: str, value: Column) -> Column:
        if kind is None or isinstance(kind, str):
            return value if kind == of else F.lit(None).cast({"numeric": "double", "date": "date"}[of])
        return F.when(kind == of, value)

    first = F.struct(
        a.alias("a"), b.alias("b"), N.normalize_text(a, unicode=unicode).alias("x"), N.normalize_text(b, unicode=unicode).alias("y"),
        N.compact_identifier(a, unicode).alias("c1"), N.compact_identifier(b, unicode).alias("c2"), only("numeric", N.to_number(a)).alias("n1"), only("numeric", N.to_number(b)).alias("n2"),
        only("date", N.parse_date(a)).alias("d1"), only("date", N.parse_date(b)).alias("d2"),
    )
    own = ("a", "b", "x", "y", "c1", "c2", "n1", "n2", "d1", "d2")
    more = ("s", "t", "k", "m", "like")

    def second(f: Column) -> Column:
        words = F.size(F.filter(F.split(F.concat(f["x"], F.lit(" "), f["y"]), " "), lambda w: w != ""))
        like = words.between(4, 10) & ~F.concat(f["x"], f["y"]).rlike(r"\d")
        return F.struct(*(f[n].alias(n) for n in own), N.expand(f["x"]).alias("s"), N.expand(f["y"]).alias("t"), N.token_key(f["x"]).alias("k"), N.token_key(f["y"]).alias("m"), like.alias("like"))

    def third(f: Column) -> Column:
        return F.struct(*(f[n].alias(n) for n in own + more), N.token_key(f["s"]).alias("ks"), N.token_key(f["t"]).alias("ms"))

    return N.let(N.let(first, second), third)


def _settled(f: Column, names: bool | Column) -> Column:
    named = (F.lit(names) if isinstance(names, bool) else names) | f["like"]
    return (f["x"] == f["y"]) | (named & (f["k"] != "") & (f["k"] == f["m"])) | (f["s"] == f["t"]) | ((f["ks"] != "") & (f["ks"] == f["ms"]))


def _asked(f: Column, names: bool | Column, side: str) -> Column:
    """The text to be scored, null for pairs that need no score."""
    return F.when(~_settled(f, names), F.when(f[side] != "", f[side]).otherwise(f["x" if side == "s" else "y"]))


def _text(f: Column, kind: str | Column, names: bool | Column, score: Column) -> Column:
    named = (F.lit(names) if isinstance(names, bool) else names) | f["like"]
    x, y, s, t, k, m, ks, ms = (f[n] for n in ("x", "y", "s", "t", "k", "m", "ks", "ms"))
    return (
        F.when((x == "") & (y == ""), _verdict(True, 100, kind, "Both values blank"))
        .when(x == y, _verdict(True, 100, kind, "Exact text match", "", x, y))
        .when(named & (k != "") & (k == m), _verdict(True, 100, kind, "Name words reordered", "", k, m))
        .when(s == t, _verdict(True, 100, kind, "Business synonym match", "", s, t))
        .when((ks != "") & (ks == ms), _verdict(True, 100, kind, "Business synonym/name order match", "", ks, ms))
        .when(score >= 85, _verdict(True, score, kind, "Minor spelling variation", "", s, t))
        .when(score >= 75, _verdict(True, score, kind, "Possible Match - Manual Review", "", s, t))
        .otherwise(_verdict(False, score, kind, "No Match", _both(f["a"], f["b"]), s, t))
    )


NAMES = ("company_name", "person_name")


def verdict_of(f: Column, kind: str | Column, score: Column, tolerance: float = TOLERANCE) -> Column:
    """The verdict on `forms`, for a kind that is known or a column. Values that are no numbers or dates fall through to text."""
    if isinstance(kind, str):
        if kind in IDENTIFIERS:
            return _identifier(f, kind)
        if kind in NAMES:
            return _text(f, kind, True, score)
        plain = _text(f, "text", False, score)
        first = {"numeric": lambda: _numeric(f, tolerance), "date": lambda: _dates(f)}.get(kind)
        return F.coalesce(first(), plain) if first else plain
    named = kind.isin(*NAMES)
    words = _text(f, F.when(named, kind).otherwise("text"), named, score)
    return F.coalesce(F.when(kind == "numeric", _numeric(f, tolerance)), F.when(kind == "date", _dates(f)), F.when(kind.isin(*sorted(IDENTIFIERS)), _identifier(f, kind)), words)


def with_verdict(
    df: DataFrame, a: Column, b: Column, kind: str | Column, into: str, unicode: bool = False, scorer: str | None = SCORER, tolerance: float = TOLERANCE, where: Column | None = None,
) -> DataFrame:
    """Adds the verdict on two texts as struct `into`, and their forms as `into`_forms; both are null outside `where`.

    Forms are a column of their own, so nothing is computed twice; only pairs that no equality settles are scored.
    """
    f, s = f"{into}_forms", f"{into}_score"
    out = df.withColumn(f, forms(a, b, unicode, kind) if where is None else F.when(where, forms(a, b, unicode, kind)))
    names = (kind in NAMES) if isinstance(kind, str) else kind.isin(*NAMES)
    if not scorer or isinstance(kind, str) and kind in IDENTIFIERS:
        out = out.withColumn(s, F.lit(0))
    else:
        text_like = F.lit(True)
        if not isinstance(kind, str):
            number = (kind == "numeric") & F.col(f"{f}.n1").isNotNull() & F.col(f"{f}.n2").isNotNull()
            day = (kind == "date") & F.col(f"{f}.d1").isNotNull() & F.col(f"{f}.d2").isNotNull()
            text_like = ~(number | day | kind.isin(*sorted(IDENTIFIERS)))
        elif kind in ("numeric", "date"):
            p, q = ("n1", "n2") if kind == "numeric" else ("d1", "d2")
            text_like = F.col(f"{f}.{p}").isNull() | F.col(f"{f}.{q}").isNull()
        asked = [F.when(text_like, _asked(F.col(f), names, side)) for side in ("s", "t")]
        out = out.withColumn(s, F.coalesce(similarity(*asked, scorer), F.lit(0)))
    verdict = verdict_of(F.col(f), kind, F.col(s), tolerance)
    return out.withColumn(into, verdict if where is None else F.when(F.col(f).isNotNull(), verdict)).drop(s)


def text(a: Column, b: Column, kind: str, names: bool, unicode: bool = False) -> Column:
    """The ladder of equalities as one expression, without scores."""
    return N.let(forms(a, b, unicode), lambda f: _text(f, kind, names, F.lit(0)))


@dataclass(frozen=True)
class Rule:
    """Columns of file 1 and of file 2 whose values must agree."""

    file_1: Sequence[str]
    file_2: Sequence[str]
    label: str = field(default="")

    def name(self) -> str:
        return self.label or ",".join(self.file_1)

    def canonical(self) -> Rule:
        one, two = ([N.field(c) for c in side if N.field(c)] for side in (self.file_1, self.file_2))
        return Rule(one, two, self.label)


DIFFERENCE = "struct<field:string,file_1:string,file_2:string,numeric:boolean,difference:double,confidence:int,status:string,differs:boolean>"


def rule_columns(df: DataFrame, fields: Sequence[str], prefix: str) -> list[Column]:
    value, is_number = rule_value(df, fields)
    return [value.alias(f"{prefix}_value"), is_number.alias(f"{prefix}_numeric")]


def with_rule(df: DataFrame, rule: Rule, prefix: str, into: str, unicode: bool = False, scorer: str | None = SCORER, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds DIFFERENCE `into` of a rule, from its columns (rule_columns of both sides, prefix_1 and prefix_2).

    A numeric hint from either side decides the kind; else names and then the two values tell it.
    """
    a, b = F.col(f"{prefix}_1_value"), F.col(f"{prefix}_2_value")
    hinted = F.col(f"{prefix}_1_numeric") | F.col(f"{prefix}_2_numeric")
    known = kind_by_name(",".join(rule.file_1), ",".join(rule.file_2))
    out = df.withColumn(f"{into}_kind", F.when(hinted, "numeric").otherwise(F.lit(known) if known else kind_of_values(a, b)))
    out = with_verdict(out, a, b, F.col(f"{into}_kind"), f"{into}_v", unicode, scorer, tolerance)
    v, f = F.col(f"{into}_v"), F.col(f"{into}_v_forms")
    is_number = v["matcher_type"] == "numeric"
    diff = F.round(F.coalesce(f["n1"], F.lit(0.0)) - F.coalesce(f["n2"], F.lit(0.0)), 2)
    status = F.when(v["matched"], v["status"]).otherwise("Mismatch")
    parts = [F.lit(rule.name()), a, b, is_number, F.when(is_number, diff), v["confidence"], status, ~(v["matched"] & (v["confidence"] == 100))]
    return out.withColumn(into, F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts))).cast(DIFFERENCE)).drop(f"{into}_kind", f"{into}_v", f"{into}_v_forms")


def outcome(confidence: Column, differences: Column) -> Column:
    """Generic pairs: a difference where the key matched below 100 or any rule differs."""
    return F.when((confidence < 100) | (F.size(differences) > 0), "difference").otherwise("matched")


def tax_differences(one: dict[str, Column], two: dict[str, Column], v: Column, threshold: int = 85, tolerance: float = TOLERANCE) -> tuple[Column, Column]:
    """(differences, review notes) of a pair of tax rows: name (verdict v, null for equal names), date and six amounts.

    Entries are made for what differs only, and without functions that Spark interprets.
    """
    name = "NAME OF TRADER/FIRM/COMPANY"
    none, kind = F.lit(None).cast("double"), f"array<{DIFFERENCE}>"

    def entry(label: str, a: Column, b: Column, is_number: bool, diff: Column, confidence: Column, status: Column, differs: Column) -> Column:
        parts = [F.lit(label), a, b, F.lit(is_number), diff, confidence, status, F.lit(True)]
        return F.when(differs, F.array(F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts)))).cast(kind)).otherwise(F.array().cast(kind))

    matched, confidence = F.coalesce(v["matched"], F.lit(True)), F.coalesce(v["confidence"], F.lit(100))
    bad_name = ~matched | (confidence < threshold)
    day = [N.day_in_range(x["INVOICE DATE"]) for x in (one, two)]
    both_blank = one["INVOICE DATE"].isNull() & two["INVOICE DATE"].isNull()
    bad_date = ~both_blank & ~F.coalesce(day[0] == day[1], F.lit(False))
    told_date = F.when(day[0].isNull() | day[1].isNull(), "No Match").otherwise("Date mismatch")
    found = [
        entry("NAME", one[name], two[name], False, none, confidence, v["status"], bad_name),
        entry("DATE", one["INVOICE DATE"].cast("date").cast("string"), two["INVOICE DATE"].cast("date").cast("string"), False, none, F.lit(0), told_date, bad_date),
    ]
    for c in TAX_AMOUNTS:
        diff = F.round(one[c] - two[c], 2)
        found.append(entry(c, one[c].cast("string"), two[c].cast("string"), True, diff, F.lit(0), F.lit("Mismatch"), F.abs(diff) > tolerance))
    return F.concat(*found), entry("NAME", one[name], two[name], False, none, confidence, v["status"], ~bad_name & (confidence < 100))


def tax_outcome(confidence: Column, differences: Column, notes: Column) -> Column:
    return F.when(F.size(differences) > 0, "mismatched").when((confidence < 100) | (F.size(notes) > 0), "confidence_review").otherwise("matched")
