"""What kind of value a column holds, and validation of columns and rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N

# Parts of column names that tell a kind, in the order in which they are tried.
NAME_HINTS = (
    ("gstin", ("gstin", "gst no", "gstn")),
    ("pan", ("pan",)),
    ("invoice", ("invoice", "inv")),
    ("date", ("date", "dt", "period")),
    ("numeric", ("amount", "amt", "value", "tax", "igst", "cgst", "sgst", "cess", "debit", "credit", "balance", "qty", "quantity", "rate", "total")),
    ("identifier", ("invoice", "inv", "bill", "voucher", "po", "purchase order", "order no", "challan", "reference", "ref", "document", "doc", "code", "id")),
    ("company_name", ("name", "party", "vendor", "supplier", "customer", "trader", "firm", "company")),
)
SAMPLE = 100
IDENTIFIERS = frozenset(("invoice", "gstin", "pan", "identifier"))
TEXTS = frozenset(("text", "company_name", "person_name"))


def threshold(kind: str) -> int:
    return 95 if kind in IDENTIFIERS or kind in ("numeric", "date") else 75


def kind_by_name(name: str, other: str = "", strict: bool = False) -> str | None:
    """The kind that hints in the two names tell. They match inside words, as "pan" in "company"; `strict` asks for words."""
    import re
    import unicodedata

    text = unicodedata.normalize("NFKC", f"{name} {other}").lower().strip()
    text = " ".join(re.sub(r"[^\w\s&]", " ", re.sub(r"[/_.-]+", " ", text)).split())
    where = f" {text} " if strict else text
    for kind, hints in NAME_HINTS:
        if any((f" {h} " if strict else h) in where for h in hints):
            return kind
    return None


def shares(c: Column) -> dict[str, Column]:
    """Shares of values that look like each kind, as aggregates."""
    tests = {
        "gstin": N.looks_like_gstin(c), "pan": N.looks_like_pan(c), "numeric": N.to_number(c).isNotNull(),
        "date": N.parse_date(c).isNotNull(), "identifier": N.looks_like_identifier(c),
    }
    return {k: F.avg(F.coalesce(t, F.lit(False)).cast("double")).alias(k) for k, t in tests.items()}


def kind_by_shares(row: dict[str, float | None]) -> str:
    for kind, least in (("gstin", 0.8), ("pan", 0.8), ("numeric", 0.8), ("date", 0.8), ("identifier", 0.6)):
        if (row.get(kind) or 0.0) >= least:
            return kind
    return "text"


def kind_of_values(a: Column, b: Column) -> Column:
    """The kind of a single pair of values, as an expression: shares over the one or two that aren't blank."""
    both = F.filter(F.array(a, b), lambda x: ~N.is_blank(x))
    n = F.size(both)

    def share(test) -> Column:
        return F.size(F.filter(both, lambda x: F.coalesce(test(x), F.lit(False)))) / n

    out = F.when(n == 0, "text")
    for kind, test, least in (
        ("gstin", N.looks_like_gstin, 0.8), ("pan", N.looks_like_pan, 0.8), ("numeric", lambda x: N.to_number(x).isNotNull(), 0.8),
        ("date", lambda x: N.parse_date(x).isNotNull(), 0.8), ("identifier", N.looks_like_identifier, 0.6),
    ):
        out = out.when(share(test) >= least, kind)
    return out.otherwise("text")


def samples(sides: Iterable[tuple[DataFrame, str]], order: str = "_ROW_NO", limit: int = SAMPLE) -> DataFrame:
    """The first values that aren't blank, side by side in turn, as a bounded top-k: column value."""
    parts = [df.select(F.lit(i).alias("side"), F.col(order).alias("at"), N.cell(df, c).alias("value")) for i, (df, c) in enumerate(sides)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where(~N.is_blank(F.col("value"))).orderBy("side", "at").limit(limit)


def detect(df1: DataFrame, key1: str, df2: DataFrame, key2: str, strict: bool = False) -> str:
    """The kind of a pair of key columns: by their names, else by the values of at most SAMPLE rows."""
    if kind := kind_by_name(key1, key2, strict):
        return kind
    row = samples([(df1, key1), (df2, key2)]).agg(*shares(F.col("value")).values()).first()
    return kind_by_shares(row.asDict())


def numeric_columns(df: DataFrame, names: Sequence[str]) -> dict[str, bool]:
    """For each column: at least one value that isn't blank, and all such are numbers. One pass."""
    aggs = []
    for i, c in enumerate(names):
        filled = ~N.is_blank(N.cell(df, c))
        aggs += [F.coalesce(F.bool_or(filled), F.lit(False)).alias(f"a{i}"), F.coalesce(F.bool_and(~filled | N.number_of(df, c).isNotNull()), F.lit(True)).alias(f"b{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    return {c: row[f"a{i}"] and row[f"b{i}"] for i, c in enumerate(names)}


def summable(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that have a value and whose every value that isn't null is a number (so "" makes a column text). One pass."""
    if not names:
        return []
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count(df[N.quoted(c)]).alias(f"n{i}"), F.bool_and(df[N.quoted(c)].isNull() | N.number_of(df, c).isNotNull()).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(names) if row[f"n{i}"] and row[f"b{i}"]]


def has_unicode(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether any of the columns holds a character beyond ASCII. One pass; decides about NFKC."""
    texts = [c for c in names if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return False
    return bool(df.agg(F.bool_or(F.coalesce(F.concat_ws("", *map(N.quoted, texts)).rlike(r"[^\x00-\x7F]"), F.lit(False)))).first()[0])


# How the two complaints begin.
MISSING, NOT_NUMERIC = "missing columns", "Combined column mappings require numeric columns."


def require_columns(df: DataFrame, names: Iterable[str], label: str) -> None:
    if absent := [c for c in names if c not in df.columns]:
        raise KeyError(f"{label}: {MISSING} {', '.join(absent)}")


def require_numeric_rules(df1: DataFrame, df2: DataFrame, rules: Iterable[tuple[list[str], list[str]]]) -> None:
    """Rules of more than one column a side need numeric columns. Both sides are asked once, whatever the number of rules."""
    asked = [(rule, side, c) for rule, sides in enumerate(rules) if max(map(len, sides)) > 1 for side in (0, 1) for c in sides[side]]
    numeric = [numeric_columns(df, sorted({c for _, s, c in asked if s == side})) for side, df in enumerate((df1, df2))]
    bad = [(rule, side, c) for rule, side, c in asked if not numeric[side][c]]
    if bad:
        first = min(rule for rule, _, _ in bad)
        by_side = {side: ", ".join(c for rule, s, c in bad if (rule, s) == (first, side)) for side in (0, 1)}
        raise ValueError(f"{NOT_NUMERIC} {'; '.join(f'File {s + 1}: {c}' for s, c in by_side.items() if c)}")


def profile(df: DataFrame, table: str = "") -> DataFrame:
    """One row a column: table, name, kind (by its name's hints, else text) and filled, the number of its values that aren't blank."""
    counts = df.agg(*(F.count_if(~N.is_blank(N.cell(df, c))).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("name"), F.lit(kind_by_name(c) or "text").alias("kind"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*rows)))
