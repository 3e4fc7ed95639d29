"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows.

File 1 is the orders table, file 2 a copy with rows dropped, keys formatted otherwise, prices and priorities changed and orphans added.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalise as N
from .functions.udfs import similarity
from .operators import compare as C
from .operators import detect as D
from .operators import exceptions as X
from .operators import jobs as J
from .operators import match as M
from .operators import prepare as P
from .plans import mapping, report
from .plans.reconcile import Result, Spec, reconcile, reconcile_tax
from .sources import tables as S
from .sources.shared import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return S.read_table(spark, f"{d}/{name}.parquet")


# ---- inputs

_KEY = "lpad(CAST(o_orderkey AS {text}), 8, '0')"
_FILE_1 = f"SELECT concat('ord', {_KEY}) AS ref, o_totalprice AS amount, o_orderpriority AS priority, o_orderdate AS ordered, o_orderkey AS okey FROM orders"
_FILE_2 = f"""
SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'ord' ELSE 'ORD-' END, {_KEY}) AS ref,
  o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 5 + (o_orderkey % 2000) ELSE 0 END AS amount,
  CASE WHEN o_orderkey % 19 = 0 THEN 'NONE GIVEN' ELSE lower(o_orderpriority) END AS priority, o_orderdate AS ordered, o_orderkey AS okey
FROM orders WHERE o_orderkey % 37 <> 0
UNION ALL SELECT concat('ORD-9', lpad(CAST(o_orderkey AS {{text}}), 7, '0')), o_totalprice, o_orderpriority, o_orderdate, -o_orderkey FROM orders WHERE o_orderkey % 101 = 0
"""


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    out = []
    for sql in (_FILE_1, _FILE_2):
        df = spark.sql(sql.replace("{text}", "string").replace("FROM orders", "FROM {orders}"), orders=orders)
        out.append(P.number_rows(df, ["ref"]))
    return out[0], out[1]


def _generic(spark: SparkSession, d: str) -> Result:
    one, two = _files(spark, d)
    rules = [C.Rule(["amount"], ["amount"]), C.Rule(["priority"], ["priority"])]
    return reconcile(one.drop("ordered", "okey"), two.drop("ordered", "okey"), Spec("ref", "ref", rules, kind="identifier", name_1="ledger.xlsx", name_2="bank.xlsx"))


#: The same pairs in SQL: keys are unique on both sides, so an equi-join on the compact key is the greedy assignment.
_CTE = f"""
WITH f1 AS (SELECT *, row_number() OVER (ORDER BY ref) + 1 AS row_no FROM ({_FILE_1.replace('{text}', 'VARCHAR')})),
f2 AS (SELECT *, row_number() OVER (ORDER BY ref) + 1 AS row_no FROM ({_FILE_2.replace('{text}', 'VARCHAR')})),
pairs AS (
  SELECT a.row_no AS row_1, b.row_no AS row_2, a.ref AS key_1, b.ref AS key_2,
    CASE WHEN lower(a.ref) = replace(lower(b.ref), '-', ' ') THEN 100 ELSE 97 END AS confidence,
    round(a.amount, 2) AS amount_1, round(b.amount, 2) AS amount_2, round(round(a.amount, 2) - round(b.amount, 2), 2) AS diff,
    lower(a.priority) <> lower(b.priority) AS bad_priority
  FROM f1 a JOIN f2 b ON regexp_replace(lower(a.ref), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b.ref), '[^a-z0-9]', '', 'g')
), judged AS (
  SELECT *, abs(diff) > 0.005 AS bad_amount, CASE WHEN confidence < 100 OR abs(diff) > 0.005 OR bad_priority THEN 'difference' ELSE 'matched' END AS outcome FROM pairs
), reported AS (
  SELECT *, row_number() OVER (ORDER BY row_1) AS ordinal FROM judged WHERE outcome = 'difference'
), exceptions AS (
  SELECT ordinal, printf('EX-%06d', ordinal) AS exception_id, key_1 AS match_key, 'AMOUNT' AS field, diff AS difference,
    CASE WHEN amount_2 <> 0 THEN diff / amount_2 END AS difference_pct, 'Value Difference' AS exception_type,
    CASE WHEN abs(diff) > 1000 THEN 'Critical' WHEN abs(diff) > 100 THEN 'High' ELSE 'Medium' END AS severity FROM reported WHERE bad_amount
  UNION ALL SELECT ordinal, printf('EX-%06d', ordinal), key_1, 'PRIORITY', NULL, NULL, 'Text Difference', 'Medium' FROM reported WHERE bad_priority
), s AS (
  SELECT (SELECT count(*) FROM f1) AS n1, (SELECT count(*) FROM f2) AS n2, (SELECT count(*) FROM judged) AS pairs,
    (SELECT count(*) FROM judged WHERE outcome = 'matched') AS matched, (SELECT count(*) FROM reported) AS reported,
    (SELECT count(*) FROM judged WHERE confidence < 100) AS review, (SELECT count(DISTINCT match_key) FROM exceptions) AS exceptions,
    (SELECT count(*) FROM exceptions) AS mismatches
), k AS (SELECT *, n2 - pairs AS missing_1, n1 - pairs AS missing_2 FROM s)
"""


# ---- scans and sinks


@query("SELECT o_orderkey AS okey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_no FROM orders")
def row_numbering(spark, d):
    out = P.number_rows(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return out.select(F.col("o_orderkey").alias("okey"), F.col(P.ROW).alias("row_no"))


@query("SELECT upper(column_name) AS name FROM (DESCRIBE supplier)")
def header_scan(spark, d):
    return spark.createDataFrame([(c,) for c in S.columns(spark, f"{d}/supplier.parquet")], "name string")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def page_slice(spark, d):
    rows, _ = S.page(_t(spark, d, "customer"), ["c_custkey"], 50, 25)
    return rows.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'tion_1')")
def text_search(spark, d):
    return S.search(_t(spark, d, "nation").select("n_nationkey", "n_name"), "TION_1")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, CASE WHEN r_regionkey >= 3 THEN r_regionkey * 1.5::DOUBLE END AS odd FROM region")
def json_sink(spark, d):
    """Not a number and both infinities come back as null."""
    odd = F.expr("CASE r_regionkey WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE r_regionkey * 1.5D END")
    rows = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", odd.alias("odd"))
    back = rows.select(F.from_json(S.json_row(rows), "r_regionkey long, r_name string, odd double").alias("j"))
    return back.select("j.*")


@query("""SELECT * FROM (VALUES ('INV-1001', '2025-03-01', 'ACME SUPPLIERS LTD', 15450.0::DOUBLE, 'OPERATIONS'), ('INV-1002', '2025-03-02', 'GLOBAL TECH SOLUTIONS', 8200.5, 'IT SERVICES'),
('INV-1003', '2025-03-05', 'NEXUS LOGISTICS INC', 24300.0, 'LOGISTICS')) AS t("Invoice No", "Invoice Date", "Vendor Name", "Amount", "Department")
UNION ALL SELECT o_orderkey::VARCHAR, o_orderdate::DATE::VARCHAR, c_name, o_totalprice, NULL FROM orders JOIN customer ON o_custkey = c_custkey""")
def general_template(spark, d):
    """The template's rows, and the orders in its shape."""
    shape = S.template(spark)
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("day", F.col("o_orderdate").cast("date"))
    return shape.unionByName(S.conformed(orders, shape, {"Invoice No": "o_orderkey", "Invoice Date": "day", "Vendor Name": "c_name", "Amount": "o_totalprice"}))


@query("""SELECT * FROM (VALUES ('GSTR-2B', 'ABC PRIVATE LIMITED', 'INV-005', '2025-03-05', 10000.0::DOUBLE, 1800.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 11800.0::DOUBLE),
('GSTR-2B', 'ABC PVT LTD', 'INV005', '2025-03-05', 5000.0, 900.0, 0.0, 0.0, 0.0, 5900.0), ('GSTR-2B', 'XYZ ENTERPRISES', 'INV-042', '2025-03-10', 20000.0, 0.0, 1800.0, 1800.0, 0.0, 23600.0))
AS t("GSTR", "NAME OF TRADER/FIRM/COMPANY", "INVOICE NO.", "INVOICE DATE", "TAXABLE VALUE", "IGST", "CGST", "SGST", "CESS", "INVOICE VALUE")
UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL, NULL, s_acctbal, NULL, NULL, NULL, NULL, NULL FROM supplier""")
def tax_template(spark, d):
    """The template's rows, and the suppliers in its shape."""
    shape = S.template(spark, tax=True)
    return shape.unionByName(S.conformed(_t(spark, d, "supplier"), shape, {"GSTR": "s_suppkey", "NAME OF TRADER/FIRM/COMPANY": "s_name", "TAXABLE VALUE": "s_acctbal"}))


@query("""WITH h AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 500)
SELECT 'c_name' AS "column", least(greatest(max(length(c_name)), 6) + 2, 60)::INT AS width FROM h
UNION ALL SELECT 'c_custkey', least(greatest(max(length(c_custkey::VARCHAR)), 9) + 2, 60)::INT FROM h""")
def column_widths(spark, d):
    return report.widths(_t(spark, d, "customer").select("c_name", "c_custkey"), "c_custkey")


# ---- normalisation

_BLANK = "coalesce(lower(trim({0})), '') IN ('', 'nan', 'none', 'nat')"
_NORM = r"CASE WHEN " + _BLANK + r" THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[/_.\-]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s&]', ' ', 'g'), '\s+', ' ', 'g')) END"
_COMPACT = "CASE WHEN " + _BLANK + " THEN '' ELSE regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') END"
_LONG = "array_to_string(list_transform(string_split({0}, ' '), lambda t: CASE t WHEN 'pvt' THEN 'private' WHEN 'priv' THEN 'private' WHEN 'ltd' THEN 'limited' WHEN 'co' THEN 'company' WHEN 'corp' THEN 'corporation' WHEN 'inc' THEN 'incorporated' WHEN 'llp' THEN 'limited liability partnership' ELSE t END), ' ')"
_NUMBER = (
    "CASE WHEN " + _BLANK + " THEN NULL ELSE try_cast(regexp_replace(CASE WHEN regexp_replace({0}, '[, ]', '', 'g') LIKE '(%)' "
    "THEN '-' || substr(regexp_replace({0}, '[, ]', '', 'g'), 2, length(regexp_replace({0}, '[, ]', '', 'g')) - 2) ELSE regexp_replace({0}, '[, ]', '', 'g') END, '[^0-9.+-]', '', 'g') AS DOUBLE) END"
)
_NAMES = "concat(s_name, CASE WHEN s_suppkey % 4 = 0 THEN ' Pvt. Ltd' WHEN s_suppkey % 4 = 1 THEN '/ACME_Corp & Co' WHEN s_suppkey % 4 = 2 THEN '  - LLP.' ELSE '' END)"


def _names(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", F.expr(_NAMES).alias("v"))


@query(f"SELECT s_suppkey, {_NORM.format('v')} AS norm FROM (SELECT s_suppkey, {_NAMES} AS v FROM supplier)")
def normalize_text(spark, d):
    return _names(spark, d).select("s_suppkey", N.normalize_text(F.col("v")).alias("norm"))


@query(f"SELECT s_suppkey, {_COMPACT.format('v')} AS compact FROM (SELECT s_suppkey, {_NAMES} AS v FROM supplier)")
def compact_identifier(spark, d):
    return _names(spark, d).select("s_suppkey", N.compact_identifier(F.col("v")).alias("compact"))


@query(f"SELECT s_suppkey, {_LONG.format('n')} AS long_form, array_to_string(list_sort(string_split({_LONG.format('n')}, ' ')), ' ') AS synonym_key FROM (SELECT s_suppkey, {_NORM.format('v')} AS n FROM (SELECT s_suppkey, {_NAMES} AS v FROM supplier))")
def business_synonyms(spark, d):
    v = F.col("v")
    return _names(spark, d).select("s_suppkey", N.normalize_text(v, True).alias("long_form"), N.sorted_token_key(v, True).alias("synonym_key"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_filter(string_split({_NORM.format('p_name')}, ' '), lambda t: t <> '')), ' ') AS token_key, len(list_filter(string_split({_NORM.format('p_name')}, ' '), lambda t: t <> ''))::BIGINT AS n_tokens FROM part")
def sorted_token_key(spark, d):
    c = F.col("p_name")
    return _t(spark, d, "part").select("p_partkey", N.sorted_token_key(c).alias("token_key"), F.size(N.tokens(c)).cast("long").alias("n_tokens"))


_MONEY = "CASE o_orderkey % 5 WHEN 0 THEN concat('(', CAST(o_orderkey AS {text}), ')') WHEN 1 THEN concat('Rs. ', CAST(o_orderkey AS {text})) WHEN 2 THEN concat(CAST(o_orderkey AS {text}), ',500.25') WHEN 3 THEN 'n/a' ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, {_NUMBER.format('v')} AS number, {_BLANK.format('v')} AS blank FROM (SELECT o_orderkey, {_MONEY.format(text='VARCHAR')} AS v FROM orders)")
def to_number(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.expr(_MONEY.format(text="string")).alias("v"))
    return rows.select("o_orderkey", N.to_number(F.col("v")).alias("number"), N.is_blank(F.col("v")).alias("blank"))


_FULL = "CASE month(d) " + " ".join(f"WHEN {i} THEN '{m.title()}'" for i, m in enumerate(N.MONTHS, 1)) + " END"
_MON = f"substr({_FULL}, 1, 3)"
_Y, _M, _D = (f"CAST({x}(d) AS {{text}})" for x in ("year", "month", "day"))
#: Ways to write a day; by order key.
_DATE_TEXTS = (
    "CAST(d AS {text})", "replace(CAST(d AS {text}), '-', '')", "replace(CAST(d AS {text}), '-', '/')", "'none'", f"concat({_M}, '/', {_D}, '/', {_Y})", f"concat({_D}, '/', {_M}, '/', {_Y})",
    f"concat({_MON}, ' ', {_D}, ' ', {_Y})", f"concat({_D}, '-', {_MON}, '-', {_Y})", f"concat({_FULL}, ' ', {_D}, ', ', {_Y})", "concat(CAST(d AS {text}), 'T23:59:59+05:30')",
    f"concat({_M}, '/', {_D}, '/', {_Y}, ' 11:05 PM')", f"concat({_D}, '.', {_M}, '.', {_Y})", f"concat({_MON}, ' ', {_Y})", f"concat('Wed, ', {_D}, ' ', {_MON}, ' ', {_Y})",
    f"concat({_D}, 'th ', {_FULL}, ' ', {_Y})", f"concat({_M}, '/', {_Y})", f"concat('INV-', {_Y})", f"concat({_M}, '/', {_D}, '/', substr({_Y}, 3, 2))",
)
_DATES = f"CASE o_orderkey % {len(_DATE_TEXTS)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_DATE_TEXTS)) + " END"


@query(f"""SELECT o_orderkey, CASE WHEN k IN (3, 16) THEN NULL WHEN k IN (5, 11) AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) WHEN k IN (12, 15) THEN make_date(year(d), month(d), 1) ELSE d END AS parsed
FROM (SELECT o_orderkey, o_orderkey % {len(_DATE_TEXTS)} AS k, o_orderdate::DATE AS d FROM orders)""")
def parse_date(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).select("o_orderkey", F.expr(_DATES.format(text="string")).alias("v"))
    return rows.select("o_orderkey", N.parse_date(F.col("v")).alias("parsed"))


_CODES = "CASE c_custkey % 4 WHEN 0 THEN concat('27abcde', lpad(CAST(c_custkey % 10000 AS {text}), 4, '0'), 'f1z5') WHEN 1 THEN concat('ABCDE-', lpad(CAST(c_custkey % 10000 AS {text}), 4, '0'), '-F') WHEN 2 THEN c_name ELSE 'no code' END"


@query(
    "SELECT c_custkey, regexp_full_match(u, '\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]') AS gstin, regexp_full_match(u, '[A-Z]{5}\\d{4}[A-Z]') AS pan, "
    "regexp_matches(u, '[A-Z]') AND regexp_matches(u, '[0-9]') AS identifier FROM (SELECT c_custkey, upper(regexp_replace(lower(v), '[^a-z0-9]', '', 'g')) AS u FROM (SELECT c_custkey, " + _CODES.format(text="VARCHAR") + " AS v FROM customer))"
)
def code_flags(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.expr(_CODES.format(text="string")).alias("v"))
    v = F.col("v")
    return rows.select("c_custkey", N.looks_like_gstin(v).alias("gstin"), N.looks_like_pan(v).alias("pan"), N.looks_like_identifier(v).alias("identifier"))


@query(f"""SELECT s_suppkey, NOT regexp_matches(n || ' ' || m, '[0-9]') AND len(list_filter(string_split(n || ' ' || m, ' '), lambda t: t <> '')) BETWEEN 4 AND 10 AS name_like FROM (
SELECT s_suppkey, {_NORM.format('a')} AS n, {_NORM.format('b')} AS m FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Alice B. Smith' ELSE s_name END AS a, CASE WHEN s_suppkey % 3 = 0 THEN 'Smith Alice' ELSE 'Bob' END AS b FROM supplier))""")
def name_like(spark, d):
    rows = _t(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'Alice B. Smith' ELSE s_name END").alias("a"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'Smith Alice' ELSE 'Bob' END").alias("b"))
    return rows.select("s_suppkey", N.looks_like_name(F.col("a"), F.col("b")).alias("name_like"))


# ---- detection


@query("""WITH v AS (SELECT c_name AS x FROM customer ORDER BY c_custkey LIMIT 100), n AS (SELECT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS c, try_cast(regexp_replace(x, '[^0-9.+-]', '', 'g') AS DOUBLE) AS num FROM v)
SELECT avg(regexp_full_match(upper(c), '\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]')::INT::DOUBLE) AS gstin, avg(regexp_full_match(upper(c), '[A-Z]{5}\\d{4}[A-Z]')::INT::DOUBLE) AS pan, avg((num IS NOT NULL)::INT::DOUBLE) AS "numeric",
0.0::DOUBLE AS "date", avg((regexp_matches(c, '[a-z]') AND regexp_matches(c, '[0-9]'))::INT::DOUBLE) AS identifier FROM n""".replace("\\\\", "\\"))
def detection_shares(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias(P.ROW), "c_name")
    return D.samples([(rows, "c_name")]).agg(*D.shares(F.col("value")).values())


_PROFILED = ("customer", "supplier", "part", "orders", "lineitem", "documents", "conversations")
_HINTED = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(t, '{h}')" for h in hints)} THEN '{kind}'" for kind, hints in D.NAME_HINTS) + " ELSE 'text' END"


def _profile_sql(table: str) -> str:
    return f"""SELECT '{table}' AS "table", column_name AS name, {_HINTED} AS kind, filled
FROM (SELECT column_name, lower(replace(column_name, '_', ' ')) AS t FROM (DESCRIBE {table}))
JOIN (UNPIVOT (SELECT count_if({_BLANK.format("COLUMNS(*)::VARCHAR").join(("NOT (", ")"))}) FROM {table}) ON COLUMNS(*) INTO NAME column_name VALUE filled) USING (column_name)"""


@query(" UNION ALL ".join(map(_profile_sql, _PROFILED)))
def detection_by_name(spark, d):
    """Kinds of the tables' columns by the hints in their names, with the number of filled values."""
    out = None
    for name in _PROFILED:
        rows = D.profile(_t(spark, d, name), name)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'o_totalprice' AS name, true AS is_numeric, true AS summed UNION ALL SELECT 'o_orderpriority', false, false UNION ALL SELECT 'o_custkey', true, true")
def numeric_columns(spark, d):
    names = ["o_totalprice", "o_orderpriority", "o_custkey"]
    df = _t(spark, d, "orders").select(*names)
    found, sums = D.numeric_columns(df, names), set(D.summable(df, names))
    return spark.createDataFrame([(n, found[n], n in sums) for n in names], "name string, is_numeric boolean, summed boolean")


# ---- preparation


@query("""SELECT l_orderkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, arg_min(l_returnflag, row_no) AS l_returnflag, min(row_no) AS row_no
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) + 1 AS row_no FROM lineitem) GROUP BY l_orderkey""")
def aggregate_by_key(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = P.number_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag"])
    out = P.aggregate_by_key(rows.select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", P.ROW), "l_orderkey")
    return out.withColumnRenamed(P.ROW, "row_no")


_TAX = """SELECT concat('27ABCDE', lpad(CAST(l_suppkey % 10 AS {text}), 4, '0'), 'F1Z5') AS `GSTR`, s_name AS `NAME OF TRADER/FIRM/COMPANY`, concat('INV-', lpad(CAST(l_orderkey AS {text}), 8, '0')) AS `INVOICE NO.`,
CAST(o_orderdate AS DATE) AS `INVOICE DATE`, l_extendedprice AS `TAXABLE VALUE`, l_extendedprice * l_tax AS `IGST`, 0.0 AS `CGST`, 0.0 AS `SGST`, l_discount AS `CESS`, l_extendedprice * (1 + l_tax) AS `INVOICE VALUE`,
l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"""
_TAX_SQL = _TAX.replace("{text}", "VARCHAR").replace("`", '"').replace("0.0 AS", "0.0::DOUBLE AS")
_TAX_ORDER = ["INVOICE NO.", "l_linenumber", "l_suppkey", "TAXABLE VALUE", "CESS"]


def _tax_table(spark, d):
    views = {n: _t(spark, d, n) for n in ("lineitem", "orders", "supplier")}
    sql = _TAX.replace("{text}", "string").replace("0.0 AS", "0.0D AS")
    for n in views:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **views)


@query(f"""SELECT "GSTR", "INVOICE NO.", v AS taxable, t AS igst FROM (SELECT "GSTR", "NAME OF TRADER/FIRM/COMPANY", "INVOICE NO.", "INVOICE DATE", round(sum("TAXABLE VALUE"), 2) AS v, round(sum("IGST"), 4) AS t FROM ({_TAX_SQL}) GROUP BY 1, 2, 3, 4)""")
def merge_duplicate_invoices(spark, d):
    rows = P.number_rows(_tax_table(spark, d), [F.col(f"`{c}`") for c in _TAX_ORDER]).drop("l_orderkey", "l_linenumber", "l_suppkey")
    out = P.merge_duplicate_invoices(P.normalise_tax(rows))
    return out.select("GSTR", F.col("`INVOICE NO.`"), F.round(F.col("`TAXABLE VALUE`"), 2).alias("taxable"), F.round("IGST", 4).alias("igst"))


@query("SELECT " + ", ".join(f"max(CASE WHEN n_name = 'NATION_{i}' THEN v END) AS \"NATION_{i}\"" for i in range(25)) + " FROM (SELECT n_name, 0 AS rec, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT n_name, 1, n_regionkey::VARCHAR FROM nation) GROUP BY rec")
def horizontal_transpose(spark, d):
    """The nation table read as a sheet of records in columns: a field for each nation, a record for each other column."""
    return P.transpose(_t(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey"))


@query(f"""WITH k AS (SELECT s_suppkey, {_COMPACT.format('s_name')} AS c, {_NORM.format('s_name')} AS n FROM supplier), q AS (SELECT s_suppkey AS id1, {_COMPACT.format('v')} AS c, {_NORM.format('v')} AS n
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('  ', upper(s_name)) WHEN s_suppkey % 3 = 1 THEN replace(s_name, '#', '-') ELSE concat(s_name, 'x') END AS v FROM supplier))
SELECT id1, id2, confidence FROM (SELECT id1, s_suppkey AS id2, CASE WHEN q.n = k.n THEN 100 ELSE 97 END AS confidence, row_number() OVER (PARTITION BY id1 ORDER BY q.n <> k.n, s_suppkey) AS r FROM q JOIN k ON q.c = k.c AND q.c <> '') WHERE r = 1""")
def best_match(spark, d):
    """For each of other spellings of the suppliers' names the supplier that fits best, by an index of terms."""
    suppliers = _t(spark, d, "supplier").select("s_suppkey", "s_name")
    spelled = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('  ', upper(s_name)) WHEN s_suppkey % 3 = 1 THEN replace(s_name, '#', '-') ELSE concat(s_name, 'x') END")
    values = suppliers.select(F.col("s_suppkey").alias("id"), spelled.alias("value"))
    return M.Lookup(suppliers, "s_name", "s_suppkey", Scratch(spark)).best_of(values, "identifier").select("id1", "id2", "confidence")


@query("SELECT o_orderkey, round(coalesce(try_cast(a AS DOUBLE), 0) + coalesce(try_cast(b AS DOUBLE), 0), 2) AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders)")
def combined_rule_value(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS string) END").alias("a"), F.expr("CAST(o_custkey AS string)").alias("b"))
    value, _ = P.rule_value(rows, ["a", "b"])
    return rows.select("o_orderkey", value.cast("double").alias("value"))


# ---- matching and comparison


@query(_CTE + "SELECT row_1, row_2, 0 AS priority FROM pairs")
def candidate_pairs(spark, d):
    one, two = _files(spark, d)
    found = M.candidates(M.keyed(one, P.ROW, F.col("ref")), M.keyed(two, P.ROW, F.col("ref")))
    return found.select(F.col("id1").alias("row_1"), F.col("id2").alias("row_2"), "priority")


@query(_CTE + "SELECT row_1, row_2, key_1, key_2, confidence, outcome, (bad_amount::INT + bad_priority::INT) AS n_differences FROM judged")
def generic_pairs(spark, d):
    return _generic(spark, d).pairs.select("row_1", "row_2", "key_1", "key_2", "confidence", "outcome", F.size("differences").alias("n_differences"))


@query(_CTE + "SELECT row_no, ref FROM f1 WHERE row_no NOT IN (SELECT row_1 FROM pairs)")
def only_in_file_1(spark, d):
    return _generic(spark, d).only_in_1.select(F.col(P.ROW).alias("row_no"), F.col("REF").alias("ref"))


@query(_CTE + "SELECT row_no, ref FROM f2 WHERE row_no NOT IN (SELECT row_2 FROM pairs)")
def only_in_file_2(spark, d):
    return _generic(spark, d).only_in_2.select(F.col(P.ROW).alias("row_no"), F.col("REF").alias("ref"))


@query(_CTE + "SELECT row_1, abs(diff) <= 0.005 AS matched, CASE WHEN abs(diff) <= 0.005 THEN 100 ELSE 0 END AS confidence, CASE WHEN abs(diff) <= 0.005 THEN 'Exact numeric match' ELSE 'Numeric difference' END AS status FROM pairs")
def numeric_verdict(spark, d):
    one, two = _files(spark, d)
    key = lambda c: N.compact_identifier(F.col(c))
    a = one.select(F.col(P.ROW).alias("row_1"), key("ref").alias("k"), F.round("amount", 2).cast("decimal(20,2)").cast("string").alias("a"))
    b = two.select(key("ref").alias("k"), F.round("amount", 2).cast("decimal(20,2)").cast("string").alias("b"))
    v = C.numeric(F.col("a"), F.col("b"))
    return a.join(b, "k").select("row_1", v["matched"].alias("matched"), v["confidence"].alias("confidence"), v["status"].alias("status"))


@query("SELECT o_orderkey, o_orderkey % 13 = 0 AS matched, CASE WHEN o_orderkey % 13 = 0 THEN 100 ELSE 0 END AS confidence, CASE WHEN o_orderkey % 13 = 0 THEN 'Exact date match' ELSE 'Date mismatch' END AS status FROM orders")
def date_verdict(spark, d):
    day = F.col("o_orderdate").cast("date")
    rows = _t(spark, d, "orders").select("o_orderkey", day.cast("string").alias("a"), F.date_add(day, (F.col("o_orderkey") % 13).cast("int")).cast("string").alias("b"))
    v = C.dates(F.col("a"), F.col("b"))
    return rows.select("o_orderkey", v["matched"].alias("matched"), v["confidence"].alias("confidence"), v["status"].alias("status"))


@query(_CTE + "SELECT row_1, confidence, CASE WHEN confidence = 100 THEN 'Exact identifier match' ELSE 'Identifier formatting difference only' END AS status FROM pairs")
def identifier_verdict(spark, d):
    return _generic(spark, d).pairs.select("row_1", "confidence", "status")


#: A pair for each rung of the ladder of texts; the last three are settled by scores that were worked out by hand (95, 83 and 0).
_RUNGS = (
    ("''", "'  '"), ("s_name", "upper(s_name)"), ("concat('Alpha ', s_name)", "concat(s_name, '-alpha')"), ("concat(s_name, ' Pvt. Ltd')", "concat(s_name, ' Private Limited')"),
    ("concat(s_name, ' Corp Ltd')", "concat('limited corporation ', s_name)"), ("'brightwater holdings'", "'brightwaters holding'"), ("'abcdef'", "'abxdef'"), ("'alpha'", "'zzz'"),
)
_A, _B = (f"CASE s_suppkey % {len(_RUNGS)} " + " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(_RUNGS)) + " END" for k in (0, 1))
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query(f"""WITH n AS (SELECT s_suppkey, {_NORM.format('a')} AS x, {_NORM.format('b')} AS y FROM (SELECT s_suppkey, {_A} AS a, {_B} AS b FROM supplier)),
l AS (SELECT *, {_LONG.format('x')} AS s, {_LONG.format('y')} AS t FROM n)
SELECT s_suppkey, CASE WHEN x = '' AND y = '' THEN 'Both values blank' WHEN x = y THEN 'Exact text match' WHEN {_SORTED.format('x')} = {_SORTED.format('y')} THEN 'Name words reordered' WHEN s = t THEN 'Business synonym match'
WHEN {_SORTED.format('s')} = {_SORTED.format('t')} THEN 'Business synonym/name order match' ELSE ['Minor spelling variation', 'Possible Match - Manual Review', 'No Match'][s_suppkey % 8 - 4] END AS status,
CASE s_suppkey % 8 WHEN 5 THEN 95 WHEN 6 THEN 83 WHEN 7 THEN 0 ELSE 100 END::INT AS confidence FROM l""")
def text_ladder(spark, d):
    rows = _t(spark, d, "supplier").select("s_suppkey", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    return C.with_verdict(rows, F.col("a"), F.col("b"), "company_name", "v").select("s_suppkey", "v.status", "v.confidence")


_CYRILLIC = "translate(CAST(s_suppkey AS {text}), '0123456789', 'абвгдежзик')"
#: Keys of four kinds that meet by their compact form, their text, their words, and their long forms.
_KEYS = (
    ("concat('Firm ', {k}, ' Ltd')", "concat('FIRM-', {k}, ', ltd')"), ("concat('фирма ', {c})", "concat('ФИРМА / ', {c})"),
    ("concat('Firm ', {k}, ' Ltd')", "concat('ltd ', {k}, ' firm')"), ("concat('Firm ', {k}, ' Pvt Ltd')", "concat('firm ', {k}, ' private limited')"),
)


def _key_sql(side: int, text: str) -> str:
    return "CASE s_suppkey % 4 " + " ".join(f"WHEN {i} THEN {pair[side]}" for i, pair in enumerate(_KEYS)).replace("{k}", f"CAST(s_suppkey AS {text})").replace("{c}", _CYRILLIC.format(text=text)) + " END"


@query(f"""WITH a AS (SELECT s_suppkey AS id, {_NORM.format('v')} AS n, {_COMPACT.format('v')} AS c FROM (SELECT s_suppkey, {_key_sql(0, 'VARCHAR')} AS v FROM supplier)),
b AS (SELECT s_suppkey AS id, {_NORM.format('v')} AS n, {_COMPACT.format('v')} AS c FROM (SELECT s_suppkey, {_key_sql(1, 'VARCHAR')} AS v FROM supplier)),
p AS (SELECT a.id AS id1, b.id AS id2, CASE WHEN a.c = b.c AND a.c <> '' THEN 0 WHEN a.n = b.n THEN 1 WHEN {_SORTED.format('a.n')} = {_SORTED.format('b.n')} THEN 2
  WHEN {_SORTED.format(_LONG.format('a.n'))} = {_SORTED.format(_LONG.format('b.n'))} THEN 3 END AS priority FROM a JOIN b ON a.id = b.id OR a.c = b.c)
SELECT * FROM p WHERE priority IS NOT NULL""")
def text_candidates(spark, d):
    """Candidates of every priority."""
    sides = [_t(spark, d, "supplier").select(F.col("s_suppkey").alias(P.ROW), F.expr(_key_sql(i, "string")).alias("v")) for i in (0, 1)]
    return M.candidates(*(M.keyed(s, P.ROW, F.col("v")) for s in sides)).select("id1", "id2", "priority")


@query(f"""WITH a AS (SELECT s_suppkey AS id, {_NORM.format('v')} AS n, {_COMPACT.format('v')} AS c FROM (SELECT s_suppkey, {_key_sql(0, 'VARCHAR')} AS v FROM supplier)),
b AS (SELECT s_suppkey AS id, {_NORM.format('v')} AS n, {_COMPACT.format('v')} AS c FROM (SELECT s_suppkey, {_key_sql(1, 'VARCHAR')} AS v FROM supplier))
SELECT a.id + 2 AS row_1, b.id + 2 AS row_2, 100 AS confidence, CASE WHEN a.n = b.n THEN 'Exact text match' WHEN {_SORTED.format('a.n')} = {_SORTED.format('b.n')} THEN 'Name words reordered' ELSE 'Business synonym match' END AS status FROM a JOIN b USING (id)""")
def name_key_pairs(spark, d):
    """A reconciliation by company names whose pairs no score is needed for: edges, assignment and verdicts."""
    sides = [_t(spark, d, "supplier").select((F.col("s_suppkey") + 2).alias(P.ROW), F.expr(_key_sql(i, "string")).alias("v")) for i in (0, 1)]
    return reconcile(*sides, Spec("v", "v", kind="company_name", scorer=None)).pairs.select("row_1", "row_2", "confidence", "status")


@query(_CTE + "SELECT pairs AS matched_records, reported AS report_rows, matched AS fully_matched_records, review AS confidence_review, n1 AS source_records_1, n2 AS source_records_2, missing_2 AS only_in_file_1, missing_1 AS only_in_file_2 FROM k")
def generic_summary(spark, d):
    return _generic(spark, d).summary()


@query("SELECT o_orderkey AS row_key, round(o_totalprice, 2) AS header, round(coalesce(s, 0), 2) AS detail, s IS NULL AS no_lines FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def header_detail_control(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    out = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(F.col("o_orderkey").alias("row_key"), F.round("o_totalprice", 2).alias("header"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("detail"), F.col("s").isNull().alias("no_lines"))


# ---- exceptions and reports


@query(_CTE + "SELECT ordinal, exception_id, match_key, field, difference, round(difference_pct, 9) AS difference_pct, exception_type, severity FROM exceptions")
def exception_rows(spark, d):
    out = X.exceptions(_generic(spark, d))
    return out.select("ordinal", "exception_id", "match_key", "field", "difference", F.round("difference_pct", 9).alias("difference_pct"), "exception_type", "severity")


@query(_CTE + "SELECT exception_type, count(*) AS n FROM exceptions GROUP BY 1 UNION ALL SELECT 'Missing in File 2', missing_2 FROM k WHERE missing_2 > 0 UNION ALL SELECT 'Missing in File 1', missing_1 FROM k WHERE missing_1 > 0")
def exception_summary(spark, d):
    return X.exception_summary(_generic(spark, d))


@query(_CTE + "SELECT field, any_value(matched) AS matched, count(*) AS mismatched, round(any_value(matched) / (any_value(matched) + count(*)), 9) AS match_share FROM exceptions, k GROUP BY field")
def field_summary(spark, d):
    return X.field_summary(_generic(spark, d)).withColumn("match_share", F.round("match_share", 9))


@query(_CTE + "SELECT CASE WHEN (SELECT bool_or(severity = 'Critical') FROM exceptions) THEN 'CRITICAL EXCEPTIONS' WHEN mismatches > 0 OR missing_1 + missing_2 > 0 THEN 'EXCEPTIONS FOUND' ELSE 'PASSED' END AS overall_status FROM k")
def overall_status(spark, d):
    return X.overall_status(_generic(spark, d))


@query(_CTE + "SELECT n1 AS total_file_1, n2 AS total_file_2, matched, reported AS mismatched, missing_1 AS missing_in_file_1, missing_2 AS missing_in_file_2 FROM k")
def run_statistics(spark, d):
    return X.statistics(_generic(spark, d))


@query(_CTE + "SELECT round(100 * matched / n1, 9) AS accuracy FROM k")
def result_accuracy(spark, d):
    return X.accuracy(_generic(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


@query(_CTE + "SELECT 'Record Count' AS control, n1::VARCHAR AS file_1, n2::VARCHAR AS file_2, CASE WHEN n1 = n2 THEN 'Pass' ELSE 'Exception' END AS result FROM k UNION ALL SELECT 'Missing Records (File 1)', missing_1::VARCHAR, '-', CASE WHEN missing_1 = 0 THEN 'Pass' ELSE 'Exception' END FROM k UNION ALL SELECT 'Missing Records (File 2)', '-', missing_2::VARCHAR, CASE WHEN missing_2 = 0 THEN 'Pass' ELSE 'Exception' END FROM k")
def control_checks(spark, d):
    return X.control_checks(_generic(spark, d))


@query(_CTE + "SELECT exception_id, field, (row_number() OVER (PARTITION BY match_key ORDER BY ordinal, field) = 1)::INT AS distinct_record FROM exceptions")
def distinct_record_flag(spark, d):
    return report.distinct_flags(X.exceptions(_generic(spark, d))).select("exception_id", "field", "distinct_record")


_TOTAL = "(matched + exceptions + missing_1 + missing_2)"


@query(_CTE + f"SELECT {_TOTAL} AS total, matched, exceptions, missing_1 + missing_2 AS missing, round(matched / {_TOTAL}, 9) AS match_rate, round(exceptions / {_TOTAL}, 9) AS exception_rate FROM k")
def executive_kpis(spark, d):
    out = report.kpis(_generic(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("match_rate", "exception_rate")})


def _shares_sql(label: str, rows: list[tuple[str, str]]) -> str:
    total = " + ".join(c for _, c in rows)
    parts = [f"SELECT '{n}' AS {label}, {c} AS n, round(({c}) / ({total}), 9) AS share FROM j" for n, c in rows]
    return " UNION ALL ".join([*parts, f"SELECT 'Total', {total}, 1.0 FROM j"])


_J = _CTE + ", j AS (SELECT *, (SELECT count(*) FROM exceptions WHERE exception_type = 'Value Difference') AS by_value, (SELECT count(*) FROM exceptions WHERE exception_type = 'Text Difference') AS by_text FROM k) "


@query(_J + _shares_sql("outcome", [("Matched", "matched"), ("Exceptions", "exceptions"), ("Missing - ledger.xlsx", "missing_1"), ("Missing - bank.xlsx", "missing_2")]))
def outcome_table(spark, d):
    return report.outcomes(_generic(spark, d)).withColumn("share", F.round("share", 9))


@query(_J + _shares_sql("exception", [("Value Difference", "by_value"), ("Text Difference", "by_text"), ("Missing in ledger.xlsx", "missing_1"), ("Missing in bank.xlsx", "missing_2")]))
def exception_breakdown(spark, d):
    return report.exception_breakdown(_generic(spark, d)).withColumn("share", F.round("share", 9))


@query(_CTE + "SELECT field, any_value(matched) AS matched, count(*) AS mismatches, round(any_value(matched) / (any_value(matched) + count(*)), 9) AS rate FROM exceptions, k GROUP BY field")
def field_performance(spark, d):
    return report.field_performance(_generic(spark, d)).withColumn("rate", F.round("rate", 9))


@query(_CTE + "SELECT field, count(*) AS mismatches FROM exceptions GROUP BY field ORDER BY 2 DESC, 1 LIMIT 1")
def top_field(spark, d):
    return report.top_field(_generic(spark, d))


@query(_CTE + f""", top AS (SELECT field, count(*) AS most FROM exceptions GROUP BY field ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 0 AS at, printf('%.1f%%', 100 * matched / {_TOTAL}) || ' of records matched perfectly (' || matched || ' of ' || {_TOTAL} || ').' AS insight FROM k
UNION ALL SELECT 1, exceptions || ' discrepant record(s) identified (' || mismatches || ' field mismatches) - review required.' FROM k
UNION ALL SELECT 2, (missing_1 + missing_2) || ' record(s) missing from one or both sources (' || missing_1 || ' ledger.xlsx, ' || missing_2 || ' bank.xlsx).' FROM k
UNION ALL SELECT 3, 'Field ''' || field || ''' has the highest exception count (' || most || ').' FROM top""")
def key_insights(spark, d):
    return report.insights(_generic(spark, d))


@query(_CTE + """SELECT 'Total records in scope' AS control, (matched + exceptions + missing_2)::VARCHAR AS file_1, (matched + exceptions + missing_1)::VARCHAR AS file_2, CASE WHEN missing_1 = missing_2 THEN 'Pass' ELSE 'Review' END AS result FROM k
UNION ALL SELECT 'Matched records (no differences)', matched::VARCHAR, matched::VARCHAR, 'Pass' FROM k
UNION ALL SELECT 'Exception records (1+ field mismatch)', exceptions::VARCHAR, exceptions::VARCHAR, CASE WHEN exceptions = 0 THEN 'Pass' ELSE 'Review Required' END FROM k
UNION ALL SELECT 'Records missing from ledger.xlsx', missing_1::VARCHAR, '-', CASE WHEN missing_1 = 0 THEN 'Pass' ELSE 'Review Required' END FROM k
UNION ALL SELECT 'Records missing from bank.xlsx', '-', missing_2::VARCHAR, CASE WHEN missing_2 = 0 THEN 'Pass' ELSE 'Review Required' END FROM k""")
def report_controls(spark, d):
    return report.control_checks(_generic(spark, d))


# ---- tax mode


def _tax(spark, d) -> Result:
    rows = P.number_rows(_tax_table(spark, d), [F.col(f"`{c}`") for c in _TAX_ORDER])
    two = rows.where("l_orderkey % 29 <> 0")
    two = two.withColumn("TAXABLE VALUE", F.col("TAXABLE VALUE") + F.when(F.col("l_orderkey") % 17 == 0, 10.0).otherwise(0.0))
    two = two.withColumn("INVOICE NO.", F.when(F.col("l_orderkey") % 7 == 0, F.replace(F.col("`INVOICE NO.`"), F.lit("-"), F.lit(""))).otherwise(F.col("`INVOICE NO.`")))
    name = "NAME OF TRADER/FIRM/COMPANY"
    two = two.withColumn("INVOICE DATE", F.when(F.col("l_orderkey") % 31 == 0, F.date_add("INVOICE DATE", 1)).otherwise(F.col("INVOICE DATE")))
    two = two.withColumn(name, F.when(F.col("l_orderkey") % 23 == 0, F.replace(F.col(name), F.lit("pp"), F.lit("p"))).otherwise(F.col(name)))
    gone = ("l_orderkey", "l_linenumber", "l_suppkey")
    return reconcile_tax(rows.drop(*gone), two.drop(*gone))


_TAX_CTE = f"""
WITH src AS (SELECT *, row_number() OVER (ORDER BY "INVOICE NO.", l_linenumber, l_suppkey, "TAXABLE VALUE", "CESS") + 1 AS row_no FROM ({_TAX_SQL})),
a AS (SELECT "GSTR" AS g, "NAME OF TRADER/FIRM/COMPANY" AS nm, l_orderkey AS o, sum("TAXABLE VALUE") AS v, min(row_no) AS r, any_value("INVOICE DATE") AS d FROM src GROUP BY 1, 2, 3),
b AS (SELECT g, nm, o, v + 0 AS v, r FROM (SELECT "GSTR" AS g, "NAME OF TRADER/FIRM/COMPANY" AS nm, l_orderkey AS o, sum("TAXABLE VALUE" + CASE WHEN l_orderkey % 17 = 0 THEN 10 ELSE 0 END) AS v, min(row_no) AS r FROM src WHERE l_orderkey % 29 <> 0 GROUP BY 1, 2, 3)),
ra AS (SELECT *, row_number() OVER (PARTITION BY g, o ORDER BY r) AS k FROM a), rb AS (SELECT *, row_number() OVER (PARTITION BY g, o ORDER BY r) AS k FROM b),
p AS (SELECT ra.r AS row_1, rb.r AS row_2, ra.g AS gstr, ra.v AS v1, rb.v AS v2, strftime(ra.d, '%Y-%m-%d') AS d1, CASE WHEN ra.o % 7 = 0 THEN 97 ELSE 100 END AS confidence, abs(round(ra.v - rb.v, 2)) > 0.005 AS bad_value, ra.o % 31 = 0 AS bad_date, ra.o % 23 = 0 AS noted, bad_value OR bad_date AS bad FROM ra JOIN rb USING (g, o, k))
"""


@query(_TAX_CTE + "SELECT row_1, row_2, gstr, confidence, CASE WHEN bad THEN 'mismatched' WHEN confidence < 100 OR noted THEN 'confidence_review' ELSE 'matched' END AS outcome, concat_ws(',', CASE WHEN bad_date THEN 'DATE' END, CASE WHEN bad_value THEN 'TAXABLE VALUE' END, CASE WHEN noted THEN 'note NAME' END) AS told FROM p")
def tax_pairs(spark, d):
    told = F.concat(F.col("differences.field"), F.transform("notes.field", lambda f: F.concat(F.lit("note "), f)))
    return _tax(spark, d).pairs.select("row_1", "row_2", "gstr", "confidence", "outcome", F.array_join(told, ",").alias("told"))


@query(_TAX_CTE + "SELECT (SELECT count(*) FROM p) AS matched_records, (SELECT count(*) FROM p WHERE bad OR noted OR confidence < 100) AS report_rows, (SELECT count(*) FROM p WHERE NOT bad AND NOT noted AND confidence = 100) AS fully_matched_records, (SELECT count(*) FROM p WHERE NOT bad AND (noted OR confidence < 100)) AS confidence_review, (SELECT count(*) FROM a) AS source_records_1, (SELECT count(*) FROM b) AS source_records_2, (SELECT count(*) FROM a) - (SELECT count(*) FROM p) AS only_in_file_1, (SELECT count(*) FROM b) - (SELECT count(*) FROM p) AS only_in_file_2")
def tax_summary(spark, d):
    return _tax(spark, d).summary()


@query(_TAX_CTE + """SELECT sheet, count(*) AS n, round(sum(v1), 2) AS taxable_1, round(sum(v2), 2) AS taxable_2, min(d1) AS first_day FROM (
SELECT CASE WHEN bad THEN 'Mismatched Invoices' ELSE 'Match Confidence Review' END AS sheet, v1, v2, d1 FROM p WHERE bad OR noted OR confidence < 100) GROUP BY sheet""")
def legacy_tax_sheets(spark, d):
    """Rows, taxable values and first days of the two sheets of pairs."""
    sheets, out = report.legacy_sections(_tax(spark, d)), None
    for name in ("Mismatched Invoices", "Match Confidence Review"):
        one, two = (F.round(F.sum(f"TAXABLE VALUE {n}"), 2).alias(f"taxable_{n}") for n in (1, 2))
        row = sheets[name].groupBy(F.lit(name).alias("sheet")).agg(F.count(F.lit(1)).alias("n"), one, two, F.min("INVOICE DATE 1").alias("first_day"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- similarity (no SQL: the score is a sequence matcher's)


@query()
def fuzzy_pairs(spark, d):
    names = _t(spark, d, "part").select("p_name").distinct()
    one = P.number_rows(names, ["p_name"])
    two = P.number_rows(names.select(F.regexp_replace("p_name", "e", "ee").alias("p_name")).distinct(), ["p_name"])
    return M.fuzzy_candidates(M.keyed(one, P.ROW, F.col("p_name")), M.keyed(two, P.ROW, F.col("p_name")))


@query()
def text_key_pairs(spark, d):
    names = _t(spark, d, "part").select("p_name").distinct()
    two = names.select(F.regexp_replace("p_name", "e", "ee").alias("p_name")).distinct()
    out = reconcile(P.number_rows(names, ["p_name"]), P.number_rows(two, ["p_name"]), Spec("p_name", "p_name", kind="text"))
    return out.pairs.select("row_1", "row_2", "key_1", "key_2", "confidence", "status", "outcome")


@query()
def similarity_scores(spark, d):
    rows = _t(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("a"), F.lower(F.reverse("s_name")).alias("b"))
    return rows.select("s_suppkey", similarity(F.col("a"), F.col("b"), "token_max").alias("score"))


# ---- job log, ranks and mapping, over the events table


_STATE = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END"


def _jobs(spark, d):
    e = _t(spark, d, "events")
    state = F.element_at(F.array(*map(F.lit, J.STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("session_id"), F.lit("generic").alias("job_type"), state.alias("status"),
        F.lit(0).alias("progress"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id"),
    )


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) AS k FROM events) WHERE k <= 20")
def newest_per_session(spark, d):
    return J.newest(_jobs(spark, d), "session_id", "created_at", "job_id").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) AS k FROM events) WHERE k > 20")
def surplus_jobs(spark, d):
    return J.surplus(_jobs(spark, d)).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) AS k FROM events) WHERE k <= 20")
def log_without_surplus(spark, d):
    """The job log after the clean-up of each session."""
    jobs = _jobs(spark, d)
    return J.without(jobs, J.surplus(jobs)).select("event_id")


@query("SELECT DISTINCT concat('f', event_id % 130) AS file_id FROM events EXCEPT SELECT concat('f', user_id % 100) FROM events WHERE event_id % 5 <> 4")
def orphan_files(spark, d):
    """Files that no job refers to; a job in five refers to none."""
    e = _t(spark, d, "events")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    files = e.select(name(F.col("event_id") % 130).alias("file_id")).distinct()
    log = e.select(F.when(F.col("event_id") % 5 != 4, F.array(name(F.col("user_id") % 100))).otherwise(F.array().cast("array<string>")).alias("files"))
    return J.orphan_files(files, log)


@query(f"SELECT event_id, 'cancelled' AS status FROM (SELECT event_id, user_id, {_STATE} AS s FROM events) WHERE user_id = 1 AND s IN ('queued', 'processing')")
def cancelled_jobs(spark, d):
    """The events that cancel the open jobs of a session."""
    jobs = _jobs(spark, d).withColumns({"settings": F.lit("{}"), "files": F.array().cast("array<string>"), "job": F.col("job_id"), "job_id": F.col("session_id")})
    open_ = J.cancel(jobs.withColumn("settings", F.col("job")), "1", datetime(2026, 7, 1))
    return open_.select(F.col("settings").cast("long").alias("event_id"), "status")


@query("SELECT event_id FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id::VARCHAR LIMIT 200")
def recent_jobs(spark, d):
    return J.recent(_jobs(spark, d), "1").select("event_id")


@query(f"SELECT count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s IN ('queued', 'processing')) AS active, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT {_STATE} AS s FROM events)")
def dashboard_counts(spark, d):
    return J.dashboard(_jobs(spark, d))


@query(f"""WITH e AS (SELECT (user_id % 50)::VARCHAR AS job_id, {_STATE} AS status, epoch_us(ts) AS t, event_id FROM events), f AS (SELECT *, status IN ('completed', 'failed', 'cancelled') AS fin FROM e)
SELECT job_id, status FROM (SELECT job_id, status, row_number() OVER (PARTITION BY job_id ORDER BY fin DESC, CASE WHEN fin THEN t ELSE -t END, event_id DESC) AS k FROM f) WHERE k = 1""")
def latest_job_state(spark, d):
    log = _jobs(spark, d).select((F.col("session_id").cast("long") % 50).cast("string").alias("job_id"), "session_id", "job_type", "status", F.col("event_id").alias("progress"), F.col("created_at").alias("at"))
    return J.latest(log).select("job_id", "status")


_MAPPED = (("documents", "conversations"), ("customer", "supplier"), ("labels", "documents"))
_SOURCES = " UNION ALL ".join(f"SELECT {i} AS pair, '{a}' AS a, {side} AS side, column_name AS name, row_number() OVER () - 1 AS id FROM (DESCRIBE {t})" for i, (a, b) in enumerate(_MAPPED) for side, t in ((1, a), (2, b)))
_WORDS = "list_filter(string_split(lower(regexp_replace(name, '[_/.-]+', ' ', 'g')), ' '), lambda w: w <> '')"
_COMMON = "(SELECT count(*) FROM (SELECT DISTINCT {0}::VARCHAR FROM {1} WHERE {0} IS NOT NULL INTERSECT SELECT DISTINCT {2}::VARCHAR FROM {3} WHERE {2} IS NOT NULL))"
_FOUND = (("documents", "doc_id", "conversations", "conv_id"), ("documents", "text", "conversations", "text"), ("customer", "c_name", "supplier", "s_name"), ("labels", "doc_id", "documents", "doc_id"))


@query(f"""WITH RECURSIVE n AS (SELECT pair, side, name, id, {_WORDS} AS w FROM ({_SOURCES})), s AS (
  SELECT a.pair, a.id AS i, b.id AS j, a.name AS source, b.name AS destination, len(list_filter(a.w, lambda x: list_contains(b.w, x))) AS shared, len(a.w) AS p, len(b.w) AS q,
    array_to_string(a.w, '') = array_to_string(b.w, '') AS same, list_has_any(list_intersect(a.w, b.w), ['id', 'name', 'salary', 'amount', 'date', 'department']) AS weighty
  FROM n a JOIN n b ON a.pair = b.pair AND a.side = 1 AND b.side = 2
), c AS (
  SELECT *, CASE WHEN same THEN 100 WHEN shared = 0 THEN 0 WHEN shared = least(p, q) THEN 94 WHEN weighty THEN 88 ELSE floor(shared / greatest(p, q) * 90 + 0.5) END AS confidence FROM s
), taken AS (
  SELECT pair, -1 AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM (SELECT DISTINCT pair FROM n)
  UNION ALL
  SELECT pair, i, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, j FROM (
    SELECT t.pair, t.i + 1 AS i, t.used, (SELECT c.j FROM c WHERE c.pair = t.pair AND c.i = t.i + 1 AND c.confidence >= 85 AND NOT list_contains(t.used, c.j) ORDER BY c.confidence DESC, c.j LIMIT 1) AS j
    FROM taken t WHERE t.i + 1 <= (SELECT max(id) FROM n WHERE n.pair = t.pair AND n.side = 1)
  )
)
SELECT c.source, c.destination, c.confidence::INT AS confidence, k.common FROM taken t JOIN c USING (pair, i, j)
JOIN ({" UNION ALL ".join(f"SELECT {[p[0] for p in _MAPPED].index(t)} AS pair, '{a}' AS source, '{b}' AS destination, {_COMMON.format(a, t, b, u)} AS common" for t, a, u, b in _FOUND)}) k ON k.pair = c.pair AND k.source = c.source AND k.destination = c.destination""")
def column_mapping(spark, d):
    """Columns of pairs of tables that belong together by their names, with the values that they have in common."""
    out = None
    for a, b in _MAPPED:
        one, two = _t(spark, d, a), _t(spark, d, b)
        rows = mapping.evidence(one, two, [tuple(r) for r in mapping.suggest(spark, one.columns, two.columns).collect()])  # at most a row a column
        out = rows if out is None else out.unionByName(rows)
    return out
