"""Scenarios of whole reconciliations, and the greedy pass against a plain simulation."""

from __future__ import annotations

import os
import random
import zipfile
import zlib
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritally.operators import exceptions as X
from veritally.operators import match as M
from veritally.operators import prepare as P
from veritally.operators.compare import Rule
from veritally.plans import mapping, report
from veritally.plans.reconcile import Cancelled, Spec, compare_values, reconcile, reconcile_tax
from veritally.sources import tables as S
from veritally.sources import workbook as W
from veritally.sources.shared import Scratch


def _rows(spark, rows, schema):
    df = spark.createDataFrame([(*r, i + 2) for i, r in enumerate(rows)], f"{schema}, _ROW_NO long")
    return df


def _counts(result):
    return result.summary().first().asDict()


def test_keys_of_other_formats_pair(spark):
    one = _rows(spark, [("INV-005", 1000, "ABC PVT LTD"), ("INV-007", 700, "Other Co")], "`Invoice No` string, Amount long, Vendor string")
    two = _rows(spark, [("INV005", 1000, "ABC PRIVATE LIMITED"), ("INV009", 900, "Missing Co")], "`Invoice_Number` string, `Invoice Amount` long, Supplier string")
    r = reconcile(one, two, Spec("Invoice No", "Invoice_Number", [Rule(["Amount"], ["Invoice Amount"]), Rule(["Vendor"], ["Supplier"])], extras_1=["Vendor"]))
    c = _counts(r)
    assert r.kind == "invoice"
    assert (c["only_in_file_1"], c["only_in_file_2"], c["matched_records"], c["report_rows"], c["confidence_review"], c["fully_matched_records"]) == (1, 1, 1, 1, 1, 0)
    pair = r.pairs.first()
    assert (pair["confidence"], pair["status"], pair["differences"], pair["extra_1"]["VENDOR"]) == (97, "Identifier formatting difference only", [], "ABC PVT LTD")


def test_one_column_against_a_sum(spark):
    one = _rows(spark, [("E001", 10), ("E002", 5)], "`Employee ID` string, `ST Hours` long")
    two = _rows(spark, [("E001", 5, 3, 2), ("E002", 3, 2, 0)], "ID string, `Standard Hours` long, `ST2 Hours` long, `ST3 Hours` long")
    c = _counts(reconcile(one, two, Spec("Employee ID", "ID", [Rule(["ST Hours"], ["Standard Hours", "ST2 Hours", "ST3 Hours"])])))
    assert (c["report_rows"], c["matched_records"]) == (0, 2)


def test_combined_rules_need_numbers(spark):
    one = _rows(spark, [("E-001", 10)], "`Employee ID` string, `ST Hours` long")
    two = _rows(spark, [("E-001", 10, "not numeric")], "ID string, `Standard Hours` long, Comment string")
    with pytest.raises(ValueError, match="Combined column mappings require numeric columns.*File 2: COMMENT"):
        reconcile(one, two, Spec("Employee ID", "ID", [Rule(["ST Hours"], ["Standard Hours", "Comment"])]))
    with pytest.raises(KeyError, match="missing columns"):
        reconcile(one, two, Spec("Employee ID", "No Such"))


def test_differences_and_reports(spark, tmp_path):
    schema = "EmpId string, Name string, Hours long"
    one = _rows(spark, [("E101", "Alice Smith", 40), ("E102", "Bob Jones", 35), ("E103", "Charlie Brown", 20)], schema)
    two = _rows(spark, [("E101", "Alice Smith", 40), ("E102", "Bob Jones", 38), ("E104", "David Clark", 25)], schema)
    r = reconcile(one, two, Spec("empid", "EmpId", [Rule(["Hours"], ["Hours"]), Rule(["Name"], ["Name"])], name_1="ledger.xlsx", name_2="bank.xlsx"))
    rows = X.exceptions(r).collect()
    assert [(e["exception_id"], e["match_key"], e["field"], e["difference"], e["severity"], e["exception_type"]) for e in rows] == [("EX-000001", "E102", "HOURS", -3.0, "Medium", "Value Difference")]
    assert rows[0]["difference_pct"] == pytest.approx(-3 / 38)
    assert {x["EMPID"] for x in r.only_in_1.collect()} == {"E103"}
    assert {x["EMPID"] for x in r.only_in_2.collect()} == {"E104"}
    assert X.overall_status(r).first()[0] == "EXCEPTIONS FOUND"
    k = report.kpis(r).first()
    assert (k["total"], k["matched"], k["exceptions"], k["missing"]) == (4, 1, 1, 2)
    assert k["match_rate"] == 0.25
    assert [x["result"] for x in report.control_checks(r).collect()] == ["Pass", "Pass", "Review Required", "Review Required", "Review Required"]
    sheets = report.sections(r)
    assert list(sheets) == ["01 Executive Summary", "02 Exceptions", "03 Matched Records", "04 Missing - ledger", "05 Missing - bank", "06 Field Differences", "07 Control Checks"]
    S.write_report({n: sheets[n] for n in ("01 Executive Summary", "02 Exceptions")}, f"{tmp_path}/r.xlsx")
    with open(f"{tmp_path}/r.xlsx", "rb") as f:
        back = list(W.rows(f.read(), "02 Exceptions"))
    assert back[0][1] == "exception_id"
    assert back[1][1] == "EX-000001"
    stored = S.write_sections({"02 Exceptions": sheets["02 Exceptions"]}, f"{tmp_path}/out")
    assert S.rebuilt(spark, stored, ["02 Exceptions"])["02 Exceptions"].count() == 1
    assert list(report.sections(r, ())) == ["Empty"]
    assert list(report.legacy_sections(r)) == ["Results", "Only in File 1", "Only in File 2"]


def test_duplicate_keys_are_summed(spark):
    one = _rows(spark, [("A1", 10.0, "x"), ("A1", 5.5, None), (None, 1.0, "y"), (None, 2.0, "z")], "ID string, AMT double, NOTE string")
    got = {r["ID"]: (r["AMT"], r["NOTE"], r["_ROW_NO"]) for r in P.aggregate_by_key(one, "ID").collect()}
    assert got == {"A1": (15.5, "x", 2), None: (3.0, "y", 4)}


TAX = "GSTR string, `NAME OF TRADER/FIRM/COMPANY` string, `INVOICE NO.` string, `INVOICE DATE` timestamp, `TAXABLE VALUE` double, IGST double, CGST double, SGST double, CESS double, `INVOICE VALUE` double"


def _tax(n, day, taxable=1000.0, name="ABC PRIVATE LIMITED", gstr="27ABCDE1234F1Z5"):
    return (gstr, name, n, datetime(2026, 7, day, 10, 30), taxable, 180.0, 0.0, 0.0, 0.0, 1180.0)


def test_tax_mode(spark):
    one = _rows(spark, [_tax("INV001", 1), _tax("INV002", 2, 2000.0), _tax("INV-9", 3, gstr="nobody")], TAX)
    two = _rows(spark, [_tax("INV001", 1), _tax("INV002", 2, 2500.0), _tax("INV003", 3)], TAX)
    r = reconcile_tax(one, two)
    c = _counts(r)
    assert (c["matched_records"], c["only_in_file_2"], c["only_in_file_1"], c["report_rows"], c["fully_matched_records"]) == (2, 1, 1, 1, 1)
    bad = r.pairs.where("outcome = 'mismatched'").first()["differences"]
    assert [(d["field"], d["difference"]) for d in bad] == [("TAXABLE VALUE", -500.0)]
    assert X.exceptions(r).first()["severity"] == "High"
    sheets = report.legacy_sections(r)
    assert list(sheets) == ["Mismatched Invoices", "File 1 Missing in File 2", "File 2 Missing in File 1", "Match Confidence Review"]
    row = sheets["Mismatched Invoices"].first()
    assert (row["INVOICE NO. 1"], row["INVOICE DATE 2"], row["TAXABLE VALUE 1"], row["TAXABLE VALUE 2"]) == ("INV002", "2026-07-02", 2000.0, 2500.0)
    assert sheets["File 1 Missing in File 2"].first()["INVOICE DATE"] == "2026-07-03"
    assert X.accuracy(r).first()[0] == pytest.approx(100 / 3)
    with pytest.raises(KeyError):
        reconcile_tax(one.drop("IGST"), two)


def test_tax_names_below_100_are_reviewed(spark):
    one = _rows(spark, [_tax("INV001", 1, name="ABC TRADERS LIMITED")], TAX)
    two = _rows(spark, [_tax("INV001", 1, name="ABC TRADRS LIMITED")], TAX)
    p = reconcile_tax(one, two).pairs.first()
    assert (p["outcome"], [n["field"] for n in p["notes"]]) == ("confidence_review", ["NAME"])


def test_records_in_columns(spark):
    sheet = spark.createDataFrame([("Invoice", "INV001", "INV002"), ("Amount", "1000", "2000"), (None, "x", "y")], "Field string, Record1 string, Record2 string")
    out = P.transpose(sheet)
    assert sorted(out.columns) == ["AMOUNT", "INVOICE"]
    assert sorted((r["INVOICE"], r["AMOUNT"]) for r in out.collect()) == [("INV001", "1000"), ("INV002", "2000")]


def test_single_values(spark):
    v = compare_values(spark, "INV-005", "inv005", "Invoice No", "Invoice_Number")
    assert v["matched"]
    assert v["confidence"] >= 95
    assert v["matcher_type"] == "invoice"
    assert compare_values(spark, "ABC PVT LTD", "ABC PRIVATE LIMITED", kind="company_name")["confidence"] == 100
    assert compare_values(spark, "(1,000.00)", "-1000", kind="numeric")["confidence"] == 100
    assert compare_values(spark, "2026-07-01", "07/01/2026", kind="date")["confidence"] == 100
    assert compare_values(spark, "John Ａ Smith Jones", "jones smith a john", kind="text")["status"] == "Name words reordered"


def _simulate(edges):
    used, out = set(), set()
    for left in sorted({e[0] for e in edges}):
        own = sorted((e for e in edges if e[0] == left and e[1] not in used), key=lambda e: (e[2], -e[3], e[4], e[1]))
        if own:
            used.add(own[0][1])
            out.add((left, own[0][1]))
    return out


@pytest.mark.parametrize("stretch", [1, 4, 10_000])
def test_assignment_is_the_greedy_pass(spark, stretch):
    r = random.Random(11 + stretch)
    edges = {(a, b): (a, b, r.randint(0, 1), r.choice([75, 90, 100]), r.randint(0, 2)) for a, b in ((r.randint(1, 25), r.randint(1, 20)) for _ in range(120))}
    df = spark.createDataFrame(list(edges.values()), "id1 long, id2 long, stage int, confidence int, priority int")
    scratch = Scratch(spark)
    got = {tuple(x) for x in M.assign_edges(df, scratch, stretch).collect()}
    assert got == _simulate(list(edges.values()))
    scratch.release()


def test_assignment_settles_a_long_chain(spark):
    """Each row's first choice is the second choice of the row before it, which waits for the one before that, and so on."""
    n = 100_000
    i = F.col("id")
    first = spark.range(1, n).select(i.alias("id1"), (i - 1).alias("id2"), F.lit(100).alias("confidence"))
    chain = first.unionByName(spark.range(0, n).select(i.alias("id1"), i.alias("id2"), F.lit(90).alias("confidence"))).withColumns({"stage": F.lit(0), "priority": F.lit(0)})
    scratch = Scratch(spark)
    got = M.assign_edges(chain, scratch, 40_000)
    assert got.count() == n
    assert got.where("id1 <> id2").count() == 0
    scratch.release()


def test_row_numbers_are_total_and_written(spark):
    rows = [(x, y) for x in (3, 1, 1, None, 2, 1) for y in ("b", "a", "a")]
    df = spark.createDataFrame(rows, "a int, b string")
    scratch = Scratch(spark)
    first = P.number_rows(df, ["a"], scratch)
    numbers = sorted((tuple(r) for r in first.collect()), key=lambda r: r[-1])
    assert [r[0] for r in numbers] == [None] * 3 + [1] * 9 + [2] * 3 + [3] * 3
    assert [n for *_, n in numbers] == list(range(2, len(rows) + 2))
    assert "InMemoryTableScan" not in first._jdf.queryExecution().executedPlan().toString()  # nothing that a lost executor takes away
    again = P.number_rows(df.repartition(5), ["a"], scratch)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    scratch.release()


def test_a_released_run_leaves_nothing(spark, tmp_path):
    before = spark.sparkContext._jsc.getPersistentRDDs().size(), len(spark.catalog.listTables())
    one = spark.createDataFrame([(f"A-{i}", i, "odd,name") for i in range(40)], "ID string, AMT int, `a.b, c` string")
    r = reconcile(one, one.where("AMT > 3"), Spec("ID", "ID", [Rule(["AMT"], ["AMT"])], extras_1=["a.b, c"]))
    assert _counts(r)["only_in_file_1"] == 4
    assert r.only_in_1.columns == ["ID", "AMT", "A.B, C", P.ROW]
    paths = list(r.scratch.paths)
    assert len(spark.catalog.listTables()) == before[1] + 2
    plan = r.pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    r.release()
    assert (spark.sparkContext._jsc.getPersistentRDDs().size(), len(spark.catalog.listTables())) == before
    assert not any(os.path.exists(p) for p in paths)


def test_single_blocks_meet_without_exchange(spark):
    scratch = Scratch(spark)
    sides = [M.side(_rows(spark, [(f"INV{sep}{i}",) for i in range(50)], "k string"), P.ROW, F.col("k"), scratch) for sep in ("-", " ")]
    a, b = (s.where("n = 1").select("grp", "block", F.col("id").alias(f"id{i}")) for i, s in enumerate(sides))
    joined = a.hint("merge").join(b, ["grp", "block"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50
    scratch.release()


def test_identifier_blocks_are_the_greedy_pass(spark):
    r = random.Random(2)
    texts = ["inv 1", "inv1", "INV-1", "inv2", "inv-2", "---", "z9", None, ""]
    for _ in range(4):
        rows = [[(i + 2, r.choice(texts)) for i in range(r.randint(0, 14))] for _ in range(2)]
        scratch = Scratch(spark)
        sides = [M.side(spark.createDataFrame(s, "_ROW_NO long, k string"), "_ROW_NO", F.col("k"), scratch) for s in rows]
        norm = lambda s: " ".join((s or "").lower().replace("-", " ").split())
        compact = lambda s: norm(s).replace(" ", "")
        edges = [(a, b, 0, 100 if norm(x) == norm(y) else 97, 0) for a, x in rows[0] for b, y in rows[1] if compact(x) and compact(x) == compact(y)]
        assert {tuple(x) for x in M.assign_identifiers(*sides, scratch).collect()} == _simulate(edges)
        scratch.release()


def _names(n: int, seed: int) -> list[str]:
    """Names of few and of many words, half of them with a frequent one, many near each other."""
    r = random.Random(seed)
    stems = ["".join(random.Random(k).choice("abcdefghij") for _ in range(random.Random(-k).randint(3, 8))) for k in range(60)]
    out = []
    for _ in range(n):
        words = [r.choice(stems) for _ in range(r.randint(1, 4))]
        k = r.randrange(len(words))
        words[k] = words[k][: r.randint(2, 9)] + r.choice(["", "x", "y"])
        out.append(" ".join(words + ["group"] * (r.random() < 0.5)))
    return out


@pytest.mark.parametrize(("scorer", "n", "hot", "tile"), [("difflib", 1500, 30_000, 200), ("difflib", 150, 0, 7), ("token_max", 250, 1000, 50), ("token_max", 250, 10**9, 50)])
def test_fuzzy_join_equals_brute_force(spark, scorer, n, hot, tile):
    from veritally.functions.scores import SCORERS

    names = [_names(n, 1), _names(n, 2)]
    sides = [M.keyed(spark.createDataFrame([(i, v) for i, v in enumerate(x)], f"{P.ROW} long, k string"), P.ROW, F.col("k")) for x in names]
    scratch = Scratch(spark)
    found = M.fuzzy_candidates(*sides, scorer, 75, scratch, hot, tile)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" not in plan
    got = [tuple(r) for r in found.collect()]
    pairs = [(i, j, a, b) for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) if set(a.split()) & set(b.split())]
    unique = list({(a, b) for _, _, a, b in pairs})
    score = dict(zip(unique, SCORERS[scorer](unique).tolist(), strict=True))
    want = {(i, j, score[a, b]) for i, j, a, b in pairs if score[a, b] >= 75}
    assert len(got) == len(set(got))
    assert set(got) == want
    scratch.release()


def test_text_keys_pair_by_spelling(spark):
    one = _rows(spark, [("Acme Suppliers Ltd",), ("Nexus Logistics",), ("Unrelated",)], "PARTNER string")
    two = _rows(spark, [("ACME SUPPLIERS LIMITED",), ("Nexus Logistcs",), ("Nobody",)], "PARTNER string")
    got = {(r["row_1"], r["row_2"], r["status"]) for r in reconcile(one, two, Spec("partner", "partner", kind="text")).pairs.collect()}
    assert got == {(2, 2, "Business synonym match"), (3, 3, "Minor spelling variation")}


def test_cancelling_and_progress(spark):
    one = _rows(spark, [("A1",)], "ID string")
    steps = []
    reconcile(one, one, Spec("ID", "ID"), progress=lambda p, s: steps.append(p))
    assert steps == [10, 20, 35, 55, 75]
    with pytest.raises(Cancelled):
        reconcile(one, one, Spec("ID", "ID"), cancelled=lambda: True)


def test_running_tasks_are_counted_and_cancelled(spark):
    import time

    from pyspark import InheritableThread

    from veritally.operators.jobs import Run

    @F.arrow_udf("long")
    def slow(x: pa.Array) -> pa.Array:
        time.sleep(30)
        return x

    one = spark.range(0, 100, numPartitions=2).select(F.concat(F.lit("A-"), slow("id")).alias("ID"), (F.col("id") + 2).alias(P.ROW))
    run, ended = Run(spark, "slow"), []

    def work() -> None:
        with run:
            try:
                reconcile(one, one, Spec("ID", "ID"), progress=run.progress, cancelled=run.cancelled)
            except Exception as e:
                ended.append(e)

    thread, start = InheritableThread(target=work), time.time()
    thread.start()
    while run.tasks()[1] < 2 and time.time() < start + 60:
        time.sleep(0.2)
    done, every = run.tasks()
    assert every >= 2
    assert done < every
    stopped = time.time()
    run.cancel()
    thread.join(60)
    assert time.time() - stopped < 20
    assert [type(e) for e in ended] == [Cancelled]
    assert run.steps[0] == (10, "reading")


def test_a_job_log(spark):
    from veritally.operators import jobs as J

    day = lambda n: datetime(2026, 7, n)
    log = J.event(spark, "a", "s1", "generic", "queued", 0, day(1), files=("f1",))
    for e in (("a", "s1", "generic", "processing", 40, day(2)), ("a", "s1", "generic", "cancelled", 40, day(3)), ("a", "s1", "generic", "completed", 100, day(4)), ("b", "s1", "tax", "queued", 0, day(2)), ("c", "s2", "tax", "failed", 10, day(2))):
        log = log.unionByName(J.event(spark, *e))
    now = {r["job_id"]: (r["status"], r["created_at"]) for r in J.latest(log).collect()}
    assert now == {"a": ("cancelled", day(1)), "b": ("queued", day(2)), "c": ("failed", day(2))}
    jobs = J.latest(log)
    assert [(r["job_id"], r["status"]) for r in J.cancel(jobs, "b", day(5)).collect()] == [("b", "cancelled")]
    assert J.cancel(jobs, "a", day(5)).count() == 0
    assert {r["job_id"] for r in J.surplus(jobs, 1).collect()} == {"a"}
    assert {r["job_id"] for r in J.without(log, J.surplus(jobs, 1)).collect()} == {"b", "c"}
    assert [r["file_id"] for r in J.orphan_files(spark.createDataFrame([("f1",), ("f2",)], "file_id string"), log).collect()] == ["f2"]
    with pytest.raises(ValueError, match="no such state"):
        J.event(spark, "a", "s", "generic", "odd", 0, day(1))


def test_many_fields_in_rows(spark):
    n = 50_000
    sheet = spark.range(0, n, numPartitions=4).select(F.concat(F.lit("f"), F.col("id")).alias("field"), (F.col("id") * 2).alias("one"), F.lit(None).cast("string").alias("two"), F.concat(F.lit("v"), F.col("id")).alias("three"))
    out = P.transpose(sheet)
    assert len(out.columns) == n
    assert (out.columns[0], out.columns[-1]) == ("F0", f"F{n - 1}")
    rows = out.collect()
    assert [r[n - 1] for r in rows] == [str(2 * n - 2), None, f"v{n - 1}"]
    assert [r[7] for r in rows] == ["14", None, "v7"]


def test_lookups_equal_a_full_scan_and_read_few_buckets(spark):
    names = _names(300, 5) + ["INV-77", "inv 77", "Acme Pvt Ltd", "acme private limited"]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(names)], f"{P.ROW} long, k string")
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    index = M.Lookup(table, "k", P.ROW, scratch)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    for kind, values in (("identifier", ["INV77", "no such thing"]), ("text", ["ACME PRIVATE LTD", names[5] + "x", ""])):
        want = [M.best_match(v, table, "k", P.ROW, kind).collect() for v in values]
        assert index.best(values[0], kind).collect() == want[0]
        many = {r["id1"]: tuple(r)[1:] for r in index.best_of(spark.createDataFrame(list(enumerate(values)), "id long, value string"), kind).collect()}
        assert many == {i: tuple(w[0]) for i, w in enumerate(want) if w}
    terms = ["cinv77", "s77 inv"]
    own = {r[0] for r in index.entries.where(F.col("term").isin(terms)).select(F.input_file_name()).distinct().collect()}
    for f in {r[0] for r in index.entries.select(F.input_file_name()).distinct().collect()} - own:
        os.remove(f.removeprefix("file://"))
    assert index.candidates(index.entries, terms).count() == 2  # files of other buckets aren't even opened
    scratch.release()


def test_workbooks(spark, tmp_path):
    at = f"{tmp_path}/book.xlsx"
    one = spark.createDataFrame([("a", 1.0, "x < y", True), ("b", 2.5, None, None), (None, None, None, None), (None, None, "last", False)], "id string, amount double, note string, ok boolean").coalesce(1)
    W.write_workbook(spark, {"one": one, "two": spark.createDataFrame([], "z string")}, at)
    df = S.read_table(spark, at)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("id", "string"), ("amount", "double"), ("note", "string"), ("ok", "boolean")]
    assert [tuple(r) for r in df.collect()] == [("a", 1.0, "x < y", True), ("b", 2.5, None, None), (None, None, "last", False)]
    assert W.read_workbook(spark, at, "two").columns == ["z"]
    assert S.read_table(spark, at, "id string, amount string, note string").first()["amount"] == "1.0"
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None
    with pytest.raises(Exception, match="no sheet"):
        W.read_workbook(spark, at, "three").count()
    assert S.is_workbook("A.XLSX")
    assert not S.is_workbook("a.csv")
    with pytest.raises(ValueError, match="unsupported"):
        S.read_table(spark, "a.txt")


def test_sheet_names_differ():
    long = "A rather long name of a section of a report"
    got = W.sheet_names([long, long, "a/b", "A:B", long.upper()])
    assert got[0] == long[:31]
    assert got[2:4] == ["a_b", "A_B (2)"]
    assert len({g.lower() for g in got}) == 5
    assert max(map(len, got)) <= 31


def test_check_sums_join():
    a, b = os.urandom(1000), os.urandom(77_777)
    assert W.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert W.joined_crc(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_large_workbooks_cross_sheets_and_ranges_at_any_uri(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.books.link./at", f"file://{tmp_path}")
    n, at = 300_000, "viewfs://books/at/big.xlsx"
    rows = spark.range(n).select("id", (F.col("id") / 4).alias("quarter"), F.concat(F.lit("text & "), F.col("id")).alias("t"), F.array("id").alias("nested")).repartitionByRange(8, "id").sortWithinPartitions("id")
    S.write_report({"Rows": rows}, at)
    assert sorted(os.listdir(tmp_path))[-1] == "big.xlsx"
    back = W.read_workbook(spark, at, "Rows")
    assert back.rdd.getNumPartitions() >= 3
    assert [(f.name, f.dataType.simpleString()) for f in back.schema.fields] == [("id", "bigint"), ("quarter", "double"), ("t", "string"), ("nested", "string")]
    got = back.agg(F.count("*"), F.sum("id"), F.sum("quarter"), F.count_distinct("t"), F.max("nested")).first()
    assert tuple(got)[:4] == (n, n * (n - 1) // 2, n * (n - 1) / 8, n)
    W.write_workbook(spark, {"Rows": rows.drop("nested")}, at, most=120_000)
    with open(f"{tmp_path}/big.xlsx", "rb") as f:
        book = W.Book(f.read())
    assert book.names[:2] == ["Rows", "Rows (2)"]
    assert sum(W.read_workbook(spark, at, x).count() for x in book.names) == n
    assert W.read_workbook(spark, at, "Rows (2)").agg(F.min("id")).first()[0] > 0


def test_mapping_of_columns(spark):
    def confidence(a, b):
        rows = mapping.scored(mapping.names_of(spark, [a]), mapping.names_of(spark, [b])).collect()
        return rows[0]["confidence"] if rows else 0

    assert confidence("Emp ID", "employee_id") == 100
    assert confidence("Invoice Amt", "amount") == 94
    assert confidence("order date", "ship date now") == 88
    assert confidence("a b", "b c d") == 30
    assert confidence("a b", "c") == 0
    assert confidence("in voice", "invoice") == 100
    assert [tuple(r) for r in mapping.suggest(spark, ["Date", "Date 2", "Amt"], ["date", "Amount"]).collect()] == [("Date", "date", 100), ("Amt", "Amount", 100)]
    one, two = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("a", 2), (None, 3)], [("a", 2), ("b", 3), (None, 9)]))
    assert [r["common"] for r in mapping.evidence(one, two, [("k", "k", 100), ("v", "v", 100)]).collect()] == [1, 2]
    assert mapping.missing_required(["a", "B "], ["A", "B", "C"]) == ["C"]


def test_templates_and_shapes(spark):
    shape = S.template(spark, tax=True)
    got = S.conformed(spark.createDataFrame([("x", "1.5", "bad")], "a string, `b.c` string, d string"), shape, {"GSTR": "a", "IGST": "b.c", "CGST": "d"}).first()
    assert (got["GSTR"], got["IGST"], got["CGST"], got["CESS"]) == ("x", 1.5, None, None)
    with pytest.raises(KeyError, match="no columns"):
        S.conformed(shape, shape, {"Nothing": "GSTR"})


def test_storage_and_streaming(spark, tmp_path):
    from veritally.streaming.incremental import reconcile_stream

    store = S.Storage(spark, f"{tmp_path}/store")
    at = store.save(spark.range(3).toDF("a"), store.upload_path("s1", "x.parquet"))
    assert store.exists(at)
    assert store.expired(2**62)
    assert store.delete(at)
    assert not store.exists(at)
    with pytest.raises(ValueError, match="outside"):
        store.delete("/elsewhere")
    _rows(spark, [("A-1", 5), ("B2", 6)], "ID string, AMT long").write.parquet(f"{tmp_path}/in")
    table = _rows(spark, [("A1", 5)], "ID string, AMT long")
    stream = spark.readStream.schema("ID string, AMT long, _ROW_NO long").parquet(f"{tmp_path}/in")
    q = reconcile_stream(stream, table, Spec("ID", "ID", [Rule(["AMT"], ["AMT"])], kind="identifier"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
