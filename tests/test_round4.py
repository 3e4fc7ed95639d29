"""What the findings of round 4 on the tax mode were about."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veritally.operators import compare as C
from veritally.operators import match as M
from veritally.operators import prepare as P
from veritally.plans.reconcile import reconcile_tax
from veritally.sources.shared import Scratch

TAX = "GSTR string, `NAME OF TRADER/FIRM/COMPANY` string, `INVOICE NO.` string, `INVOICE DATE` timestamp, `TAXABLE VALUE` double, IGST double, CGST double, SGST double, CESS double, `INVOICE VALUE` double, _ROW_NO long"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_few_rows_meet_in_place(spark):
    rows = [[(2 + i, f"INV-{i // size}") for i in range(60)] for size in (3, 4)]
    scratch = Scratch(spark)
    sides = [M.side(spark.createDataFrame(x, f"{P.ROW} long, k string"), P.ROW, F.col("k"), scratch) for x in rows]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.assign_identifiers(*sides, scratch)
        assert "Exchange" not in _plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = set()
    for block in range(20):
        want |= set(zip(*([i for i, k in x if k == f"INV-{block}"] for x in rows), strict=False))
    assert {tuple(r) for r in found.collect()} == want
    scratch.release()


def test_blocks_of_many_rows_pair_by_rank(spark):
    most = M.FEW + 9
    one = [(2 + i, "INV-1") for i in range(most)] + [(100 + i, "INV-2") for i in range(3)]
    two = [(2 + i, "INV-1") for i in range(most + 2)] + [(200 + i, "INV2") for i in range(most)]
    scratch = Scratch(spark)
    sides = [M.side(spark.createDataFrame(x, f"{P.ROW} long, k string"), P.ROW, F.col("k"), scratch) for x in (one, two)]
    got = sorted(tuple(r) for r in M.assign_identifiers(*sides, scratch).collect())
    assert got == [(2 + i, 2 + i) for i in range(most)] + [(100 + i, 200 + i) for i in range(3)]
    scratch.release()


def test_tax_differences_are_compiled(spark):
    row = spark.createDataFrame([("G", "N", "I", datetime(2026, 7, 1), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 2)], TAX)
    of = {c: F.col(f"`{c}`") for c in P.TAX_COLUMNS}
    verdict = F.lit(None).cast(C.VERDICT)
    out = row.withColumn("v", F.when(F.col("_ROW_NO") > 5, verdict)).select(*C.tax_differences(of, of, F.col("v")))
    assert "lambda" not in _plan(out) and out.first()[:] == ([], [])


def test_tax_days_and_names_by_pair(spark):
    day, late, old = datetime(2026, 7, 1), datetime(2026, 7, 1, 23, 59), datetime(1500, 1, 1)
    cases = [  # name, date of either side, what is told
        ("ABC LTD", day, "ABC LTD", late, []),
        ("ABC LTD", day, "ABC LTD", datetime(2026, 7, 2), [("DATE", "Date mismatch")]),
        ("ABC LTD", None, "ABC LTD", None, []),
        ("ABC LTD", None, "ABC LTD", day, [("DATE", "No Match")]),
        ("ABC LTD", old, "ABC LTD", old, [("DATE", "No Match")]),
        ("", day, "", day, []),
        ("ABC LTD", day, "LTD ABC", day, []),
        ("ABC LTD", day, "ABC LIMITED", day, []),
        ("ABC LTD", day, "XYZ", day, [("NAME", "No Match")]),
    ]
    sides = [spark.createDataFrame([("G1", c[i], f"INV-{n}", c[i + 1], 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, n + 2) for n, c in enumerate(cases)], TAX) for i in (0, 2)]
    r = reconcile_tax(*sides)
    told = {p["row_1"] - 2: p for p in r.pairs.collect()}
    for n, c in enumerate(cases):
        assert [(x["field"], x["status"]) for x in told[n]["differences"]] == c[4], n
        assert told[n]["notes"] == [] and told[n]["outcome"] == ("mismatched" if c[4] else "matched")
        assert told[n]["record_2"]["INVOICE DATE"] == c[3] and told[n]["record_1"]["GSTR"] == "G1"
    names = [told[0]["name_1"], told[0]["record_1"]["INVOICE NO."], told[0]["match_type"], told[0]["confidence"], told[0]["status"]]
    assert names == ["ABC LTD", "INV-0", "invoice", 100, "Exact identifier match"]
    assert {r["INVOICE NO."] for r in r.left.collect()} == {f"INV-{n}" for n in range(len(cases))}
    everything = reconcile_tax(*sides, threshold=101).pairs.where("row_1 = 2").first()  # no name reaches it
    assert [(x["field"], x["status"]) for x in everything["differences"]] == [("NAME", "Exact text match")]
