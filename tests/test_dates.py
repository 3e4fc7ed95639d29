"""Days of texts, read by hand."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from veritally.functions import normalise as N

JULY_1 = "2026-07-01"
# text, day; None: no day
CASES = {
    JULY_1: JULY_1, "2026-7-1": JULY_1, "2026/07/01": JULY_1, "2026.07.01": JULY_1, "2026 07 01": JULY_1, "20260701": JULY_1, "20260701103000": JULY_1,
    "07-2026": JULY_1, "7/2026": JULY_1, "2026-07": JULY_1, "2026/7": JULY_1, "2026": "2026-01-01",
    "1/7/2026": "2026-01-07", "7/1/2026": JULY_1, "13/07/2026": "2026-07-13", "13.7.2026": "2026-07-13", "1.7.2026": "2026-01-07", "25-07-2026": "2026-07-25", "1 2 2026": "2026-01-02",
    "12/31/99": "1999-12-31", "31/12/99": "1999-12-31", "1/7/26": "2026-01-07", "99-12-31": "1999-12-31", "010726": "2026-01-07", "1/2/3": "2003-01-02",
    "Jul 1 2026": JULY_1, "July 1, 2026": JULY_1, "1 July 2026": JULY_1, "1-Jul-2026": JULY_1, "01-Jul-26": JULY_1, "3/Sep/2026": "2026-09-03", "2026 Jul 1": JULY_1, "July 2026": JULY_1,
    "1st July 2026": JULY_1, "July 1st, 2026": JULY_1, "Sept 3 2026": "2026-09-03", "Sep. 3 2026": "2026-09-03", "Wed, 01 Jul 2026": JULY_1, "Wednesday 1 July 2026": JULY_1, "1jul2026": JULY_1,
    "Jul 1 2026 10:30": JULY_1, "2026-07-01T10:30:00Z": JULY_1, "2026-07-01 23:30:00+05:30": JULY_1, "2026-07-01 10:30 PM": JULY_1, "1/7/2026 10:30:15 AM": "2026-01-07",
    "2026/07/01 10:30:00.123456": JULY_1, "1 Jul 2026 10:30 GMT": JULY_1, "2026-07-01T10": JULY_1, "20260701T1030": JULY_1, "2026-07-01 5 pm": JULY_1, " 2026-07-01 ": JULY_1,
    "5": None, "1000": None, "1.5": None, "E101": None, "may": None, "Jul 26": None, "26-Jul": None, "jul-26": None, "2026-02-30": None, "30/02/2026": None, "00/01/2026": None, "2026-182": None,
    "01072026": None, "2026-07-01 25:00": None, "1/13/2026 10:61": None, "T10:30": None, "10:30": None, "today": None, "2026-W27-3": None, "0001-01-01": None, "9999-12-31": None, "INV-2026": None,
    "12 march april 2026": None, "": None, "nan": None, None: None, "1-2-3-4": None, "2026-07-01x": None, "13/13/2026": None, "Marathon 2026": None,
}


def test_texts_of_days(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", N.parse_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] and r["d"].isoformat() for r in rows} == CASES


def test_typed_days(spark):
    row = spark.range(1).select(N.parse_date(F.lit("2026-07-01 23:30:00").cast("timestamp"), "timestamp").alias("d")).first()
    assert row["d"] == datetime.date(2026, 7, 1)
