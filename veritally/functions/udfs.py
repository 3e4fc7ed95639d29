"""Arrow UDFs: what Spark's own functions can't express."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import SCORER, SCORERS


def nfkc(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())

    return run(c)


def similarity(a: Column, b: Column, scorer: str = SCORER) -> Column:
    """0 to 100; null where either is null, so rows that need no score cost nothing but their transfer. Equal pairs of a batch are scored once."""
    score = SCORERS[scorer]

    @F.arrow_udf("int")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = list(zip(left.to_pylist(), right.to_pylist(), strict=True))
        known = list(dict.fromkeys(p for p in pairs if p[0] is not None and p[1] is not None))
        scores = dict(zip(known, score(known).tolist(), strict=True))
        return pa.array([scores.get(p) for p in pairs], pa.int32())

    return run(a, b)
