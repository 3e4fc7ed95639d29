"""What the findings of round 4 were about."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from veritally.llm import shingle_dedup, simhash

#: A join by two keys takes 16 MB for any table.
SMALL = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "20m"}


def _held(spark, conf, run):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_simhash_never_broadcasts_its_look_ups(spark):
    fps = np.unique(np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 30_000)).tolist()
    fps += [fps[0] ^ 3]
    nodes = simhash.stash(spark.createDataFrame(pa.table({"node": pa.array(range(len(fps))), "fp": pa.array(fps, pa.int64())})))
    links = _held(spark, SMALL, lambda: simhash.link(nodes).collect())  # 35 look-ups a node, some 34 MB
    assert {(r["u"], r["v"]) for r in links} == {(len(fps) - 1, 0)}


def test_shingles_never_broadcast_their_bands(spark):
    band = np.random.default_rng(2).integers(0, 1 << 62, (30_000, shingle_dedup.BANDS))  # some 19 MB as rows, without what a broadcast adds
    band[1] = band[0]
    rows = pa.table({"node": pa.array(range(30_000)), "text": pa.array([b"one text", b"one text"] + [b""] * 29_998)})
    key = [shingle_dedup._key(shingle_dedup.shingles(b"one text"))] + list(range(29_999))
    signed = pa.table({"node": pa.array(range(30_000)), "key": pa.array(key, pa.int64()), "bands": pa.array(band.tolist(), pa.list_(pa.int64()))})
    signed = simhash.stash(spark.createDataFrame(signed))
    found = _held(spark, SMALL, lambda: shingle_dedup.groups(spark.createDataFrame(rows), signed).count())
    assert found == 30_000
