"""What the findings of round 3 were about."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from veritally.llm import lm_scoring, packing, sentencepiece_codec


def test_packing_hands_small_tables_on_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PLACED", 100)
    docs = spark.createDataFrame([(i, "a word " * (i % 40)) for i in range(250)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = packing.pack_documents(docs, size=64)
        rows, tasks = out.collect(), out.rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert {r["doc_id"] for r in rows} == set(range(250))
    assert tasks == -(-len(rows) // 100)


def test_codec_searches_short_parts_where_paths_ask_only(monkeypatch):
    import sentencepiece

    r = random.Random(4)
    syllables = ["th", "an", "er", "tion", "re", "Ing", "é", "ß", "日本", "🙂", ".", ",", "$$$", "7", "\t", "\n", "\r", "  ", "▁", "\x00"]
    texts = [" ".join("".join(r.choices(syllables, k=r.randint(1, 6))) for _ in range(60)) for _ in range(80)] + ["", " ", "a" * 41, "x" * 700 + " y", "a" * 40]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    want = [library.encode(x) for x in texts]
    asked = []

    class Counted(sentencepiece_codec.Codec):
        def piece_before(self, text, i, last):
            asked.append(i)
            return super().piece_before(text, i, last)

    for remembered, together in ((sentencepiece_codec.REMEMBERED, 1 << 20), (40, 300)):
        monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", remembered)
        monkeypatch.setattr(sentencepiece_codec, "TOGETHER", together)
        c = Counted(sentencepiece_codec.model_path())
        asked.clear()
        found = list(c.encode_all(texts))
        assert [memoryview(x).cast("I").tolist() for x in found] == want
        assert [c.encode(x) for x in texts] == found
        assert not any(len(p) > sentencepiece_codec.LONGEST_WORD for p in c.words.ids)
        if remembered > 40:
            assert len(asked) < 0.7 * sum(map(len, c.words.ids))  # the search of whole windows has a step for each character


def test_bits_are_counted_as_they_come(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(lm_scoring, "TaskContext", Task)
    r, bits = np.random.default_rng(1), (5, 3)
    parts = [(np.stack([r.integers(0, 32, n), r.integers(32, 40, n)]).astype(np.uint32), r.integers(0, 2, n).astype(np.int8)) for n in (700, 1, 0, 90)]
    met, ones = (Counter(int(k) for slots, y in parts for row in slots for k in row[use(y)]) for use in (lambda y: y >= 0, lambda y: y == 1))
    count = lm_scoring._counter(bits, lambda _: ((slots.copy(), y) for slots, y in parts))
    list(count(iter([])))  # pyarrow imports what it needs
    tracemalloc.start()
    try:
        (found,) = count(iter([]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for name, want in (("n", met), ("ones", ones)):
        got = np.frombuffer(pa.decompress(found.column(name)[0].as_py(), 40 * 8, "zstd"), "<i8")
        assert got.tolist() == [want[k] for k in range(40)]
    assert peak < 1 << 20  # nothing waits to be counted
