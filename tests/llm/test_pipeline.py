"""The pipeline: stages in order, each on what the one before kept, and the queries' registration."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from veritally.llm import packing, registry, shingle_dedup, simhash


def _words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "an", "er", "tion", "re"]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, _words(80, i)) for i in range(60)] + [(100 + i, _words(80, i)) for i in range(10)] + [(200 + i, " ".join(w + "***" for w in _words(60, 500 + i).split())) for i in range(30)] + [(300, None), (301, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows[:100]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_keep_columns_and_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.stash(stage(spark, seen, corpus))
        assert seen.columns == docs.columns, name
    kept = {r["doc_id"] for r in seen.collect()}
    assert kept == set(range(60))
    final = corpus_pipeline.run(spark, corpus).collect()
    assert {r["doc_id"] for r in final} == kept


def _near_groups(rows: list[tuple]) -> dict[int, int]:
    """Groups of row numbers by plain Python: equal texts, fingerprints of 4-word shingles within 4 bits, 5-word shingle sets at 0.8."""
    prints, sets = [simhash.fingerprint((t or "").encode()) for _, t in rows], []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and (5 * both >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 4):
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    return dict(enumerate(group))


def _kept(rows: list[tuple]) -> Counter:
    group, best = _near_groups(rows), {}
    for k, (i, t) in enumerate(rows):
        rank = (i is None, i if i is not None else 0)
        if group[k] not in best or rank < best[group[k]][0]:
            best[group[k]] = (rank, i)
    return Counter(i for _, i in best.values())


def test_stages_match_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def fine(text: str | None) -> bool:
        w = (text or "").split()
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeats = len({j for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        return len(w) >= 20 and 100 * repeats <= 30 * len(w) and 100 * symbols <= 25 * len(w) and sum(map(len, w)) <= 25 * len(w)

    assert {r["doc_id"] for r in corpus_pipeline.rules(spark, docs, corpus).collect()} == {i for i, t in rows if fine(t)}
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, corpus).collect()) == _kept(rows)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    out = corpus_pipeline.packed(spark, docs, corpus).collect()
    assert {i: sum(r["length"] for r in out if r["doc_id"] == i) for i, _ in rows} == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}
    lengths = Counter()
    for r in out:
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= packing.SIZE
    assert len(lengths) == -(-sum(lengths.values()) // packing.SIZE)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    base, other = _words(90, 1), _words(90, 2)
    near = base.split()
    near[40] = "changed"
    rows = [(1, base), (1, base), (1, other), (2, " ".join(near)), (None, base), (None, _words(50, 3)), (None, _words(50, 3)), (7, None), (8, ""), (9, other), (9, other)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, node string, component int, _of int")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, base), (1, other), (None, _words(50, 3)), (7, None)])
    assert Counter(r[0] for r in got.elements()) == _kept(rows)
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_one_id_on_two_texts(spark):
    base, other = _words(90, 11), _words(90, 12)
    rows = [(5, base), (5, other), (6, base), (7, other), (4, other)]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 5), (6, 5), (5, 4), (7, 4), (4, 4)])


def test_stages_take_odd_rows(spark, tmp_path):
    texts = [(i, _words(80, i)) for i in range(20)]
    rows = [*texts, texts[3], texts[3], (None, _words(80, 50)), (None, _words(80, 50)), (90, None), (91, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1, [1], "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, words array<int>, key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == Counter([*range(20), None])
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("block", [4, shingle_dedup.BLOCK])
def test_near_dedup_links_shingle_similarity_of_four_fifths(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_dedup, "BLOCK", block)
    r, rows = random.Random(8), []
    for base in range(12):
        words = [f"w{r.randrange(9999)}" for _ in range(200)]
        for copy in range(8):
            at = r.sample(range(200), copy % 5 * 2) if base % 2 else r.sample(range(200), 1)
            rows.append((len(rows), " ".join(f"x{r.randrange(9999)}" if k in at else w for k, w in enumerate(words))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i, g in group.items() if i == g}
    assert 12 < len(got) < 96


def test_every_operator_is_registered():
    names = set(registry.QUERIES)
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 4
    assert set(registry.ORACLE_SQL) <= names


def test_workers_rest_small_after_packing(spark):
    texts = [(k, " ".join(f"w{k}x{i}" for i in range(2000))) for k in range(60)]  # 120,000 words
    assert packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).count() > 60

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(x.ids) + len(x.older) for k in packing._tokenizers.values() for x in (k.words, k.parts))]})

    assert max(r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()) <= packing.REMEMBERED // 4
    store = packing.Recent(8)
    for keys in ("abcdef", "abghi"):
        store.ids.update({k: k.encode() for k in store.missing(set(keys))})
    store.shrink()
    assert store.ids == {"a": b"a", "b": b"b"} and not store.older
    store.shrink()
    assert store.missing({"b"}) == []
    assert store.missing({"z"}) == ["z"]


def test_near_duplicates_run_one_python_worker_a_task(spark, monkeypatch):
    """Links reach components() from a table: where two Python steps share a task, it has two workers, which stay."""
    plans = []
    for module in (simhash, shingle_dedup):
        monkeypatch.setattr(module, "components", lambda links, f=module.components: (plans.append(links._jdf.queryExecution().toString()), f(links))[1])
    docs = spark.createDataFrame([(i, _words(60, i % 9) + (" end" if i % 2 else "")) for i in range(20)], "doc_id long, text string")
    assert simhash.deduplicate(docs).count() == 9
    assert len(plans) == 4 and not any("InArrow" in p for p in plans)
