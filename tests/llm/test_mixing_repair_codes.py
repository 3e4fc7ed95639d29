"""Mixing, conversation repair and vector codes against brute force, and the cases that tables may hold."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veritally.llm import conversation_repair as repair
from veritally.llm import mixing, vector_codes

EXTRA = ", size long, target double, bucket int, s string, held int"


# ---- 11 mixing


def _filled(sizes: dict, mix: mixing.Mix) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: mix.weights[i % len(mix.weights)] for i, n in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), mix.share * sum(sizes.values())
    open_ = [n for n in names if sizes[n]]
    while open_ and left > 1e-9:
        total = sum(weight[n] for n in open_)
        for n in open_:
            target[n] += left * weight[n] / total
        left = sum(max(0.0, target[n] - mix.most * sizes[n]) for n in open_)
        for n in open_:
            target[n] = min(target[n], float(mix.most * sizes[n]))
        open_ = [n for n in open_ if target[n] < mix.most * sizes[n]]
    return target


def _mix_rows(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "hot"] + ["hot"] * 4
    rows = [(i, "w " * r.choice([1, 2, 3, 8, 40, 200]), r.choice(sources)) for i in range(n)]
    rows += [(None, None, "a"), (None, "x y", None), (3, "", "b"), (5, "same words here", "a"), *[(5, "same words here", "a")] * 40, (n, "word\n" * 9000, "hot")]
    return [(*x, 1, 2.0, 3, "q", 4) for x in rows]


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = _mix_rows(700, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string" + EXTRA)
    out = mixing.mix_documents(docs).collect()
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((x[0], size(x[1])) for x in rows)
    sums, most = defaultdict(int), defaultdict(int)
    for x in rows:
        sums[x[2]] += size(x[1])
        most[x[2]] = max(most[x[2]], size(x[1]))
    want = _filled(sums, mixing.Mix())
    by_size = {(sums[s], round(want[s], 6)): s for s in sums}
    taken = defaultdict(int)
    for r in out:
        s = by_size[r["source_size"], round(r["target"], 6)]
        mean = want[s] / sums[s]
        assert r["taken"] in (int(mean) * r["size"], (int(mean) + 1) * r["size"])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= most[s]
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_equals_a_plain_tree_of_trades(spark):
    """The same draws, hash by hash, in plain Python."""
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 30), "a" if i % 3 else "b") for i in range(400)]
    mix = mixing.Mix(weights=(1, 3), seed=5)
    out = {r["doc_id"]: r for r in mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), mix).collect()}

    def hashed(seed: int, *values: int) -> int:
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v, h)
        return h

    long = lambda v: struct.pack("<q", v)
    int_ = lambda v: struct.pack("<i", v)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    sizes = {s: sum(len(x[1].split()) for x in rows if x[2] == s) for s in "ab"}
    want = _filled(sizes, mix)
    for s in "ab":
        docs = [(signed(hashed(42, int_(mix.seed), long(i), long(len(t.split())))), i, len(t.split())) for i, t, o in rows if o == s]
        mean = min(out[docs[0][1]]["target"] / sizes[s], 2.0)
        assert out[docs[0][1]]["target"] == pytest.approx(want[s])
        width, taken = -(-len(docs) // mixing.FAN_IN), {}
        groups = defaultdict(list)
        for h, i, n in docs:
            groups[h % width].append((h, i, n, mean - int(mean)))
        levels = 0
        while width > 1:
            levels, width = levels + 1, -(-width // mixing.FAN_IN)
        most = -(-max(sum(x[2] == o for x in rows) for o in "ab") // mixing.FAN_IN)
        deepest = 0
        while most > 1:
            deepest, most = deepest + 1, -(-most // mixing.FAN_IN)
        for level in range(deepest + 1):
            left = defaultdict(list)
            for b, units in groups.items():
                held = None
                for unit in sorted(units):
                    if held is None:
                        held = unit
                        continue
                    (h1, i1, n1, p1), (h2, i2, n2, p2) = held, unit
                    ratio = n2 / n1
                    up, down = min(1 - p1, p2 * ratio), min(p1, (1 - p2) * ratio)
                    draw = hashed(42, long(h1), long(h2), int_(level), int_(mix.seed))
                    if ((draw >> 11) + 0.5) / float(1 << 53) * (up + down) < down:
                        if 1 - p1 <= p2 * ratio:
                            taken[i1], held = 1, (h2, i2, n2, min(1.0, max(0.0, p2 - (1 - p1) / ratio)))
                        else:
                            taken[i2], held = 0, (h1, i1, n1, min(1.0, max(0.0, p1 + p2 * ratio)))
                    elif p1 <= (1 - p2) * ratio:
                        taken[i1], held = 0, (h2, i2, n2, min(1.0, max(0.0, p2 + p1 / ratio)))
                    else:
                        taken[i2], held = 1, (h1, i1, n1, min(1.0, max(0.0, p1 - (1 - p2) * ratio)))
                left[b // mixing.FAN_IN].append(held)
            groups = left
        ((h, i, n, p),) = [u for units in groups.values() for u in units]
        taken[i] = int(((hashed(42, long(h), int_(mix.seed)) >> 11) + 0.5) / float(1 << 53) < p)
        assert {i: out[i]["taken"] for _, i, _ in docs} == {i: n * (int(mean) + taken[i]) for _, i, n in docs}


def test_mixing_keeps_expectations(spark):
    rows = [(i, "w " * (i % 7 + 1), "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = Counter()
    runs = 12
    for seed in range(runs):
        for r in mixing.mix_documents(docs, mixing.Mix(weights=(3, 2), seed=seed)).collect():
            sums[r["doc_id"]] += r["taken"] / r["size"]
            mean = r["target"] / r["source_size"]
            sums["all"] += r["taken"] / r["size"] - mean
    assert abs(sums["all"]) / (runs * len(rows)) < 0.05
    assert all(0 < sums[i] / runs < 2.01 for i in range(40))


def test_mixing_of_little(spark):
    schema = "doc_id long, text string, source string" + EXTRA
    assert mixing.mix_documents(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, None, 1, 1.0, 1, "", 1), (None, " \n", "a", 1, 1.0, 1, "", 1)], schema)
    assert sorted((r["size"], r["target"], r["taken"]) for r in mixing.mix_documents(blank).collect()) == [(0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b c", "x", 1, 1.0, 1, "", 1)], schema)
    (r,) = mixing.mix_documents(one).collect()
    assert r["target"] == pytest.approx(4.5) and r["taken"] in (3, 6)


# ---- 12 conversation repair


def _brute(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Dijkstra over whole edit scripts: (cost, audit) of the first finished one, least audit first."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("gone" if not said or (role, text) in seen else "short" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        for role in ("user", "assistant"):
            if len(roles) < 2 * len(rows) + 4 and _prefix(roles + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], [*out, (role, "")]))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if faults[i] != "gone":
                more = 5 if faults[i] == "short" else 0
                if role[:1] and _prefix(roles + role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], [*out, (role, text)]))
                for to in ("user", "assistant"):
                    if _prefix(roles + to[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, roles + to[0], [*out, (to, text)]))
    raise AssertionError


def _prefix(roles: str) -> bool:
    return re.fullmatch(r"s?(ua)*u?", roles) is not None


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "speaker"]
TEXTS = ["Yes.", "no", "", "  ", "Why?", "Stop!\n", "é", "Yes."]


def _random_turns(conv, n: int, r: random.Random) -> list[tuple]:
    return [(conv, r.choice([None, *range(n)]), r.choice(ROLES), r.choice(TEXTS) + r.choice(["", " ok.", f" {r.randint(0, 9)}"]), 1, "x", 2) for _ in range(n)]


def _digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rows).encode()).hexdigest()


@pytest.mark.parametrize("rows_a_piece", [1024, 3, 1])
def test_repair_equals_a_search_over_scripts(spark, rows_a_piece, monkeypatch):
    """Also when every conversation is cut into pieces of a few rows: pieces are cut in tasks, which get the bound with the code."""
    r = random.Random(rows_a_piece)
    turns = [t for c in range(60) for t in _random_turns(c, r.randint(1, 7), r)] + _random_turns(None, 5, r)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, at int, whole string, code int")
    cut = repair._cut
    if rows_a_piece != 1024:

        def small(batches):
            repair.ROWS = rows_a_piece
            yield from cut(batches)
            repair.ROWS = 1024

        monkeypatch.setattr(repair, "_cut", small)
    got = {x["conv_id"]: x for x in repair.digests(repair.repair(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in turns:
        by[c].append((t is not None, t, role, text))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        rows = [(role, text) for _, _, role, text in own]
        cost, audit, out = _brute(rows)
        x = got[c]
        assert (x["cost"], x["audit"], x["repaired_sha256"]) == (cost, audit, _digest(out)), (c, rows)
        kinds = {t for _, t, _, _ in own if t is not None}
        assert x["gaps"] == (max(kinds) - min(kinds) + 1 - len(kinds) if kinds else 0)
        assert x["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        seen, counts = set(), [0, 0, 0]
        for row in rows:
            said = row[1].strip(" \t\n\x0b\x0c\r")
            kind = 0 if not said else 1 if row in seen else 2 if said[-1] not in ".!?" else None
            seen.add(row)
            if kind is not None:
                counts[kind] += 1
        assert [x["blank"], x["duplicate"], x["truncated"]] == counts


def test_repair_of_one_conversation_that_holds_all_rows(spark):
    """Thousands of rows, among them very long texts, cross many pieces and ranges; the audit equals that of the rows at once."""
    r = random.Random(9)
    turns = _random_turns(7, 6000, r) + [(7, 99_999, "user", "long " * 400_000 + ".", 1, "x", 2), (7, 99_999, "user", "long " * 400_000 + ".", 1, "x", 2)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, at int, whole string, code int").repartition(5)
    pieces = repair.repair(df)
    assert pieces.count() > 5
    (x,) = repair.digests(pieces).collect()
    rows = sorted(((t[1] is not None, t[1] or 0, t[2], t[3]) for t in turns))
    code = repair.observed([a[2] for a in rows], [a[3] for a in rows], [1], set())[0]
    cost, audit = repair.solved(code)
    assert (x["cost"], x["audit"]) == (cost, audit)
    assert x["repaired_sha256"] == _digest(repair.replayed(audit, [a[2] for a in rows], [a[3] for a in rows], repair.START))


def test_damage_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "assistant", "One. Two!") for c in (1, None) for t in (*range(60), None)] + [(5, 1, None, None)]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damage(spark.createDataFrame(rows, schema)).collect())
    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c, t, "user" if kind == 4 else role, text] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert got == +want
    assert repair.digests(repair.repair(spark.createDataFrame([], schema))).count() == 0


# ---- 13 vector codes


def _plain_codes(rows: list[tuple]) -> dict:
    """The contract, number by number."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out, labels = [], Counter()
    for i, v, label in kept:
        got = [near(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
        labels[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, code, error, labels[label], sha) for i, code, error, label in out)


def test_codes_equal_a_plain_count(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, -0.3, 0.2, 0.7]) + r.random() / 50 for _ in range(8)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [rows[3], rows[3], (None, [0.5] * 8, None), (900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 2), (903, [float("-inf")] * 8, 2), *[(1000 + i, [0.25] * 8, 2) for i in range(150)]]
    df = spark.createDataFrame([(*x, 1, "c", 2, [3]) for x in rows], "vec_id long, embedding array<double>, label int, n int, code string, error int, v array<int>")
    out = vector_codes.compress(df.repartition(5))
    assert Counter(map(tuple, out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == _plain_codes(rows)


def test_codes_of_little_and_of_large_components(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [None], 1)], schema)).count() == 0
    mixed = spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.25] * 6, 1), (3, [], None), (4, [0.5] * 4, 1)], schema)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.compress(mixed).collect()}
    assert got == {1: ("00000000", 0), 2: ("00000000", 0), 3: ("00000000", 0), 4: ("00000000", 0)}
    large = [(i, [r * 3e4 for r in (1.0, -1.0, 0.5, 0.25)], i % 2) for i in range(5)] + [(9, [-3e4] * 4, None)]
    assert Counter(tuple(r)[:4] for r in vector_codes.compress(spark.createDataFrame(large, schema)).collect()) == Counter({k[:4]: n for k, n in _plain_codes(large).items()})
    with pytest.raises(ValueError, match="64-bit"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1)], schema)).count()


# ---- exactness of operator 7 beyond a thousand dimensions


@pytest.mark.parametrize("dim", [1024, 1536, 4096])
def test_products_of_long_rows_are_whole(dim):
    from veritally.llm.embedding_dedup import products

    r = np.random.default_rng(dim)
    q, p = (r.choice(np.array([-127, 126, 127], np.int8), size=(40, dim)) for _ in range(2))
    q[0], p[0] = 127, 127
    assert (products(q, p.astype(np.float32).T) == q.astype(np.int64) @ p.astype(np.int64).T).all()


@pytest.mark.parametrize("dim", [1536, 4096])
def test_long_vectors_at_the_threshold(spark, dim):
    """Pairs whose cosine is 0.95 plus and minus a hundred-millionth."""
    from veritally.llm.embedding_dedup import near_vectors

    r, rows, want = np.random.default_rng(dim), [], {}
    for k in range(6):
        u = r.normal(size=dim)
        v = r.normal(size=dim)
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        c = 0.95 + (1e-8 if k % 2 else -1e-8)
        rows += [(2 * k, u.tolist()), (2 * k + 1, (c * u + np.sqrt(1 - c * c) * v).tolist())]
        want |= {2 * k: k % 2, 2 * k + 1: k % 2}
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: x["n_links"] for x in got} == want
