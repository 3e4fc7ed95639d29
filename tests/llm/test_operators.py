"""The ten operators against brute force, round trips and the cases that tables may hold: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veritally.llm import chat, components, embedding_dedup, html_extraction, lm_model, lm_scoring, packing, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash

EXTRA = ", words array<int>, node string, rank int, key string, chunk string, _row int, _score int, shard int, of int"
DOCS = "doc_id long, text string" + EXTRA


def _text(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "an", "er", "tion", "re", "in", "ou"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def _rows() -> list[tuple]:
    base = _text(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: None, 4: "", 5: " \t\n", 6: "Short", 7: _text(9000, 2), 8: "é" * 50 + " <|endoftext|> ÀB c",
        9: "same line here\n" * 12 + _text(30, 3), 10: "*** " * 40, 11: _text(60, 4).upper(), 12: base, 13: "<|im_end|> \\ <\\| x",
    }
    rows = [(k, v) for k, v in texts.items()] + [(12, base), (None, "no id at all"), (None, None)]
    return [(*r, [1], "n", 5, "k", "c", 7, 8, 9, 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 packing


def test_packing_reads_back_and_has_no_gaps(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    out = packing.pack_documents(docs, size=64).collect()
    want = Counter()
    for r in _rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    ends = defaultdict(int)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 64
    assert len(ends) <= -(-sum(ends.values()) // 64) + 2


def test_word_ids_equal_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    odd = ["It's", "they'll,", "W\u030A,", "\u0130stanbul,", "\u0130", "A\u0301!", "<|endoftext|>", "x<|endoftext|>.", "<|ENDOFTEXT|>", "\u00c9t\u00e9!!", "\u00c4\u00df,", "\u01c5a.", "a\u00a0b", "3.5,", "can't!'", "'s", "\u03a3\u03a3.", "x=\u0338", "\x1cq", "don't.stop", "-a", "...", "\U0001f600,"]
    texts = [" ".join(odd), *odd, "", " ".join(f"{w}{p}" for w in ("Hend", "hend", "\u00e9w") for p in ("", ".", "'s", "?!"))]
    for size in (1, 10_000):
        for name in ("REMEMBERED", "PARTS", "TOGETHER", "JOINED"):
            monkeypatch.setattr(packing, name, size)
        found = packing.WordIds(packing.vocabulary_path()).of([x.encode() for x in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_ids_encode_a_run_of_letters_once():
    known, asked = packing.WordIds(packing.vocabulary_path()), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **kw):
            asked.extend(w.strip("!.,").lower() for x in texts for w in x.split())
            return self.tokenizer.encode_batch_fast(texts, **kw)

    for name in ("tokenizer", "plain"):
        if hasattr(known, name):
            setattr(known, name, Counted(getattr(known, name)))
    list(known.of([b"Hend hend, HEND!!", b"hend. hend,"]))
    assert asked.count("hend") == 1


def test_word_ids_parse_only_words_with_more_than_ascii_letters(monkeypatch):
    known, parsed, real = packing.WordIds(packing.vocabulary_path()), [], packing._CUT
    monkeypatch.setattr(packing, "_CUT", lambda text: parsed.extend(text.split(" ")) or real(text))
    texts = [b"The cat\tand the\x0b dog ", "caf\u00e9 the dog. 3 CAT".encode(), b"cat", b"\n"]
    found = [np.frombuffer(x, "<u4").tolist() for x in known.of(texts)]
    assert found == [known.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in texts]
    assert sorted(parsed) == ["3", "caf\u00e9", "dog."]


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        size = r.choice([10, 37, 100])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 200))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [x for x in rooms if x >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(size - n)
        counts, seen = Counter(lengths), defaultdict(list)
        plan = sorted(packing.best_fit_plan(counts, size))
        for k, (length, rank, first, each, offset) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
            for i in range(end - rank):
                seen[first + i // each].append((offset + i % each * length, length))
        assert len(seen) == len(rooms)
        assert sum(map(len, seen.values())) == len(lengths)
        for slots in seen.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= size


# ---- 2 chat


def test_chat_reads_back_every_turn(spark):
    rows = [
        (1, 0, "user", "hi", 1), (1, 1, "user", chat.FORGED, 1), (1, 2, "assistant", "a\\<|b\n<", 1), (1, 3, "assistant", None, 1), (1, 4, "user", "|x", 1),
        (2, 0, None, "", 1), (2, 0, "assistant", "tie", 1), (2, 0, "assistant", "tie", 1), (None, None, "odd\nrole<|im_body|>", "é", 1), (3, 0, "system", None, 1),
    ]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_back(out["formatted"]).alias("t"), chat.loss_text(out["segments"]).alias("l")).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [x[1:] for x in own]
        assert got[conv]["l"] == "".join(x[2] for x in own if x[1] == "assistant")
    assert got[1]["formatted"].count("<|im_start|>") == 3  # adjacent turns of a role are one block
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 3 quality rules


def _measures(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_whole_texts(docs, none):
    out = quality_rules.ledger(docs)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in out.collect()) == Counter((r[0], *_measures(r[1])) for r in _rows())
    assert quality_rules.ledger(none).count() == 0


def test_policies_and_ablations_come_from_the_bits(docs):
    rows = quality_rules.ledger(docs).select("failed").collect()
    policy = quality_rules.POLICIES["v1"]
    got = {r["rule"]: (r["failing"], r["only_this"]) for r in quality_rules.ablations(quality_rules.ledger(docs), policy).collect()}
    for i, rule in enumerate(quality_rules.RULES):
        hit = [r["failed"] for r in rows if r["failed"] >> i & 1]
        assert got[rule.name] == (len(hit), sum(f == 1 << i for f in hit))
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["failed"] == 0 for r in rows)


# ---- 4 SentencePiece


def test_codec_gives_the_library_ids_and_the_text_back(docs, none):
    import sentencepiece

    path = sentencepiece_codec.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.encode_documents(docs, path)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect())
    assert got == Counter((r[0], tuple(library.encode(r[1] or ""))) for r in _rows())
    assert out.where("NOT round_trip").count() == 0
    texts = Counter(map(tuple, sentencepiece_codec.decode_documents(out, path).collect()))
    assert texts == Counter((r[0], r[1] or "") for r in _rows())
    assert sentencepiece_codec.encode_documents(none, path).count() == 0


def test_search_streams_without_words():
    import sentencepiece

    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    for text in (_text(400, 9), "a" * 700, "日本語 🙂 naïve " * 20, "x" + " " * 90 + "y"):
        whole = list(c.search("▁" + text.replace(" ", "▁")))
        assert "".join(whole) == "▁" + text.replace(" ", "▁")
        ids = [i for t in whole for i in ([c.id[t]] if t in c.id else [c.bytes[b] for b in t.encode()])]
        assert ids == library.encode(text)


# ---- 5 HTML


def test_html_keeps_the_article_only(spark):
    page = """<html><head><title>t</title><script>var t="</p><article>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div>
    <article><h1>T&amp;C</h1><p><b>one <i>two</i>&nbsp; three<br>four<p>five<div class="comments"><p>me first</div><form>f</form></article><footer>end</footer>"""
    own = "<div>Sign up for the weekly letter of this very fine site</div>"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "x", ""), (4, "http://b/1", own + "<p>alone in the world</p>"), (5, "http://b/2", own + "<p>other text</p>"), (6, "http://c/", "<p>single &lt;page</p>")]
    rows = [(*r, "clash") for r in [*rows, rows[0]]]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    got = Counter((r["page_id"], r["text"]) for r in out.collect())
    assert got == Counter({(1, "T&C\none two three four\nfive"): 2, (2, ""): 1, (3, ""): 1, (4, "alone in the world"): 1, (5, "other text"): 1, (6, "single <page"): 1})
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_parsed_article_goes_to_the_host(spark):
    pages = {
        "role='main'": ("<div>top</div><div role='main'><p>kept here</p></div>", "kept here"),
        "role=main": ("<div>top</div><div ROLE=Main><p>kept here</p></div>", "kept here"),
        "comment": ("<!-- <article> --><p>kept here</p>", "kept here"),
        "script": ("<script>var a='<main>'</script><p>kept here</p>", "kept here"),
        "replies": ('<div><p>the post</p></div><article class="comment"><p>a reply</p></article>', "the post"),
        "empty main": ("<main></main><div>beside it</div>", "beside it"),
        "nothing": ("<nav>only a menu</nav>", ""),
    }
    rows = [(i, f"http://{i}/", page) for i, (page, _) in enumerate(pages.values())]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(i, text) for i, (_, text) in enumerate(pages.values())]


def test_html_wrappers_keep_their_pages():
    article = "<article><h1>head</h1><p>body</p></article>"
    for page, want in [
        (f'<div class="content with-sidebar">{article}</div>', "head\nbody"),
        (f'<div id="page" class="no-sidebar">{article}<div class="sidebar">side</div></div>', "head\nbody"),
        ('<article class="post comments-open promo"><h1 class="entry-header">head</h1><p>body</p></article>', "head\nbody"),
        ('<article><div class="page-header"><h2 class="header">head</h2></div><p>body</p><div class="comment-list">no</div></article>', "head\nbody"),
        (f'<div class="widget">{article}</div>', "head\nbody"),
        (f'<div class="widget"><article>teaser</article></div>{article}<div class="site-footer">no</div>', "head\nbody"),
    ]:
        assert html_extraction.settled(page) == (True, want.split("\n")), page
    assert html_extraction.settled('<div><p>the post</p></div><div class="comments"><article>a reply</article></div>') == (False, ["the post"])
    assert html_extraction.settled('<div class="post">the post</div><div class="sidebar"><article>teaser</article></div>') == (False, ["the post", "teaser"])


def test_html_scanner_and_teasers():
    body = "real words of the page " * 12
    for page, want in [
        ("<script>var a = 1 // don't</script><p>One</p><p>it's fine</p>", (False, ["One", "it's fine"])),
        ("<style>a{content:'<'}</style><p>x</p>", (False, ["x"])),
        ('<article><div class="article-header"><h1>Head line</h1></div><p>x</p></article>', (True, ["Head line", "x"])),
        (f"<article>teaser card</article><main><p>{body}</p></main>", (True, [body.strip()])),
        (f"<main><p>{body}</p></main><article>teaser card</article>", (True, [body.strip()])),
        (f"<main><p>{body}</p><article>teaser</article></main>", (True, [body.strip(), "teaser"])),
        (f"<main><article>{body}</article><p>related links</p></main>", (True, [body.strip()])),
        (f"<div>{body}</div><article>teaser</article>", (False, [body.strip(), "teaser"])),
        ("<p>&am<b>p;</b> &lt;b&gt;</p>", (False, ["&amp; <b>"])),
        (f"<p>{'long ' * 200_000}</p>", (False, [("long " * 200_000).strip()])),
    ]:
        assert html_extraction.settled(page) == want


def test_html_runs_decide_with_elements(spark):
    """Site-wide blocks go from articles too, quotations stay; pages without elements are those of brute force over the whole host."""
    r = random.Random(12)
    site = "share this story with all of your friends by post today"
    quote = "a line that three of the articles on this site quote in full"
    rows, want = [], {}
    for i in range(20):
        own = [_text(25, 3000 + i), *([quote] if i % 7 == 0 else [])]
        rows.append((i, f"http://news/{i}", f"<body><nav>menu</nav><article>{''.join(f'<p>{t}</p>' for t in own)}<p>{site}</p></article>"))
        want[i] = "\n".join(own)
    parts = [_text(12, 4000 + k) for k in range(6)]
    plain = {i: [_text(14, 5000 + i), *r.sample(parts, r.randint(0, 3))] for i in range(100, 112)}
    for i, blocks in plain.items():
        rows.append((i, f"http://plain/{i}", "".join(f"<div>{t}</div>" for t in blocks)))
    for i, kept in zip(plain, html_extraction.unique_runs(list(plain.values()), several=3), strict=True):
        want[i] = "\n".join(kept)
    out = html_extraction.extract(spark.createDataFrame([(*q, 1, "x") for q in rows], "page_id long, url string, html string, bundle int, key string"))
    assert {q["page_id"]: q["text"] for q in out.collect()} == want


def test_html_copies_keep_their_text(spark):
    own = "<div>Sign up for the weekly letter of this very fine site</div>"
    quote = "a saying of eight words that two articles quote"
    texts = [_text(30, 60), _text(30, 61) + " " + quote, _text(30, 62) + " " + quote]
    pages = [f"{own}<p>{t}</p>" for t in texts]
    rows = [(i, f"http://h/{i}", page) for i, page in enumerate(pages)]  # several pages
    rows += [rows[1], rows[1], (3, "http://h/mirror", pages[1])]  # repeated rows and a mirror
    rows += [(i, f"http://one/{i}", pages[0]) for i in range(4, 8)]  # a host of one page in copies
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Counter((r["page_id"], r["text"]) for r in out.collect())
    one = own.removeprefix("<div>").removesuffix("</div>") + "\n" + texts[0]
    assert got == Counter([(0, texts[0]), (1, texts[1]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (3, texts[1]), *((i, one) for i in range(4, 8))])


def test_html_hosts_of_many_bundles_count_every_page(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "BUNDLE", 4)
    run = [_text(12, 900), _text(12, 901)]  # on 3 pages, on 2
    pages = [[_text(30, 700 + i), *(run[:1] if i in (0, 17, 39) else run[1:] if i in (5, 22) else [])] for i in range(40)]
    rows = [(i, f"http://big/{i}", "".join(f"<p>{t}</p>" for t in page)) for i, page in enumerate(pages)]
    out = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = ["\n".join(x) for x in html_extraction.unique_runs(pages, several=3)]
    assert [r["text"] for r in out.orderBy("page_id").collect()] == want
    assert sum(run[0] in t for t in want) == 0 and sum(run[1] in t for t in want) == 2


def test_repeated_runs_are_those_of_brute_force():
    r = random.Random(3)
    for _ in range(30):
        pages = [[" ".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 6))]
        streams = [[w for b in p for w in b.split()] for p in pages]
        where = defaultdict(set)
        for k, s in enumerate(streams):
            for i in range(len(s) - 3):
                where[tuple(s[i : i + 4])].add(k)
        want = []
        for k, (p, s) in enumerate(zip(pages, streams, strict=True)):
            covered = {j for i in range(len(s) - 3) if len(where[tuple(s[i : i + 4])]) > 1 for j in range(i, i + 4)}
            at, kept = 0, []
            for b in p:
                words = b.split()
                if left := [w for j, w in enumerate(words) if at + j not in covered]:
                    kept.append(" ".join(left))
                at += len(words)
            want.append(kept)
        assert html_extraction.unique_runs(pages, 4) == want


# ---- 6 sharding


def test_shards_by_key(docs, none):
    tree = sharding.Tree.even(24)
    assert tree.shards() == 24
    assert tree.grown().shards() == 25
    out = sharding.shard_documents(docs, tree).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in _rows())
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(none, tree).count() == 0


def test_growth_moves_rows_into_the_new_shard_only(spark):
    keys, tree = spark.range(4000), sharding.Tree.even(24)
    out = sharding.place(sharding.place(keys, "id", tree, "a"), "id", tree.grown(), "b").collect()
    moved = [r for r in out if r["a"] != r["b"]]
    assert {r["b"] for r in moved} == {24}
    assert 80 < len(moved) < 260
    counts = Counter(r["a"] for r in out)
    assert set(counts) == set(range(24))
    assert max(counts.values()) < 230


def test_weights_confine_movement_to_their_subtree(spark):
    one, two = sharding.Tree((((1, 1), (1, 1)), ((1, 1),))), sharding.Tree((((1, 3), (1, 1)), ((1, 1),)))
    out = sharding.place(sharding.place(spark.range(3000), "id", one, "a"), "id", two, "b").collect()
    assert all(r["b"] < 4 for r in out if r["a"] != r["b"])  # rows only move into or inside the region whose weight grew


# ---- 7 embeddings


def test_near_vectors_are_those_of_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 16))
    for k in range(40):
        x[50 + k] = x[k % 9] + r.normal(size=16) * r.uniform(0, 0.2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, x[3].tolist()), (201, (x[3] * 7).tolist()), (202, None), (203, [0.0] * 16), (204, [None] + [1.0] * 15), (205, [float("nan")] * 16), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [1e200] * 16), (None, x[3].tolist())]
    df = spark.createDataFrame([(*a, "c", 1) for a in rows], "vec_id long, embedding array<double>, node string, links int")
    got = {q["vec_id"]: q for q in embedding_dedup.near_vectors(df, tile=16).collect()}
    fine = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    near = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    for i, _ in rows:
        if i is None:
            assert got[i]["component_id"] is None
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(reach), min(reach) == i)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_one_id_on_two_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.99, 0.01]), (7, [0.01, 0.99]), (8, [0.02, 0.98])]
    got = Counter((q["vec_id"], q["n_links"], q["component_id"]) for q in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)])


def test_pairs_at_the_threshold_are_recomputed(spark):
    # cosines of 0.95 give or take 1e-12: no bound settles them
    rows = [(0, [1.0] + [0.0] * 7)]
    for k, off in enumerate((-1e-12, 1e-12, -3e-12, 3e-12), 1):
        c = 0.95 + off
        rows.append((k, [c] + [0.0] * k + [(1 - c * c) ** 0.5] + [0.0] * (6 - k)))
    got = {q["vec_id"]: q["n_links"] for q in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 2, 1: 0, 2: 1, 3: 0, 4: 1}


def test_quantisation_bounds_hold():
    r = np.random.default_rng(2)
    u, q, scale, size, rest = embedding_dedup.quantise(r.normal(size=(300, 24)) * r.uniform(0.1, 50, size=(300, 24)))
    near = (q.astype(float) * scale[:, None]) @ (q.astype(float) * scale[:, None]).T
    assert (np.abs(near - u @ u.T) <= size[:, None] * rest[None] + rest[:, None] + 1e-12).all()


# ---- 8 language model


def test_scores_are_a_distribution_and_base_is_exact(docs, none):
    out = lm_scoring.score_documents(docs).collect()
    rows = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in _rows()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(-1e6 < r["score"] < 0 for r in out)
    assert lm_scoring.score_documents(none).count() == 0


def test_spelling_sums_to_one():
    # from any context the 256 next bytes share probability 1, whatever the tables hold
    r = np.random.default_rng(0)
    n = r.integers(0, 50, lm_model.offsets(lm_model.BYTES)[-1])
    speller = lm_model.Predictors.fresh(lm_model.BYTES, np.floor(n * r.random(len(n))), n)
    speller.settle(r.normal(0.3, 0.1, speller.weights.size), r.integers(0, 90, len(speller.refined)) + 90.0, r.integers(0, 90, len(speller.refined)) * 1.0)
    for start in (b"", b"th", b"then"):
        slots, y, of = lm_model.byte_bits([start + bytes([b]) for b in range(256)], np.arange(256) % 17 * 0 + 3)
        cost = speller.cost(slots, y).reshape(-1, 8).sum(1)[np.flatnonzero(of[::8] >= 0)]
        cost = cost.reshape(256, -1)[:, len(start)]
        assert abs(np.exp(cost).sum() - 1) < 1e-4


def _captured(docs, monkeypatch):
    """Rows of score_documents, and what it made of its documents: coded chunks, the vocabulary, the code and the predictors."""
    seen, real = {}, lm_scoring.fitted

    def fitted(coded, vocabulary, code):
        speller, mixer = real(coded, vocabulary, code)
        seen.update(coded=coded.toArrow(), vocabulary=vocabulary.collect(), code=code, speller=speller, mixer=mixer)
        return speller, mixer

    monkeypatch.setattr(lm_scoring, "fitted", fitted)
    return lm_scoring.score_documents(docs).collect(), seen


def _plain_bits(code, word):
    """The coded bits of a word (level, index, class) as (node, bit), and the logarithm of the rest, by walking the code."""
    lev, ix, cls = word
    out, rest = [(n + 1, b) for n, b in code.paths[lev]], 0.0
    if lev >= lm_model.level(np.array([lm_model.MIXED]))[0]:
        many = int(code.words[lev].sum())
        width, low, high = (many - 1).bit_length(), 0, 1 << (many - 1).bit_length()
        for d in range(width):
            mid = (low + high) // 2
            b = int(ix >= mid)
            if mid < many:
                out.append(((lev << 48) + (1 << 32) + (1 << d) + (ix >> width - d), b))
            low, high = (mid, high) if b else (low, mid)
    elif lev:
        for d in range(3):
            half = 1 << 2 - d
            up, b = cls >> 3 - d, cls >> 2 - d & 1
            other = (up * 2 + 1 - b) * half
            if code.words[lev][other : other + half].sum():
                out.append((64 + (lev << 8) + (1 << d) + up, b))
        rest = -np.log(code.words[lev][cls])
    return out, rest


def _plain_score(words, table, code, speller, mixer):
    """The natural logarithm of a text's probability, token by token and bit by bit."""
    M, b, c = (1 << 64) - 1, *(int(x) for x in (lm_model._B, lm_model._C))
    at, total, new = lm_model.offsets(lm_model.TOKENS).tolist(), 0.0, (0, 0, 0)
    pairs, run, votes = {}, 0, [0] * 8

    def ident(w):
        n, (lev, ix, _) = table.get(w, (0, new))
        return (lev << 48) + ix + 2 if n > 1 else 0

    def kind(w):
        lev, _, cls = table.get(w, (0, new))[1]
        return cls * 4 + sum(lev >= x for x in (1, 3, 5))

    def known(w):
        return w in table

    for t, w in enumerate(words):
        one, two = (words[t - 1] if t > 0 else None), (words[t - 2] if t > 1 else None)
        lead = votes.index(max(votes)) if any(votes) else 8
        names = [1 if x is None else ident(x) for x in (one, two)]
        kinds = [32 if x is None else kind(x) for x in (one, two)]
        near = names[0] * b & M
        contexts = [(lead + 1) * c & M, near, ((lead * 128 + kinds[0]) * 128 + kinds[1] + 1) * b & M]
        offer = pairs.get((two, one)) if t > 1 else None
        own, rest = _plain_bits(code, table.get(w, (0, new))[1])
        told = _plain_bits(code, table.get(offer, (0, new))[1])[0] if offer is not None else []
        for d, (node, bit) in enumerate(own):
            agrees = d < len(told) and told[d][0] == node
            slots = [((x >> 32 ^ (node * c & M) >> 32) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - n for x, n in zip(contexts, lm_model.TOKENS, strict=False)] + [run * 2 + told[d][1] if agrees else 32]
            total += mixer.cost(np.array([[s + o] for s, o in zip(slots, at, strict=False)], np.int32), np.array([bit]))[0]
        total += rest
        if not known(w):
            if offer is not None and not known(offer):
                k = at[3] + run * 2 + 1
                p = (mixer.ones[k] + 0.4) / (mixer.n[k] + 0.8)
                total += np.log(p) if offer == w else np.log(1 - p)
            if offer is None or offer != w:
                total += lm_model.spelled([w], np.array([lead]), speller)[0]
        run = min(run + 1, 15) if offer == w else 0
        if t > 1:
            pairs[two, one] = w
        if known(w):
            votes[table[w][1][2]] += 1
    return total


def test_codes_are_those_of_walking_the_code():
    r = np.random.default_rng(3)
    words = np.zeros((lm_model.LEVELS, lm_model.GROUPS), np.int64)
    words[1], words[3, 2], words[8], words[10, 5] = r.integers(0, 9, lm_model.GROUPS), 4, r.integers(1, 5, lm_model.GROUPS), 1
    tokens = np.where(words.sum(1) > 0, r.integers(1, 900, lm_model.LEVELS), 0)
    code = lm_model.Code.of(words, tokens)
    every = [(lev, int(words[lev, :cls].sum()) + k, cls) for lev in range(lm_model.LEVELS) for cls in range(lm_model.GROUPS) for k in range(int(words[lev, cls]))] + [(0, 0, 0)]
    lev, ix, cls = (np.array(x) for x in zip(*every, strict=True))
    ends, nodes, bits, plain = code.lay(lev, lev, ix, cls)
    total, seen = 0.0, Counter()
    for k, word in enumerate(every):
        a, b = (ends[k - 1] if k else 0), ends[k]
        own, rest = _plain_bits(code, word)
        hashed = lm_model.short(np.array([n for n, _ in own], np.uint64) * lm_model._C)
        assert nodes[a:b].tolist() == hashed.tolist()
        assert bits[a:b].tolist() == [x for _, x in own]
        assert np.isclose(plain[k], rest)
        seen[tuple(own)] += 1
        total += 0.5 ** len(own) * np.exp(rest)
    assert np.isclose(total, 1)  # a code, whatever the bits' probabilities


def test_bits_of_histories_are_those_of_each_token():
    r = np.random.default_rng(4)
    words = np.zeros((lm_model.LEVELS, lm_model.GROUPS), np.int64)
    words[1, 2], words[2, 1], words[6, 3] = 3, 4, 9
    lev, index, cls = np.repeat([0, 1, 2, 6], [1, 3, 4, 9]), np.array([0, *range(3), *range(4), *range(9)]), np.repeat([0, 2, 1, 3], [1, 3, 4, 9])
    laid = lm_model.Code.of(words, words.sum(1) * 5).lay(lev, lev, index, cls)
    codes = r.integers(0, len(lev), 500)
    history = lm_model.History.of(codes, np.array([0, 200]), index.astype(np.uint64) + (lev.astype(np.uint64) << np.uint64(48)) + np.uint64(2), cls, lev)
    ends, nodes, bits, _ = laid
    want, got = Counter(), Counter()
    for t, c in enumerate(codes.tolist()):
        for k in range(ends[c - 1] if c else 0, ends[c]):
            want[t, int(bits[k]), *(int(lm_model.slot(x[t], nodes[k], b)) + o for x, b, o in zip(history.contexts, lm_model.TOKENS, lm_model.offsets(lm_model.TOKENS).tolist(), strict=False))] += 1
    for slots, y, of in history.bits(laid, 128):
        assert slots.dtype == np.uint32
        got.update(zip(of.tolist(), y.tolist(), *slots[:3].tolist(), strict=True))
    assert got == want


def test_scores_are_those_of_brute_force(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [["the", "and", *(_text(1, i) for i in range(60))], ["der", "und", *("z" + _text(1, 90 + i) for i in range(60))]]
    texts = []
    for i in range(120):
        own = [r.choices(vocabulary[i % 2], [60, 40, *(60 / (k + 1) for k in range(60))])[0] if r.random() < 0.95 else _text(3, 500 + r.randint(0, 999)) for _ in range(r.randint(0, 80))]
        texts.append(" ".join(own + own[:20] * (i % 3 == 0)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "ENTRIES", 100)
    monkeypatch.setattr(lm_scoring, "TOGETHER", 2)
    rows, seen = _captured(docs, monkeypatch)
    code, table = seen["code"], {}
    at = {}
    for v in sorted(seen["vocabulary"], key=lambda v: v["part"]):
        c = lm_scoring._ints(bytes(v["c"]), v["n"])
        for w, n, cls in zip(bytes(v["words"]).split(b"\n"), c.tolist(), v["cls"], strict=True):
            lev = int(lm_model.level(np.array([n]))[0])
            table[w] = (n, lev, cls)
    for lev in {x[1] for x in table.values()}:
        for cls in range(8):
            start, k = int(code.words[lev][:cls].sum()), 0
            for v in sorted(seen["vocabulary"], key=lambda v: v["part"]):
                for w in bytes(v["words"]).split(b"\n"):
                    if table[w][1:] == (lev, cls):
                        at[w] = (table[w][0], (lev, start + k, cls))
                        k += 1
    held = {i for i, _ in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 == 2}
    assert Counter(w for i, t in enumerate(texts) if i not in held for w in [*t.encode().split(), b""]) == Counter({w: n for w, (n, _) in at.items()})
    assert any(not set(texts[i].encode().split()) <= set(at) for i in held)
    for q in rows:
        want = _plain_score([*texts[q["doc_id"]].encode().split(), b""], at, code, seen["speller"], seen["mixer"])
        assert abs(q["score"] - want / np.log(10)) < 1e-3 * max(1, abs(q["score"])) * 0.1
    # the codes of all words, with a new one's, have probability one in any place
    for history in ([], [b"the"], [b"the", b"and", b"the"]):
        before = _plain_score(history, at, code, seen["speller"], seen["mixer"])
        total = sum(np.exp(_plain_score([*history, w], at, code, seen["speller"], seen["mixer"]) - before) for w in at)
        fresh = b"neverseen"
        new = _plain_score([*history, fresh], at, code, seen["speller"], seen["mixer"]) - before
        votes = Counter(at[w][1][2] for w in history if w in at)
        lead = min(votes, key=lambda k: (-votes[k], k)) if votes else 8
        assert abs(total + np.exp(new - lm_model.spelled([fresh], np.array([lead]), seen["speller"])[0]) - 1) < 1e-3


def test_words_are_predicted_by_the_word_before(spark):
    # words of two bytes lead no kind of documents, so all are of one class: only their indices tell them apart
    r = random.Random(12)
    letters = "abcdefghijklmnop"
    pairs = [(f"{a}{b}", f"{b}{a}") for a in "qrst" for b in letters]
    right, wrong = ([i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][k] for k in (0, 1))
    rows = [(i, " ".join(w for _ in range(20) for w in r.choice(pairs))) for i in range(300) if i not in (right, wrong)]
    told = r.sample(pairs, 20)
    rows += [(right, " ".join(w for p in told for w in p)), (wrong, " ".join(w for k, p in enumerate(told) for w in (p[0], told[k - 1][1])))]
    got = {q["doc_id"]: q for q in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert np.isclose(got[right]["base_score"], got[wrong]["base_score"])
    assert got[right]["score"] > got[wrong]["score"] + 10


def test_long_documents_are_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 200)
    text = _text(300, 44)
    assert b" ".join(lm_scoring.pieces(text.encode())) == text.encode()
    assert list(lm_scoring.pieces(b"x" * 500)) == [b"x" * 500]
    assert list(lm_scoring.pieces(b"")) == [b""]
    # the functions that tasks run take the size from the module, so the pieces are seen here only
    out = lm_scoring.score_documents(spark.createDataFrame([(0, text), (1, text), (9, "a b")], "doc_id long, text string")).collect()
    assert {q["doc_id"]: q["n_tokens"] for q in out} == {0: 301, 1: 301, 9: 3}


# ---- 9 classifier


def test_classifier_on_labelled_folds(spark):
    good, bad = [_text(60, i) for i in range(150)], [" ".join(w + "!!" for w in _text(60, 1000 + i).upper().split()) for i in range(150)]
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)] + [(900, None), (901, ""), (None, good[0]), (902, good[1] * 200)]
    docs = spark.createDataFrame([(*r, 3, "c") for r in rows], "doc_id long, text string, quality int, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.score_documents(docs, quality_classifier.fitted(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held)
    assert not out[None]["held_out"]
    assert np.mean([out[i]["predicted"] == 1 - i % 2 for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert out[902]["predicted"] == 1
    kept = quality_classifier.filter_documents(docs, quality_classifier.fitted(docs, labels))
    assert kept.columns == docs.columns
    empty = quality_classifier.fitted(docs.limit(0), labels)
    assert {r["score"] for r in quality_classifier.score_documents(docs, empty).collect()} == {0.5}
    assert quality_classifier.score_documents(docs.limit(0), empty).count() == 0


# ---- 10 SimHash


def _fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, none):
    out = simhash.near_duplicates(docs).collect()
    for r in out:
        assert r["fp"] % (1 << 64) in {_fingerprint(x[1]) for x in _rows() if x[0] == r["doc_id"]}
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[1] == by[12] == 0
    assert by[3] == by[4] == by[5] == 3  # no words
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {0, 3, 6, 7}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [40, 4000])
def test_links_keep_every_component(spark, crowd):
    """Random fingerprints with a crowd around one centre, so that buckets of both kinds occur."""
    r = np.random.default_rng(crowd)
    centre = int(r.integers(0, 1 << 63))
    fps = {centre}
    while len(fps) < crowd:
        x = centre
        for b in r.choice(64, r.integers(1, 9), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in r.integers(0, 1 << 63, 300)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    nodes = simhash.stash(spark.createDataFrame([(i, int(x)) for i, x in enumerate(signed)], "node long, fp long"))
    found = {q["node"]: q["component"] for q in components.components(simhash.link(nodes)).collect()}
    u = signed.view(np.uint64)
    label = np.arange(len(u))
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= 4) for x in u]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert [found.get(i, i) for i in range(len(u))] == label.tolist()


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_of_any_shape(spark, shape):
    r = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(300)], "random": [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)]}[shape] + [(900, 900)]
    parent = {x: x for e in links for x in e}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {q["node"]: q["component"] for q in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def test_digests_of_chat_query_are_what_they_say(spark, tmp_path):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, str(tmp_path)).collect()}
    assert got[0]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    forged = html.unescape(chat.FORGED)
    assert (got[-1]["n_turns"], got[-1]["loss_chars"], got[-1]["loss_sha256"]) == (2, len(forged), hashlib.sha256(forged.encode()).hexdigest())
