"""Language-model scores by online logistic context mixing.

A text is a sequence of lower-cased words and one end. Each token is coded in bits, and every bit is predicted by counts under
several hashed contexts, whose stretched shares are combined by gated weights and refined by an adaptive map (lm_model):

* A token's level (how often the word occurs in the training documents; level 0: never), then, for words that occur MIXED (8) times or more, the
  bits of its index in the level, and for rarer ones the bits of their class, in which all words of the level are as likely. Contexts: the leading class of the document so far, the
  word before, class and level of the two words before, and whether the token that followed when these two last stood in this document
  goes on agreeing, by how many such copies came true in a row.
* A word of level 0 may be such a copy; else it is spelled, bit by bit of its bytes and a closing space, under the last 1 to 4 bytes and the leading class.

A word's class is the kind of training documents that it is most frequent in. A document's kind is its most frequent word of three bytes or more,
if that is one of the GROUPS - 1 most usual such words. Indices in a level are sorted by class.

The counts are of all training tokens (and of all training words once each, for spelling); where a training bit trains weights, it
is left out of them, so a word met once counts as new there. The weights are learned online in each chunk (over spelling: in each part of
the vocabulary) and averaged. All codes together have probability one, so `score` is a log10 probability and
-score / log10(2) the total bits; a word could also be spelled though it is known, so words' own probabilities sum to a little less.

Execution: documents become chunks, each with a dictionary of its words. A chunk asks for its words' counts in one row for each part of
the vocabulary, and gets one row back; parts hold about ENTRIES entries, so their number grows with the corpus. Tables of predictors have a
fixed size, are summed block by block, and are broadcast. Tokens move once, with their chunk.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lm_model as L
from .common import discard, fold, partitions, stash, table

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a chunk, about, and of a piece of a long document, about: a document's history starts anew with each piece.
CHUNK, PIECE = 8 << 20, 4 << 20
#: Dictionary entries that one part of the vocabulary meets, about; chunks whose entries meet in one group; slots in a block of a table.
ENTRIES, TOGETHER, BLOCK = 400_000, 512, 1 << 16
#: Words of a chunk that wait as single objects until they are taken into an array, about.
TAKEN = 1 << 16
#: Stands for the end of a text: no word is empty.
END = b""
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_CHUNKS = "chunk long, rows array<long>, doc_ids array<long>, held array<boolean>, tops array<binary>, sizes array<long>, n_bytes array<long>, words binary, n_words long, codes binary"
_CODED = "rows array<long>, doc_ids array<long>, held array<boolean>, sizes array<long>, n_bytes array<long>, codes binary, fresh binary, n_fresh long, c binary, ix binary, cls binary"
_BLOBS = "block int, salt int, ones binary, n binary"
_LEARNED = "weights array<double>, seen array<double>, hit array<double>, bits double"


def _ints(blob: bytes | memoryview, n: int) -> np.ndarray:
    """n numbers packed by _packed."""
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<u8").astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u8" if len(x) and x.max() >> 32 else "<u4").tobytes()


def _sparse(counts: np.ndarray) -> bytes:
    """Rows of counts by what isn't zero: how many there are in each row, their places, and they."""
    row, place = np.nonzero(counts)
    return np.bincount(row, minlength=len(counts)).astype(np.uint8).tobytes() + place.astype(np.uint8).tobytes() + _packed(counts[row, place])


def _dense(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and numbers that _sparse packed of n rows."""
    many = np.frombuffer(blob, np.uint8, n)
    total = int(many.sum())
    return np.repeat(np.arange(n), many), np.frombuffer(blob, np.uint8, total, n), _ints(blob[n + total :], total)


def _split(blob: bytes, n: int) -> list[bytes]:
    return blob.split(b"\n") if n else []


def pieces(text: bytes, size: int = 0) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at, size = 0, size or PIECE
    while len(text) - at > size:
        cut = _GAP.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def top_word(words: list[bytes]) -> bytes:
    """The most frequent word of three bytes or more, of equals the smallest; empty if there is none."""
    top, most = b"", 0
    for w, n in Counter(words).items():
        if n >= most and len(w) > 2 and (n > most or w < top):
            top, most = w, n
    return top


class Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """_CHUNKS: dictionaries, and the codes of all tokens in turn; an entry of rows, sizes and so on is a piece of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, row, size = TaskContext.get().partitionId(), 0, 0, 0
        lists: dict[str, list] = {n: [] for n in ("rows", "doc_ids", "held", "tops", "sizes", "n_bytes")}
        tokens: list[pa.Array] = []
        waiting: list[bytes] = []

        def take() -> None:
            tokens.append(pa.array(waiting, pa.binary()))
            waiting.clear()

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            take()
            coded = pa.concat_arrays(tokens).dictionary_encode()
            out = {"chunk": part << 32 | made} | {n: list(v) for n, v in lists.items()}
            out |= {"words": b"\n".join(coded.dictionary.to_pylist()), "n_words": len(coded.dictionary), "codes": coded.indices.to_numpy().astype("<u4").tobytes()}
            made, size = made + 1, 0
            for v in (tokens, *lists.values()):
                v.clear()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

        for batch in batches:
            names, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                text, row = batch.column(1)[k].as_py() or b"", row + 1
                left = len(text)
                for piece in pieces(text):
                    words = piece.lower().split()
                    left -= len(piece) + 1
                    if left < 0:
                        words.append(END)
                    waiting += words
                    if len(waiting) > TAKEN:
                        take()
                    for n, v in zip(lists, (part << 40 | row, names[k], out[k], b"" if out[k] else top_word(words), len(words), len(piece)), strict=True):
                        lists[n].append(v)
                    size += len(piece)
                    if size >= CHUNK:
                        yield flush()
        if lists["rows"]:
            yield flush()

    out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), out).mapInArrow(run, _CHUNKS)


def _training(held: list[bool], sizes: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(held, bool), sizes)


def _dealt(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by their part of the vocabulary, and where each part starts in it."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    return np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(parts + 1))


def asked(made: DataFrame, kinds: dict[bytes, int], parts: int, salts: int) -> DataFrame:
    """A row for each chunk and part of the vocabulary: the chunk's words of that part and how often they occur in its training documents of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes, words = np.array(r["sizes"]), _split(r["words"], r["n_words"])
                of = np.repeat([kinds.get(bytes(t), L.GROUPS - 1) for t in r["tops"]], sizes)
                counts = np.bincount((np.frombuffer(r["codes"], "<u4") * np.int64(L.GROUPS) + of)[_training(r["held"], sizes)], minlength=len(words) * L.GROUPS).reshape(-1, L.GROUPS)
                order, starts = _dealt(words, parts)
                rows = [(p, r["chunk"] % salts, r["chunk"], b"\n".join([words[i] for i in order[a:b]]), int(b - a), _sparse(counts[order[a:b]])) for p, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if b > a]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "salt", "chunk", "words", "n", "c"])

    return made.select("chunk", "words", "n_words", "held", "tops", "sizes", "codes").mapInArrow(run, "part long, salt long, chunk long, words binary, n long, c binary")


def _added(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray]:
    """The words of a part of the vocabulary that training documents have, sorted, with their counts in each kind."""
    numbers = Numbers()
    counts = np.zeros((1024, L.GROUPS), np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            n = batch.column("n")[k].as_py()
            at = np.fromiter(map(numbers.__getitem__, _split(batch.column("words")[k].as_py(), n)), np.int64, n)
            while len(numbers) > len(counts):
                counts = np.concatenate([counts, np.zeros_like(counts)])
            row, place, many = _dense(batch.column("c")[k].as_py(), n)
            counts[at[row], place] += many
    used = counts.any(1).tolist()
    words = sorted(w for w, k in numbers.items() if used[k])
    return words, counts[[numbers[w] for w in words]] if words else counts[:0]


def _summed_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = _added(batches)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([b"\n".join(words)], pa.binary()), pa.array([len(words)]), pa.array([_sparse(counts)], pa.binary())], ["part", "words", "n", "c"])


def _vocabulary(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = _added(batches)
    cls = counts.argmax(1).astype(np.uint8) if words else np.zeros(0, np.uint8)
    blobs = [pa.array([x], pa.binary()) for x in (b"\n".join(words), _packed(counts.sum(1)), cls.tobytes())]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), blobs[0], pa.array([len(words)]), *blobs[1:]], ["part", "words", "n", "c", "cls"])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words each level and class of a part has, and how many training tokens each level (an occurrence being left out)."""
    for batch in batches:
        for r in batch.to_pylist():
            c = _ints(r["c"], r["n"])
            words = np.bincount(L.level(c) * L.GROUPS + np.frombuffer(r["cls"], np.uint8), minlength=L.LEVELS * L.GROUPS)
            tokens = np.bincount(L.left_out(c), c, L.LEVELS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([words.tolist()], pa.list_(pa.int64())), pa.array([tokens.tolist()], pa.list_(pa.int64()))], ["part", "words", "tokens"])


def _answers(base: np.ndarray):
    """For each chunk that asks: its words' counts in the corpus, indices in their levels and classes, in the order asked. base: where classes begin in levels."""

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        c, ix, cls = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8)
        for r in two.to_pylist():
            known = {w: k for k, w in enumerate(_split(r["words"], r["n"]))}
            c, cls = np.r_[_ints(r["c"], r["n"]), 0], np.r_[np.frombuffer(r["cls"], np.uint8), 0].astype(np.uint8)
            of = L.level(c[:-1]) * L.GROUPS + cls[:-1]
            order = np.argsort(of, kind="stable")
            ix = np.zeros(len(c), np.int64)
            ix[order] = np.arange(len(order)) - np.searchsorted(of[order], of[order]) + (np.array(r["starts"]) + base.reshape(-1))[of[order]]
        rows, get = [], known.get
        for k in range(one.num_rows):
            n = one["n"][k].as_py()
            at = np.fromiter(map(get, _split(one["words"][k].as_py(), n), repeat(-1)), np.int64, n)
            rows.append((one["chunk"][k].as_py(), one["part"][k].as_py(), _packed(c[at]), _packed(ix[at]), cls[at].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["chunk", "part", "c", "ix", "cls"])

    return run


def _coded(parts: int):
    """_CODED of chunks and the answers to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k] for n in batch.schema.names}
                n = r["n_words"].as_py()
                words = _split(r["words"].as_py(), n)
                order, starts = _dealt(words, parts)
                c, ix, cls = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint8)
                for a in sorted(r["answers"].as_py(), key=lambda a: a["part"]):
                    own = order[starts[a["part"]] : starts[a["part"] + 1]]
                    c[own], ix[own], cls[own] = _ints(a["c"], len(own)), _ints(a["ix"], len(own)), np.frombuffer(a["cls"], np.uint8)
                fresh = [w for w, new in zip(words, (c == 0).tolist(), strict=True) if new]
                blobs = [pa.array([x], pa.binary()) for x in (b"\n".join(fresh), _packed(c), _packed(ix), cls.tobytes())]
                kept = [batch.column(x).slice(k, 1) for x in ("rows", "doc_ids", "held", "sizes", "n_bytes", "codes")]
                names = ["rows", "doc_ids", "held", "sizes", "n_bytes", "codes", "fresh", "n_fresh", "c", "ix", "cls"]
                yield pa.RecordBatch.from_arrays([*kept, blobs[0], pa.array([len(fresh)]), *blobs[1:]], names)

    return run


class Chunk:
    """A row of _CODED as arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        at = lambda n: batch.column(n)[k]
        self.rows, self.doc_ids, self.sizes, self.n_bytes = (at(n).values for n in ("rows", "doc_ids", "sizes", "n_bytes"))
        self.held = at("held").values
        self.cls = np.frombuffer(at("cls").as_py(), np.uint8).astype(np.int64)
        self.codes, n = np.frombuffer(at("codes").as_py(), "<u4"), len(self.cls)
        self.c, self.ix, self.fresh = _ints(at("c").as_py(), n), _ints(at("ix").as_py(), n), _split(at("fresh").as_py(), at("n_fresh").as_py())
        self.lev = L.level(self.c)
        #: Words met once are one context: left out, they would be unknown.
        self.ident = np.where(self.c > 1, (self.lev.astype(np.uint64) << np.uint64(48)) + self.ix.astype(np.uint64) + np.uint64(2), np.uint64(0))

    def laid(self, code: L.Code, training: bool) -> tuple:
        return code.lay(L.left_out(self.c) if training else self.lev, self.lev, self.ix, self.cls)

    def histories(self, training: bool) -> Iterator[tuple[np.ndarray, L.History]]:
        """Runs of pieces, of training documents only if asked: their numbers, and the tokens with what they stand after."""
        sizes, use = self.sizes.to_numpy(), ~np.array(self.held.to_pylist(), bool) if training else np.ones(len(self.sizes), bool)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            began = int(ends[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(ends, began + (1 << 17), "right")))
            mine = np.flatnonzero(use[first:last] & (sizes[first:last] > 0)) + first
            codes = self.codes[began : int(ends[last - 1])].astype(np.int64)
            if training:
                codes = codes[np.repeat(use[first:last], sizes[first:last])]
            if len(codes):
                yield mine, L.History.of(codes, np.cumsum(sizes[mine]) - sizes[mine], self.ident, self.cls, self.lev)
            first = last

    def spelling(self, history: L.History, by_bytes: L.Predictors, by_words: L.Predictors) -> np.ndarray:
        """The cost of each token of level 0 beyond its level: whether it is the copy that its history offers, else its spelling."""
        out, new = np.zeros(len(history.codes)), np.flatnonzero(self.c[history.codes] == 0)
        if not len(new):
            return out
        number = np.cumsum(self.c == 0) - 1
        pairs, at = np.unique(number[history.codes[new]] * (L.GROUPS + 1) + history.lead[new], return_inverse=True)
        spelled = L.spelled([self.fresh[k] for k in (pairs // (L.GROUPS + 1)).tolist()], pairs % (L.GROUPS + 1), by_bytes)[at]
        offer = np.where(history.last[new] >= 0, history.codes[history.last[new]], -1)
        offered = (offer >= 0) & (self.c[offer] == 0)
        copy = L.offsets(L.TOKENS)[3] + history.run[new] * 2 + 1
        p = (by_words.ones[copy] + 0.4) / (by_words.n[copy] + 0.8)
        same = offered & (offer == history.codes[new])
        out[new] = np.where(same, np.log(p), spelled + np.where(offered, np.log(1 - p), 0))
        return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk(batch, k)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Training words of each part of the vocabulary, the end of texts aside, in an order that mixes them, and their classes."""
    for batch in batches:
        for k in range(batch.num_rows):
            words, cls = _split(batch.column("words")[k].as_py(), batch.column("n")[k].as_py()), np.frombuffer(batch.column("cls")[k].as_py(), np.uint8)
            order = np.argsort(np.fromiter((zlib.crc32(w[::-1]) for w in words), np.uint32, len(words)), kind="stable")
            order = order[np.fromiter(map(bool, words), bool, len(words))[order]]
            yield [words[i] for i in order.tolist()], cls[order]


def _counter(bits: tuple[int, ...], source):
    """Counts of a task's bits, a row for each block of the joint tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * int(L.offsets(bits)[-1]), np.int64)  # of each slot's bits that are 0 and that are 1
        for slots, y in source(batches):
            slots *= 2
            slots += y.view(np.uint8)
            for own in slots:
                np.add.at(counts, own.astype(np.intp), 1)
        ones, n = counts[1::2], counts[::2] + counts[1::2]
        salt = TaskContext.get().partitionId() // 64
        for b, a in enumerate(range(0, len(n), BLOCK)):
            if n[a : a + BLOCK].any():
                blobs = [pa.array([pa.compress(x[a : a + BLOCK].astype("<i8").tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (ones, n)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([salt], pa.int32()), *blobs], ["block", "salt", "ones", "n"])

    return run


def summed(blobs: DataFrame, bits: tuple[int, ...]) -> L.Predictors:
    """Tables of the sums of all tasks' counts; the driver sees their fixed size."""
    total = int(L.offsets(bits)[-1])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(BLOCK, total - key[0].as_py() * BLOCK)
        sums = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
        for batch in batches:
            for k in range(batch.num_rows):
                for s, name in zip(sums, ("ones", "n"), strict=True):
                    s += np.frombuffer(pa.decompress(batch.column(name)[k].as_py(), size * 8, "zstd"), "<i8")
        packed = [pa.array([pa.compress(s.tobytes(), "zstd", asbytes=True)], pa.binary()) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), *packed], ["block", "salt", "ones", "n"])

    halfway = blobs.groupBy("block", "salt").applyInArrow(add, _BLOBS)
    rows = halfway.groupBy("block").applyInArrow(add, _BLOBS).collect()
    ones, n = np.zeros(total), np.zeros(total)
    for r in rows:
        at, size = r["block"] * BLOCK, min(BLOCK, total - r["block"] * BLOCK)
        for x, name in ((ones, "ones"), (n, "n")):
            x[at : at + size] = np.frombuffer(pa.decompress(bytes(r[name]), size * 8, "zstd"), "<i8")
    return L.Predictors.fresh(bits, ones, n)


def taught(model: L.Predictors, learned: DataFrame) -> L.Predictors:
    """The model with weights averaged over _LEARNED rows by their bits, and the map of all their counts."""
    weights = learned.select("bits", F.posexplode("weights").alias("i", "x")).where("bits > 0").groupBy("i").agg((F.sum(F.col("x") * F.col("bits")) / F.sum("bits")).alias("w"))
    counts = learned.select(F.posexplode(F.arrays_zip("seen", "hit")).alias("i", "x")).groupBy("i").agg(F.sum("x.seen").alias("s"), F.sum("x.hit").alias("h"))
    w, c = weights.orderBy("i").collect(), counts.orderBy("i").collect()  # of a fixed number of gates
    if w:
        model.settle(np.array([r["w"] for r in w]), np.array([r["s"] for r in c]), np.array([r["h"] for r in c]))
    return model


def _learned(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    lists = [pa.array([found[n].tolist()], pa.list_(pa.float64())) for n in ("weights", "seen", "hit")]
    return pa.RecordBatch.from_arrays([*lists, pa.array(found["bits"])], ["weights", "seen", "hit", "bits"])


def fitted(coded: DataFrame, vocabulary: DataFrame, code: L.Code) -> tuple[L.Predictors, L.Predictors]:
    """Predictors of spelling, from the vocabulary's words, and of tokens, from the chunks' training documents."""
    spark = coded.sparkSession

    def spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for words, cls in _word_batches(batches):
            for at in range(0, len(words), L.SPELLED):
                yield L.byte_bits(words[at : at + L.SPELLED], cls[at : at + L.SPELLED])[:2]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chunk in _each(batches):
            laid = chunk.laid(code, True)
            for _, history in chunk.histories(True):
                yield from ((slots, y) for slots, y, _ in history.bits(laid))

    out = []
    for bits, source, rows in ((L.BYTES, spelling, vocabulary.select("words", "n", "cls")), (L.TOKENS, tokens, coded)):
        model = summed(rows.mapInArrow(_counter(bits, source), _BLOBS), bits)
        shared = spark.sparkContext.broadcast(model)  # of the tables' fixed size

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, source=source) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _learned(shared.value.learn(source(iter([batch.slice(k, 1)]))))

        found = stash(rows.mapInArrow(learn, _LEARNED))
        out.append(taught(model, found))
        discard(found)
        shared.unpersist()
    return out[0], out[1]


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row.

    Null and empty texts are one end token; repeated rows are scored (and learned from) each; a row with a null doc_id is in no fold, so it
    is learned from; with no training document at all every token is new; an empty table gives no rows; columns other
    than doc_id and text are ignored. A document longer than PIECE bytes is several histories.
    """
    spark = docs.sparkSession
    made = stash(chunks(docs), "zstd")
    sizes = made.agg(F.sum("n_words").alias("entries"), F.count(F.lit(1)).alias("chunks")).first()
    led = made.select(F.explode("tops").alias("top")).where("length(top) > 0").groupBy("top").count()
    kinds = {bytes(r["top"]): k for k, r in enumerate(led.orderBy(F.desc("count"), "top").limit(L.GROUPS - 1).collect())}
    parts, salts = max(1, -(-(sizes["entries"] or 0) // ENTRIES)), max(1, -(-sizes["chunks"] // TOGETHER))
    wanted = stash(asked(made, kinds, parts, salts), "zstd")
    halfway = wanted
    if salts > 1:
        halfway = wanted.groupBy("part", "salt").applyInArrow(_summed_words, "part long, words binary, n long, c binary")
    vocabulary = stash(halfway.groupBy("part").applyInArrow(_vocabulary, "part long, words binary, n long, c binary, cls binary"), "zstd")
    stats = stash(vocabulary.mapInArrow(_stats, "part long, words array<long>, tokens array<long>"))
    shape = np.zeros((2, L.LEVELS * L.GROUPS), np.int64)
    for k, column in enumerate(("words", "tokens")):
        for r in stats.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # levels x groups
            shape[k, r["i"]] = r["x"]
    words, tokens = shape[0].reshape(L.LEVELS, L.GROUPS), shape[1, : L.LEVELS]
    n, v, code = int(tokens.sum()), int(words.sum()), L.Code.of(words, tokens)
    before = F.coalesce(F.sum("x").over(Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stats.select("part", F.posexplode("words").alias("i", "x")).select("part", "i", before.alias("x")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    starts = starts.select(F.col("part").alias("of"), F.transform("s", lambda s: s["x"]).alias("starts"))
    told = vocabulary.join(starts, F.col("part") == F.col("of")).drop("of").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    answers = wanted.groupBy("part", "salt").cogroup(told.groupBy("part", "salt")).applyInArrow(_answers(np.cumsum(words, 1) - words), "chunk long, part long, c binary, ix binary, cls binary")
    answers = answers.groupBy(F.col("chunk").alias("to")).agg(F.collect_list(F.struct("part", "c", "ix", "cls")).alias("answers"))
    tasks = min(sizes["chunks"], max(partitions(spark), sizes["chunks"] // 8)) or 1  # chunks are few and heavy: small tables must not end up in one task
    joined = made.repartition(tasks, "chunk").join(answers.repartition(tasks, "to"), F.col("chunk") == F.col("to"))
    coded = stash(joined.mapInArrow(_coded(parts), _CODED), "zstd")
    for x in (made, wanted, stats):
        discard(x)
    speller, mixer = fitted(coded, vocabulary, code)
    discard(vocabulary)
    shared = spark.sparkContext.broadcast((speller, mixer))  # of the tables' fixed size
    base = math.log10(n + v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _each(batches):
            by_bytes, by_words = shared.value
            sizes, total, laid = chunk.sizes.to_numpy(), np.zeros((3, len(chunk.sizes))), chunk.laid(code, False)
            for mine, history in chunk.histories(False):
                cost = laid[3][history.codes] + chunk.spelling(history, by_bytes, by_words)
                for slots, y, own in history.bits(laid):
                    found = np.bincount(own - (first := own.min(initial=len(cost))), by_words.cost(slots, y))
                    cost[first : first + len(found)] += found
                of, c = np.repeat(np.arange(len(mine)), sizes[mine]), chunk.c[history.codes]
                for k, x in enumerate((c > 0, np.log10(c + 1.0) - base, cost / math.log(10))):
                    total[k, mine] = np.bincount(of, x, len(mine))
            known = pa.array(total[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([chunk.rows, chunk.doc_ids, chunk.held, chunk.sizes, known, pa.array(total[1]), pa.array(total[2]), chunk.n_bytes], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"])

    found = coded.mapInArrow(score, _SCORES).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score", "n_bytes")))
    per_byte = -F.col("score") / math.log10(2) / F.greatest(F.lit(1), "n_bytes")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", per_byte.alias("bits_per_byte"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
