"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become pieces of at most SIZE tokens. Best-fit decreasing runs on counts of lengths, not on pieces: the
driver sees at most SIZE rows (length, count), and identical bins are kept as ranges of numbers, so planning costs the
same for a thousand pieces or a trillion. A piece then takes its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping
from itertools import filterfalse, islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, give_back, stash, table

SIZE = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, whose ids a task remembers in each of two generations; what is used again moves from the older one to the newer.
REMEMBERED, PARTS = 200_000, 200_000
#: Bytes of texts, about, whose words are looked up together, and runs of letters that are encoded as one text.
TOGETHER, JOINED = 1 << 20, 256
#: Placed pieces in a task that hands them on, about: were there one for each shuffle partition, a small table would end in many files.
PLACED = 1 << 13
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words: Latin letters, then ASCII punctuation, or anything else. The letter whose lower case is two characters (U+0130) isn't one here.
_CUT = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\\[-`{-~]*)(?= |$)|([^ ]+)").findall
_tokenizers: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """Ids of what was met last, in two generations."""

    def __init__(self, size: int):
        self.size, self.ids, self.older = size, {}, {}

    def missing(self, keys: set) -> list:
        """Those of keys that neither generation has; the others are in the newer one then. A full generation becomes the older one."""
        new = keys.difference(self.ids)
        if len(self.ids) + len(new) > self.size:
            self.ids, self.older, new = {}, self.ids, keys
        out = new.difference(self.older)
        new = new - out
        self.ids.update(zip(new, map(self.older.__getitem__, new), strict=True))
        return list(out)

    def shrink(self) -> None:
        """Keeps all if that is little, else what both generations have, which is what is met often; half a generation at most."""
        if len(self.ids) + len(self.older) <= self.size // 4:
            kept = self.older | self.ids
        else:
            kept = {k: self.ids[k] for k in islice(filter(self.older.__contains__, self.ids), self.size // 2)}
        self.ids, self.older = kept, {}


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit numbers, by ids of single words.

    The tokenizer never joins characters across ASCII white space, so a text's ids are its words' ids in turn. It lowers letters and cuts
    between a letter and punctuation, so ids of letters with punctuation behind are those of the lower-case letters and of the
    punctuation. Letters alone are one run, whose last token is marked: many runs are encoded as one text and cut at the marks.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.words, self.parts = Tokenizer.from_file(path), Recent(REMEMBERED), Recent(PARTS)
        #: The same model, without the steps that leave lower-case Latin letters as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def rest(self) -> None:
        """Drops most of what a task has met. A worker lives on after its task, and an executor keeps more workers than run at a time."""
        self.words.shrink()
        self.parts.shrink()
        give_back()

    def of(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append(text.split())
            size += len(text)
            if size >= TOGETHER:
                yield from self._joined(group)
                group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[bytes]]) -> Iterator[bytes]:
        if new := self.words.missing(set().union(*group)):
            self._learn(new)
        get = self.words.ids.__getitem__
        for words in group:
            yield b"".join(map(get, words))

    def _learn(self, new: list[bytes]) -> None:
        """Adds words by their letters and punctuation, or whole if they are of another kind."""
        plain, mixed = [list(f(bytes.isalpha, new)) for f in (filter, filterfalse)]  # ASCII letters alone, and all else
        letters, tails, others = zip(*_CUT(b" ".join(mixed).decode()), strict=True) if mixed else ((), (), ())
        runs = b" ".join(plain).lower().decode().split(" ") if plain else []
        starts = " ".join(letters).lower().split(" ") if mixed else []
        known = {*runs, *starts}
        lacking = self.parts.missing(known.union(tails, others) - {""})
        rest = [p for p in lacking if p not in known]
        first, ids = [p for p in lacking if p in known], self.parts.ids
        ids.update(zip(first, self._runs(first), strict=True))
        ids.update(zip(rest, self._each(rest), strict=True))
        ids[""] = b""
        get = ids.__getitem__
        self.words.ids.update(zip(plain, map(get, runs), strict=True))
        self.words.ids.update(zip(mixed, map(add, map(add, map(get, starts), map(get, tails)), map(get, others)), strict=True))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters; one by one where the marks don't tell them apart."""
        out: list[bytes] = []
        groups = [runs[a : a + JOINED] for a in range(0, len(runs), JOINED)]
        for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends, blob = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            out += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) == len(group) and ends[-1] == len(blob) else self._each(group)
        return out


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """PIECES of each document: its ids and `end`, cut every `size` ids. Null text: empty, so one piece of length 1."""
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        try:
            for batch in batches:
                rows: list[tuple] = []
                names, texts = batch.column(0).to_pylist(), (x.as_py() or b"" for x in batch.column(1))
                for name, ids in zip(names, known.of(texts), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        finally:
            known.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(cut, PIECES)


def best_fit_plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts: rows (length, first rank, first sequence, pieces in each, offset of the first).

    Ranks from `first rank` up to the next row of the length fill sequences from `first sequence` on, so many in
    each, side by side from the offset. Sequences with equal room are alike, so a class of them is a list of ranges; each length
    adds at most three ranges, which bounds the plan whatever the counts are.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} isn't within 1 and {size}")
        left, rank = counts[length], 0
        while left > 0:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first, n = size, sequences, -(-left // (size // length))
                sequences += n
            each = room // length
            for full, per in ((min(n, left // each), each), (1, left % each)):
                if full and per and n and left and (per == each or left < each):
                    rows.append((length, rank, first, per, size - room))
                    put(room - per * length, first, full)
                    rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            put(room, first, n)
    return rows


def pack(pieces_table: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to PIECES (a stash: it is read three times)."""
    counts = {r["length"]: r["n"] for r in pieces_table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    plan = np.array(sorted(best_fit_plan(counts, size)), np.int64).reshape(-1, 5)
    starts = plan[:, 0] << 48 | plan[:, 1]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("rank", "length"))
            row = plan[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            k = rank - row[:, 1]
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            new = [pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*own, *new], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = gapless_rank(pieces_table, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    tasks = max(1, -(-sum(counts.values()) // PLACED))
    return ranked.coalesce(tasks).mapInArrow(take, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row for each piece of each document, with its sequence and place.

    Null texts are empty documents of one end token; repeated rows are packed each; a null doc_id stays null; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    return pack(stash(pieces(docs, path or vocabulary_path(), size)), size)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
ORACLE_SQL: dict[str, str] = {}
