"""SentencePiece encoding and decoding by a streaming Viterbi search.

At each position the search keeps the best last piece of the text so far, with a pointer to where that piece began. A
step from one piece to the next counts only where the two, encoded on their own as one string, stay the two pieces;
that makes the best path the one that the model's merges give (the supplied vocabulary is a merge model, whose pieces
have ranks instead of probabilities, so sums of scores would give other ids). Pieces have at most `longest` characters, so only that
many positions can still be left behind: whenever the paths from all of them meet at one boundary, ids up to it are committed
and forgotten, so `search` holds that window only. `encode` first cuts texts into parts that no piece goes across and remembers the ids of
short ones, which is faster and holds the texts' parts and ids. Short parts never fill the window, so the same recurrence runs over them from the
end: only positions that a path from there asks for get their last piece. Parts go in sorted order, and each keeps what it shares with the one before.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import Recent

MODEL = "piece_bpe_32k.model"
#: Words that a worker remembers in each of two generations (what is used again moves to the newer), pairs that it remembers, and the longest such word.
REMEMBERED, PAIRS, LONGEST_WORD = 450_000, 400_000, 40
#: Characters of texts, about, whose parts are looked up together.
TOGETHER = 1 << 20
SPACE = "▁"
_codecs: dict[str, Codec] = {}


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("this codec reads merge models without text normalisation")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.id, self.score, self.bytes, self.piece = {}, {}, {}, []
        for i, p in enumerate(m.pieces):
            text = p.piece.replace(SPACE, " ").encode()
            if p.type == p.NORMAL:
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == p.BYTE:
                text = bytes([int(p.piece[1:-1], 16)])
                self.bytes[text[0]] = i
            elif p.type == p.CONTROL:
                text = b""
            elif p.type == p.UNKNOWN:
                self.unknown, text = i, b" \xe2\x81\x87 "
            self.piece.append(text)
        self.longest = max(map(len, self.id))
        #: Of the last three characters of pieces, how many characters the longest such piece has.
        self.reach: dict[str, int] = {}
        for p in self.id:
            self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        inside = {x for p in self.id for x in p[1:]}
        stops = SPACE if not any(SPACE in p.lstrip(SPACE) for p in self.id) else ""
        alone = "".join(x for x in "\n\t\r" if x not in inside and not any(x in p for p in self.id))
        #: Parts that no piece goes across.
        self.parts = re.compile(rf"{stops}*[^{stops}{alone}]+|{stops}+|[{alone}]") if stops and alone else re.compile(r".+", re.S)
        self.words = Recent(REMEMBERED)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives for a short string: the best-ranked pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stay(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def search(self, text: str) -> Iterator[str]:
        """Pieces of a text without cutting it into words: the streaming search. Characters of no piece stand alone."""
        n, base, committed, longest, pieces, known = len(text), 0, 0, self.longest, self.id, self.pairs
        back, last = [0], [""]  # of position base + k
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = text[j:i]
                if t in pieces or i - j == 1:
                    pair = (last[j - base], t)
                    if known[pair] if pair in known else self.stay(*pair):
                        break
            else:  # pragma: no cover - every prefix has an encoding
                raise ValueError("no path")
            back.append(j)
            last.append(t)
            if i - committed >= 4 * self.longest or i == n:
                # paths from which later pieces can start: follow the furthest back until all meet
                ends = {i} if i == n else set(range(i - self.longest + 1, i + 1))
                while len(ends) > 1:
                    far = max(ends)
                    ends.remove(far)
                    ends.add(back[far - base])
                meet, path = ends.pop(), []
                while meet > committed:
                    path.append(last[meet - base])
                    meet = back[meet - base]
                yield from reversed(path)
                committed += sum(map(len, path))
                drop = min(committed, i - self.longest + 1) - base
                if drop > 0:
                    del back[:drop], last[:drop]
                    base += drop

    def piece_before(self, text: str, i: int, last: list[str | None]) -> str:
        """The last piece of the path to position i; `last` has those known so far and gets those that are asked for."""
        pieces, known = self.id, self.pairs
        for j in range(max(0, i - max(2, self.reach.get(text[max(0, i - 3) : i], 2))), i):
            t = text[j:i]
            if t in pieces or i - j == 1:
                before = last[j]
                if before is None:
                    before = self.piece_before(text, j, last)
                pair = (before, t)
                if known[pair] if pair in known else self.stay(*pair):
                    last[i] = t
                    return t
        raise ValueError("no path")  # pragma: no cover - every prefix has an encoding

    def paths(self, parts: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of some short parts, in sorted order, with its pieces."""
        earlier, last = "", [""]
        for text in sorted(parts):
            same, n = 0, len(text)
            for x, y in zip(earlier, text, strict=False):
                if x != y:
                    break
                same += 1
            last[same + 1 :] = [None] * (n - same)
            path, i = [], n
            while i:
                path.append(last[i] or self.piece_before(text, i, last))
                i -= len(path[-1])
            path.reverse()
            yield text, path
            earlier = text

    def ids(self, path: Iterable[str]) -> bytes:
        """Ids of pieces, as little-endian unsigned 32-bit numbers."""
        out: list[int] = []
        for t in path:
            if (i := self.id.get(t)) is not None:
                out.append(i)
            else:
                out += [self.bytes.get(b, self.unknown) for b in t.encode()] if self.bytes else [self.unknown]
        return struct.pack(f"<{len(out)}I", *out)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[list[str]] = []
        size, prefix = 0, SPACE if self.prefix else ""
        for text in texts:
            group.append(self.parts.findall(prefix + text.replace(" ", SPACE)) if text else [])
            size += len(text)
            if size >= TOGETHER:
                yield from self._joined(group)
                group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[str]]) -> list[bytes]:
        new = self.words.missing(set().union(*group))
        known, long = self.words.ids, [p for p in new if len(p) > LONGEST_WORD]
        for p, path in self.paths(p for p in new if len(p) <= LONGEST_WORD):
            known[p] = self.ids(path)
        for p in long:
            known[p] = self.ids(self.search(p))
        out = [b"".join(map(known.__getitem__, parts)) for parts in group]
        for p in long:
            del known[p]
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, ids_crc32 long and round_trip: whether decoding the ids gives the text back; no exchange.

    Null and empty texts have no ids; repeated rows are encoded each; a null doc_id stays null; an empty table gives no rows; columns
    other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            # a few documents at a time, so that a batch of long ones stays small
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                coded = list(known.encode_all(texts))
                same = [known.decode(np.frombuffer(c, "<u4")) == x for c, x in zip(coded, texts, strict=True)]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                columns = [part.column(0), ids, pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            texts = [known.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip", "ids")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
