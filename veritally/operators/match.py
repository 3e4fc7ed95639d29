"""Pairing rows one to one: candidate joins on derived keys, then greedy assignment in file order.

The greedy pass gives each row of file 1, in file order, the best row of file 2 that is left. It is a serial
dictatorship, so it decomposes: identifier keys can only pair inside a block of one compact key, and everything else is settled
stretch by stretch of file order, as far as no earlier stretch can interfere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.scores import SCORER, SCORERS, ratios
from ..functions.udfs import similarity
from ..sources.shared import Scratch, partitions
from .compare import with_verdict
from .detect import IDENTIFIERS, TEXTS, threshold

PAIRS = "id1 long, id2 long"


def forms(c: Column, unicode: bool = False) -> dict[str, Column]:
    return {
        "compact": N.compact_identifier(c, unicode), "norm": N.normalize_text(c, unicode=unicode),
        "token_key": N.sorted_token_key(c, unicode=unicode), "synonym_key": N.sorted_token_key(c, True, unicode),
    }


def keyed(df: DataFrame, row: str, key: Column, group: Column | None = None, unicode: bool = False) -> DataFrame:
    """id, key and the derived keys of each row that has one, computed once."""
    text = key.cast("string")
    out = df.select(F.col(row).alias("id"), text.alias("key"), (group if group is not None else F.lit("")).alias("grp")).where(~N.is_blank(F.col("key")))
    return out.select("id", "key", "grp", *(c.alias(n) for n, c in forms(F.col("key"), unicode).items()))


#: What rows of identifier keys pair in, and rows of a block up to which each is compared with each of the other side's.
BLOCK, FEW = ["block", "grp"], 16
#: Columns of a side beside its payload.
SIDE = ("id", "key", "grp", "compact", "norm", "token_key", "synonym_key", "block", "n", "k", "plain")


def side(df: DataFrame, row: str, key: Column, scratch: Scratch, group: Column | None = None, unicode: bool = False, payload: Sequence[Column] = (), words: bool = True) -> DataFrame:
    """One side of a reconciliation, written once: SIDE and the payload of each row, bucketed by block and group.

    A block is a group's rows of one compact key, else of one synonym key, else a row by itself. n: rows of the block, k: the row's place in it
    by id, plain: whether all its texts are one. They are counted where the rows are dealt for their buckets, so that everything that is asked
    of blocks later reads files in place and exchanges nothing. Sorts compare blocks by their first eight bytes, which keys often share and
    ends don't, so that a block's text is turned round. Where only blocks pair rows, `words` can be False: then token_key is null, and so is synonym_key where there is a compact key.
    """
    rows = df.select(F.col(row).alias("id"), key.cast("string").alias("key"), (group if group is not None else F.lit("")).alias("grp"), *payload)
    found = forms(F.col("key"), unicode)
    if not words:
        found |= {"token_key": F.lit(None).cast("string"), "synonym_key": F.when(found["compact"] == "", found["synonym_key"])}
    rows = rows.select("*", *(c.alias(n) for n, c in found.items()))
    block = F.when(F.col("compact") != "", F.concat(F.lit("c"), F.col("compact"))).when(F.col("synonym_key") != "", F.concat(F.lit("s"), F.col("synonym_key")))
    block = F.reverse(F.coalesce(block, F.concat(F.lit("n"), F.col("id").cast("string"))))
    dealt = rows.withColumn("block", block).repartition(partitions(df.sparkSession), *BLOCK)
    ordered = Window.partitionBy(*BLOCK).orderBy("id")
    of = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = dealt.withColumns({"k": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(of), "plain": F.min("norm").over(of) == F.max("norm").over(of)})
    return scratch.bucketed(counted, BLOCK, ordered=False)


def has_key(side_: DataFrame) -> DataFrame:
    return side_.where("compact <> '' OR synonym_key <> ''")


def candidates(k1: DataFrame, k2: DataFrame) -> DataFrame:
    """Pairs with an equal compact key (priority 0) or synonym key (1: equal texts, 2: equal words, 3: equal long forms).

    Equal texts have equal word keys and these equal synonym keys, so two equi-joins cover all four lookups; no pair comes twice.
    """
    a, b = k1.alias("a"), k2.alias("b")
    same = F.col("a.grp") == F.col("b.grp")
    by_compact = a.join(b, same & (F.col("a.compact") == F.col("b.compact")) & (F.col("a.compact") != "")).withColumn("priority", F.lit(0))
    by_words = a.join(b, same & (F.col("a.synonym_key") == F.col("b.synonym_key")) & (F.col("a.synonym_key") != "") & ~((F.col("a.compact") == F.col("b.compact")) & (F.col("a.compact") != "")))
    by_words = by_words.withColumn("priority", F.when(F.col("a.norm") == F.col("b.norm"), 1).when(F.col("a.token_key") == F.col("b.token_key"), 2).otherwise(3))
    cols = [F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.col("a.key").alias("key1"), F.col("b.key").alias("key2"), "priority"]
    return by_compact.select(*cols).unionByName(by_words.select(*cols))


#: Pairs of texts that meet at one word up to which they are joined row by row; words beyond that are worked off in tiles of so many texts a side.
HOT, TILE = 1_000_000, 1024
#: Pairs that are scored at once in a tile.
AT_ONCE = 50_000


def _possible(scorer: str, least: int, x: Column, y: Column) -> Column:
    """What lengths alone say: a common subsequence is at most as long as the shorter text. Windows and word sets have no such bound."""
    return 200 * F.least(x, y) >= (least - 0.5) * (x + y) if scorer == "difflib" else F.lit(True)


def _histogram(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(letters)), np.int32)
    for i, t in enumerate(texts):
        for c in t:
            out[i, letters[c]] += 1
    return out


def _tile(scorer: str, least: int):
    """Texts of two tiles of one frequent word: the pairs whose rarest common word it is and that reach the score."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        word = key[1].as_py()
        ones, twos = left["s"].to_pylist(), right["s"].to_pylist()
        holders: dict[str, list[int]] = {}
        for j, names in enumerate(right["names"].to_pylist()):
            for w in names[: names.index(word)]:
                holders.setdefault(w, []).append(j)
        size = np.fromiter(map(len, twos), np.int64, len(twos))
        letters = {c: i for i, c in enumerate(sorted(set("".join(ones)) | set("".join(twos))))} if scorer == "difflib" else {}
        chars = _histogram(twos, letters) if letters else None
        found: list[tuple[str, str]] = []
        scores: list[np.ndarray] = []
        waiting: list[tuple[str, str]] = []

        def flush() -> None:
            pairs = waiting
            if scorer == "difflib" and pairs:  # its blocks are a common subsequence, so the longest one bounds the score
                keep = np.flatnonzero(ratios(pairs) >= least - 0.5)
                pairs = [pairs[k] for k in keep.tolist()]
            got = SCORERS[scorer](pairs)
            hit = np.flatnonzero(got >= least)
            found.extend(pairs[k] for k in hit.tolist())
            scores.append(got[hit])
            waiting.clear()

        for text, names in zip(ones, left["names"].to_pylist(), strict=True):
            open_ = np.ones(len(twos), bool)
            for w in names[: names.index(word)]:
                open_[holders.get(w, [])] = False  # these two met at a rarer word
            if chars is not None:
                common = np.minimum(_histogram([text], letters)[0], chars).sum(axis=1)
                open_ &= 200 * common >= (least - 0.5) * (len(text) + size)
            waiting.extend((text, twos[j]) for j in np.flatnonzero(open_).tolist())
            if len(waiting) >= AT_ONCE:
                flush()
        flush()
        n = len(found)
        return pa.table({"grp": pa.array([key[0].as_py()] * n, pa.string()), "s1": pa.array([x for x, _ in found], pa.string()), "s2": pa.array([y for _, y in found], pa.string()), "confidence": pa.array(np.concatenate(scores), pa.int32())})

    return run


def fuzzy_candidates(k1: DataFrame, k2: DataFrame, scorer: str = SCORER, least: int = 75, scratch: Scratch | None = None, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """(id1, id2, confidence) of all pairs that share a word (long forms) and score `least`, scored once for each pair of distinct texts.

    The words of a text are ordered by the pairs that they would make, fewest first, and a pair meets at the first word that both have,
    and there alone: nothing is compared twice and no pairs are made distinct. Words that few pairs share are an equi-join. The texts of a frequent
    word are dealt over tiles, and two tiles make pairs inside one task only, where counts of characters and common subsequences
    rule most of them out before they are scored. No word is left out, so that the result is whole.
    """
    scratch = scratch or Scratch(k1.sparkSession)
    texts = [k.select("grp", N.expand(F.col("norm")).alias("s")).distinct() for k in (k1, k2)]
    words = [t.select("grp", "s", F.explode(F.array_distinct(F.split("s", " "))).alias("word")).where("word <> ''") for t in texts]
    counts = [w.groupBy("grp", "word").agg(F.count(F.lit(1)).alias(f"n{i}")) for i, w in enumerate(words, 1)]
    met = counts[0].join(counts[1], ["grp", "word"]).withColumn("cost", F.col("n1") * F.col("n2"))  # a word of one side alone joins nothing
    one, two = (
        scratch.written(w.join(met, ["grp", "word"]).groupBy("grp", "s").agg(F.array_sort(F.collect_list(F.struct("cost", "word", "n1", "n2"))).alias("ws")).withColumn("names", F.col("ws.word")))
        for w in words
    )
    own = [t.select("grp", F.col("s").alias(f"s{i}"), F.col("names").alias(f"names{i}"), F.explode(F.filter("ws", lambda x: x["cost"] <= hot)["word"]).alias("word")) for i, t in enumerate((one, two), 1)]
    few = own[0].join(own[1], ["grp", "word"]).where((F.array_intersect("names1", "names2")[0] == F.col("word")) & _possible(scorer, least, F.length("s1"), F.length("s2")))
    scored = few.select("grp", "s1", "s2", similarity(F.col("s1"), F.col("s2"), scorer).alias("confidence")).where(F.col("confidence") >= least)
    tiles = lambda n: F.ceil(F.col(f"w.{n}") / tile)
    dealt = []
    for t, mine, other, at, to in ((one, "n1", "n2", "i", "j"), (two, "n2", "n1", "j", "i")):
        often = t.select("grp", "s", "names", F.explode(F.filter("ws", lambda x: x["cost"] > hot)).alias("w"))
        spread = often.withColumn(at, F.pmod(F.xxhash64("s"), tiles(mine))).withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), tiles(other) - 1)))
        dealt.append(spread.select("grp", F.col("w.word").alias("word"), "i", "j", "s", "names").groupBy("grp", "word", "i", "j"))
    many = dealt[0].cogroup(dealt[1]).applyInArrow(_tile(scorer, least), "grp string, s1 string, s2 string, confidence int")
    ids = [k.select("grp", F.col("id").alias(f"id{i}"), N.expand(F.col("norm")).alias(f"s{i}")) for i, k in enumerate((k1, k2), 1)]
    return scored.unionByName(many).join(ids[0], ["grp", "s1"]).join(ids[1], ["grp", "s2"]).select("id1", "id2", "confidence")


def edges(k1: DataFrame, k2: DataFrame, kind: str, unicode: bool = False, scorer: str | None = SCORER, scratch: Scratch | None = None) -> DataFrame:
    """id1, id2, stage, confidence, priority of every pair that may be taken."""
    found = candidates(k1, k2)
    judged = with_verdict(found, F.col("key1"), F.col("key2"), kind, "v", unicode, scorer)
    first = judged.withColumn("confidence", F.col("v.confidence")).where(F.col("confidence") >= threshold(kind))
    first = first.select("id1", "id2", F.lit(0).alias("stage"), "confidence", "priority")
    if kind not in TEXTS or not scorer:
        return first
    second = fuzzy_candidates(k1, k2, scorer, threshold(kind), scratch).join(first.select("id1", "id2"), ["id1", "id2"], "left_anti")
    return first.unionByName(second.select("id1", "id2", F.lit(1).alias("stage"), "confidence", F.lit(0).alias("priority")))


def _greedy(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A contested block: rows of file 1 in order take the first equal text that is left, else the first row that is left."""
    rights = sorted(zip(right["id"].to_pylist(), right["norm"].to_pylist(), strict=True))
    by_norm: dict[str, list[int]] = {}
    for i, (_, norm) in enumerate(rights):
        by_norm.setdefault(norm, []).append(i)
    for at in by_norm.values():
        at.reverse()
    used, nxt, out = [False] * len(rights), 0, []
    for i, norm in sorted(zip(left["id"].to_pylist(), left["norm"].to_pylist(), strict=True)):
        own = by_norm.get(norm, [])
        while own and used[own[-1]]:
            own.pop()
        if own:
            k = own.pop()
        else:
            while nxt < len(rights) and used[nxt]:
                nxt += 1
            if nxt == len(rights):
                break
            k = nxt
        used[k] = True
        out.append((i, rights[k][0]))
    return pa.table({"id1": pa.array([x[0] for x in out], pa.int64()), "id2": pa.array([x[1] for x in out], pa.int64())})


def _with_ends(pairs: DataFrame, one: DataFrame, two: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """PAIRS with columns of both sides."""
    ends = [s.select(F.col("id").alias(f"_end{i}"), *cols) for i, (s, cols) in enumerate(((one, left), (two, right)), 1)]
    named = pairs.select(F.col("id1").alias("_end1"), F.col("id2").alias("_end2"))
    return named.join(ends[0], "_end1").join(ends[1], "_end2").select(*left, *right)


def pair_blocks(one: DataFrame, two: DataFrame, scratch: Scratch, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The pairs of identifier keys with the columns `left` of side one and `right` of side two, block by block.

    Blocks with few rows a side that have one text, nearly all of them, are a join in place, by rank. The names of the others are written; where there are any, those with
    one text on each side pair by rank too, and only blocks that mix texts go through Python, with their ids and texts alone.
    """
    block = BLOCK
    a, b = (has_key(s) for s in (one, two))
    near = [s.where((F.col("n") <= FEW) & F.col("plain")).select(*block, F.col("k").alias(f"_k{i}"), *cols) for i, (s, cols) in enumerate(((a, left), (b, right)), 1)]
    # ranks aren't a key: tables that are dealt by block only would be exchanged for it
    single = near[0].join(near[1], block).where(F.col("_k1") - F.col("_k2") == 0).select(*left, *right)
    shapes = [s.where("k = 1").select(*block, F.col("n").alias(f"n{i}"), F.col("plain").alias(f"plain{i}")) for i, s in enumerate((a, b), 1)]
    rest = (F.greatest("n1", "n2") > FEW) | ~(F.col("plain1") & F.col("plain2"))
    many = scratch.written(shapes[0].join(shapes[1], block).where(rest).select(*block, (F.col("plain1") & F.col("plain2")).alias("alike")))
    if many.isEmpty():
        return single
    own = [s.drop("plain").join(many, block) for s in (a, b)]
    ranked = [o.where("alike").select(*block, "k", *cols) for o, cols in zip(own, (left, right), strict=True)]
    plain = ranked[0].join(ranked[1], [*block, "k"]).select(*left, *right)
    mixed = [o.where("NOT alike") for o in own]
    groups = [m.select(*block, "id", "norm").groupBy(*block) for m in mixed]
    found = groups[0].cogroup(groups[1]).applyInArrow(_greedy, PAIRS)
    return single.unionByName(plain).unionByName(_with_ends(found, *mixed, left, right))


def assign_identifiers(one: DataFrame, two: DataFrame, scratch: Scratch) -> DataFrame:
    """PAIRS of two sides with identifier keys."""
    ends = [s.withColumn(f"id{i}", F.col("id")) for i, s in enumerate((one, two), 1)]
    return pair_blocks(*ends, scratch, ["id1"], ["id2"])


# ---- weighted edges


#: Rows of file 1 that one task settles in one go.
STRETCH = 200_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of file 1 in file order, each row's edges best first: the pairs that no earlier stretch can change.

    A row takes its best free partner at once, unless a row of an earlier stretch still has an edge to that partner, or an unsettled row of
    this stretch might take it. Then the row waits, and all that it might take is in doubt for those behind it.
    """
    at, row, taken, doubtful, waits, out = None, None, set(), set(), False, ([], [])
    settled = False
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("stretch", "id1", "id2", "earlier"))
        for stretch, i, j, earlier in zip(*cols, strict=True):
            if stretch != at:
                at, row, taken, doubtful = stretch, None, set(), set()
            if i != row:
                row, waits, settled = i, False, False
            if settled or j in taken:
                continue
            if waits or earlier or j in doubtful:
                waits = True
                doubtful.add(j)
                continue
            settled = True
            taken.add(j)
            out[0].append(i)
            out[1].append(j)
        if out[0]:
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["id1", "id2"])
            out = ([], [])


def assign_edges(found: DataFrame, scratch: Scratch, stretch: int = STRETCH) -> DataFrame:
    """PAIRS of the greedy pass over weighted edges (id1, id2, stage, confidence, priority), which are computed and written once.

    Rows of file 1 are cut into stretches of file order, and every task settles its own as far as no earlier stretch can interfere;
    a chain of rows that wait for each other falls within its stretch. What is left, edges between rows that
    are both still free, goes round again. The earliest stretch always ends, so that rounds are at most as many as stretches.
    """
    spark = found.sparkSession
    n = partitions(spark)
    best_first = [F.col("stage"), F.col("confidence").desc(), F.col("priority"), F.col("id2")]
    placed = found.select("id1", "id2", F.row_number().over(Window.partitionBy("id1").orderBy(*best_first)).alias("k"), F.floor(F.col("id1") / stretch).alias("stretch"))
    live, done = scratch.written(placed), None
    while True:
        first = live.groupBy("id2").agg(F.min("stretch").alias("first"))
        told = live.join(first, "id2").select("stretch", "id1", "k", "id2", (F.col("first") < F.col("stretch")).alias("earlier"))
        dealt = told.repartition(n, "stretch").sortWithinPartitions("stretch", "id1", "k")
        pairs = scratch.written(dealt.mapInArrow(_settle, PAIRS))
        done = pairs if done is None else done.unionByName(pairs)
        left = live.join(pairs.select("id1"), "id1", "left_anti").join(pairs.select("id2"), "id2", "left_anti")
        old, live = live, scratch.written(left)
        scratch.drop(old)
        if live.isEmpty():
            return done


def match(one: DataFrame, two: DataFrame, kind: str, scratch: Scratch, left: Sequence[str], right: Sequence[str], unicode: bool = False, scorer: str | None = SCORER) -> DataFrame:
    """The pairs of two sides, one to one, with the columns `left` and `right` of both."""
    if kind in IDENTIFIERS:
        return pair_blocks(one, two, scratch, left, right)
    k1, k2 = (s.where(~N.is_blank(F.col("key"))) for s in (one, two))
    return _with_ends(assign_edges(edges(k1, k2, kind, unicode, scorer, scratch), scratch), one, two, left, right)


def _best(found: DataFrame) -> DataFrame:
    """The best edge of each id1: value, id2, stage, confidence."""
    order = F.struct("stage", (-F.col("confidence")).alias("c"), "priority", "id2")
    return found.groupBy("id1").agg(F.min_by(F.struct("id2", "stage", "confidence"), order).alias("b")).select("id1", "b.*")


class Lookup:
    """The rows of a table by all that a look-up can meet them with: compact key, word key and single words, as terms.

    Every term of every row is written once into buckets by the term's hash, so that a look-up reads the few buckets
    of its own terms, and many look-ups at once are a join that exchanges their terms only.
    """

    def __init__(self, table: DataFrame, key: str, row: str, scratch: Scratch, unicode: bool = False):
        own = keyed(table, row, N.cell(table, key), unicode=unicode)
        self.entries, self.unicode = scratch.bucketed(own.withColumn("term", F.explode(self._terms())).repartition(partitions(table.sparkSession), "term"), ["term"]), unicode
        self.scratch = scratch

    @staticmethod
    def _terms() -> Column:
        marked = lambda kind, c: F.when(c != "", F.concat(F.lit(kind), c))
        words = F.transform(F.split("synonym_key", " "), lambda w: marked("w", w))
        return F.array_distinct(F.filter(F.concat(F.array(marked("c", F.col("compact")), marked("s", F.col("synonym_key"))), words), lambda t: t.isNotNull()))

    def candidates(self, asked: DataFrame, terms: list[str] | None = None) -> DataFrame:
        """The rows that share a term with one of the values asked for, each once."""
        if terms is not None:
            met = self.entries.where(F.col("term").isin(terms))
        else:
            met = self.entries.join(asked.select(F.explode(self._terms()).alias("term")).distinct(), "term", "left_semi")
        return met.drop("term").dropDuplicates(["id"])

    def best_of(self, values: DataFrame, kind: str, scorer: str | None = SCORER) -> DataFrame:
        """id1, id2, stage and confidence of the best row for each of `values` (id, value) that has one."""
        asked = keyed(values, "id", F.col("value"), unicode=self.unicode)
        return _best(edges(asked, self.candidates(asked), kind, self.unicode, scorer, self.scratch))

    def best(self, value: str, kind: str, scorer: str | None = SCORER) -> DataFrame:
        """The best row for one value, no row if none reaches the threshold; only the buckets of its terms are read."""
        spark = self.entries.sparkSession
        asked = keyed(spark.range(1).select("id", F.lit(value).alias("value")), "id", F.col("value"), unicode=self.unicode)
        terms = [r["t"] for r in asked.select(F.explode(self._terms()).alias("t")).collect()]  # a value's words
        return _best(edges(asked, self.candidates(asked, terms), kind, self.unicode, scorer, self.scratch)).drop("id1")


def best_match(value: str, table: DataFrame, key: str, row: str, kind: str, scorer: str | None = SCORER) -> DataFrame:
    """The best row of a table for one value by a full scan: id2, stage, confidence; no row if none reaches the threshold. Lookup is for several."""
    one = table.sparkSession.range(1).select("id", F.lit(value).alias("_value"))
    return _best(edges(keyed(one, "id", F.col("_value")), keyed(table, row, N.cell(table, key)), kind, scorer=scorer)).drop("id1")
