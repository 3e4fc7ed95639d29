"""Conversation structure repair: the cheapest edits that make roles match (s?(ua)+)?, by a bidirectional tight-arc DAG.

Nodes are (rows used, state), states are: nothing yet, after system, after user, after assistant. Forward and backward minimum
costs of all nodes tell which arcs lie on a cheapest path; the audit follows the least letter among the tight arcs of its
frontier at every step. What a run of rows does to costs is a 4 x 4 (min, +) matrix, so conversations are cut into pieces
of bounded size, wherever they are long: matrices are made piece by piece, and only they pass in order
through a stream that carries four numbers, once forward and once backward. Whole conversations, nearly all, never leave their piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import partitions, stash, table

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
INF = 1 << 60
#: Rows and characters of text after which a piece ends.
ROWS, CHARS = 1024, 1 << 22
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: What each state takes next, and the state after it.
NEXT = ({"s": AFTER_SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER})
LEGAL = {"su", "ua", "au"}
FINE, GONE, SHORT = range(3)
WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]"), "\x20\t\n\x0b\x0c\r"


# ---- one run of rows, each a symbol: its role's initial and fault


def symbol(role: str, fault: int) -> str:
    """One character: s, u, a or x (any other role), in upper case where the row must go; 1 to 4 for the same four where it ends too soon."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial if fault == FINE else initial.upper() if fault == GONE else {"s": "1", "u": "2", "a": "3", "x": "4"}[initial]


@lru_cache(maxsize=None)
def row_arcs(sign: str) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, state before, state after, cost) of the edits that use one row."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if not sign.isupper():
        initial, more = (sign, 0) if sign.islower() else ("suax"[int(sign) - 1], CUT_SHORT)
        arcs += [("K", q, to[initial], KEEP + more) for q, to in enumerate(NEXT) if initial in to]
        arcs += [("R", q, to[r], REROLE + more) for q, to in enumerate(NEXT) for r in "ua" if r in to]
    return tuple(arcs)


INSERTS = tuple(("I", q, to[r], INSERT) for q, to in enumerate(NEXT) for r in "ua" if r in to)


def inserted(f: list[int]) -> list[int]:
    """Forward costs after inserts; a cycle of inserts costs more than it starts with, so that one step of each arc twice settles."""
    f = list(f)
    for _ in range(2):
        for _, q, to, cost in INSERTS:
            f[to] = min(f[to], f[q] + cost)
    return f


def uninserted(b: list[int]) -> list[int]:
    """Backward costs before inserts."""
    b = list(b)
    for _ in range(2):
        for _, q, to, cost in INSERTS:
            b[q] = min(b[q], b[to] + cost)
    return b


#: Backward costs after the last row.
END = uninserted([0, INF, INF, 0])


def advanced(f: list[int], code: str) -> list[int]:
    """Forward costs after the rows of code, before inserts behind them."""
    for sign in code:
        f, out = inserted(f), [INF] * 4
        for _, q, to, cost in row_arcs(sign):
            out[to] = min(out[to], f[q] + cost)
        f = out
    return f


def matrix(code: str) -> list[int]:
    return [x for q in range(4) for x in advanced([0 if p == q else INF for p in range(4)], code)]


def times(f: list[int], m: list[int]) -> list[int]:
    return [min(INF, min(f[q] + m[4 * q + to] for q in range(4))) for to in range(4)]


def times_back(m: list[int], b: list[int]) -> list[int]:
    return uninserted([min(INF, min(m[4 * q + to] + b[to] for to in range(4))) for q in range(4)])


def traversed(code: str, f: list[int], b: list[int], best: int, frontier: set[int], last: bool) -> tuple[str, set[int]]:
    """Letters of the edits of code's rows that are least among the cheapest, and the states after them.

    f: forward costs at the first row before inserts; b: backward costs behind the last row; best: cost of the conversation.
    """
    fs, bs = [inserted(f)], [b]
    for sign in code:
        out = [INF] * 4
        for _, q, to, cost in row_arcs(sign):
            out[to] = min(out[to], fs[-1][q] + cost)
        fs.append(inserted(out))
    for sign in reversed(code):
        out = [INF] * 4
        for _, q, to, cost in row_arcs(sign):
            out[q] = min(out[q], bs[-1][to] + cost)
        bs.append(uninserted(out))
    bs.reverse()
    i, letters = 0, []
    while True:
        tight = [(x, to, i) for x, q, to, cost in INSERTS if q in frontier and fs[i][q] + cost + bs[i][to] == best] if last or i < len(code) else []
        if i < len(code):
            tight += [(x, to, i + 1) for x, q, to, cost in row_arcs(code[i]) if q in frontier and fs[i][q] + cost + bs[i + 1][to] == best]
        if not tight:
            return "".join(letters), frontier
        least = min(x for x, _, _ in tight)
        frontier = {to for x, to, _ in tight if x == least}
        i = next(at for x, _, at in tight if x == least)
        letters.append(least)


@lru_cache(maxsize=1 << 14)
def _solved(code: str) -> tuple[int, str]:
    f = [0, INF, INF, INF]
    best = min(x + y for x, y in zip(advanced(f, code), END, strict=True))
    return best, traversed(code, f, END, best, {START}, True)[0]


def solved(code: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; short ones are remembered."""
    return _solved(code) if len(code) <= 64 else _solved.__wrapped__(code)


def replayed(audit: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """The turns that edits leave; a state takes only one of user and assistant, so letters say all."""
    out, i = [], 0
    for letter in audit:
        if letter == "I" or letter == "R":
            role = "user" if "u" in NEXT[state] else "assistant"
            out.append((role, "" if letter == "I" else texts[i]))
            state = NEXT[state][role[0]]
        elif letter == "K":
            out.append((roles[i], texts[i]))
            state = NEXT[state][roles[i][0]]
        i += letter != "I"
    return out


# ---- pieces


def _key(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_PIECE = "conv_id {0}, at long, whole boolean, turns array<{1}>, roles array<string>, texts array<string>"
_FACTS = "code string, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, kinds long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows. A piece is whole if the conversation before and after it is another one and it wasn't cut."""
    base, rows, chars, ready, held = TaskContext.get().partitionId() << 33, [], 0, 0, False
    conv, cut, n, done = None, True, 0, []

    def batch_of() -> pa.RecordBatch:
        types = [kind[0], pa.int64(), pa.bool_(), pa.list_(kind[1]), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", "at", "whole", "turns", "roles", "texts"])

    for batch in batches:
        kind = (batch.schema.field("conv_id").type, batch.schema.field("turn").type)
        for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
            new = held and c != conv
            if rows and (new or len(rows) >= ROWS or chars >= CHARS):
                done.append((conv, base + n, new and not cut, *zip(*rows, strict=True)))
                n, ready, rows, chars, cut = n + 1, ready + chars, [], 0, not new
            if ready >= CHARS or len(done) >= ROWS:
                yield batch_of()
                done, ready = [], 0
            conv, held = c, True
            rows.append((t, r, x))
            chars += len(x)
    if rows:
        done.append((conv, base + n, False, *zip(*rows, strict=True)))  # the next range may go on with it
        yield batch_of()


def observed(roles: list[str], texts: list[str], turns: list, earlier: set[bytes]) -> tuple:
    """The facts of a piece, given the keys of its rows that were seen in pieces before it."""
    signs, counts, seen = [], [0, 0, 0], set(earlier)
    for role, text in zip(roles, texts, strict=True):
        key, said = _key(role, text), text.rstrip(SPACE)
        kind = 0 if not WORD.search(text) else 1 if key in seen else 2 if said[-1] not in ".!?" else None
        seen.add(key)
        if kind is not None:
            counts[kind] += 1
        signs.append(symbol(role, FINE if kind is None else SHORT if kind == 2 else GONE))
    initials = [r[:1] for r in roles]
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    known = [t for t in turns if t is not None]
    return "".join(signs), *counts, illegal, initials[0], initials[-1], min(known, default=None), max(known, default=None), len(set(known))


_DONE = "audit string, cost long, said array<struct<role string, text string>>, final boolean"


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            facts = observed(row["roles"], row["texts"], row["turns"], set())
            cost, audit = solved(facts[0])
            said = replayed(audit, row["roles"], row["texts"], START)
            rows.append((row["conv_id"], row["at"], *facts, audit, cost, [{"role": r, "text": x} for r, x in said]))
        if rows:
            yield _batch(rows, batch.schema.field("conv_id").type)


def _batch(rows: list[tuple], conv: pa.DataType, final: bool = True) -> pa.RecordBatch:
    text, whole = pa.string(), pa.int64()
    said = pa.list_(pa.struct([("role", text), ("text", text)]))
    fields = [("conv_id", conv), ("at", whole), ("code", text), *((x, whole) for x in ("blank", "duplicate", "truncated", "illegal")), ("first", text), ("last", text), *((x, whole) for x in ("least", "most", "kinds")), ("audit", text), ("cost", whole), ("said", said)]
    arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.record_batch([*arrays, pa.array([final] * len(rows))], names=[*(f for f, _ in fields), "final"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys = sorted({_key(r, x) for r, x in zip(row["roles"], row["texts"], strict=True)})
            yield pa.record_batch([pa.array([row["conv_id"]] * len(keys), batch.schema.field("conv_id").type), pa.array(keys, pa.binary()), pa.array([row["at"]] * len(keys))], names=["conv_id", "key", "at"])


def _streamed(rows: DataFrame, down: bool, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of each conversation pass in the order of their pieces; step(state, row) gives the next state and the row to return, or None.

    A task holds one state and one batch, however many pieces a conversation has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    conv, state, begun = row["conv_id"], start(), True
                state, put = step(state, row)
                if put is not None:
                    out.append(put)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=made)

    made = to_arrow_schema(StructType.fromDDL(schema))
    order = [F.col("conv_id"), F.col("at").desc() if down else F.col("at")]
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _open_pieces(pieces: DataFrame, conv: str) -> DataFrame:
    """The pieces of conversations that were cut or lie at the end of a range, with what _solve_whole gives for the others."""
    keys = pieces.mapInArrow(_keys, f"conv_id {conv}, key binary, at long")
    first = keys.groupBy("conv_id", "key").agg(F.min("at").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keys.join(first.withColumnRenamed("conv_id", "c").withColumnRenamed("key", "k"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("at > of")
    earlier = again.groupBy(F.col("at").alias("a")).agg(F.collect_list("key").alias("earlier"))  # at most a key a row of the piece
    known = pieces.join(earlier, F.col("at") == F.col("a"), "left").drop("a")

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                facts = observed(row["roles"], row["texts"], row["turns"], set(row["earlier"] or ()))
                out = _batch([(row["conv_id"], row["at"], *facts, "", 0, [])], batch.schema.field("conv_id").type)
                yield pa.record_batch([*out.columns[:-4], pa.array([matrix(facts[0])], pa.list_(pa.int64()))], names=[*out.schema.names[:-4], "m"])

    seen = stash(known.mapInArrow(see, f"conv_id {conv}, at long, {_FACTS}, m array<long>"))

    def forward(state, row):
        f, last, most = state
        edge = last is not None and last + row["first"] not in LEGAL
        shared = most is not None and row["least"] == most
        put = {k: row[k] for k in ("conv_id", "at", "m")} | {"f": f, "edge": int(edge), "shared": int(shared)}
        return (times(f, row["m"]), row["last"], most if row["most"] is None else row["most"]), put

    ahead = stash(_streamed(seen.select("conv_id", "at", "m", "first", "last", "least", "most"), False, lambda: ([0, INF, INF, INF], None, None), forward, f"conv_id {conv}, at long, m array<long>, f array<long>, edge long, shared long"))

    def backward(state, row):
        b, best = state
        final = best is None
        if final:
            best = min(x + y for x, y in zip(times(row["f"], row["m"]), b, strict=True))
        put = {k: row[k] for k in ("conv_id", "at", "f", "edge", "shared")} | {"b": b, "best": best, "final": final}
        return (times_back(row["m"], b), best), put

    costs = stash(_streamed(ahead, True, lambda: (END, None), backward, f"conv_id {conv}, at long, f array<long>, edge long, shared long, b array<long>, best long, final boolean"))
    priced = seen.drop("conv_id").join(costs, "at")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state after a piece for each state that a cheapest path enters it in (-1: none does). What letters say of the
        rows before fixes their roles, and so the state: frontiers hold one state wherever a piece ends."""
        for batch in batches:
            for row in batch.to_pylist():
                to = []
                for q in range(4):
                    on_path = row["f"][q] + times_back(row["m"], row["b"])[q] == row["best"]
                    to.append(min(traversed(row["code"], row["f"], row["b"], row["best"], {q}, False)[1]) if on_path else -1)
                yield pa.record_batch([pa.array([row["conv_id"]], batch.schema.field("conv_id").type), pa.array([row["at"]]), pa.array([to], pa.list_(pa.int64()))], names=["conv_id", "at", "to"])

    moves = stash(priced.select("conv_id", "at", "code", "m", "f", "b", "best").mapInArrow(exits, f"conv_id {conv}, at long, to array<long>"))
    entered = stash(_streamed(moves, False, lambda: START, lambda q, row: (row["to"][q], {"conv_id": row["conv_id"], "at": row["at"], "entry": q}), f"conv_id {conv}, at long, entry long"))
    ready = priced.join(entered.select("at", "entry"), "at").join(pieces.select("at", "roles", "texts"), "at")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                audit, _ = traversed(row["code"], row["f"], row["b"], row["best"], {row["entry"]}, row["final"])
                said = replayed(audit, row["roles"], row["texts"], row["entry"])
                facts = [row[x.split()[0]] for x in _FACTS.split(", ")]
                facts[4] += row["edge"]
                facts[9] -= row["shared"]
                yield _batch([(row["conv_id"], row["at"], *facts, audit, row["best"] if row["final"] else 0, [{"role": r, "text": x} for r, x in said])], batch.schema.field("conv_id").type, row["final"])

    return ready.mapInArrow(solve, f"conv_id {conv}, at long, {_FACTS}, {_DONE}")


def repair(turns: DataFrame) -> DataFrame:
    """Pieces of the repaired conversations: conv_id, at (their order), whole, final, counts, audit, cost and said (the turns after repair).

    turns: conv_id, turn, role, text; null role or text: one space. Rows of a conversation (null is one) go by turn, nulls first,
    then role and text. A role has its first character's part; one without characters can't be kept. Repeated rows are duplicates; an empty table
    gives no rows; other columns are ignored. Counts and costs of a conversation are the sums over its pieces.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)  # noqa: E731
    rows = turns.select("conv_id", "turn", spaced("role"), spaced("text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    # texts that begin alike go by hash, so that ranges are cut by small keys; equal rows may lie in any order and over several ranges
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *(c.alias(f"_{i}") for i, c in enumerate(order[3:])))
    order = [*order[:3], *(F.col(f"_{i}") for i in range(3))]
    dealt = keyed.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    pieces = stash(dealt.mapInArrow(_cut, _PIECE.format(types["conv_id"], types["turn"])))
    schema = f"conv_id {types['conv_id']}, at long, {_FACTS}, {_DONE}"
    whole = pieces.where("whole").select("conv_id", "at", "turns", "roles", "texts").mapInArrow(_solve_whole, schema).withColumn("whole", F.lit(True))
    parts = _open_pieces(pieces.where("NOT whole").drop("whole"), types["conv_id"]).withColumn("whole", F.lit(False))
    return whole.unionByName(parts)


def digests(pieces: DataFrame) -> DataFrame:
    """gaps, counts, cost, audit and repaired_sha256 of each conversation.

    A whole conversation is hashed where it is; pieces of others pass in order through one running hash, which SHA-256 needs.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    said = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = lambda most, least, kinds: F.coalesce(most - least + 1 - kinds, F.lit(0)).cast("long").alias("gaps")  # noqa: E731
    whole = pieces.where("whole").select("conv_id", gaps(F.col("most"), F.col("least"), F.col("kinds")), *counts, "audit", F.sha2(said, 256).alias("repaired_sha256"))
    parts = pieces.where("NOT whole")
    sums = parts.groupBy("conv_id").agg(gaps(F.max("most"), F.min("least"), F.sum("kinds")), *(F.sum(c).alias(c) for c in counts))

    def step(state, row):
        digest, letters, before = state
        if row["said"]:
            text = "\n".join(f"{t['role']}:{t['text']}" for t in row["said"])
            digest.update((f"\n{text}" if before else text).encode())
        letters.append(row["audit"])
        done = {"conv_id": row["conv_id"], "audit": "".join(letters), "repaired_sha256": digest.hexdigest()} if row["final"] else None
        return (digest, letters, before or bool(row["said"])), done

    conv = pieces.schema["conv_id"].dataType.simpleString()
    streamed = _streamed(parts.select("conv_id", "at", "audit", "said", "final"), False, lambda: (hashlib.sha256(), [], False), step, f"conv_id {conv}, audit string, repaired_sha256 string")
    other = streamed.withColumnRenamed("conv_id", "c")
    return whole.unionByName(sums.join(other, sums["conv_id"].eqNullSafe(other["c"])).drop("c"))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows with planted faults, chosen by crc32 of `conv_id:turn` modulo 20 (nulls: one space)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times_ = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times_.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = digests(repair(damage(turns))).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)  # noqa: E731
    return every.join(done, every["conv_id"].eqNullSafe(done["c"]), "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )  # fmt: skip


def _oracle() -> str:
    """Forward search over (cost, audit) of each state: at one node the least audit of the least cost is the best one to go on with."""

    def add(s: str, cost: str, letter: str) -> str:
        return f"lpad((substr({s}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({s}, 9) || '{letter}'"

    def take(s: str, initial: str) -> str:
        keep = f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(s, 'more', 'K')} END"
        return f"least({keep}, CASE WHEN NOT gone THEN {add(s, '1 + more', 'R')} END)"

    def inserts(i: str) -> str:
        return f"least(s2, {add('s0', '5', 'I')}, {add('s1', '5', 'I')}, {add('s3', '5', 'I')})" if i == "2" else f"least(s3, {add('i2', '5', 'I')})"

    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)"
    codes = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::UBIGINT)"
    return rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {bit}), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank,
    NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-]*\z') AS short,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), signs AS MATERIALIZED (
  SELECT *, blank OR again AS gone, CASE WHEN short THEN 5 ELSE 0 END AS more FROM faults
), counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM signs GROUP BY conv_id
), search AS (
  SELECT conv_id, 0 AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i, {add("s0", "2", "D")},
    least({add("s1", "2", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {add("s0", "more", "K")} END),
    least({add("i2", "2", "D")}, {take("s0", "u")}, {take("s1", "u")}, {take("i3", "u")}),
    least({add("i3", "2", "D")}, {take("i2", "a")})
  FROM (
    SELECT *, {inserts("3")} AS i3 FROM (
      SELECT s.conv_id, r.i, s0, s1, s3, {inserts("2")} AS i2, r.gone, r.more, r.initial
      FROM search s JOIN signs r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
    )
  )
), ended AS (
  SELECT *, least(s0, s3, {add("i2", "5", "I")}) AS best FROM (
    SELECT s.*, n, {inserts("2")} AS i2 FROM search s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n
  )
), letters AS (
  SELECT conv_id, j, substr(best, 8 + j, 1) AS letter FROM ended, generate_series(1, length(best) - 8) AS g(j)
), steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER before AS used, count(*) FILTER (letter <> 'D') OVER before AS m FROM letters
  WINDOW before AS (PARTITION BY conv_id ORDER BY j)
), said AS (
  SELECT e.conv_id, e.j, e.m, e.letter, r.role, CASE WHEN e.letter = 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN e.m = 1 AND e.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS led
  FROM steps e LEFT JOIN signs r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.used
  WHERE e.letter <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha
  FROM said GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(substr(e.best, 1, 8)::BIGINT, 0) AS cost,
  coalesce(substr(e.best, 9), '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL = {"op12_conversation_repair": _oracle()}
