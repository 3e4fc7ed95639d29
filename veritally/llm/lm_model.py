"""Bit predictors under hashed contexts, mixed by gated logistic weights: the arithmetic of lm_scoring.

A table is a range of slots, each with how many bits met it and how many of them were 1. A bit looks up one slot in each table; the
stretched shares are combined with weights that a gate chooses (how often the longer contexts were met), and an adaptive map
from (gate, mixed value) to what happened refines the result. Everything is numpy over many bits at once, and costs are natural
logarithms throughout: nothing is cut off at a least probability.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bits of the tables' slots. Spelling: the class with the last 1, 2 and 3 bytes; the last 4 bytes. Tokens: the class; the word before; the class
#: with class and level of the two words before; a run of copies.
BYTES, TOKENS = (16, 18, 19, 19), (16, 20, 20, 6)
STEPS, BATCH = 24, 1 << 15
#: Words that are spelled together: their bits stay in a core's memory.
SPELLED = 512
#: Levels of words by their number of training occurrences (0: none, 1: one, then up to 7, 31, 127 and so on), classes of words, and
#: occurrences from which a word's index in its level is predicted bit by bit (below, each index of a level and class is as likely).
LEVELS, GROUPS, MIXED = 26, 8, 8
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def offsets(bits: tuple[int, ...]) -> np.ndarray:
    return np.cumsum([0, *(1 << b for b in bits)])


def short(x: np.ndarray) -> np.ndarray:
    """The upper halves of mixed 64-bit numbers."""
    return (x >> np.uint64(32)).astype(np.uint32)


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2^bits from a context and a node, both mixed and 32-bit."""
    return ((context ^ node) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def level(c: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else one more than half the number of binary digits."""
    return np.minimum(np.where(c > 0, 1 + np.frexp(np.maximum(c, 1).astype(np.float64))[1].astype(np.int64) // 2, 0), LEVELS - 1)


def left_out(c: np.ndarray) -> np.ndarray:
    """The level that a training word has without the occurrence at hand; of words above MIXED the level itself."""
    return np.where(c < MIXED, level(c - 1), level(c))


@dataclass
class Predictors:
    """Tables side by side, mixing weights for each gate, and the final map."""

    bits: tuple[int, ...]
    ones: np.ndarray
    n: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls, bits: tuple[int, ...], ones: np.ndarray, n: np.ndarray) -> Predictors:
        gates = 16 if bits == BYTES else 64
        flat = squash(np.arange(STEPS) * (24 / STEPS) - 12 + 12 / STEPS)
        return cls(bits, ones.astype(np.float32), n.astype(np.float32), np.full((gates, len(bits) + 1), 0.3), np.tile(flat, gates))

    def __post_init__(self) -> None:
        self.steps: dict[bool, tuple[np.ndarray, ...]] = {}

    def __getstate__(self) -> dict:
        return {n: v for n, v in self.__dict__.items() if n != "steps"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, steps={})

    def stretched(self, left_out: bool) -> tuple[np.ndarray, ...]:
        """Of each slot the stretched share of 1, whose last two binary digits are the level of its count; left_out: of each slot and outcome, that bit being left out.

        Then what follows from a key, which is the levels of the two tables that gate, and of tokens the slot in the table of copies: the gate, and the share that this table gives.
        """
        if left_out not in self.steps:
            few = np.float32(0.4)
            if left_out:
                x = np.stack([(self.ones + few) / np.maximum(self.n - 1 - self.ones + few, few), np.maximum(self.ones - 1 + few, few) / (self.n - self.ones + few)], 1).reshape(-1)
                n = np.repeat(np.maximum(self.n - 1, 0), 2)
            else:
                x, n = (self.ones + few) / (self.n - self.ones + few), self.n
            known = np.log(x, dtype=np.float32).view(np.uint32) & ~np.uint32(3) | ((n >= 3).astype(np.uint32) + (n >= 15) + (n >= 63))
            if self.bits == TOKENS:
                copy = np.arange(1 << TOKENS[3])
                run = copy >> 1
                gates = (np.arange(16)[:, None] * 4 + np.where(run == 16, 0, 1 + (run >= 1) + (run >= 4))).reshape(-1)
                shares = np.tile(known.view(np.float32)[offsets(TOKENS)[3] << left_out :], 16)
            else:
                gates, shares = np.arange(16), np.zeros(16 << left_out, np.float32)
            self.steps[left_out] = known, gates, shares
        return self.steps[left_out]

    def look(self, slots: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, gates and keys of bits (slots: a row for each table); where the outcomes y are given, the tables hold these very bits, which are left out.

        The table of copies has no row in the inputs: its share follows from the key (with y: 2 key + y).
        """
        known, gates, _ = self.stretched(y is not None)
        many = 3 if self.bits == TOKENS else 4
        x = np.empty((many, slots.shape[1]), np.uint32)
        for row, own in zip(x, slots, strict=False):
            np.take(known, own if y is None else own * 2 + y.view(np.uint8), out=row, mode="clip")  # unlike "raise" it doesn't buffer; all slots are valid
        key = ((x[-2] & np.uint32(3)) << np.uint32(2) | x[-1] & np.uint32(3)).astype(np.int64)
        if self.bits == TOKENS:
            key <<= TOKENS[3]
            key += slots[3]
            key -= offsets(TOKENS)[3]
        return x.view(np.float32), gates.take(key, mode="clip"), key

    def mixed(self, x: np.ndarray, gate: np.ndarray, key: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        _, gates, shares = self.stretched(y is not None)
        own = gates if y is None else np.repeat(gates, 2)
        rest = (self.weights[own, -1] * 0.3).astype(np.float32)
        if self.bits == TOKENS:
            rest += self.weights[own, 3].astype(np.float32) * shares
        s = rest.take(key if y is None else key * 2 + y, mode="clip")
        for w, one in zip(np.ascontiguousarray(self.weights.T, np.float32), x, strict=False):
            w = w.take(gate, mode="clip")
            w *= one
            s += w
        np.minimum(s, np.float32(10), out=s)
        return np.maximum(s, np.float32(-10), out=s)

    def cell(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        own = ((s + np.float32(12)) * np.float32(STEPS / 24)).astype(np.int64)
        own += gate * STEPS
        return own

    def cost(self, slots: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The natural logarithm of each bit's probability."""
        x, gate, key = self.look(slots)
        s = self.mixed(x, gate, key)
        p = self.refined.astype(np.float32).take(self.cell(s, gate), mode="clip")
        p += squash(s)
        p *= np.float32(0.5)
        p -= 1 - y
        return np.log(np.abs(p, out=p), out=p)

    def learn(self, bits: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """One online pass over bits (slots, outcomes) that the tables hold: weights, the map's counts, and how many bits there were."""
        own = Predictors(self.bits, self.ones, self.n, self.weights.copy(), self.refined)
        own.steps[True] = _, of, shares = self.stretched(True)
        gates, k, total = len(own.weights), 0, 0
        met = np.zeros(gates * STEPS * 2, np.int64)  # of each cell, bits that are 0 and that are 1
        for slots, y in bits:
            parts = -(-len(y) // (2 * BATCH))
            for part in range(parts):
                a, b = (len(y) * p // parts for p in (part, part + 1))
                t = y[a:b]
                x, gate, key = own.look(slots[:, a:b], t)
                s = own.mixed(x, gate, key, t)
                cell = own.cell(s, gate)
                cell *= 2
                cell += t
                now = np.bincount(cell, minlength=len(met))
                met += now
                err = t - squash(s)
                many, step = np.maximum(now.reshape(gates, -1).sum(1), 200), 0.5 / (1 + k / 20)
                change = np.zeros_like(own.weights)
                for i, one in enumerate(x):
                    change[:, i] = np.bincount(gate, err * one, gates)
                key *= 2
                key += t
                by_key = np.bincount(key, err, len(shares))
                change[:, -1] = np.bincount(of, 0.3 * by_key.reshape(-1, 2).sum(1), gates)
                if own.bits == TOKENS:
                    change[:, 3] = np.bincount(of, (by_key * shares).reshape(-1, 2).sum(1), gates)
                own.weights += step * change / many[:, None]
                k, total = k + 1, total + len(t)
        hit = met[1::2].astype(np.float64)
        return {"weights": own.weights.reshape(-1), "seen": met[::2] + hit, "hit": hit, "bits": np.array([float(total)])}

    def settle(self, weights: np.ndarray, seen: np.ndarray, hit: np.ndarray) -> None:
        self.weights = weights.reshape(self.weights.shape)
        self.refined = np.clip((hit + 20 * self.refined) / (seen + 20), 1e-5, 1 - 1e-5)


# ---- spelling


def _of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each byte's bits, and the bits."""
    byte, shifts = np.arange(256)[:, None], np.arange(8)
    return short(((1 << shifts) | (byte >> (8 - shifts))).astype(np.uint64) * _C), (byte >> (7 - shifts) & 1).astype(np.int8)


_OF_BYTES = _of_bytes()


def byte_bits(words: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bit of the words and their closing spaces: slots in the joint tables, the bit, and whose it is; classes are of the words."""
    joined = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    nodes, y = (x.take(joined, 0) for x in _OF_BYTES)
    slots, context, at = np.empty((len(BYTES), 8 * len(joined)), np.uint32), np.zeros(len(joined), np.uint64), offsets(BYTES)
    kind = (np.asarray(classes).astype(np.uint64) + np.uint64(1))[of] << np.uint64(48)
    for k, bits in enumerate(BYTES):
        before = np.zeros(len(joined), np.int64)
        before[k + 1 :] = joined[: -k - 1]
        context = context * np.uint64(257) + np.where(place >= k + 1, before + 1, 0).astype(np.uint64)
        own = slots[k].reshape(nodes.shape)
        np.bitwise_xor(short((context ^ kind if k < 3 else context) * _B)[:, None], nodes, out=own)
        own *= np.uint32(0x9E3779B1)  # as in slot()
        own >>= np.uint32(32 - bits)
        own += np.uint32(at[k])
    return slots, y.reshape(-1), np.repeat(of, 8)


def spelled(words: list[bytes], classes: np.ndarray, model: Predictors) -> np.ndarray:
    """The natural logarithm of each word's spelling."""
    out = []
    for at in range(0, len(words), SPELLED):
        slots, y, of = byte_bits(words[at : at + SPELLED], classes[at : at + SPELLED])
        out.append(np.bincount(of, model.cost(slots, y), len(words[at : at + SPELLED])))
    return np.concatenate(out) if out else np.zeros(0)


# ---- codes of known words


@dataclass
class Code:
    """The binary code of words: a path to the level, then the bits of the index in it, or those of the word's class.

    Made from how many words each level and class has, and how many training tokens each level has. A bit that can have one value only,
    because nothing lies beyond the other, isn't coded; so the probabilities of all codes sum to one.
    """

    words: np.ndarray
    paths: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, words: np.ndarray, tokens: np.ndarray) -> Code:
        """words: levels x GROUPS; tokens: levels."""
        heap = [(float(tokens[k]) + 1, k, (k,)) for k in range(LEVELS) if k == 0 or words[k].sum()]
        paths: list[list[tuple[int, int]]] = [[] for _ in range(LEVELS)]
        heapq.heapify(heap)
        name = len(heap) - 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, a), (1, b)):
                for k in side[2]:
                    paths[k].insert(0, (name, bit))
            heapq.heappush(heap, (a[0] + b[0], LEVELS + name, a[2] + b[2]))
            name -= 1
        return cls(words, paths)

    def lay(self, lev: np.ndarray, real: np.ndarray, index: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ends, nodes, bits, plain) of words: where each one's coded bits end, the bits with their nodes, and the rest's cost.

        lev is the level that the path leads to, real the one that the index counts in (they differ where an occurrence is left out).
        """
        depth = max(map(len, self.paths))
        node, bit, size = np.zeros((LEVELS, depth), np.uint64), np.zeros((LEVELS, depth), np.int8), np.array(list(map(len, self.paths)))
        for k, path in enumerate(self.paths):
            for d, (n, b) in enumerate(path):
                node[k, d], bit[k, d] = n + 1, b
        mixed, every = level(np.array([MIXED]))[0], self.words.sum(1)
        low, high, many = np.flatnonzero((lev > 0) & (lev < mixed)), np.flatnonzero(lev >= mixed), size[lev]
        more = [(of, *made(lev[of], real[of], index[of], cls[of], every)) for of, made in ((low, self._by_class), (high, self._by_index))]
        for of, coded, _, _ in more:
            many[of] += coded.sum(0)
        ends = np.cumsum(many)
        begin, nodes, bits = ends - many, np.empty(many.sum(), np.uint32), np.empty(many.sum(), np.int8)
        hashed = short(node * _C)
        for d in range(depth):
            of = np.flatnonzero(size[lev] > d)
            at, k = begin[of] + d, lev[of]
            nodes[at], bits[at] = hashed[k, d], bit[k, d]
        for of, coded, own, b in more:
            at = begin[of] + size[lev[of]]
            for c, n, x in zip(coded, own, b, strict=True):
                nodes[at[c]], bits[at[c]] = short(n[c] * _C), x[c]
                at += c
        plain = np.zeros(len(lev))
        plain[low] = -np.log(np.maximum(self.words[lev[low], cls[low]], 1))
        return ends, nodes, bits, plain

    def _by_class(self, lev: np.ndarray, real: np.ndarray, index: np.ndarray, cls: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bit of the class and each word: whether it is coded, its node, and it."""
        width = GROUPS.bit_length() - 1
        coded, nodes, bits = np.empty((width, len(lev)), bool), np.empty((width, len(lev)), np.uint64), np.empty((width, len(lev)), np.int8)
        for d in range(width):
            up, b = cls >> (width - d), cls >> (width - 1 - d) & 1
            under = self.words.reshape(LEVELS, -1, GROUPS >> d + 1).sum(2)  # words under each start of a class's bits
            coded[d], nodes[d], bits[d] = under[lev, (up << 1 | b) ^ 1] > 0, 64 + (lev << 8) + (1 << d) + up, b
        return coded, nodes, bits

    def _by_index(self, lev: np.ndarray, real: np.ndarray, index: np.ndarray, cls: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the bits of the index in its level."""
        width = np.array([max(int(v) - 1, 0).bit_length() for v in every])[real]
        most, of = int(width.max(initial=0)), every[real]
        coded, nodes, bits = np.empty((most, len(lev)), bool), np.empty((most, len(lev)), np.uint64), np.empty((most, len(lev)), np.int8)
        start = (lev.astype(np.uint64) << np.uint64(48)) + (1 << 32)
        for d in range(most):
            left = np.maximum(width - d - 1, 0)
            up, b = index >> (left + 1), index >> left & 1
            coded[d] = (width > d) & ((b == 1) | ((up << 1 | 1) << left < of))
            nodes[d], bits[d] = start + (np.uint64(1) << np.uint64(d)) + up.astype(np.uint64), b
        return coded, nodes, bits


# ---- tokens


def _last(key: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with its key, -1 if there is none."""
    order = np.argsort(key)
    ranks = key[order]
    same = ranks[1:] == ranks[:-1]
    order = np.sort(np.cumsum(np.r_[False, ~same]) << 32 | order) & 0xFFFFFFFF  # equal keys by their places
    out = np.full(len(key), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def leading_class(classes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the most frequent class of the known tokens before it in its history, GROUPS where there is none."""
    sizes = np.diff(np.r_[starts, len(classes)])
    lead, most = np.full(len(classes), GROUPS), np.zeros(len(classes), np.int32)
    for k in range(GROUPS):
        sums = np.cumsum((classes == k) & counts, dtype=np.int32)
        sums = np.r_[np.int32(0), sums[:-1]]
        sums -= np.repeat(sums[starts], sizes)
        lead[sums > most] = k
        np.maximum(most, sums, out=most)
    return lead


@dataclass
class History:
    """What tokens stand after; codes are numbers of dictionary words, starts the places where histories begin."""

    codes: np.ndarray
    starts: np.ndarray
    lead: np.ndarray
    #: Where the token stands that followed when the same two words stood last in this history (-1: nowhere), and how many such copies came true in a row.
    last: np.ndarray
    run: np.ndarray
    contexts: list[np.ndarray]

    @classmethod
    def of(cls, codes: np.ndarray, starts: np.ndarray, ident: np.ndarray, classes: np.ndarray, lev: np.ndarray) -> History:
        """ident (what a word is as a context), classes and lev are the dictionary's."""
        first = np.zeros(len(codes), bool)
        first[starts] = True
        one = np.r_[-1, codes[:-1]]
        one[first] = -1
        two = np.r_[-1, one[:-1]]
        two[first] = -1
        pair = (((np.cumsum(first).astype(np.uint64) * _A) ^ one.astype(np.uint64)) * _B ^ two.astype(np.uint64)) * _C
        last = _last(np.where(two < 0, np.arange(len(codes), dtype=np.uint64), pair | np.uint64(1 << 63)))
        last[two < 0] = -1
        hit, i = (last >= 0) & (codes[last] == codes), np.arange(len(codes))
        stop = np.maximum.accumulate(np.where(~hit | first, i, -1))
        run = np.r_[0, (i - stop)[:-1]]
        run[first] = 0
        lead = leading_class(classes[codes], lev[codes] > 0, starts)
        names = np.r_[ident, np.uint64(1)]  # [-1]: the history's start
        kind = np.r_[classes * 4 + np.searchsorted([1, 3, 5], lev, "right"), 4 * GROUPS].astype(np.uint64)
        near = names[one] * _B
        form = ((lead.astype(np.uint64) * np.uint64(128) + kind[one]) * np.uint64(128) + kind[two] + np.uint64(1)) * _B
        return cls(codes, starts, lead, last, np.minimum(run, 15), list(map(short, ((lead.astype(np.uint64) + np.uint64(1)) * _C, near, form))))

    def bits(self, laid: tuple, step: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the coded bits of tokens, in parts: slots in the joint tables, the bits, and the tokens that they are of; laid is Code.lay of the dictionary.

        A part has its tokens' first bits, then the second ones and so on. Tokens with more bits come first, so those that have another one are a slice.
        """
        ends, nodes, bits, _ = laid
        size = np.diff(ends, prepend=0)
        begin, at, contexts = ends - size, offsets(TOKENS), np.stack(self.contexts)
        shifts = np.array([[32 - b] for b in TOKENS[:3]], np.uint32)
        for a in range(0, len(self.codes), step):
            order = np.argsort(-size[self.codes[a : a + step]].astype(np.int16), kind="stable") + a
            own = self.codes[order]
            many, first = size[own], begin[own]
            deep = len(own) - np.cumsum(np.bincount(many))[:-1]  # tokens that have a first bit, a second one and so on
            starts = np.r_[0, np.cumsum(deep)]
            total = int(starts[-1])
            flat, of, slots, near = np.empty(total, np.int64), np.empty(total, np.int64), np.empty((len(TOKENS), total), np.uint32), contexts[:, order]
            for d, m in enumerate(deep.tolist()):
                b = int(starts[d])
                np.add(first[:m], d, out=flat[b : b + m])
                of[b : b + m] = order[:m]
                slots[:3, b : b + m] = near[:, :m]
            node, y = nodes.take(flat, mode="clip"), bits.take(flat, mode="clip")
            hashed = slots[:3]
            hashed ^= node
            hashed *= np.uint32(0x9E3779B1)  # as in slot()
            hashed >>= shifts
            hashed += at[:3, None].astype(np.uint32)
            slots[3] = at[3] + 32
            if len(told := np.flatnonzero((self.last[order] >= 0) & (many > 0))):
                t = np.repeat(told, many[told])
                d = np.arange(len(t)) - np.repeat(np.cumsum(many[told]) - many[told], many[told])
                mine, guess = starts[d] + t, self.codes[self.last[order[t]]]
                place = np.where(d < size[guess], begin[guess] + d, 0)
                right = (d < size[guess]) & (nodes[place] == node[mine])
                slots[3, mine[right]] = at[3] + self.run[order[t[right]]] * 2 + bits[place[right]]
            yield slots, y, of
