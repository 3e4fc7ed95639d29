"""Scores of two texts, a batch at a time.

A longest common subsequence is one machine word a pair: bit i of the word says whether the row of the classic table steps up at
position i, so a character of the longer text costs an addition, a subtraction and two masks for all positions of the shorter one. NumPy does them
for thousands of pairs at once. Windowed ratios slide: every window of the longer text is a word of its own, and all of them step together over
one table of the shorter text's characters. Texts of more than 64 characters a side use whole Python integers as their words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np

WORD = 64
#: Entries of a table of characters, and words that step together.
TABLE, WORDS = 1 << 21, 1 << 16
ONES = np.uint64((1 << 64) - 1)

Pairs = Sequence[tuple[str, str]]


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one behind the other, and their lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _padded(flat: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _tables(short: Sequence[str], long: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks (pair, character) of where a short text has a character; the long texts as characters; both lengths.

    The last character is one that no text has: it fills the long texts up and changes no word.
    """
    (fs, ns), (fl, nl) = _codes(short), _codes(long)
    known, at = np.unique(np.concatenate([fs, fl]), return_inverse=True)
    small, large = _padded(at[: len(fs)], ns, len(known)), _padded(at[len(fs) :], nl, len(known))
    masks, rows = np.zeros((len(short), len(known) + 1), np.uint64), np.arange(len(short))
    for i in range(small.shape[1]):
        own = rows[ns > i]
        masks[own, small[own, i]] |= np.uint64(1 << i)
    return masks, large, ns, nl


def _steps(word: np.ndarray, mask: np.ndarray) -> np.ndarray:
    up = word & mask
    return (word + up) | (word - up)


def _count(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    within = np.where(sizes >= WORD, ONES, (np.uint64(1) << np.minimum(sizes, WORD - 1).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~word & within).astype(np.int64)


def _wide(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    word = whole
    for c in b:
        up = word & masks.get(c, 0)
        word = ((word + up) | (word - up)) & whole
    return len(a) - word.bit_count()


def _chunks(order: np.ndarray, texts: Sequence[str], most: int) -> Iterator[np.ndarray]:
    """Parts of order whose tables stay small: a table has a column for each character that its texts hold."""
    part, chars = [], set()
    for k in order.tolist():
        own = set(texts[k])
        if part and (len(part) >= most or (len(part) + 1) * (len(chars | own) + 1) > TABLE):
            yield np.array(part)
            part, chars = [], set()
        part.append(k)
        chars |= own
    if part:
        yield np.array(part)


def lcs_lengths(pairs: Pairs) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    ends = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    sizes = np.fromiter((len(y) for _, y in ends), np.int64, len(ends))
    fits = np.fromiter((len(x) <= WORD for x, _ in ends), bool, len(ends))
    out = np.zeros(len(ends), np.int64)
    for k in np.flatnonzero(~fits).tolist():
        out[k] = _wide(*ends[k])
    narrow = np.flatnonzero(fits)
    both = [x + y for x, y in ends]
    for part in _chunks(narrow[np.argsort(sizes[narrow], kind="stable")], both, WORDS):
        masks, long, ns, _ = _tables([ends[k][0] for k in part], [ends[k][1] for k in part])
        word, rows = np.full(len(part), ONES), np.arange(len(part))
        for j in range(long.shape[1]):
            word = _steps(word, masks[rows, long[:, j]])
        out[part] = _count(word, ns)
    return out


def ratios(pairs: Pairs) -> np.ndarray:
    """100 times twice the longest common subsequence over both lengths; two empty texts are equal."""
    total = np.fromiter((len(x) + len(y) for x, y in pairs), np.float64, len(pairs))
    return np.where(total > 0, 200.0 * lcs_lengths(pairs) / np.maximum(total, 1), 100.0)


def windowed(pairs: Pairs) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer one, windows cut off at the ends included; 0 if one is empty."""
    ends = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    out = np.zeros(len(ends))
    sizes = np.fromiter((len(x) + len(y) for x, y in ends), np.int64, len(ends))
    fits = np.fromiter((0 < len(x) <= WORD for x, _ in ends), bool, len(ends))
    for k in np.flatnonzero(~fits).tolist():
        short, long = ends[k]
        n = len(short)
        if n:
            out[k] = max(200.0 * _wide(short, w) / (n + len(w)) for at in range(1 - n, len(long)) if (w := long[max(0, at) : at + n]))
    narrow = np.flatnonzero(fits)
    both = [x + y for x, y in ends]
    shorter = np.fromiter((len(x) for x, _ in ends), np.int64, len(ends))
    for part in _chunks(narrow[np.lexsort((sizes[narrow], shorter[narrow]))], both, max(1, WORDS // int(sizes[narrow].max(initial=1)))):
        masks, long, ns, nl = _tables([ends[k][0] for k in part], [ends[k][1] for k in part])
        most, many = int(ns.max()), ns + nl - 1  # windows of each pair
        # the mask of each character of the long text, with room before and behind it for windows that stick out
        width = long.shape[1] + 2 * most
        under = np.zeros((len(part), width), np.uint64)
        under[:, most : most + long.shape[1]] = np.take_along_axis(masks, long, axis=1)
        owner = np.repeat(np.arange(len(part)), many)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + 1 - ns[owner]
        at, flat, n, m = owner * width + start + most, under.ravel(), ns[owner], nl[owner]
        word = np.full(len(owner), ONES)
        for j in range(most):
            mask = flat[at + j]
            word = _steps(word, mask if j < ns[0] else np.where(j < n, mask, np.uint64(0)))
        best = 200.0 * _count(word, n) / (n + np.minimum(start + n, m) - np.maximum(start, 0))
        out[part] = np.maximum.reduceat(best, np.cumsum(many) - many)
    return out


def token_max(pairs: Pairs) -> np.ndarray:
    """The best of whole, sorted-word, word-set and windowed ratios, as publicly defined; cut to a whole number; 0 if a text is empty.

    Texts of rather different lengths (1.5 times and more) also count by their windowed word ratio, scaled down.
    """
    best = np.zeros(len(pairs))
    asked, owners, slid, slid_owners, scales = [], [], [], [], []

    def ask(k: int, x: str, y: str) -> None:
        asked.append((x, y))
        owners.append(k)

    for k, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        ta, tb = a.split(), b.split()
        sa, sb = " ".join(sorted(ta)), " ".join(sorted(tb))
        wa, wb = set(ta), set(tb)
        common, left, right = (" ".join(sorted(x)) for x in (wa & wb, wa - wb, wb - wa))
        ask(k, a, b)
        ask(k, sa, sb)
        slid.append((a, b))
        slid_owners.append(k)
        scales.append(1.0)
        size = max(len(a), len(b)) / min(len(a), len(b))
        scale = 0.95 * (0.9 if size <= 8 else 0.6) if size >= 1.5 else 0.0
        if common and (not left or not right):
            best[k] = 100.0
        else:
            both = f"{common} {left}".strip(), f"{common} {right}".strip()
            ask(k, *both)
            if common:  # a prefix of both, so that all of it is the common subsequence
                best[k] = max(200.0 * len(common) / (len(common) + len(x)) for x in both)
        if scale and common:
            best[k] = max(best[k], scale * 100.0)
        elif scale:
            slid.append((sa, sb))
            slid_owners.append(k)
            scales.append(scale)
    np.maximum.at(best, np.array(owners, np.int64), ratios(asked))
    # a window holds at most the whole common subsequence: where that can't beat what is known, nothing slides
    short = np.fromiter((min(len(x), len(y)) for x, y in slid), np.float64, len(slid))
    most = lcs_lengths(slid)
    reach = np.array(scales) * np.where(short + most > 0, 200.0 * most / np.maximum(short + most, 1), 0.0)
    at = np.array(slid_owners, np.int64)
    open_ = np.flatnonzero(reach > best[at]) if len(at) else at
    if len(open_):
        np.maximum.at(best, at[open_], np.array(scales)[open_] * windowed([slid[i] for i in open_.tolist()]))
    return best.astype(np.int64)


def difflib_ratio(pairs: Pairs) -> np.ndarray:
    """Python's sequence matcher in whole percents, 0 if a text is empty; pairs with one second text share its index."""
    out = np.zeros(len(pairs), np.int64)
    matcher, last = SequenceMatcher(), None
    for k in sorted(range(len(pairs)), key=lambda k: pairs[k][1]):
        a, b = pairs[k]
        if not a or not b:
            continue
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        out[k] = int(round(matcher.ratio() * 100))
    return out


#: The scorer that is meant where none is named.
SCORER = "token_max"
SCORERS = {"difflib": difflib_ratio, "token_max": token_max}
