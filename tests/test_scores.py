"""Batched scores against plain definitions and values worked out by hand."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest

from veritally.functions import scores as S


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = before + 1 if x == y else max(above, row[j - 1])
            before = above
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _windowed(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max((_ratio(short, w) for k in range(1 - n, len(long)) if (w := long[max(0, k) : k + n])), default=0.0) if n else 0.0


def _token_max(a: str, b: str) -> int:
    if not a or not b:
        return 0
    ta, tb = a.split(), b.split()
    sa, sb = " ".join(sorted(ta)), " ".join(sorted(tb))
    common, left, right = (" ".join(sorted(x)) for x in (set(ta) & set(tb), set(ta) - set(tb), set(tb) - set(ta)))
    found = [_ratio(a, b), _ratio(sa, sb), _windowed(a, b)]
    if common and (not left or not right):
        found.append(100.0)
    else:
        both = f"{common} {left}".strip(), f"{common} {right}".strip()
        found += [_ratio(*both), *((_ratio(common, x) for x in both) if common else ())]
    size = max(len(a), len(b)) / min(len(a), len(b))
    if size >= 1.5:
        found.append(0.95 * (0.9 if size <= 8 else 0.6) * (100.0 if common else _windowed(sa, sb)))
    return int(max(found))


def _texts(n: int, seed: int, most: int = 30) -> list[str]:
    r = random.Random(seed)
    letters = "abcde é漢 "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_subsequences_and_windows_equal_the_plain_table():
    pairs = list(zip(_texts(400, 1), _texts(400, 2), strict=True)) + [("a" * 64, "a" * 64), ("a" * 65, "ba" * 40), ("x" * 63 + "y", "y" + "x" * 90), ("", "abc"), ("", ""), ("ab", "")]
    assert S.lcs_lengths(pairs).tolist() == [_lcs(*p) for p in pairs]
    assert S.ratios(pairs).tolist() == [_ratio(*p) for p in pairs]
    assert S.windowed(pairs).tolist() == [_windowed(*p) for p in pairs]
    long = list(zip(_texts(6, 3, 200), _texts(6, 4, 150), strict=True))
    assert S.lcs_lengths(long).tolist() == [_lcs(*p) for p in long]
    assert S.windowed(long[:3]).tolist() == [_windowed(*p) for p in long[:3]]
    assert S.lcs_lengths([]).tolist() == S.windowed([]).tolist() == S.token_max([]).tolist() == []


def test_scores_equal_their_definitions():
    pairs = list(zip(_texts(500, 5), _texts(500, 6), strict=True)) + [("acme limited", "limited acme corporation"), ("a b", "a b"), ("abc", "xyzabcxyzxyz")]
    assert S.token_max(pairs).tolist() == [_token_max(*p) for p in pairs]
    plain = [int(round(SequenceMatcher(None, a, b).ratio() * 100)) if a and b else 0 for a, b in pairs]
    assert S.difflib_ratio(pairs).tolist() == plain


@pytest.mark.parametrize(
    ("a", "b", "token_max", "difflib"),
    [
        # abcd and bcde share bcd: 2 * 3 / 8; the window bcd, cut off at the start: 2 * 3 / 7 = 85.7
        ("abcd", "bcde", 85, 75),
        # one word of two is the whole other text: its word set is contained
        ("acme", "acme group", 100, 57),
        # kitten, sitting: i, t, t, n are common, 2 * 4 / 13 = 61.5; best window sittin: 2 * 4 / 12 = 66.7
        ("kitten", "sitting", 66, 62),
        # the words are the same: sorted they are equal; unsorted the longest block is of 5 of 9 characters
        ("beta alpha", "alpha beta", 100, 50),
        ("abc", "", 0, 0),
        # nothing in common
        ("abc", "xyz", 0, 0),
        # the window abc of the longer text
        ("abc", "zzzabczzz", 100, 50),
    ],
)
def test_scores_worked_out_by_hand(a, b, token_max, difflib):
    assert S.token_max([(a, b)]).tolist() == [token_max]
    assert S.difflib_ratio([(a, b)]).tolist() == [difflib]


def test_batches_are_much_faster_than_the_plain_table():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(200)]
    name = lambda: " ".join(r.choice(words) for _ in range(4))
    pairs = [(name(), name()) for _ in range(4000)]
    start = time.perf_counter()
    got = S.token_max(pairs)
    fast = (time.perf_counter() - start) / len(pairs)
    start = time.perf_counter()
    want = [_token_max(*p) for p in pairs[:40]]
    slow = (time.perf_counter() - start) / 40
    assert got[:40].tolist() == want
    assert slow > 20 * fast
