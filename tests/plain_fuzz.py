"""The similarity family from its definitions, one pair at a time."""

from __future__ import annotations

import re

W_SET, W_SORT, W_PART = 0.5, 0.3, 0.2


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and each side's shared-plus-own words."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    with_left = f"{shared} {only_left}".strip()
    with_right = f"{shared} {only_right}".strip()
    best = ratio(with_left, with_right)
    if shared:
        best = max(best, ratio(shared, with_left), ratio(shared, with_right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of the longer one, cut windows at both ends included.

    Of strings of equal length either may be the one that is cut; the better direction counts.
    """
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


def _best_window(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    size, n = len(short), len(long)
    windows = {long[i:i + size] for i in range(n - size + 1)} | {w for k in range(1, size) for w in (long[:k], long[n - k:])}
    return max(ratio(short, w) for w in windows)


def plain(text: str) -> str:
    """Lower case, anything but letters and digits as blanks."""
    return re.sub(r"[\W_]", " ", text).lower().strip()


def blend(a: str, b: str, strict: bool = False) -> float:
    whole, part = set_ratio(a, b), partial_ratio(a, b)
    if strict and part > whole and not set(a.split()) <= set(re.split(r"\W+", b)):
        part = whole
    return W_SET * whole + W_SORT * sort_ratio(a, b) + W_PART * part


def pair_score(target: str, candidate: str) -> float:
    t, c = plain(target), plain(candidate)
    return blend(t, c) if t and c else 0.0


def company_pair_score(target_key: str, candidate_key: str) -> float:
    """Both sides are cleaned company keys."""
    return blend(target_key, candidate_key, strict=True) if target_key and candidate_key else 0.0
