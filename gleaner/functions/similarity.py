"""String similarities on a scale of 0 to 100, for small groups of short strings."""

from __future__ import annotations


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit per character of ``a`` (Hyyro, 2004)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and each side's words behind them; 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    shared = " ".join(sorted(both))
    one, two = (f"{shared} {s}".strip() for s in (left, right))
    best = ratio(one, two)
    if both:
        best = max(best, ratio(shared, one), ratio(shared, two))
    return best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by the common beginning (up to 4 characters) from 0.7 on."""
    if a == b:
        return 100.0 if a else 100.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro > 0.7:
        head = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
        jaro += head * weight * (1 - jaro)
    return 100.0 * jaro


def near_titles(a: str, b: str, least: float = 85.0) -> bool:
    """Whether two titles name one opening: alike as word sets and as strings, and not apart by one telling word."""
    if not a or not b or token_set_ratio(a, b) < least:
        return False
    x, y = set(a.split()), set(b.split())
    only = (x - y, y - x)
    if len(only[0]) == len(only[1]) == 1:
        (p,), (q,) = only
        if min(len(p), len(q)) >= 3 and ratio(p, q) < 75:
            return False
    return ratio(a, b) >= 75


def company_score(a: str, b: str) -> float:
    score = 0.4 * jaro_winkler(a, b) + 0.35 * token_sort_ratio(a, b) + 0.25 * ratio(a, b)
    return score * 0.7 if min(len(a), len(b)) < 5 else score


def company_threshold(name: str) -> float:
    return 90.0 if len(name) >= 10 else 93.0 if len(name) >= 5 else 97.0
