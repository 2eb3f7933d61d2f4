"""The definitions of the operators, row by row and without Spark."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None, pattern=WORD) -> list[bytes]:
    return pattern.findall((text or "").encode())


def lower(text: str | None) -> str:
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def kept_words(rows: list[tuple], size: int = 20) -> list[tuple[list[bytes], list[bool]]]:
    """Words of each row, and whether each stays; rows in order of id (none last) and text."""
    seen, found = set(), {}
    for place in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, rows[i][1] or "")):
        w = words(rows[place][1])
        stay = [True] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                stay[i : i + size] = [False] * size
            seen.add(window)
        found[place] = w, stay
    return [found[i] for i in range(len(rows))]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = words(lower(text))
    grams = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(points: list[int], most: int = 3) -> list[int]:
    """The place of the first point that can be reached, for each point."""
    root = list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= most:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


def hits(text: str | None, items: list[tuple], span: int = 10, coverage: float = 1.0) -> tuple[int, set[int], set[int]]:
    """Number of words, places hit, and items found."""
    w, places, found = words(lower(text), TEST_WORD), set(), set()
    for item, content in items:
        of = words(lower(content), TEST_WORD)
        size = max(1, min(span, math.ceil(coverage * len(of))))
        windows = {tuple(of[i : i + size]) for i in range(len(of) - size + 1)} if of else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                places |= set(range(i, i + size))
                found.add(item)
    return len(w), places, found


def backoff(texts: list[str | None], order: int, alpha: float) -> list[float]:
    """Scores from the counts of all other texts."""
    from collections import Counter

    tokens = [words(t) for t in texts]

    def grams(w: list[bytes]) -> Counter:
        return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    whole, out = grams([]), []
    for w in tokens:
        whole.update(grams(w))
    for w in tokens:
        own, total = grams(w), max(sum(map(len, tokens)) - len(w), 1)

        def score(gram: tuple, own=own, total=total) -> float:
            c = whole[gram] - own[gram]
            if c:
                return c / (whole[gram[:-1]] - own[gram[:-1]] if len(gram) > 1 else total)
            return alpha * (score(gram[1:]) if len(gram) > 1 else 1 / total)

        out.append(sum(math.log(score(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))))
    return out


def sha(parts: list[bytes], mark: bytes) -> str:
    return hashlib.sha256(mark.join(parts)).hexdigest()
