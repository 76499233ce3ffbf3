"""Where a byte-level tokenizer's pattern cuts a text, on whole slices of texts at once.

The two patterns cut between runs of letters, numbers, white space and other characters; what differs is which runs
take a blank before them and whether digits stand alone. Both keep the contractions 's 't 're 've 'm 'll 'd together.
"""

from __future__ import annotations

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The code points of the property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The letters that may follow an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def character_classes() -> bytes:
    """The class of every code point, one byte each."""
    codes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, code in (("L", LETTER), ("N", NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            shift = [0 if i < 0xD800 else 0x800 for i in (run.start(), run.end() - 1)]
            codes[run.start() + shift[0] : run.end() + shift[1]] = code
    codes[WHITE_SPACE] = SPACE
    return codes.tobytes()


def _contractions(points, kinds, starts, first):
    """Apostrophes that begin a contraction, and its length; ``starts``: runs as they are cut so far."""
    n = len(points)
    at = np.flatnonzero((points == ord("'")) & starts)
    at = at[at + 1 < n]
    # The apostrophe must be a run of its own, and letters follow it in the same text.
    at = at[(kinds[at + 1] == LETTER) & ~first[at + 1]]
    one = points[at + 1]
    two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
    same = (at + 2 < n) & (kinds[np.minimum(at + 2, n - 1)] == LETTER) & ~first[np.minimum(at + 2, n - 1)]
    length = np.where(np.isin(one, [ord(c) for c in SHORT]), 2, 0)
    for a, b in LONG:
        length[(length == 0) & same & (one == ord(a)) & (two == ord(b))] = 3
    return at[length > 0], length[length > 0]


def _apply_contractions(points, kinds, starts, first, own):
    at, length = _contractions(points, kinds, own, first)
    starts[at + 1] = False
    after = at + length
    inside = after < len(points)
    after = after[inside]
    starts[after[(kinds[after] == LETTER) & ~first[after]]] = True


def cuts_with_blanks(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the matches of ``'s|..| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    points: code points of several texts; first: whether a text begins here.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes[points]
    change = np.ones(n, bool)
    change[1:] = (kinds[1:] != kinds[:-1]) | first[1:]
    space = kinds == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (points[:-1] == 0x20) & ~first[1:]
    starts = change & (space | ~blank_before)
    # The last white space before other text stands alone or goes with it.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    starts[last] = True
    _apply_contractions(points, kinds, starts, first, starts & ~space)
    return np.flatnonzero(starts)


def cuts_without_space(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of ``'s|..|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = classes[points]
    starts = np.ones(n, bool)
    starts[1:] = (kinds[1:] != kinds[:-1]) | first[1:] | (kinds[1:] == NUMBER)
    _apply_contractions(points, kinds, starts, first, starts & (kinds == OTHER))
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)
    kept = kinds[at] != SPACE
    return at[kept], ends[kept]
