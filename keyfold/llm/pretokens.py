"""Splitting of UTF-8 text into words for byte-level BPE, over whole byte arrays at once."""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    return out


def byte_classes(b: np.ndarray) -> np.ndarray:
    """Class of each byte of valid UTF-8: that of the character it belongs to."""
    table = char_classes()
    cls = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if lead.size:
        x = b.astype(np.int32) if lead.size * 4 > b.size else None
        at = (lambda i: x[i]) if x is not None else (lambda i: b[i].astype(np.int32))
        first = at(lead)
        for low, high, extra, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0x100, 3, 0x07)):
            pick = (first >= low) & (first < high)
            p = lead[pick]
            if not p.size:
                continue
            cp = first[pick] & bits
            for k in range(1, extra + 1):
                cp = (cp << 6) | (at(np.minimum(p + k, b.size - 1)) & 0x3F)
            kind = table[np.minimum(cp, 0x10FFFF)]
            for k in range(extra + 1):
                cls[np.minimum(p + k, b.size - 1)] = kind
    return cls


def word_starts(b: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start offsets of all words of concatenated texts.

    ``doc_starts`` are the offsets (below ``len(b)``) at which texts begin. The
    rule: contractions, runs of letters, numbers or other characters each with
    one blank before it, and white space, whose last character stands alone if
    something follows and it is no blank.
    """
    n = b.size
    if n == 0:
        return np.zeros(0, np.int64)
    cls = byte_classes(b)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    fresh = np.zeros(n, bool)
    fresh[doc_starts] = True
    start |= fresh
    space = cls == SPACE
    after = np.flatnonzero(~space[1:] & space[:-1] & ~fresh[1:]) + 1
    last = after - 1
    blank = b[last] == 0x20
    start[after[blank]] = False
    for _ in range(3):  # to the lead byte of white space outside ASCII
        last = last - ((b[last] & 0xC0) == 0x80)
    start[last] = True

    quote = np.flatnonzero((b == 0x27) & start)
    if quote.size:
        limit = np.append(doc_starts, n)
        end = limit[np.searchsorted(limit, quote, side="right")]
        one = b[np.minimum(quote + 1, n - 1)]
        two = b[np.minimum(quote + 2, n - 1)]
        has1, has2 = quote + 1 < end, quote + 2 < end
        short = has1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = has2 & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for which, size in ((short, 2), (long & ~short, 3)):
            q = quote[which]
            start[q + 1] = False
            nxt = q + size
            start[nxt[nxt < end[which]]] = True
    return np.flatnonzero(start)
