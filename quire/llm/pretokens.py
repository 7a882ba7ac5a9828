"""The byte-level BPE pre-tokenizer as array work over UTF-8 bytes.

The public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

cuts a text where the class of characters changes (letter, number, space,
other), with two corrections: the last character of a space run goes to what
follows (joined if it is U+0020), and an apostrophe that starts a match may
take one or two letters with it. Both look at neighbours only, so the cuts of
many texts are found at once without running a regular expression.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # The White_Space property.
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    table[0x2000:0x200B] = BLANK
    return table


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each begins."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[lead].astype(np.int32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        at, first = lead[wide], cp[wide]
        padded = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int32)
        b1, b2, b3 = (padded[at + i] & 0x3F for i in (1, 2, 3))
        two = ((first & 0x1F) << 6) | b1
        three = ((first & 0x0F) << 12) | (b1 << 6) | b2
        four = ((first & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
        cp[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return cp, lead


def pretokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where matches begin (and the end), and where each text's matches begin."""
    n = len(buf)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    cp, lead = code_points(buf)
    m = len(cp)
    kind = _classes()[cp]
    start = np.zeros(m + 4, dtype=bool)  # a text begins here
    start[np.searchsorted(lead, off[:-1][off[:-1] < off[1:]])] = True
    start[m:] = True
    cut = start.copy()
    cut[1:m] |= kind[1:] != kind[:-1]
    # The last blank before something else in the same text leaves its run.
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~start[1:m])
    cut[last] = True
    cut[last[cp[last] == 0x20] + 1] = False
    # Contractions.
    quote = np.flatnonzero((cp == 0x27) & cut[:m])
    if len(quote):
        tail = np.concatenate((cp, np.zeros(4, cp.dtype)))
        same1, same2 = ~start[quote + 1], ~start[quote + 1] & ~start[quote + 2]
        a, b = tail[quote + 1], tail[quote + 2]
        one = same1 & np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & same2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        one, two = quote[one], quote[two]
        cut[one + 1] = False
        cut[two + 1] = False
        for at, size in ((one, 2), (two, 3)):
            ahead = at + size
            ahead = ahead[ahead < m]
            cut[ahead[kind[ahead] == LETTER]] = True
    begins = lead[np.flatnonzero(cut[:m])]
    return np.append(begins, n), np.searchsorted(begins, off)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
