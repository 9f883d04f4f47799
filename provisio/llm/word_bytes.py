"""Words of many texts at once, as arrays over their bytes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Between two texts; in a text it counts as a blank.
MARK = "\x1e"
BEYOND_ASCII = re.compile(r"[^\w\x00-\x7f]+")
ASCII_WORDS = bytes(c if c > 127 or chr(c).isalnum() or c == 30 else 32 for c in range(256))
BASE = 0x9E3779B97F4A7C15
STEP = 1 << 20
KEPT = 9 << 18


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 and so on, ``n`` of them; those of usual lengths are kept."""
    return _powers(base, n) if n > KEPT else _kept_powers(base)[:n]


@lru_cache(maxsize=4)
def _kept_powers(base: int) -> np.ndarray:
    return _powers(base, KEPT)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def plain(texts: list[str]) -> bytes:
    """The texts in lower-case UTF-8, each followed by ``MARK``; what is neither letter nor digit is blank."""
    joined = MARK.join(t.replace(MARK, " ") if MARK in t else t for t in texts).lower() + MARK
    other = [c for c in set(joined) if c > "\x7f" and not c.isalnum()]
    if len(other) > 64:
        joined = BEYOND_ASCII.sub(" ", joined)
    else:
        for c in other:
            joined = joined.replace(c, " ")
    return joined.encode("utf-8", "replace").translate(ASCII_WORDS)


def words_of(text: str) -> list[bytes]:
    """The words of one text: the longest runs of letters or digits, lower-cased."""
    return plain([text]).replace(MARK.encode(), b" ").split()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    b = np.frombuffer(b" " + plain(texts), np.uint8)
    inside = b > 32
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turn[0::2], turn[1::2]
    marks = np.flatnonzero(b == 30)
    counts = np.diff(np.r_[0, np.searchsorted(starts, marks)])
    power, back = powers(BASE, STEP + 1), powers(pow(BASE, -1, 1 << 64), STEP + 1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # stretches of about STEP bytes
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + STEP, "right"))
        if to == at:  # a word longer than that
            v = 0
            for c in bytes(b[base : ends[at]])[::-1]:
                v = (v * BASE + c) & 0xFFFFFFFFFFFFFFFF
            out[at] = v
            at += 1
            continue
        h = np.zeros(int(ends[to - 1]) - base + 1, np.uint64)
        np.cumsum(b[base : ends[to - 1]] * power[: len(h) - 1], out=h[1:])
        out[at:to] = (h[ends[at:to] - base] - h[starts[at:to] - base]) * back[starts[at:to] - base]
        at = to
    return mix(out), counts
