"""Word hashes and shingle sets of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task keeps; beyond that it starts anew.
CACHE_WORDS = 200_000
MASK = (1 << 64) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
_kept: dict[bytes, bytes] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words (bytes.split() of UTF-8 cuts at exactly the six ASCII white-space characters)."""
    out = list(map(_kept.get, words))
    if None in out:
        if len(_kept) > CACHE_WORDS:
            _kept.clear()
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                if (x := _kept.get(w)) is None:
                    x = _kept[w] = xxhash.xxh3_64_digest(w)
                out[i] = x
    return np.frombuffer(b"".join(out), np.uint64)


def forget() -> None:
    """Let go of the kept words: at the end of a task, as its worker lives on."""
    _kept.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * ODD + hashes[k : k + n]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text with A-Z lowered; the whole sequence if it has fewer words, none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        whole = windows(hashes, len(words))
        return mix(whole + np.uint64(len(words)))
    return np.unique(windows(hashes, width))
