"""Sparse features of texts for the trained models: hashed words, structure statistics, metadata."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
#: Bins of each structure statistic.
BINS = 16
STATS = (
    "words", "chars", "lines", "distinct_words", "mean_word", "mean_line", "upper", "digits", "symbols", "repeats_next",
    "top_word", "distinct_lines", "letters_only", "ends_symbol", "short_words", "long_words", "declared_chars",
)


def _bin(share: float) -> int:
    return min(BINS - 1, max(0, int(share * BINS)))


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(0.0, x))))


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[int]:
    """The bin of each statistic in STATS."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words))
    letters = sum(map(str.isalpha, words))
    digits = sum(map(str.isdigit, words))
    ends = sum(not w[-1].isalnum() for w in words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    symbols = chars - sum(map(len, LETTERS.findall(text))) - text.count(" ")
    lengths = list(map(len, words))
    return [
        _log_bin(len(words)), _log_bin(len(text)), _log_bin(len(lines)), _bin(len(counts) / n), min(BINS - 1, int(sum(lengths) / n)),
        _log_bin(len(text) / len(lines)), _bin(upper / n), _bin(digits / n), _bin(symbols / chars * 2), _bin(repeats / n),
        _bin(max(counts.values(), default=0) / n * 2), _bin(len(set(lines)) / len(lines)), _bin(letters / n), _bin(ends / n),
        _bin(sum(x < 3 for x in lengths) / n), _bin(sum(x > 14 for x in lengths) / n * 4),
        0 if n_chars is None else 1 + min(BINS - 2, int(math.log2(1 + abs(n_chars)))),
    ]


def quality_features(text: str, n_chars: int | None, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words weigh 1 / sqrt(distinct words) each, the bins of the statistics 1."""
    words = text.split()
    counts = Counter(words)
    mask, base = (1 << word_bits) - 1, 1 << word_bits
    idx = {zlib.crc32(w.encode()) & mask for w in counts}
    stats = [base + i * BINS + b for i, b in enumerate(structure(text, words, counts, n_chars))]
    indices = np.fromiter(idx, np.int32, len(idx))
    indices.sort()
    values = np.ones(len(indices) + len(stats), np.float32)
    values[: len(indices)] = 1 / math.sqrt(max(1, len(indices)))
    return np.concatenate([indices, np.array(stats, np.int32)]), values


def word_features(text: str, word_bits: int) -> np.ndarray:
    """Sorted hashes of the distinct lower-cased letter runs."""
    mask = (1 << word_bits) - 1
    idx = {zlib.crc32(w.encode()) & mask for w in set(LETTERS.findall(text.lower()))}
    out = np.fromiter(idx, np.int32, len(idx))
    out.sort()
    return out
