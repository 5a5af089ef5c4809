"""Packing token sequences with minimum bin slack."""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sliced

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a task keeps; beyond that it starts anew.
CACHE_WORDS = 200_000


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False):
    """Text -> packed little-endian uint32 ids, as the tokenizers file at path gives them with add_special_tokens=False.

    The file's byte-level vocabulary is also its merge order, so the faster tiktoken reads the same table. Text is
    cut before each single space and ids are kept by word. A cut can part only a token that holds a space after its
    first byte (here runs of space and U+00A0), so texts in which such a token is spelled go whole through the file.
    added: so do texts that spell one of the file's added tokens, which then get its id as Tokenizer.encode gives it;
    otherwise they get the ids of its characters (encode_special_tokens).
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    kept: dict[str, bytes] = {}
    tokenizer.encode_special_tokens = not added
    # bytes of a character that a token cuts off are left out of what is looked for
    spaced = {t.decode(errors="ignore") for t in ranks if b" " in t[1:]} | (special if added else set())
    whole = [x for x in spaced if not any(y in x for y in spaced - {x})]

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def pack(text: str) -> bytes:
        return packed(plain(text))

    def encode(text: str) -> bytes:
        for x in whole:
            if x in text:
                return packed(tokenizer.encode(text, add_special_tokens=False).ids)
        if "  " in text or not text:
            return pack(text)
        first, *words = text.split(" ")
        out = list(map(kept.get, words))
        if None in out:
            if len(kept) > CACHE_WORDS:
                kept.clear()
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    if (x := kept.get(w)) is None:
                        x = kept[w] = pack(" " + w)
                    out[i] = x
        return b"".join([pack(first) if first else b"", *out])

    encode.forget = kept.clear
    return encode


def best_fill(counts: dict[int, int], capacity: int) -> list[int]:
    """The multiset of lengths, the largest one included, whose sum is closest to capacity from below.

    A bitset holds the sums that can be reached; counts enter by binary splitting, and the way back through the
    kept bitsets gives how many of each length were used.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = [first]
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * k
            total -= length * k
    return chosen


class Packer:
    """Fills sequences from documents; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, pool_tokens: int):
        self.capacity, self.pool_tokens = capacity, pool_tokens
        self.counts: dict[int, int] = {}
        self.pieces: dict[int, deque] = defaultdict(deque)
        self.tokens = 0

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pieces[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.tokens += n

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
        self.tokens -= n
        return self.pieces[n].popleft()

    def _fill(self, size: int) -> list[tuple]:
        """One sequence of exactly size tokens: the closest multiset, and where it leaves slack the largest rest is cut to it."""
        out: list[tuple] = []
        while room := size - sum(len(p[2]) // 4 for p in out):
            fits = {n: c for n, c in self.counts.items() if n <= room}
            if fits:
                out += [self._take(n) for n in best_fill(fits, room)]
            else:
                doc, start, ids, whole = self._take(max(self.counts))
                out.append((doc, start, ids[: 4 * room], whole))
                self._put((doc, start + room, ids[4 * room :], whole))
        return out

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        whole, step = len(ids) // 4, 4 * self.capacity
        full = len(ids) // step * step
        for at in range(0, full, step):
            yield [(doc, at // 4, ids[at : at + step], whole)]
        if full < len(ids):
            self._put((doc, full // 4, ids[full:], whole))
        if self.tokens > self.pool_tokens:
            while self.tokens > self.pool_tokens // 4:
                yield self._fill(self.capacity)

    def close(self) -> Iterator[list[tuple]]:
        """The rest: full sequences, then sequences of powers of two, which need no padding."""
        while self.tokens:
            size = self.capacity if self.tokens >= self.capacity else 1 << (self.tokens.bit_length() - 1)
            yield self._fill(size)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, pool_tokens: int = 1 << 20, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts, end each with end_id, and pack them into sequences of capacity tokens (a power of two).

    Runs beside the scan, without a shuffle: each task keeps a pool of rests of up to pool_tokens and fills windows
    from it; what a task has left at its end goes to sequences whose lengths are powers of two. Sequence ids carry
    the partition in their upper bits, so a task that is run again gives the same ids.

    Returns a row per piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.
    Ids are those of Tokenizer.encode(text, add_special_tokens=False), so a text that spells an added token has its id.
    Null and empty texts are the end id alone; ids may be null or repeat (each row is a document); no rows give none.
    """
    ship(docs.sparkSession)
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path, added=True), Packer(capacity, pool_tokens)
        base, rows, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def sequences() -> Iterator[list[tuple]]:
            for batch in sliced(batches):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc, encode(text or "") + end)
            yield from packer.close()

        for sequence in sequences():
            offset = 0
            for doc, start, ids, whole in sequence:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, whole, base + made, offset))
                offset += n
            made, size = made + 1, size + 4 * offset
            if size > 4 << 20:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()
        encode.forget()  # the worker lives on

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
