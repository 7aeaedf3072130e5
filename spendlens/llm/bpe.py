"""Byte-level BPE encoding and decoding of whole texts, with a two-tier lookup of pre-tokens.

Tier one is a minimal perfect hash over the vocabulary: one probe and one byte comparison tell whether a whole
pre-token is in the vocabulary, and its id. Tier two encodes the misses: bytes in a linked list, adjacent pairs in a
heap by rank and position, so a pre-token of n bytes costs n log n whatever its length.

The vocabulary (one line per token) is read on the driver and broadcast: its size is fixed by the rank file and does
not grow with the data. Each Python worker remembers a bounded number of encoded pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pretoken import splitter

REMEMBERED = 1 << 18
ROWS_AT_ONCE = 512
_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, one slot each.

    Buckets are placed largest first; a bucket of several keys takes the first displacement that sends all of them
    to free slots, and a bucket of one key points at a free slot (a negative entry).
    """

    def __init__(self, keys: list[bytes]):
        self.size, self.buckets = len(keys), max(1, len(keys) // 2)
        self.displacement, self.slots = [0] * self.buckets, [b""] * self.size
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        if len({h for g in groups.values() for h, _ in g}) < self.size:
            raise ValueError("the keys are not distinct")
        taken, single = [False] * self.size, []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                single.append((bucket, members[0][1]))
                continue
            d = 0
            while True:
                at = {self._slot(h, d) for h, _ in members}
                if len(at) == len(members) and not any(taken[s] for s in at):
                    break
                d += 1
            self.displacement[bucket] = d
            for h, key in members:
                s = self._slot(h, d)
                taken[s], self.slots[s] = True, key
        free = (s for s in range(self.size) if not taken[s])
        for (bucket, key), s in zip(single, free):
            self.displacement[bucket], self.slots[s] = -1 - s, key

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * _STEP) & _MASK
        return (((x ^ (x >> 32)) * _MIX & _MASK) >> 20) % self.size

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 if it is not among the keys."""
        if not self.size:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return s if self.slots[s] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: merge the adjacent pair of lowest rank, leftmost first, until none is left.

    ``end[i]`` links the part that starts at byte i to the next one (-1: merged away). A heap entry (rank, i, e) is
    stale unless the part at i and the one after it still end at e.
    """
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, -1
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """Pre-token -> its ids as little-endian int32 bytes; a miss is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), dtype="<i4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Vocabulary:
    """Ranks of byte strings, the pre-token pattern, and the perfect hash over the byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.id_at = [ranks[token] for token in self.hash.slots]
        self.token_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.token_of[i] = token

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        """Read lines of "base64 token, space, rank"."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def encode_word(self, word: str) -> list[int]:
        piece = word.encode()
        slot = self.hash.find(piece)
        return [self.id_at[slot]] if slot >= 0 else merge_bytes(piece, self.ranks)

    def encode(self, text: str) -> np.ndarray:
        if "memo" not in self.__dict__:
            self.memo = Memo(self.encode_word)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, splitter(self.pattern)(text))), dtype="<i4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``ROWS_AT_ONCE`` rows, so that what a task makes of them stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(low, ROWS_AT_ONCE)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) and ``out``, the ids of the whole ``text`` as array<int>.

    Null and empty texts give an empty array. Repeated rows stay. A column named like ``out`` is replaced. Texts are
    encoded one at a time, so memory is bounded by one Arrow batch and its ids.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*kept, df[text].alias("_text"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            texts = batch.column(len(kept))
            ids = [own.encode(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], _lists(ids)], names=[*kept, out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) and ``out``, the bytes that ``ids`` stand for (null ids: no bytes).

    The bytes are binary and not text: ids may be cut anywhere within a character. An id outside the vocabulary
    fails the job. A column named like ``out`` is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*kept, df[ids].alias("_ids"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            column = batch.column(len(kept))
            values = column.values.to_numpy(zero_copy_only=False)
            cuts, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            data = [own.decode(values[a:b].tolist()) if ok else b"" for a, b, ok in zip(cuts, cuts[1:], there)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(data, pa.binary())],
                                             names=[*kept, out])

    return source.mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    cuts = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=cuts[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32()))
