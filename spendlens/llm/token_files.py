"""Token ids in binary files: fixed-width bit packing in blocks, with block offsets for random access.

A dataset is a folder of files. Documents are cut into shards, contiguous ranges of ascending ``doc_id``; a shard is
one run of frames in one file:

    frame  = header (8 little-endian int64) + payload + one newline byte (the row separator of Spark's text writer)
    header = magic, kind, shard, sequence number, first position, count, bits, payload bytes

Frames of kind IDS hold ``BLOCK_IDS`` ids of the shard's stream (the last one fewer), each in the fewest bits that
hold the vocabulary, whatever the document borders. Frames of kind DOCS hold, for up to ``BLOCK_DOCS`` documents, a
null flag, the doc_id and the id count. The frame of kind END lists the byte offset, relative to the shard's first
frame, of every IDS frame, and last its own. A shard is a file of its own, whose number is the shard's. To read some ids
(``lookup``), the end of the file leads to the END frame, this to block p // BLOCK_IDS of position p, and only the bytes that
hold the ids asked for are read and unpacked with numpy. A reader of whole files (``read``) goes from frame to frame.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import REMEMBERED, sliced
from .pretoken import BYTE_LEVEL, starts
from .work import hadoop, new_path, offsets, stored

MAGIC = int.from_bytes(b"TOKFRAME", "little")
HEADER = 8
IDS, DOCS, END = 0, 1, 2
BLOCK_IDS = 1 << 16
BLOCK_DOCS = 1 << 13
SHARD_TEXT_BYTES = 24 << 20
#: Words that are given to the library side by side.
WORDS_BESIDE = 256
#: Texts in a call of the library; what it makes of them is freed before the next call.
TEXTS_AT_ONCE = 32
#: Code points of texts that are split at once, or one text of more.
POINTS_AT_ONCE = 1 << 21


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary_size - 1."""
    return max(1, (max(1, vocabulary_size) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), bitorder="little").tobytes()


def unpack(data, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from position ``first`` on, as uint32; only the bytes that hold them are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype(np.uint32)
    low, high = first * bits // 8, -(-(first + count) * bits // 8)
    return unpack_bits(memoryview(data)[low:high], bits, count, first * bits - low * 8)


def unpack_bits(data, bits: int, count: int, skip: int) -> np.ndarray:
    """``count`` ids of ``bits`` bits each, after ``skip`` bits of the bytes."""
    raw = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")
    planes = raw[skip:skip + count * bits].reshape(count, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


@dataclass
class LibraryTokenizer:
    """A tokenizer of the ``tokenizers`` library, as its JSON text, and the pattern of its pre-tokenizer.

    With no normalizer and a byte-level pre-tokenizer that only splits, a text's ids are those of its pre-tokens
    side by side. The texts of a batch are then split with numpy and their distinct pre-tokens found with Arrow; those
    that are not remembered are given to the library, each once, and remembered while there is room. Those that are a
    space and letters are given side by side, as one text of many, and its ids are dealt out by the bytes that each
    stands for. A text is cut
    at the tokenizer's added tokens first; if these take in text around them or can overlap, a text that holds one is
    given to the library whole. Any other tokenizer is given whole texts. With ``added_tokens=False`` special tokens in
    a text are plain text.
    """

    json: str
    pattern: str
    added_tokens: bool = True

    def size(self) -> int:
        return self._library().get_vocab_size(with_added_tokens=True)

    def _library(self):
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(self.json)
        if not self.added_tokens:
            t.encode_special_tokens = True
        return t

    def _ready(self) -> None:
        import json
        t, spec = self._library(), json.loads(self.json)
        pre = spec["pre_tokenizer"] or {}
        self.by_word = not spec["normalizer"] and not spec["post_processor"] and pre.get("type") == "ByteLevel" \
            and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and self.pattern == BYTE_LEVEL
        many = getattr(t, "encode_batch_fast", t.encode_batch)
        self.whole = lambda text: t.encode(text, add_special_tokens=False).ids
        self.many = lambda texts: (e.ids for low in range(0, len(texts), TEXTS_AT_ONCE)
                                   for e in many(texts[low:low + TEXTS_AT_ONCE], add_special_tokens=False))
        self.memo: dict[str, bytes] = {}
        size = t.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(t.id_to_token(i) or "") for i in range(size)]) if self.by_word else None
        added = [a for a in spec.get("added_tokens") or [] if a["content"] and (self.added_tokens or not a["special"])]
        self.cut = re.compile("(" + "|".join(re.escape(a["content"]) for a in added) + ")") if added else None
        self.cut_alone = len(added) == 1 and not any(added[0].get(k) for k in ("single_word", "lstrip", "rstrip"))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text as int32; about ``POINTS_AT_ONCE`` code points are split at a time."""
        if "memo" not in self.__dict__:
            self._ready()
        out, low, held = [], 0, 0
        for high, text in enumerate(texts, 1):
            held += len(text)
            if held >= POINTS_AT_ONCE or high == len(texts):
                out += self._encode_some(texts[low:high])
                low, held = high, 0
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        any_held = self.cut is not None and self.cut.search("".join(texts))
        held = [bool(any_held and self.cut.search(text)) for text in texts]
        whole = [not self.by_word or h and not self.cut_alone for h in held]
        pieces = [[] if w else self.cut.split(text) if h else [text] for text, h, w in zip(texts, held, whole)]
        ids, ends = self._by_word([p for ps in pieces for p in ps], [i % 2 == 1 for ps in pieces for i in range(len(ps))])
        cuts = ends[np.cumsum([0, *map(len, pieces)])].tolist()
        return [np.array(self.whole(text), dtype="<i4") if w else ids[a:b]
                for text, w, a, b in zip(texts, whole, cuts, cuts[1:])]

    def _by_word(self, pieces: list[str], added: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces side by side, and where each piece begins and the last one ends; an added token is a word."""
        text = "".join(pieces)
        if not text:
            return np.zeros(0, dtype="<i4"), np.zeros(len(pieces) + 1, dtype=np.int64)
        data = text.encode()
        points = np.frombuffer(data, dtype=np.uint8) if len(data) == len(text) else \
            np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        bounds = np.cumsum([0, *map(len, pieces)])
        first = np.zeros(len(points), dtype=bool)
        first[bounds[bounds < len(points)]] = True
        start = starts(points, first)
        for k in np.flatnonzero(added).tolist():
            start[bounds[k] + 1:bounds[k + 1]] = False
        at = np.flatnonzero(start)
        of_pieces = np.searchsorted(at, bounds)
        if len(data) > len(text):
            at = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[at]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = list(map(self.memo.get, distinct))
        if None in made:
            new = self._learn({w for w, ids in zip(distinct, made) if ids is None})
            made = [new[w] if ids is None else ids for w, ids in zip(distinct, made)]
        made = pa.array(made, pa.large_binary()).take(words.indices)
        _, ends, data = made.buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(made) + 1) // 4
        return np.frombuffer(data, dtype="<i4", count=int(ends[-1])), ends[of_pieces]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Pre-token -> its ids as little-endian int32 bytes, by the library."""
        beside = [w for w in words if w[:1] == " " and w[1:].isalpha()]
        alone = list(words.difference(beside))
        groups = [beside[i:i + WORDS_BESIDE] for i in range(0, len(beside), WORDS_BESIDE)]
        texts = ["".join(g) for g in groups]
        new: dict[str, bytes] = {}
        for group, text, ids in zip(groups, texts, self.many(texts)):
            ids = np.array(ids, dtype="<i4")
            ends = np.cumsum(self.bytes_of[ids])
            of_words = np.cumsum([len(w.encode()) for w in group])
            cuts = np.searchsorted(ends, of_words) + 1
            if self.cut is not None and self.cut.search(text) or len(ends) < cuts[-1] or (ends[cuts - 1] != of_words).any():
                alone += group  # not the ids of these words side by side
                continue
            data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            new.update((w, data[a:b]) for w, a, b in zip(group, cuts, cuts[1:]))
        new.update((w, np.array(ids, dtype="<i4").tobytes()) for w, ids in zip(alone, self.many(alone)))
        room = REMEMBERED - len(self.memo)
        self.memo.update(islice(new.items(), max(0, room)))
        return new

    def __getstate__(self):
        return {"json": self.json, "pattern": self.pattern, "added_tokens": self.added_tokens}


def shard_bounds(df: DataFrame, doc_id: str, text: str, shard_text_bytes: int) -> np.ndarray:
    """First doc_id of every shard but the first: quantiles of doc_id, one per ``shard_text_bytes`` of text.

    The driver gets one number per shard; which rows a shard holds depends only on these.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_text_bytes))
    if shards == 1:
        return np.zeros(0, dtype=np.int64)
    cuts = [i / shards for i in range(1, shards)]
    found = df.agg(F.percentile_approx(doc_id, cuts, F.lit(10_000 + 10 * shards)).alias("b")).first()["b"] or []
    return np.unique(np.array(found, dtype=np.int64))


def write(df: DataFrame, path: str, tokenizer: LibraryTokenizer, doc_id: str = "doc_id", text: str = "text",
          end_id: int | None = 0, shard_text_bytes: int = SHARD_TEXT_BYTES) -> None:
    """Encode the whole ``text`` of every row and write the ids to files under ``path``, by ascending doc_id.

    Null texts count as empty; ``end_id`` is appended to every document. Null ids come first. Rows with the same
    doc_id stay apart, ordered by their ids' bytes. An empty table writes an empty folder. Each row's ids cross one
    shuffle, bit-packed; a task sorts and writes one shard. Spark's committer publishes the files, so a lost task
    leaves nothing behind.
    """
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    bounds = shard_bounds(rows, "doc_id", "text", shard_text_bytes)
    bits = bits_for(tokenizer.size())
    shared = df.sparkSession.sparkContext.broadcast((tokenizer, bounds))
    tail = np.array([] if end_id is None else [end_id], dtype="<i4")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads hold memory each
        own, first_ids = shared.value
        for batch in sliced(batches):
            ids = [np.concatenate([made, tail]) for made in own.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            known = pc.fill_null(batch.column(0), 0).to_numpy()
            shard = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), 0,
                             np.searchsorted(first_ids, known, side="right"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([pack(i, bits) for i in ids], pa.binary())], names=["shard", "doc_id", "n", "packed"])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in sliced(batches):
            for shard, doc, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or out.shard != shard:
                    if out:
                        yield _frames(out.close())
                    out = _Shard(shard, bits)
                out.add(doc, unpack(data, bits, n))
            if out and out.frames:
                yield _frames(out.take())
        if out:
            yield _frames(out.close())

    parts = rows.mapInArrow(encoded, "shard int, doc_id long, n long, packed binary") \
        .repartitionById(len(bounds) + 1, F.col("shard")) \
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "packed")
    frames = parts.mapInArrow(framed, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


class _Shard:
    """Frames of one shard, made as its documents arrive."""

    def __init__(self, shard: int, bits: int):
        self.shard, self.bits = shard, bits
        self.frames: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.position = self.bytes = self.n_docs = self.seq = 0
        self.docs: list[tuple[int, int, int]] = []
        self.offsets: list[int] = []

    def _frame(self, kind: int, first: int, count: int, bits: int, payload: bytes) -> None:
        head = np.array([MAGIC, kind, self.shard, self.seq, first, count, bits, len(payload)], dtype="<i8")
        self.frames.append(head.tobytes() + payload)
        self.seq += 1
        self.bytes += HEADER * 8 + len(payload) + 1

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc is None, doc or 0, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._blocks(BLOCK_IDS)
        if len(self.docs) == BLOCK_DOCS:
            self._documents()

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        at = 0
        while len(ids) - at >= max(1, least):
            block = ids[at:at + BLOCK_IDS]
            self.offsets.append(self.bytes)
            self._frame(IDS, self.position, len(block), self.bits, pack(block, self.bits))
            self.position += len(block)
            at += len(block)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def _documents(self) -> None:
        self._frame(DOCS, self.n_docs, len(self.docs), 64, np.array(self.docs, dtype="<i8").tobytes())
        self.n_docs += len(self.docs)
        self.docs = []

    def take(self) -> list[bytes]:
        out, self.frames = self.frames, []
        return out

    def close(self) -> list[bytes]:
        self._blocks(1)
        if self.docs:
            self._documents()
        self._frame(END, self.position, len(self.offsets), 64, np.array([*self.offsets, self.bytes], dtype="<i8").tobytes())
        return self.take()


def _frames(frames: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def shards_in(data) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int]]]]:
    """(shard, offset of its first frame, documents (is null, doc_id, n), ids frames (offset, count, bits))."""
    at, view, base, docs, blocks = 0, memoryview(data), None, [], []
    while at < len(view):
        magic, kind, shard, _, _, count, bits, size = np.frombuffer(view, dtype="<i8", count=HEADER, offset=at).tolist()
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        base, body = at if base is None else base, at + HEADER * 8
        if kind == DOCS:
            docs.append(np.frombuffer(view, dtype="<i8", count=3 * count, offset=body).reshape(count, 3))
        elif kind == IDS:
            blocks.append((body, count, bits))
        at = body + size + 1
        if kind == END:
            yield shard, base, np.concatenate(docs) if docs else np.zeros((0, 3), dtype=np.int64), blocks
            base, docs, blocks = None, [], []


def read_span(data, blocks: list[tuple[int, int, int]], first: int, count: int) -> np.ndarray:
    """Ids ``first`` .. ``first + count`` of a shard; only the blocks that hold them are unpacked."""
    parts = []
    while count > 0:
        body, size, bits = blocks[first // BLOCK_IDS]
        skip = first % BLOCK_IDS
        n = min(count, size - skip)
        parts.append(unpack(memoryview(data)[body:], bits, n, skip))
        first, count = first + n, count - n
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of a dataset: shard, doc_id, shard_start, n_tokens, and ``ids`` (array<long>) or ``ids_crc32``.

    With ``ids=False`` the ids stay in the task that unpacked them, and their unsigned CRC-32 as little-endian
    unsigned 32-bit integers is returned. A task holds one file: the shards of one writing task.
    """
    from zlib import crc32

    value = ("ids", "array<long>") if ids else ("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                buffer = data.as_buffer()
                for shard, _, docs, blocks in shards_in(buffer):
                    starts = np.cumsum(docs[:, 2]) - docs[:, 2]
                    for low in range(0, len(docs), BLOCK_DOCS):
                        part, first = docs[low:low + BLOCK_DOCS], starts[low:low + BLOCK_DOCS]
                        spans = (read_span(buffer, blocks, int(a), int(n)) for a, n in zip(first, part[:, 2]))
                        got = [s.astype(np.int64) for s in spans] if ids else \
                            [crc32(s.astype("<u4").tobytes()) for s in spans]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), shard, dtype=np.int32)),
                             pa.array(part[:, 1], pa.int64(), mask=part[:, 0] == 1), pa.array(first, pa.int64()),
                             pa.array(part[:, 2], pa.int64()),
                             pa.array(got, pa.list_(pa.int64()) if ids else pa.int64())],
                            names=["shard", "doc_id", "shard_start", "n_tokens", value[0]])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, f"shard int, doc_id long, shard_start long, n_tokens long, {value[0]} {value[1]}")


def _bytes_at(stream, at: int, count: int) -> bytes:
    """``count`` bytes of an open file from byte ``at``."""
    stream.seek(at)
    return bytes(stream.readNBytes(count))


def lookup(spark: SparkSession, path: str, shard: int, first: int, count: int) -> list[int]:
    """Random access: ``count`` ids of one shard from position ``first``. One file is opened, and of it only the end, the
    block offsets, and the headers and bytes of the blocks that hold these ids are read. IndexError beyond the shard's ids.
    """
    folder, fs = hadoop(spark, path)
    files = [] if count < 0 or first < 0 else fs.globStatus(hadoop(spark, f"{path}/part-{shard:05d}-*")[0])
    if not files:
        raise IndexError(f"no shard {shard} in {path}")
    stream, size = fs.open(files[0].getPath()), files[0].getLen()
    try:
        ints = lambda at, n: np.frombuffer(_bytes_at(stream, at, 8 * n), dtype="<i8")
        end = int(ints(size - 9, 1)[0])  # the END frame's own offset, before the newline byte
        _, kind, own, _, ids, blocks, _, _ = ints(end, HEADER).tolist()
        if kind != END or own != shard or first + count > ids:
            raise IndexError(f"no ids {first} to {first + count} in shard {shard}")
        parts, left = [], count
        while left:
            block, skip = divmod(first, BLOCK_IDS)
            at = int(ints(end + 8 * (HEADER + block), 1)[0])
            _, _, _, _, _, held, bits, _ = ints(at, HEADER).tolist()
            n = min(left, held - skip)
            low, high = skip * bits // 8, -(-(skip + n) * bits // 8)
            data = _bytes_at(stream, at + 8 * HEADER + low, high - low)
            parts.append(unpack_bits(data, bits, n, skip * bits - low * 8))
            first, left = first + n, left - n
    finally:
        stream.close()
    return np.concatenate(parts).tolist() if parts else []


def global_starts(docs: DataFrame) -> DataFrame:
    """``docs`` of ``read`` with ``start``: the ids of all documents before each one, over the whole dataset."""
    docs = stored(docs, "token-docs")
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = offsets(totals, [], [F.col("shard")], "n", "base").select("shard", "base")
    return docs.join(base, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def write_and_read(df: DataFrame, tokenizer: LibraryTokenizer, **options) -> DataFrame:
    """Write a dataset to a fresh shared folder and return its documents with global starts and checksums."""
    path = new_path(df.sparkSession, "tokens")
    write(df, path, tokenizer, **options)
    return global_starts(read(df.sparkSession, path, ids=False))
