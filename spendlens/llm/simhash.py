"""SimHash fingerprints and their components within a Hamming radius, searched in BK-trees.

1. One pass makes a 64-bit fingerprint per text. Equal fingerprints become one row, so a group of copies costs one row
   per task from then on, whatever its size.
2. Two fingerprints within the radius r are equal in at least one of any r + 1 runs of bits (only r bits differ). So
   each distinct fingerprint goes to r + 1 shards, named by a run and its bits, and a shard with more than ``SHARD``
   of them is dealt again by r + 1 runs of its other bits, and so on: the same argument holds within it. After a few
   steps every shard is small, because too few bits are left for more different fingerprints. No shard is cut off.
3. A task builds one BK-tree per shard: a child hangs below its parent by its integer Hamming distance to it. A search
   at distance d from a node follows only the edges d - r to d + r. The trees of an Arrow batch of shards are built and
   searched level by level with numpy. What leaves a shard is a star per component found, not its pairs.
4. The stars of all shards are put together by alternating large and small stars.

A tree serves the queries of its own shard, in the task that holds it. To broadcast the trees of all shards would carry
every fingerprint through the driver, which has no size bound; only a step's bit masks are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import sliced
from .graph import components
from .work import stored

WORDS, SEED, RADIUS = 3, 42, 3
SHARD = 1024
PIECE = 1 << 18
FRONTIER = 1 << 20
#: A fingerprint that holds at least one row in so many is joined by broadcast: there are at most so many of them.
HOT_SHARE = 1000
_BITS = 64
_EDGE = _BITS + 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ----------------------------------------------------------------- fingerprints

def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of the text, by pieces of about ``PIECE`` bytes that end between words."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words joined by one space."""
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprint(text, n: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 where more than half of the text's shingle hashes have it set; repeats count. 0 without words."""
    ones, total, held = np.zeros(_BITS, dtype=np.int64), 0, []
    for words in _word_lists(bytes(text or b"")):
        held += words
        if len(held) >= n:
            hashes = _hashes(held, n, seed)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
                .sum(axis=0, dtype=np.int64)
            total += len(hashes)
            held = held[len(held) - n + 1:]
    if not total and held:
        return xxhash.xxh64_intdigest(b" ".join(held), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS,
                      seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [fingerprint(t.as_buffer(), n, seed) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, dtype=np.uint64).view(np.int64))],
                                             names=["doc_id", "fp"])

    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ----------------------------------------------------------------------- shards

def signed(mask: int) -> int:
    return mask - (1 << _BITS) if mask >> (_BITS - 1) else mask


def deeper(mask: int, radius: int) -> list[int]:
    """``mask`` with each of radius + 1 runs of the bits that it leaves out; a signed integer, as in Spark."""
    free = [i for i in range(_BITS) if not mask >> i & 1]
    return [signed((mask % (1 << _BITS)) | sum(1 << int(i) for i in run)) for run in np.array_split(free, radius + 1)]


def shards(fps: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """(fps): arrays of distinct fingerprints, ``most`` or fewer each (or 1,024, if that is more), so that any two
    within the radius share an array. ``fps`` holds distinct fingerprints in column fp.
    """
    spark, closed = fps.sparkSession, []
    left, masks = fps.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    while masks:
        steps = [(m, d) for m in masks for d in deeper(m, radius)]
        rows = left.join(F.broadcast(spark.createDataFrame(steps, "mask long, deeper long")), "mask") \
            .select(F.col("deeper").alias("mask"), F.col("fp").bitwiseAND(F.col("deeper")).alias("bits"), "fp")
        if len({d for _, d in steps}) < len(steps):  # two masks lead to one
            rows = rows.distinct()
        sizes = stored(rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        small = (F.col("n") <= most) | (F.bit_count("mask") >= _BITS - 10)  # 2^10 are left at most
        placed = rows.join(sizes, ["mask", "bits"])
        closed.append(placed.where(small).groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps")).select("fps"))
        masks = [r["mask"] for r in sizes.where(~small).select("mask").distinct().collect()]
        left = stored(placed.where(~small).select("fp", "mask"), "open") if masks else None
    return reduce(DataFrame.union, closed)


# --------------------------------------------------------------------- BK-trees

class Forest:
    """One BK-tree per group of fingerprints; groups lie one after the other and a group's first is its root.

    An edge is the number parent * 65 + distance; edges are sorted, with the child of each.
    """

    def __init__(self, fps: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(sizes) - sizes
        self.fps, self.root = fps, np.repeat(first, sizes)
        self.group_size = np.repeat(sizes, sizes)
        edges, children = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        rest = np.flatnonzero(self.root != np.arange(len(fps)))
        at = self.root[rest]
        while len(rest):
            edge, chosen, of = np.unique(at * _EDGE + self.distance(rest, at), return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(rest[chosen])
            down = np.ones(len(rest), dtype=bool)
            down[chosen] = False
            rest, at = rest[down], rest[chosen][of][down]
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).astype(np.int64)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most ``radius`` apart, level by level, of queries in their own group's tree."""
        q, node = queries, self.root[queries]
        while len(q):
            d = self.distance(q, node)
            yield q[d <= radius], node[d <= radius]
            low = np.searchsorted(self.edges, node * _EDGE + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, node * _EDGE + np.minimum(d + radius, _BITS), side="right")
            n = high - low
            within_run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), self.children[np.repeat(low, n) + within_run]

    def components(self, radius: int) -> np.ndarray:
        """The first fingerprint of its component for every one, components within groups."""
        label = np.arange(len(self.fps))
        cost = np.cumsum(self.group_size)   # a query may visit its whole tree
        cuts = np.searchsorted(cost, np.arange(FRONTIER, cost[-1] + FRONTIER, FRONTIER), side="right") if len(cost) else []
        low = 0
        for high in [*cuts, len(label)]:
            high = max(high, min(low + 1, len(label)))
            for a, b in self.within(np.arange(low, high), radius):
                _merge(label, a, b)
            low = high
        return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; labels are first members and stay so."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if len(a):
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]


def links(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each fingerprint of a shard beside the first one of its component there, if that is another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            forest = Forest(lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64))
            label = forest.components(radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            fps = forest.fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS, seed: int = SEED,
                    radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach, its own included) per row.

    Texts without words, empty and null ones have fingerprint zero and link like any other. Repeated rows and repeated
    ids stay, one output row each. Null ids are never the smallest; a component of null ids only has none. Other columns
    of ``df`` are not read; an empty table gives an empty result.
    """
    rows = stored(with_fingerprints(df, text, doc_id, n, seed), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprints")
    found = stored(links(shards(fps, radius), radius), "links")
    named = stored(fps.join(components(found).withColumnRenamed("node", "fp"), "fp", "left")
                   .withColumn("root", F.coalesce("root", "fp")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stored(named.join(smallest, "root").select("fp", "copies", "component_id"), "components")
    total = of_fp.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = of_fp.where(F.col("copies") * HOT_SHARE >= total)
    marked = rows.join(F.broadcast(hot.select("fp", F.lit(True).alias("hot"), "component_id")), "fp", "left")
    rest = marked.where("hot is null").select("doc_id", "fp").join(of_fp.where(F.col("copies") * HOT_SHARE < total), "fp")
    return marked.where("hot").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id")) \
        .select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
