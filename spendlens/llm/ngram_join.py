"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets of the texts (equal sets share a row, named by a 64-bit digest);
columns are n-grams. Two rows link when the overlap reaches the threshold of the union. The product is not formed
in full: only columns, and in them only pairs, count that can still reach the overlap that the sizes ask for.

1. One pass over the texts writes each text's row and set size, and a sketch of how often every n-gram occurs in all
   texts. Within a row, columns are put in one global order, rarest first (estimate, then hash).
2. A row of n entries that links at all shares one of its first n - ceil(t n) + 1 columns with the other row, so only
   these are shuffled, blocked by column; a column seen in one row falls out within its block. Columns that the
   sketch calls very frequent are split by row into several blocks, and keep entries that are alone in theirs.
   Columns with the same rows become one *list* with their number as its weight: the columns of a copied passage, or of
   a pair of copies, are many, and differ in nothing.
3. Step 1 also makes a fixed-width bitmap of each row, in which every entry flips a bit. Two rows differ in at least as many
   entries as their bitmaps in bits, which bounds the overlap from above: rows that merely share a passage fall out before
   a pair exists. A row without any partner that sizes and bitmaps let link leaves all lists; the rows that stay are made
   once more, from one text each, and kept.
4. Contraction: in some rounds each component of the rows linked so far tests one pair, its best (later: a random) one
   within the bounds with a component that comes earlier in the round's order. A group of copies is joined by about as
   many tests as rows. Lists whose rows are in one component are done.
5. The product over what is left: blocks of each list that still holds two components, against blocks of the same list,
   give the pairs of rows in different components within the bounds, with the list's weight. Weights are summed up over
   all blocks to the overlap in the first columns of both rows; with the most that the other columns can add, pairs below
   the size-derived overlap are discarded, and the rest is counted over the whole rows.

Steps 4 and 5 need no pair inside a component: it changes no component. No row, column or pair is dropped for its size.
A list of more than ``BLOCK`` rows is dealt to blocks by row, so no task holds a list that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .bpe import sliced
from .graph import components
from .wordhash import NON_SPACE, grams, mix, words
from .work import broadcast_up_to, drop, store, stored

WORDS = 5
THRESHOLD = (75, 100)
TEXTS_A_BATCH = 256
SPLIT_ROWS = 1 << 20
FREQUENCY_BITS = 21
#: Rows of a list that one block holds, and bits of a row's bitmap.
BLOCK = 2048
BITMAP = 1024
#: Rounds of contraction: at most so many, and none after one that links less than this share of the first one's.
ROUNDS, LEAST_SHARE = 12, 0.005
#: Tables of a few integers a row are broadcast up to so many rows, and shuffled beyond.
MOST_BROADCAST = 200_000
_AT_ONCE = 1 << 21
PAIRS_HELD = 1 << 20


def gram_set(text, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of the whole text; none without words."""
    return np.unique(grams(words(text, NON_SPACE), n))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def text_key(raw) -> int:
    return xxhash.xxh3_64_intdigest(raw or b"") - (1 << 63)


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, np.ndarray, int]]:
    for i, text in enumerate(batch.column(column)):
        own = gram_set(text.as_buffer(), n)
        yield i, own, set_key(own)


def _rows_and_sketch(texts: DataFrame, n: int) -> DataFrame:
    """doc_id, n, key and text key of every text, bitmaps of rows that a task meets for the first time, and, in rows of their
    own, slices of the tasks' sketches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.Counts(FREQUENCY_BITS), set()
        for batch in sliced(batches):
            sizes, keys, held, raw, bits = [], [], [], [text_key(t.as_buffer()) for t in batch.column(1)], []
            for _, own, key in _sets(batch, 1, n):
                sizes.append(len(own))
                keys.append(key if len(own) else None)
                bits.append(bitmap(own) if len(own) and key not in seen else None)
                if key not in seen:
                    seen.add(key)
                    held.append(own)
            if held:
                counts.add(np.concatenate(held))
            none = [None] * len(keys)
            yield _batch(batch.column(0), sizes, keys, raw, bits, none, none)
        part = counts.slices()
        none = [None] * len(part)
        yield _batch(none, none, none, none, none, [i for i, _ in part], [c for _, c in part])

    return texts.mapInArrow(run, "doc_id long, n long, key long, text_key long, bits binary, slice int, counts binary")


def _batch(doc_id, n, key, raw, bits, part, counts) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip((doc_id, n, key, raw, bits, part, counts), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "key", "text_key", "bits", "slice", "counts"])


def _postings(texts: DataFrame, n: int, frequency: np.ndarray, t: tuple[int, int]) -> DataFrame:
    """(gram, salt, key, n, rest) of the first entries of every row that a task meets for the first time.

    Salt 0 is that of columns in one block; the blocks of a split column are numbered from 1.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen, held = shared.value, set(), []
        for batch in sliced(batches):
            for _, own, key in _sets(batch, 1, n):
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                size = len(own)
                estimate = often[sketch.cells(own, often.size.bit_length() - 1)]
                first = np.argsort(estimate, kind="stable")[:size - -(-size * t[0] // t[1]) + 1]
                blocks = 1 + estimate[first].astype(np.int64) // SPLIT_ROWS
                salt = np.where(blocks > 1, 1 + np.mod(np.int64(key), blocks), 0)
                held.append((own[first].view(np.int64), salt, np.full(len(first), key), np.full(len(first), size),
                             size - np.arange(len(first))))
                if len(held) == TEXTS_A_BATCH:
                    yield _columns(held)
                    held = []
        if held:
            yield _columns(held)

    def _columns(parts: list) -> pa.RecordBatch:
        gram, salt, key, size, rest = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        sizes = (size << 32) | rest
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(salt.astype(np.int32)), pa.array(key),
                                           pa.array(sizes)], names=["gram", "salt", "key", "sizes"])

    return texts.mapInArrow(run, "gram long, salt int, key long, sizes long")


def _shared_columns(postings: DataFrame, with_salt: bool = False) -> DataFrame:
    """The entries of columns that hold two rows or more, and all of split columns; blocks stream through, sorted by column."""
    names = ["gram", "key", "n", "rest"] + ["salt"] * with_salt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)
        before = None  # the column of the entry before the held one
        for batch in batches:
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            rows = np.concatenate([held, rows])
            if len(rows) > 1:
                rows = rows[np.concatenate([[True], (rows[1:, [0, 2]] != rows[:-1, [0, 2]]).any(axis=1)])]
            same = rows[1:, 0] == rows[:-1, 0]
            as_before = np.concatenate([[before is not None and rows[0, 0] == before], same]) if len(rows) else same
            keep = as_before.copy()
            keep[:-1] |= same
            out = rows[:-1][keep[:-1] | (rows[:-1, 1] != 0)]
            if len(rows) > 1:
                before = rows[-2, 0]
            held = rows[-1:]
            yield _entries(out)
        if len(held) and (held[0, 1] != 0 or before is not None and held[0, 0] == before):
            yield _entries(held)

    def _entries(rows: np.ndarray) -> pa.RecordBatch:
        columns = [rows[:, 0], rows[:, 2], rows[:, 3] >> 32, rows[:, 3] & 0xFFFFFFFF, rows[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns[:len(names)]], names=names)

    return postings.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _lists(entries: DataFrame) -> DataFrame:
    """(list, key, n, rest, w) of entries that stream through sorted by column: columns with the same rows become a list,
    w of them, with the largest ``rest`` of each row. A list's number is made of its keys; equal numbers of different
    lists, which do not happen, would make their union. A split column, seen in parts, is a list of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            done = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []  # the last column may go on
            if len(done):
                yield named([h[:done[-1] + 1] for h in held])
                held = [h[done[-1] + 1:] for h in held]
        if len(held[0]):
            yield named(held)

    def named(columns: list[np.ndarray]) -> pa.RecordBatch:
        gram, key, n, rest, salt = columns
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        of_column = mix(np.add.reduceat(mix(key.view(np.uint64)), starts))
        number = np.repeat(of_column, np.diff(np.append(starts, len(gram))))
        number = np.where(salt != 0, mix(gram.view(np.uint64)), number)
        return pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(key), pa.array(n), pa.array(rest)],
                                          names=["list", "key", "n", "rest"])

    return entries.mapInArrow(run, "list long, key long, n long, rest long").groupBy("list", "key") \
        .agg(F.max("n").alias("n"), F.max("rest").alias("rest"), F.count("*").alias("w"))


def bitmap(own: np.ndarray) -> bytes:
    """``BITMAP`` bits; every entry of the row flips one."""
    cells = (mix(own) >> np.uint64(65 - BITMAP.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def _pick(doc_ids: pa.Array, text_keys: np.ndarray) -> np.ndarray:
    """A digest of id and text; a null id counts as 0."""
    return mix(text_keys.view(np.uint64) ^ mix(doc_ids.fill_null(0).to_numpy().view(np.uint64))).view(np.int64)


def _kept_sets(texts: DataFrame, rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(key, grams) of every row of a list, made of the row of ``texts`` of least text key and id that has it (more than once
    only where that is repeated); most other texts are only digested.
    """
    keys = stored(members.select("key").distinct(), "keys")

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pick(batch.column(0), batch.column(1).to_numpy()))], names=["pick"])

    one = rows.where("key is not null").join(keys, "key", "left_semi") \
        .groupBy("key").agg(F.min(F.struct("text_key", "doc_id")).alias("one"))
    one = stored(one.select("key", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("t")), "picked")
    picked = one.select("id", "t").mapInArrow(picks, "pick long")
    wanted = texts.sparkSession.sparkContext.broadcast(np.packbits(sketch.of_column(picked, "pick") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, held = np.unpackbits(wanted.value), set(), []
        for batch in sliced(batches):
            buffers, ids = [text.as_buffer() for text in batch.column(1)], batch.column(0).to_pylist()
            text_keys = np.array([text_key(raw) for raw in buffers], dtype=np.int64)
            digests = _pick(batch.column(0), text_keys)
            for i in np.flatnonzero(bits[sketch.cells(digests.view(np.uint64))]):
                if digests[i] in seen:
                    continue
                seen.add(digests[i])
                own = gram_set(buffers[i], n)
                if len(own):
                    held.append((set_key(own), ids[i], int(text_keys[i]), own))
                if len(held) == TEXTS_A_BATCH:
                    yield _keyed(held)
                    held = []
        if held:
            yield _keyed(held)

    def _keyed(found: list) -> pa.RecordBatch:
        key, doc_id, text, own = zip(*found)
        cuts = np.concatenate([[0], np.cumsum([len(g) for g in own])]).astype(np.int32)
        grams_of = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(own).view(np.int64)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, doc_id, text)), grams_of],
                                          names=["k", "doc_id", "text_key", "grams"])

    made = texts.mapInArrow(run, "k long, doc_id long, text_key long, grams array<long>")
    same = (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("t"))
    kept = stored(made.join(broadcast_up_to(one, MOST_BROADCAST), same).select("key", "grams"), "kept")
    wanted.destroy()
    return kept


def _blocked(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """Members with their bitmap, their component (their own yet) and ``parts``, the blocks that their list is dealt to."""
    large = stored(lists.groupBy("list").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "large")
    return lists.join(large, "list", "left") \
        .withColumn("parts", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("long")).drop("m") \
        .join(bits, "key").withColumn("root", F.col("key"))


_BLOCK_COLUMNS = ["list", "block", "side", "key", "root", "n", "rest", "w"]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Whole blocks, some at a time: integer columns by name, bitmaps, and the end of the block of each row."""
    held, bits = [np.zeros(0, dtype=np.int64)] * len(_BLOCK_COLUMNS), np.zeros((0, BITMAP // 64), dtype=np.uint64)

    def blocks(high: int):
        cut = (held[0][1:high] != held[0][:high - 1]) | (held[1][1:high] != held[1][:high - 1])
        ends = np.append(np.flatnonzero(cut) + 1, high)
        return dict(zip(_BLOCK_COLUMNS, (h[:high] for h in held))), bits[:high], np.repeat(ends, np.diff(ends, prepend=0))

    for batch in batches:
        own = np.frombuffer(b"".join(batch.column(len(held)).to_pylist()), dtype=np.uint64).reshape(-1, BITMAP // 64)
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
        bits = np.concatenate([bits, own])
        done = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
        if len(done):  # the last block may go on
            yield blocks(done[-1] + 1)
            held, bits = [h[done[-1] + 1:] for h in held], bits[done[-1] + 1:]
    if len(held[0]):
        yield blocks(len(held[0]))


def _pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of a block, for rows whose block ends at ``end``, about ``_AT_ONCE`` words of bitmaps at a time."""
    at, held, n = np.arange(len(end)), [], 0
    for d in range(1, int((end - at).max(initial=0))):
        i = np.flatnonzero(at + d < end)
        held.append((i, i + d))
        n += len(i)
        if n * (BITMAP // 64) >= _AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _may_link(rows: dict[str, np.ndarray], bits: np.ndarray, end: np.ndarray,
              t: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits), i < j, of rows of a block in different components that sizes and bitmaps let link.

    Sets of sizes a and b that link differ in (a + b)(1 - t)/(1 + t) entries at most.
    """
    n, root = rows["n"], rows["root"]
    for i, j in _pairs(end):
        may = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * t[1] >= np.maximum(n[i], n[j]) * t[0])
        i, j = i[may], j[may]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = differ * (t[0] + t[1]) <= (n[i] + n[j]) * (t[1] - t[0])
        yield i[ok], j[ok], differ[ok]


def _partnered(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(key) of the rows that have a partner in a list which sizes and bitmaps let link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bits, end in _by_block(batches):
            some = np.zeros(len(end), dtype=bool)
            for i, j, _ in _may_link(rows, bits, end, t):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(rows["key"][some]))], names=["key"])

    return _blocks_of(members, _beside()).mapInArrow(run, "key long").distinct()


def _tests(members: DataFrame, turn: int, t: tuple[int, int]) -> DataFrame:
    """At most one row (r, hub, a, b) per component r: a pair of its row b and row a of component ``hub``, which comes
    before r in an order that each turn draws anew. The best pair in the first turn, any one later.
    """
    names = ["r", "score", "hub", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bits, end in _by_block(batches):
            key, root, n, rest = (rows[c] for c in ("key", "root", "n", "rest"))
            order = mix(root.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            found = [np.zeros((0, len(names)), dtype=np.int64)]
            for i, j, differ in _may_link(rows, bits, end, t):
                ok = np.minimum(rest[i], rest[j]) * (t[0] + t[1]) >= (n[i] + n[j]) * t[0]
                i, j, differ = i[ok], j[ok], differ[ok]
                later = np.where(order[i] > order[j], i, j)
                hub = i + j - later
                score = (differ << 20) // (n[i] + n[j]) if turn == 0 else \
                    (mix(key[later].view(np.uint64) ^ order[hub]) >> np.uint64(2)).view(np.int64)
                found.append(np.column_stack([root[later], score, root[hub], key[hub], key[later]]))
                if sum(map(len, found)) > PAIRS_HELD:
                    found = [_first_of_each(np.concatenate(found))]
            best = _first_of_each(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in best.T], names=names)

    one = F.array(F.struct(F.pmod(F.xxhash64("key", F.lit(turn)), "parts").alias("block"), F.lit(0).alias("side")))
    best = _blocks_of(members, one).mapInArrow(run, ", ".join(f"{c} long" for c in names)) \
        .groupBy("r").agg(F.min(F.struct("score", "hub", "a", "b")).alias("best"))
    return best.select("r", "best.hub", "best.a", "best.b")


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """The least row for each value of the first column."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])] if len(rows) else rows


def _beside() -> Column:
    """Every block of a list against every block of it: (block, side), side 0 where both are the same."""
    own, parts = F.pmod(F.xxhash64("key"), F.col("parts")), F.col("parts")
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(
        (F.least(p, own) * parts + F.greatest(p, own)).alias("block"),
        F.when(p == own, 0).when(own < p, 1).otherwise(2).alias("side")))


def _products(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b, w) for every block of a list against every block of it: the pairs of rows in different components that sizes
    and bitmaps let link, with the weights of the lists that a task has met them in, up to ``PAIRS_HELD`` pairs at a time.

    Lists go to tasks by their least key, so those of one group of copies, which share most of their pairs, meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for rows, bits, end in _by_block(batches):
            key, side, w = rows["key"], rows["side"], rows["w"]
            for i, j, _ in _may_link(rows, bits, end, t):
                once = (side[i] == 0) & (side[j] == 0) | (side[i] + side[j] == 3)
                i, j = i[once], j[once]
                held.append((np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.maximum(w[i], w[j])))
                n_held += len(i)
                if n_held >= PAIRS_HELD:
                    held = [summed(held)]
                    if 2 * len(held[0][0]) >= PAIRS_HELD:
                        yield batch_of(held.pop())
                    n_held = len(held[0][0]) if held else 0
        if held:
            yield batch_of(summed(held))

    def summed(parts: list) -> tuple:
        a, b, w = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
        return a[new], b[new], np.add.reduceat(w, new) if len(a) else w

    def batch_of(columns: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "w"])

    anchors = stored(members.groupBy("list").agg(F.min("key").alias("anchor")), "anchors")
    return _blocks_of(members.join(anchors, "list"), _beside(), "anchor").mapInArrow(run, "a long, b long, w long")


def _blocks_of(members: DataFrame, deal: Column, by: str = "list") -> DataFrame:
    """Members dealt to blocks by ``deal`` (an array of structs block, side), the rows of a block one after the other in the
    task that column ``by`` and the block lead to.
    """
    dealt = members.withColumn("_to", F.explode(deal)).select(
        F.col(by).alias("by"), "list", F.col("_to.block").cast("long").alias("block"), F.col("_to.side").cast("long").alias("side"),
        "key", "root", "n", "rest", "w", "bits")
    return dealt.repartition("by", "block").sortWithinPartitions("list", "block").drop("by")


def _linked(pairs: DataFrame, kept: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs whose whole rows overlap enough, with all their columns; only the rows of pairs are shuffled."""
    sides = stored(pairs.withColumn("key", F.explode(F.array("a", "b"))), "sides")
    of = lambda side: F.min(F.when(F.col("key") == F.col(side), F.col("grams")))  # noqa: E731  a repeated row has equal grams
    both = kept.join(broadcast_up_to(sides, MOST_BROADCAST), "key").groupBy(*pairs.columns).agg(of("a").alias("ga"), of("b").alias("gb"))
    counted = both.withColumn("common", F.size(F.array_intersect("ga", "gb")).cast("long")) \
        .withColumn("union", F.size("ga") + F.size("gb") - F.col("common"))
    return counted.where(F.col("common") * t[1] >= F.col("union") * t[0]).select(*pairs.columns)


def _reachable(products: DataFrame, members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose overlap in the first columns of both, summed over blocks, and the most that other columns can
    add, reach the bound. A common column that is not among the first of both lies in the tail of one of them.
    """
    sums = products.groupBy("a", "b").agg(F.sum("w").alias("w"))
    sizes = members.select("key", "n").distinct()
    both = sums.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a") \
        .join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    tail = f"(({{0}} * {t[0]} + {t[1] - 1}) div {t[1]} - 1)"  # all but the first n - ceil(t n) + 1
    return both.where(f"(w + greatest({tail.format('na')}, {tail.format('nb')})) * {t[0] + t[1]} >= (na + nb) * {t[0]}") \
        .select("a", "b")


def similar_sets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS,
                 threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n and key of every input row, and the links (a, b) between keys that joined components.

    Links hold at least a spanning set of every component of the full join; each one is exact. Null and empty texts
    and texts without words have key null and link with nothing; so do no rows of an empty table. Repeated rows and
    repeated ids stay, one output row each.
    """
    texts = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    both = stored(_rows_and_sketch(texts, n), "sets")
    rows = both.where("slice is null").select("doc_id", "n", "key", "text_key")
    frequency = sketch.total(both.where("slice is not null"), FREQUENCY_BITS)
    blocks = _postings(texts, n, frequency, threshold).repartition("gram", "salt") \
        .sortWithinPartitions("gram", "salt", "key")
    lists = stored(_lists(_shared_columns(blocks, with_salt=True)), "lists")
    bits = stored(both.where("bits is not null").select("key", "bits").dropDuplicates(["key"]), "bits")
    some = stored(_partnered(_blocked(lists, bits), threshold), "partnered")
    members, path = store(_open(_blocked(lists.join(some, "key", "left_semi"), bits)), "members")
    kept = _kept_sets(texts, rows, members, n)
    links, most = [], 0
    for turn in range(ROUNDS):
        pairs = stored(_tests(members, turn, threshold), "pairs")
        found = stored(_linked(pairs, kept, threshold), "links")
        links.append(found.select("a", "b"))
        n_found = found.count()
        if not n_found:
            break
        most = max(most, n_found)
        parents = _jump(found.select(F.col("r").alias("child"), F.col("hub").alias("parent")))
        now, now_path = store(_open(_moved(members, stored(parents, "parents"))), "members")
        drop(texts.sparkSession, path)
        members, path = now, now_path
        if n_found < LEAST_SHARE * most:
            break
    pairs = stored(_reachable(_products(members, threshold), members, threshold), "pairs")
    links.append(_linked(pairs, kept, threshold))
    return rows.drop("text_key"), stored(reduce(DataFrame.union, links), "links")


def _moved(members: DataFrame, parents: DataFrame) -> DataFrame:
    """Members with the components that ``parents`` lead them to."""
    return members.join(parents, F.col("root") == F.col("child"), "left") \
        .withColumn("root", F.coalesce("parent", "root")).select(*members.columns)


def _open(members: DataFrame) -> DataFrame:
    """The members of lists that hold two components or more."""
    mixed = members.groupBy("list").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("list")
    return members.join(stored(mixed, "mixed"), "list", "left_semi")


def _jump(parents: DataFrame, times: int = 3) -> DataFrame:
    """(child, parent) with every pointer led on up to 2^times steps; a pointer that ends earlier stays at its end.

    Pointers go to components that come earlier in the turn's order, so they have no cycles.
    """
    for _ in range(times):
        parents = stored(parents, "parents")
        up = parents.select(F.col("child").alias("c"), F.col("parent").alias("p"))
        parents = parents.join(up, F.col("parent") == F.col("c"), "left") \
            .select("child", F.coalesce("p", "parent").alias("parent"))
    return parents


def near_duplicate_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS,
                          threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, key and component_id (smallest doc_id that links reach, its own included) of every row.

    A row without words stands alone. Null ids are never the smallest; a component of null ids only has none.
    """
    rows, links = similar_sets(df, text, doc_id, n, threshold)
    least = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("own"))
    named = least.join(components(links).withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("own").alias("component_id"))
    of_key = named.join(smallest, "root").select("key", "component_id")
    return rows.join(of_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "key",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
