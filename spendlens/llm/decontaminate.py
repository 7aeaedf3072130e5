"""Benchmark decontamination by a distributed positional inverted index of the training texts.

1. The occurrences of every test word in all texts are counted.
2. Of each test window (13 consecutive words of an item; a shorter item is one window), the two rarest words are its
   anchors. Windows with a word that no text has are out.
3. The index stores postings (term, text key, position) of the anchor words only; rare words have short lists, so it
   stays small against the texts.
4. Posting lists are intersected after subtracting each anchor's offset in its item: where two anchors of an item give
   the same start, the item may lie there. Each such alignment is then compared word by word with the text, and runs
   of matching words as long as a window are exact phrase matches.

Equal texts share one key (a 64-bit digest) and are searched once. What is broadcast has a fixed size: a bit filter
of words or keys, with exact joins behind it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .bpe import sliced
from .wordhash import ALNUM, words
from .work import stored

WINDOW = 13
ANCHORS = 2
TEXTS_A_BATCH = 512


def text_key(raw) -> int:
    return xxhash.xxh3_64_intdigest(raw or b"") - (1 << 63)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, object, int]]:
    for i, text in enumerate(batch.column(column)):
        raw = text.as_buffer()
        yield i, raw, text_key(raw)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _filter(df: DataFrame, column: str) -> np.ndarray:
    """A bit filter of fixed size that holds every value of a column."""
    return np.packbits(sketch.of_column(df, column) > 0)


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``key``, the digest that names equal texts; a column of that name is replaced."""
    kept = [c for c in df.columns if c != "key"]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = [key for _, _, key in _texts(batch, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*kept, "key"])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("key", T.LongType())])
    return df.select(*kept).mapInArrow(run, schema)


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, words): the word hashes of every distinct row that has an id and at least a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(words(t.as_buffer(), ALNUM)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))],
                                             names=["item_id", "words"])

    rows = items.select(items[item_id].cast("string").alias("item_id"), items[text].alias("text"))
    return rows.where("item_id is not null").distinct().mapInArrow(run, "item_id string, words array<long>") \
        .where("size(words) > 0").withColumn("item", F.monotonically_increasing_id())


def count_terms(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words) of every text, and (term, n) of the ``terms`` that occur, over all distinct texts.

    A copy that another task meets is counted again: the counts order the words, they decide nothing.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(_filter(terms, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, counts = np.unpackbits(wanted.value).astype(bool), {}, Counter()
        for batch in sliced(batches):
            keys, sizes, held = [], [], []
            for _, raw, key in _texts(batch, 1):
                if key not in seen:
                    found = words(raw, ALNUM)
                    seen[key] = len(found)
                    held.append(found[bits[sketch.cells(found)]])
                keys.append(key)
                sizes.append(seen[key])
            if held:
                counts.update(dict(zip(*(x.tolist() for x in np.unique(np.concatenate(held), return_counts=True)))))
            yield _rows(batch.column(0), keys, sizes, [None] * len(keys), [None] * len(keys))
        nothing = [None] * len(counts)
        yield _rows(nothing, nothing, nothing, list(_signed(np.array(list(counts), dtype=np.uint64))),
                    list(counts.values()))

    def _rows(*columns) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_words", "term", "n"])

    both = stored(texts.mapInArrow(run, "doc_id long, key long, n_words long, term long, n long"), "term-counts")
    counts = both.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    return both.where("term is null").select("doc_id", "key", "n_words"), counts.join(terms.distinct(), "term")


def choose_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(item, at, term): the places in an item that are among the rarest words of one of its possible windows."""
    placed = items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term")) \
        .join(counts, "term", "left")
    first = F.greatest(F.lit(0), F.col("at") - window + 1)
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - window))
    in_windows = placed.withColumn("w", F.explode(F.sequence(first, last)))
    by_window = Window.partitionBy("item", "w")
    return in_windows.withColumn("all", F.min(F.coalesce("n", F.lit(0))).over(by_window)).where("all > 0") \
        .withColumn("rank", F.row_number().over(by_window.orderBy("n", "at"))).where(F.col("rank") <= anchors) \
        .select("item", "at", "term").distinct()


def build_index(texts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, key, at) of the given words, or of all words, in every distinct text."""
    wanted = None if terms is None else texts.sparkSession.sparkContext.broadcast(_filter(terms, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, held = None if wanted is None else np.unpackbits(wanted.value).astype(bool), set(), []
        for batch in sliced(batches):
            for _, raw, key in _texts(batch, 1):
                if key in seen:
                    continue
                seen.add(key)
                found = words(raw, ALNUM)
                at = np.arange(len(found)) if bits is None else np.flatnonzero(bits[sketch.cells(found)])
                if len(at):
                    held.append((_signed(found[at]), np.full(len(at), key, dtype=np.int64), at))
                if len(held) == TEXTS_A_BATCH:
                    yield _rows(held)
                    held = []
        if held:
            yield _rows(held)

    def _rows(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                          names=["term", "key", "at"])

    postings = texts.mapInArrow(run, "term long, key long, at long")
    if terms is not None:
        postings = postings.join(terms.distinct(), "term")
    return postings.dropDuplicates(["term", "key", "at"])


def alignments(index: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item, key, start): places in a text where enough anchors of an item agree on the item's first word."""
    need = F.least(F.lit(ANCHORS), F.size("words"))
    found = index.alias("p").join(anchors.alias("a"), "term") \
        .groupBy("item", "key", (F.col("p.at") - F.col("a.at")).alias("start")).agg(F.count("*").alias("n"))
    return found.join(items.select("item", need.alias("need")), "item").where("n >= need").select("item", "key", "start")


def proximity_matches(index: DataFrame, terms: list[int], within: int) -> DataFrame:
    """(key, at) of each occurrence of the rarest of ``terms`` that has all others at most ``within`` words away.

    The index must hold all of ``terms`` (word hashes, signed). Repeated terms count once; none match nothing.
    """
    terms = sorted(set(terms))
    lists = index.where(F.col("term").isin(terms)) if terms else index.limit(0)
    rarest = lists.groupBy("term").agg(F.count("*").alias("n")).orderBy("n", "term").limit(1).select("term")
    first = lists.join(F.broadcast(rarest), "term").select("key", "at")
    near = first.alias("f").join(lists.alias("o"), "key") \
        .where(F.abs(F.col("f.at") - F.col("o.at")) <= within)
    return near.groupBy("key", F.col("f.at").alias("at")).agg(F.countDistinct("o.term").alias("n")) \
        .where(F.col("n") == len(terms)).select("key", "at")


def phrase_matches(texts: DataFrame, items: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n_hit, item_ids, spans) of the texts that hold a window of an item.

    ``spans`` are the runs of hit words (first and last position); ``n_hit`` counts hit words once.
    """
    found = candidates.join(items, "item").groupBy("key") \
        .agg(F.collect_list(F.struct("item_id", "start", "words")).alias("places"))
    wanted = texts.sparkSession.sparkContext.broadcast(_filter(candidates.select("key").distinct(), "key"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen, held = np.unpackbits(wanted.value).astype(bool), set(), []
        for batch in sliced(batches):
            for _, raw, key in _texts(batch, 1):
                if key in seen or not bits[sketch.cells(np.array([key]).view(np.uint64))[0]]:
                    continue
                seen.add(key)
                held.append((key, _signed(words(raw, ALNUM))))
                if len(held) == TEXTS_A_BATCH:
                    yield _keyed(held)
                    held = []
        if held:
            yield _keyed(held)

    def _keyed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()),
                                           pa.array([w for _, w in rows], pa.list_(pa.int64()))],
                                          names=["key", "text_words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                own = batch.column(1)[i].values.to_numpy()
                hit, ids = np.zeros(len(own), dtype=bool), set()
                for place in batch.column(2)[i].values.to_pylist():
                    item = np.array(place["words"], dtype=np.int64)
                    if mark(own, item, place["start"], min(window, len(item)), hit):
                        ids.add(place["item_id"])
                if ids:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
                    rows.append((batch.column(0)[i].as_py(), int(hit.sum()), sorted(ids), spans))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()),
                     pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)],
                                             names=["key", "n_hit", "item_ids", "spans"])

    own = texts.mapInArrow(sequences, "key long, text_words array<long>").dropDuplicates(["key"])
    return own.join(found, "key").select("key", "text_words", "places").mapInArrow(
        compare, "key long, n_hit long, item_ids array<string>, spans array<struct<first: long, last: long>>")


def mark(text: np.ndarray, item: np.ndarray, start: int, least: int, hit: np.ndarray) -> bool:
    """Mark in ``hit`` the runs of ``least`` or more words that agree with the item laid at ``start``."""
    low, high = max(0, start), min(len(text), start + len(item))
    if high - low < least:
        return False
    equal = text[low:high] == item[low - start:high - start]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    any_run = False
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= least:
            hit[low + a:low + b] = any_run = True
    return any_run


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, item_ids (distinct, sorted as strings) and spans of every row of ``docs``.

    Null and empty texts have no words and no hits. Items without an id or a word are left out; repeated items count
    once. Repeated rows and ids stay, one output row each; an empty benchmark hits nothing.
    """
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    items = stored(item_words(benchmark, item_id, item_text), "items")
    rows, counts = count_terms(texts, items.select(F.explode("words").alias("term")).distinct())
    anchors = stored(choose_anchors(items, counts, window), "anchors")
    index = build_index(texts, anchors.select("term").distinct())
    places = stored(alignments(index, items, anchors), "places")
    hits = phrase_matches(texts, items, places, window)
    return rows.join(hits, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<first: long, last: long>>")).alias("spans"))


def is_contaminated(percent: int = 5):
    """The rule over the columns of ``contamination``: at least a hit, and ``percent`` of the words hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
