"""The n-gram Jaccard join, word hashing, sketches and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import ngram_join, queries, sketch, wordhash
from spendlens.llm.graph import components

SF = "/root/testdata/sf0.01"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(rows):
    """(doc_id, n, component) of (doc_id, text) rows by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def run(df):
    return sorted(map(tuple, ngram_join.near_duplicate_groups(df).select("doc_id", "n_shingles", "component_id")
                      .collect()), key=repr)


def words_of(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("is_word,pattern", [(wordhash.NON_SPACE, rb"[^\x20\x09-\x0D]+"),
                                             (wordhash.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("piece", [8, 64, 1 << 18])
def test_words_in_pieces(monkeypatch, is_word, pattern, piece):
    monkeypatch.setattr(wordhash, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(60):
        text = "".join(rng.choice("aB1é中 \t\n\x0b\x1c._x" + "z" * 9) for _ in range(rng.randrange(300)))
        found = list(re.finditer(pattern, lower(text).encode()))
        hashes, first, last = wordhash.spans(text, is_word)
        assert list(zip(first, last)) == [m.span() for m in found]
        ids = {}
        for m, h in zip(found, hashes.tolist()):
            assert ids.setdefault(m[0], h) == h
        assert len(set(ids.values())) == len(ids)
    long_word = "q" * 1000
    assert wordhash.words(long_word + " " + long_word, is_word).tolist()[0] == wordhash.words("Q" * 1000, is_word)[0]


def test_grams_short_and_empty():
    w = wordhash.words("a b c", wordhash.NON_SPACE)
    assert len(wordhash.grams(w, 5)) == 1 and len(wordhash.grams(w, 2)) == 2 and not len(wordhash.grams(w[:0], 5))
    assert wordhash.grams(w, 5)[0] != wordhash.grams(wordhash.words("a b c d", wordhash.NON_SPACE), 5)[0]


def test_sketch_counts_at_least(spark):
    values = [5] * 300 + list(range(1000))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
    got = sketch.of_column(df, "v")
    at = sketch.cells(np.array([5, 999, 0], dtype=np.int64).view(np.uint64))
    assert got[at[0]] >= 301 and got[at[1]] >= 1 and got.sum() == len(values)
    assert sketch.of_column(df.limit(0), "v").sum() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(900, 950)] + [(7, 7), (500, 501), (501, 500)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(201)} | {i: 900 for i in range(900, 950)} | {1000: 900, 500: 500, 501: 500}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_of_documents(spark):
    docs = queries.table(spark, SF, "documents")
    want = groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, queries.op6_ngram_jaccard(spark, SF).collect()), key=repr) == want


def test_near_copies_common_passage_and_odd_rows(spark):
    rng = random.Random(11)
    rows, passage = [], words_of(rng, 60)
    base = words_of(rng, 80)
    for _ in range(150):  # near-copies of one text, some of them far from its first one
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
        rows.append(" ".join(copy))
    rows += [" ".join(words_of(rng, rng.randrange(2, 40)) + passage) for _ in range(120)]
    chain = words_of(rng, 60)
    for i in range(12):  # each links with the next, not with the last
        rows.append(" ".join(chain))
        chain = chain[3:] + words_of(rng, 3)
    rows += ["Same Text here", "same text HERE", "same text", "", None, " \n\t ", "one", "ONE", "é É", "É é"]
    rows += [" ".join(words_of(rng, 20_000))] * 2
    numbered = [(i * 3 % 1009, t) for i, t in enumerate(rows)] + [(None, "one"), (4, "one"), (4, "one"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in numbered], "doc_id long, text string, key int, component_id int")
    assert run(df.repartition(7)) == groups(numbered)
    assert run(df.limit(0)) == []


@pytest.mark.parametrize("block, rounds", [(7, 6), (7, 0), (2048, 0), (50, 1)])
def test_lists_in_blocks_with_and_without_contraction(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(block + rounds)
    passage, base, rows = words_of(rng, 50), words_of(rng, 70), []
    for _ in range(60):  # near-copies, also of each other, and texts that share a passage and little else
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
        rows.append(" ".join(copy))
        rows.append(" ".join([*words_of(rng, rng.randrange(0, 30)), *passage]))
    numbered = list(enumerate(rows))
    assert run(spark.createDataFrame(numbered, "doc_id long, text string").repartition(5)) == groups(numbered)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 6000).astype(np.uint64)
    for _ in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 3000))) for _ in range(2))
        differ = np.bitwise_count(np.frombuffer(ngram_join.bitmap(a), np.uint64) ^ np.frombuffer(ngram_join.bitmap(b), np.uint64))
        assert differ.sum() <= len(np.setxor1d(a, b))
    assert len(ngram_join.bitmap(pool)) * 8 == ngram_join.BITMAP


def test_columns_with_the_same_rows_are_one_list(spark):
    entries = [(g, k, 9, 5 + g % 2, 0) for g in (1, 2, 3, 4) for k in (7, 8)] + [(5, 7, 9, 9, 0), (5, 9, 9, 9, 0)] + \
        [(6, 7, 9, 4, 1)]
    df = spark.createDataFrame(entries, "gram long, key long, n long, rest long, salt long").coalesce(1) \
        .sortWithinPartitions("gram", "salt", "key")
    by_list = {}
    for r in ngram_join._lists(df).collect():
        by_list.setdefault(r["list"], []).append((r["key"], r["n"], r["rest"], r["w"]))
    assert sorted(sorted(v) for v in by_list.values()) == [[(7, 9, 4, 1)], [(7, 9, 6, 4), (8, 9, 6, 4)], [(7, 9, 9, 1), (9, 9, 9, 1)]]


def test_columns_split_into_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = words_of(rng, 30)
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(30)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = df.select("doc_id", "text")
    often = np.full(1 << 10, 5 * ngram_join.SPLIT_ROWS)
    split = ngram_join._postings(texts, 5, often, ngram_join.THRESHOLD)
    assert split.select("salt").distinct().count() == 6
    whole = ngram_join._postings(texts, 5, np.zeros(1 << 10, dtype=np.int64), ngram_join.THRESHOLD)

    def shared(p):
        p = p.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "key")
        found = ngram_join._shared_columns(p)
        return {tuple(r) for r in found.join(found.groupBy("gram").count().where("count > 1"), "gram", "left_semi").collect()}

    assert shared(split) == shared(whole)


def test_near_copies_in_different_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPLIT_ROWS", 1)
    rng, rows = random.Random(6), []
    for i in range(24):
        base = words_of(rng, 8, 10 ** 6)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, f"z{i}"]))]
    keys = [ngram_join.set_key(ngram_join.gram_set(pa.scalar(t).as_buffer(), 5)) for _, t in rows]
    assert any((a % 3 == 0) != (b % 3 == 0) for a, b in zip(keys[::2], keys[1::2]))
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    often = np.full(1 << 10, 2)  # two rows in every column: three blocks
    p = ngram_join._postings(texts, 5, often, ngram_join.THRESHOLD).repartition(64, "gram", "salt")
    found = ngram_join._shared_columns(p.sortWithinPartitions("gram", "salt", "key")).select("gram", "key").collect()
    columns = [{r.gram for r in found if r.key == k} for k in keys]
    assert all(a & b for a, b in zip(columns[::2], columns[1::2]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=14), min_size=1, max_size=25))
def test_random_small_alphabets(texts):
    from spendlens.session import get_session
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(get_session().createDataFrame(rows, "doc_id long, text string")) == groups(rows)
