"""SimHash fingerprints, shards, BK-trees and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.llm import queries, simhash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """Index of the first member of the component of each fingerprint, by all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)), key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, mask int")
    return sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()),
                  key=repr)


def test_spark_hash_is_the_same(spark):
    words = ["", "a b c", "é ü 漢", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBé \t\n\x0b\x1c ", max_size=60), st.integers(1, 9))
def test_fingerprint(text, piece):
    before, simhash.PIECE = simhash.PIECE, piece
    try:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    finally:
        simhash.PIECE = before


def near_group(rng, n, flips, base=None):
    base = rng.getrandbits(64) if base is None else base
    return {base ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, flips)))) for _ in range(n)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 4), st.sampled_from([1 << 20, 50]))
def test_trees_equal_all_pairs(seed, radius, frontier):
    rng = random.Random(seed)
    before, simhash.FRONTIER = simhash.FRONTIER, frontier
    groups = [list(near_group(rng, rng.randint(1, 40), rng.randint(0, 6)) | {rng.getrandbits(64) for _ in range(rng.randint(0, 9))})
              for _ in range(rng.randint(1, 4))]
    try:
        forest = simhash.Forest(np.array(sum(groups, []), dtype=np.uint64), np.array([len(g) for g in groups]))
        label, at = forest.components(radius), 0
    finally:
        simhash.FRONTIER = before
    for g in groups:
        assert [x - at for x in label[at:at + len(g)]] == plain_components(g, radius)
        at += len(g)


def test_an_edge_is_the_distance_to_the_parent_and_others_are_not_followed():
    rng = random.Random(3)
    forest = simhash.Forest(np.array(list({rng.getrandbits(64) for _ in range(3000)}), dtype=np.uint64), np.array([3000]))
    assert len(forest.edges) == 2999 and sorted(forest.children) == list(range(1, 3000))
    assert (forest.distance(forest.edges // 65, forest.children) == forest.edges % 65).all()
    visited, inside = 0, simhash.Forest.distance

    class Counting(simhash.Forest):
        def distance(self, a, b):
            nonlocal visited
            visited += len(a)
            return inside(self, a, b)

    forest.__class__ = Counting
    list(forest.within(np.arange(100), 3))
    assert visited < 0.7 * 100 * 3000


@pytest.mark.parametrize("most", [1024, 60, 4])
def test_shards_hold_every_near_pair(spark, most):
    rng = random.Random(5)
    fps = list(near_group(rng, 1500, 5) | near_group(rng, 60, 3) | {rng.getrandbits(64) for _ in range(500)} | {0, 2**64 - 1})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    met, arrays = set(), [r[0] for r in simhash.shards(df, 3, most).collect()]
    for a in arrays:
        assert len(a) == len(set(a)) <= max(most, 1024)
        met |= {(x, y) for x in a for y in a if x < y and ((x ^ y) % 2**64).bit_count() <= 3}
    all_fps = [simhash.signed(f) for f in fps]
    assert met == {(x, y) for x in all_fps for y in all_fps if x < y and ((x ^ y) % 2**64).bit_count() <= 3}


WORDS = "the a of red green river stone walks over under bright cold seven house"


def corpus(seed):
    rng, words = random.Random(seed), WORDS.split()
    rows, i = [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, "one two"), (None, "one"),
               (None, "only here without an id"), (106, "one"), (106, "one")], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("hot_share", [1000, 4])
def test_components_equal_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(simhash, "HOT_SHARE", hot_share)
    rows = corpus(hot_share) + [(1000 + i, "a copy of one text that many rows hold") for i in range(150)]
    assert result(spark, rows) == expected(rows)


def test_empty_table_and_one_row(spark):
    assert result(spark, []) == []
    assert result(spark, [(7, None)]) == [(7, "0" * 16, 7)]
    assert result(spark, [(None, "x")]) == expected([(None, "x")])


def test_very_long_text(spark):
    text = " ".join(random.Random(1).choices(WORDS.split(), k=300_000)) + " " + "z" * 600_000
    assert result(spark, [(1, text), (2, text.upper())]) == expected([(1, text), (2, text)])


def test_query_on_given_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected(docs)
