"""Benchmark decontamination against a search of every window in every text."""

import random
import re

from spendlens.llm import decontaminate, queries, wordhash

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words_of(text)
        if item is not None and w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n, grams in windows.items():
            for i in range(len(w) - n + 1):
                if (ids := grams.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((d, len(w), len(hit), tuple(sorted(found)), tuple(sorted(hit))))
    return sorted(out, key=repr)


def run(docs, items):
    got = decontaminate.contamination(docs, items).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids),
                    tuple(p for s in r.spans for p in range(s.first, s.last + 1))) for r in got), key=repr)


def test_query_equals_brute_force(spark):
    docs, items = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    got = {r.doc_id: r for r in queries.op7_decontaminate(spark, SF).collect()}
    assert len(got) == len(want) and any(n for _, _, n, _, _ in want)
    for d, n_words, n_hit, ids, _ in want:
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items) == (n_words, n_hit, len(ids))
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def test_odd_texts_and_items(spark):
    rng = random.Random(2)
    text = lambda n, size=300: " ".join(f"v{rng.randrange(size)}" for _ in range(n))
    long_item, low = text(60), text(40, 3)
    items = [(1, long_item), (2, "Short ITEM, here"), (3, "word"), (4, None), (5, " .,- "), (None, text(20)), (6, low),
             (1, long_item), (1, text(14)), (7, "é中 ça"), (8, "a " * 30), (9, text(13))]
    docs = [(0, None), (1, ""), (2, "word"), (3, long_item), (4, long_item.upper()), (None, long_item),
            (5, text(50) + " " + " ".join(long_item.split()[20:34]) + " " + text(30)),
            (6, " ".join(long_item.split()[:12])), (7, "x short-item_here y"), (8, "É中 ça é中 ÇA é中 ça"), (9, "a " * 100),
            (9, "a " * 100), (10, low + " " + low), (11, text(20_000) + " " + long_item), (12, " ".join(long_item.split()[::-1])),
            (13, " ".join(long_item.split()[:30] + ["odd"] + long_item.split()[31:]))]
    docs += [(100 + i, text(8) + " " + long_item) for i in range(60)]
    d = spark.createDataFrame([(i, t, 5, "k") for i, t in docs], "doc_id long, text string, n_words int, key string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    assert run(d.repartition(5), b) == brute(docs, items)
    assert run(d.limit(0), b) == []
    assert run(d, b.limit(0)) == brute(docs, [])


def test_random_small_alphabets(spark):
    rng = random.Random(9)
    for size in (2, 4, 12):
        text = lambda n: " ".join(rng.choice("abcdefghijkl"[:size]) for _ in range(n))
        docs = [(i, text(rng.randrange(120))) for i in range(40)]
        items = [(i, text(rng.randrange(1, 30))) for i in range(12)]
        items += [(50 + i, " ".join(t.split()[5:40])) for i, t in docs[:6]]
        assert run(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_proximity(spark):
    texts = [(1, "alpha x x beta x gamma"), (2, "gamma alpha q q q q q beta"), (3, "alpha beta"), (4, "beta GAMMA, alpha alpha")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = decontaminate.build_index(df)
    keys = {decontaminate.text_key(t.encode()): i for i, t in texts}
    term = lambda w: int(wordhash.words(w, wordhash.ALNUM).view("int64")[0])
    terms = [term(w) for w in ("alpha", "beta", "gamma")]
    near = lambda t, k: sorted((keys[r.key], r.at) for r in decontaminate.proximity_matches(index, t, k).collect())
    assert near(terms, 3) == [(4, 1)] and near(terms, 5) == [(1, 5), (4, 1)] and near(terms, 7) == [(1, 5), (2, 0), (4, 1)]
    assert near([], 3) == [] and near([term("nowhere"), terms[0]], 9) == []
