"""Fingerprints, sharding, chat formatting and licence scans: hand-made rows and brute force."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from spendlens.llm import chat, fingerprints, licences, queries, sharding

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, [name], verbose=False)[name][0] is True


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(text):
    return sha(",".join(sha(",".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def test_fingerprint_tree(spark):
    texts = ["", "a", "a\nb", "a\n\nb", "a\n\n\nb", "\n", "\n\n", "x" * 500, "é中😀\n\nz", None]
    df = spark.createDataFrame([(t, "old") for t in texts], "text string, fingerprint string")
    got = [r.fingerprint for r in fingerprints.fingerprints(df).collect()]
    assert got == [merkle(t or "") for t in texts] and len(set(got)) == len(set(t or "" for t in texts))
    assert fingerprints.fingerprints(df).columns == df.columns


def test_differing_branches(spark):
    cases = [("a\nb\n\nc\nd", "a\nX\n\nc\nd", [(0, 1)]), ("a\n\nb", "a", [(1, 0)]), ("a", "a", []), (None, "", []),
             ("a\nb", "a\nb\nc", [(0, 2)]), ("a\n\nb\n\nc", "z\n\nb\n\ny\nw", [(0, 0), (2, 0), (2, 1)])]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = df.select(fingerprints.differing_branches(F.col("a"), F.col("b")).alias("d")).collect()
    assert [[(x.section, x.paragraph) for x in r.d] for r in got] == [w for _, _, w in cases]


@pytest.mark.parametrize("bucket_bytes", [1, 400, 1 << 24])
def test_next_text_in_buckets(spark, bucket_bytes):
    rng = random.Random(1)
    rows = [(rng.randrange(40), "t%d" % rng.randrange(9) * rng.randrange(6)) for _ in range(120)]
    rows += [(None, "null id"), (None, "another"), (3, None), (-5, "least"), (2 ** 60, "big"), (2 ** 60 + 1, "bigger")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted([(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)], key=repr)
    got = fingerprints.with_next_text(df, bucket_bytes=bucket_bytes).select("doc_id", "text", "next_text").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert fingerprints.with_next_text(df.limit(0)).collect() == []
    one = fingerprints.with_next_text(df.where("doc_id = -5")).first()
    assert (one.text, one.next_text, sorted(one.leaves)) == ("least", "least", sorted(one.next_leaves))


def test_edits_are_nearer_than_neighbours(spark):
    rows = queries.op5_fingerprints(spark, SF).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def check_shards(rows, texts, shards=8):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def used_shards(rows, texts):
    """Number of shards over which each group of equal texts is laid, by group size."""
    of = defaultdict(set)
    text = dict(texts)
    for r in rows:
        of[text[r.doc_id]].add(r.shard)
    size = Counter(t for _, t in texts)
    return [(size[t], len(s)) for t, s in of.items() if size[t] > 1]


def test_sharding_query(spark):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    rows = queries.op10_sharding(spark, SF).collect()
    check_shards(rows, texts)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    split = used_shards(rows, texts)
    assert sum(n > 1 for _, n in split) <= 0.1 * len(split) + 1


def test_sharding_hot_group(spark):
    rng = random.Random(4)
    texts = ["hot"] * 700 + [f"pair {i // 2}" for i in range(600)] + [f"own {i}" for i in range(777)] + [None] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, node string")
    got = sharding.shard_documents(df).collect()
    check_shards(got, rows)
    split = dict(Counter(used_shards(got, rows)))
    hot = sorted(Counter(r.shard for r in got if texts[r.doc_id] == "hot").values(), reverse=True)
    assert sum(hot[:3]) >= 0.9 * 700
    assert sum(c for (size, n), c in split.items() if n > 1 and size == 2) <= 10


def test_sharding_small_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    got = sharding.shard_documents(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and {r.slot for r in got} == {0}
    assert sharding.shard_documents(df.limit(0)).collect() == []


def test_propagation_of_overlapping_links(spark):
    links = [(a, 1000 * c + a) for c in range(6) for a in range(100 * c, 100 * c + 99)]
    members = [(a, g) for a, g in links] + [(a + 1, g) for a, g in links]  # six chains of 100
    got = dict(map(tuple, sharding.propagate(spark.createDataFrame(members, "node long, group_id long"), [160] * 4).collect()))
    cut = sum(got[a] != got[a + 1] for a, _ in links)
    assert len(got) == 600 and cut < 0.6 * len(links)  # three of four links are cut at random
    assert max(Counter(got.values()).values()) <= 200


def test_chat_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "end")]
    convs = {1: turns[:1], 2: turns[:3], 3: turns, 4: turns, 5: turns[:2] + [("user", "")], 6: [("user", "other")],
             7: [("us", "erhi")], 8: turns[1:], None: turns[:2] + [("user", "null id")]}
    rows = [(c, 2 * i + (c or 0), r, t, 9) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert got[3].rendered == "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns) and got[3].n_turns == 4
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_with_nulls_and_many_turns_equal_the_sql(spark, tmp_path):
    long = [(1, t, "user" if t % 2 else "bot", f"turn {t}") for t in range(2050)]
    rows = long + [(2, *r[1:]) for r in long[:1025]] + [(3, *r[1:]) for r in long] + [
        (4, 1, "user", None), (4, 2, None, "x"), (5, 1, "user", ""), (5, 2, "", "x"), (6, 1, "user", None),
        (7, None, "user", "first"), (7, 1, "bot", "then"), (8, 1, "user", "first"), (8, 2, "bot", "then"),
        (None, 1, "user", "no id"), (None, 2, "bot", None), (9, 1, "user", "no id"), (10, 1, "b", "same"), (10, 1, "a", "same"),
        (10, 1, None, "same"), (11, 3, "é", "漢\n"), (11, 3, "é", "漢\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, queries.op8_chat_format(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op8_chat_format"]).fetchall(), key=repr)
    assert got == want
    assert {(c, p) for c, p, _, _ in got} == {(1, 0), (1, 1), (1, 2), (4, 0), (5, 0), (7, 0), (None, 0), (10, 0), (11, 0)}


def test_chat_blocks_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(8)
    convs, long = {}, [("u", f"m{i}") for i in range(23)]
    for c in range(30):
        convs[c] = long[:rng.randrange(1, 24)] + ([("u", f"fork {c % 4}")] if rng.random() < 0.3 else [])
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    rows += [(40, 5, "a", "x"), (40, 5, "a", "x"), (40, None, "b", "y"), (41, 5, "a", "x"), (41, None, "b", "y")]
    convs |= {40: [("b", "y"), ("a", "x"), ("a", "x")], 41: [("b", "y"), ("a", "x")]}
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kept = {c for c, ts in convs.items()
            if not any(o != c and us[:len(ts)] == ts and (len(us) > len(ts) or o < c) for o, us in convs.items())}
    text = defaultdict(str)
    for r in got.orderBy("conv_id", "part").collect():
        assert r.n_turns <= 4
        text[r.conv_id] += r.rendered
    assert dict(text) == {c: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in convs[c]) for c in kept}


def test_licences(spark):
    apache = licences.TEMPLATES[1][1]
    rows = [(1, "Prose here.\nReleased under the MIT License.\nMore"), (2, "Some words. Licensed under CC BY-NC 4.0. More words."),
            (3, apache.upper()), (4, "licensed under the apache license version 2"), (5, None), (6, ""), (7, "under the of"),
            (8, "word " * 30_000), (9, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, "one")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, licence string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(got) == len(rows)
    assert {d: r.licence for d, r in got.items() if r.licence} == {
        1: "MIT", 2: "CC-BY-NC-4.0", 3: "Apache-2.0", 4: "Apache-2.0", 9: "CC-BY-NC-4.0"}
    assert got[3].dice == 1.0 and 0.8 <= got[4].dice < 1 and got[5].dice == 0.0 and got[1].part == "Released under the MIT License."
    assert licences.scan(df.limit(0)).collect() == []
    assert {r.licence for r in licences.scan(df, templates=[]).collect()} == {None}
    own = licences.scan(df, templates=[("own", "one word only? no: word word word")], threshold=0.3).collect()
    assert {r.doc_id for r in own if r.licence} == {8}


def test_wrapped_notices(spark):
    gpl, bsd, mit = (next(t for n, t in reversed(licences.NOTICES) if n == name) for name in ("GPL-3.0", "BSD", "MIT"))
    wrapped = lambda t, width, mark="": "\n".join(mark + line for line in textwrap.wrap(t, width))
    rows = [(1, "int a;\n" + wrapped(gpl, 72, " * ") + "\nint b;"), (2, wrapped(bsd, 60, "# ") + "\n\n1. Keep it."), (3, mit),
            (4, "Copyright\n\n" + wrapped(mit, 76) + "\n\nThe above"), (5, "It is\nreleased under\nthe MIT License. Yes."),
            (6, "permission is granted\nto any software under\nthe license of a person"), (7, gpl[:90] + "\n" + "word " * 50),
            (8, "\n".join(["Licensed under", "CC BY-NC 4.0."] * 200))]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r.licence, r.dice) for d, r in got.items() if r.licence} == {
        1: ("GPL-3.0", 1.0), 2: ("BSD", 1.0), 3: ("MIT", 1.0), 4: ("MIT", 1.0), 5: ("MIT", 1.0), 8: ("CC-BY-NC-4.0", 1.0)}
    assert got[3].part == mit and got[5].part == "released under the mit license"


def window_matches(text, name, grams, threshold=0.8):
    """The windows of a text that match a template, by trying all: (dice, licence, words) of those that no overlapping beats."""
    ws = re.findall("[a-z0-9]+", text.translate(str.maketrans(licences.UPPER, licences.LOWER)))
    pairs = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    size, own, best = len(grams), set(grams), []
    most = int(size / (threshold / (2 - threshold)) + 1e-9)
    for i, g in enumerate(pairs):
        if g in own:
            found = []
            for j in range(i, min(len(pairs), i + most)):
                window = set(pairs[i:j + 1])
                dice = 2.0 * len(window & own) / (len(window) + size)
                if pairs[j] in own and dice >= threshold:
                    found.append((dice, -i, -j))
            best += [max(found)] if found else []
    kept = [w for w in best if not any(o > w and o[1] >= w[2] and o[2] <= w[1] for o in best)]
    return {(d, name, " ".join(ws[-i:-j + 2])) for d, i, j in kept}


def test_windows_equal_brute_force_and_sql(spark, tmp_path):
    rng, rows = random.Random(8), []
    notices = [t for _, t in licences.NOTICES]
    for i in range(60):
        ws = ["some"] * rng.randrange(4)
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(notices).split(" ")
            for _ in range(rng.randrange(0, 4)):  # words lost, changed and put in
                k = rng.randrange(len(own))
                own[k:k + rng.randrange(2)] = rng.choice([[], ["other"], [own[k], own[k]]])
            ws += own + ["more"] * rng.randrange(3)
        rows.append((i, "".join(w + rng.choice([" ", " ", "  ", "\n", "\n * "]) for w in ws)))
    rows += [(100, None), (101, ""), (102, "\n".join(["Licensed under", "CC BY-NC 4.0."] * 20))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licences.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    known = [(name, licences.template_bigrams(t)) for name, t in licences.NOTICES]
    plain = lambda part: " ".join(re.findall("[a-z0-9]+", part.lower()))
    for i, text in rows:
        found = {(m.dice, m.licence, plain(m.part)) for m in got[i].matches}
        wide = set().union(*(window_matches(text or "", *t) for t in known))
        covered = lambda w, others: any(m[1] == w[1] and m[0] >= w[0] and m != w and f" {w[2]} " in f" {m[2]} "
                                        for m in others)
        assert all(w in found or covered(w, found | wide) for w in wide), (i, wide - found)
        in_lines = {plain(p) for line in (text or "").split("\n") for p in [line, *re.split("(?<=[.!?]) +", line)]}
        assert all(m in wide or m[2] in in_lines for m in found), (i, found - wide)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op9_licence_scan"]).fetchall())
    assert sorted((r.doc_id, r.licence, r.dice, r.part) for r in got.values()) == want


def test_all_licences_of_a_text(spark, tmp_path):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [(9, f"{mit}\n{cc}"), (10, f"{mit}\nNow {cc}"), (11, "None here."), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    every = sorted(map(tuple, queries.op9_licence_matches(spark, str(tmp_path)).collect()))
    assert [r for r in every if r[0] == 9] == [(9, "CC-BY-NC-4.0", 1.0, cc), (9, "MIT", 1.0, mit)]
    assert {r[:2] for r in every} == {(9, "CC-BY-NC-4.0"), (9, "MIT"), (10, "CC-BY-NC-4.0"), (10, "MIT")}
    best = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [m.licence for m in best[9].matches] == ["CC-BY-NC-4.0", "MIT"] and best[11].matches == []
