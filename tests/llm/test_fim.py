"""Fill-in-the-middle against a plain per-text version, and back."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import fim


def expected(doc_id, text, seed=7, rate=100, spm_rate=50):
    """n, form, prefix and middle characters, output of one row."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 5, "x") for i, t in rows],
                               "doc_id long, text string, output string, n int, source string")
    out = fim.restored(fim.fill_in_middle(df, **options)).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored",
                                       "text", "source")) for r in out), key=repr)
    want = sorted(((i, *expected(i, t, **options), t or "", t, "x") for i, t in rows), key=repr)
    assert got == want


EDGES = ["", None, "\n", "\n\n\n", "one line", "one line\n", "a\nb", "a\nb\n", "é\nüß\n漢字\n😀", "x <P> y\nz", "<S>", "<M",
         "<P", "P>\n", "<\nP>", "<P\n>", "a<\n<\n>M>\n", "\r\n\r\n", "a\x00b\n\x00"]


def test_edges_nulls_ties_and_clashing_columns(spark):
    rows = [(i, t) for i in range(12) for t in EDGES] + [(None, "a\nb\nc\n"), (None, None), (3, "a\nb"), (3, "a\nb")]
    check(spark, rows)
    check(spark, rows, seed=11, rate=60, spm_rate=20)
    check(spark, [])


def test_texts_longer_than_a_block(spark):
    rows = [(i, f"{'wörd ' * (i % 9)}{i}\n" * (40_000 * (i % 3))) for i in range(12)]
    assert max(len(t.encode()) for _, t in rows) > 2 * fim.BLOCK
    check(spark, rows)


LINES = st.lists(st.text(alphabet="ab<PSM>é😀\n\r ", max_size=12), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 2**62), LINES), max_size=12), st.integers(1, 40))
def test_batch_equals_plain_version(rows, block):
    import numpy as np
    import pyarrow as pa
    before, fim.BLOCK = fim.BLOCK, block
    try:
        drawn = np.array([[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[8 * j:8 * j + 8], 16) for j in range(4)]
                          for i, _ in rows], dtype=np.int64).reshape(-1, 4)
        data, ends = fim.buffer(pa.array(["skipped", *(t for _, t in rows)]).slice(1))
        n, form, cuts = fim.choose(data, ends, drawn, 100, 50)
        out = fim.arrange(data, ends, form, cuts)
        want = [expected(i, t) for i, t in rows]
        assert [(a, fim.FORMS[f]) for a, f in zip(n, form)] == [w[:2] for w in want]
        assert fim.strings(*out).to_pylist() == [w[4] for w in want]
        prefix, middle = fim.piece_chars(data, ends, cuts)
        assert [(p, m) for p, m, w in zip(prefix, middle, want) if w[1] != "plain"] == \
               [w[2:4] for w in want if w[1] != "plain"]
        back, back_ends, whole = fim.rebuild(*out, form)
        assert whole.all() and fim.strings(back, back_ends).to_pylist() == [t for _, t in rows]
    finally:
        fim.BLOCK = before


def test_broken_outputs_come_back_null(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "<S>b<P>a<M>c"), ("psm", "<P>a<S>b"), ("spm", ""),
            ("psm", "x<P>a<S>b<M>c"), ("plain", "<P>"), ("psm", None), (None, "a"), ("other", "a"),
            ("psm", "<P>a<S>b<S>d<M>c")]
    out = fim.restored(spark.createDataFrame(rows, "form string, output string").coalesce(1)).collect()
    assert [r["restored"] for r in out] == ["acb", "acb", None, None, None, None, "<P>", None, None, None, None]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_given_texts(spark, sf):
    from spendlens.llm import queries
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_fill_in_middle"](spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        n, form, p, m, out = expected(i, text)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
