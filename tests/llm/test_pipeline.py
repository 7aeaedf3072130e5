"""The corpus pipeline stage by stage against brute force, and on odd rows."""


import pytest
import tiktoken

import corpus_pipeline as cp
import public_tokenizers
from spendlens.llm import queries
from test_decontaminate import brute
from test_ngram_join import groups

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    scored = {r.doc_id: r.score for r in queries.op4_toxicity(spark, SF).collect()}
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scored.items() if s < queries.TOXIC}

    own = [(r.doc_id, r.text) for r in kept.collect()]
    single = cp.drop_near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in groups(own)}

    items = queries.table(spark, SF, "benchmark").select("item_id", "text").collect()
    own = [(r.doc_id, r.text) for r in single.collect()]
    clean = cp.drop_contaminated(spark, single, SF)
    assert {r.doc_id for r in clean.collect()} == {d for d, n, h, _, _ in brute(own, items) if not (h and 20 * h >= n)}

    vocabulary = queries.byte_bpe()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks,
                                special_tokens={})
    text = {r.doc_id: r.text for r in clean.collect()}
    out = cp.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(text) and len(out) == len(text)
    assert all(r.ids == library.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_odd_rows(spark, name, stage):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words of no id at all", "en", "s", 1),
            (4, "one two three four five six", "en", "s", 1), (4, "one two three four five six", "en", "s", 1),
            (3, "One two three four five six", "en", "s", 1), (5, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, df, SF)
    ids = sorted((r.doc_id for r in got.collect()), key=repr)
    assert ids == sorted([1, 2, None, 3, 5] if name == "ngram_jaccard" else [r[0] for r in rows], key=repr)
    if name != "byte_bpe":
        assert got.columns == df.columns
    assert stage(spark, df.limit(0), SF).collect() == []
