"""A training-corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark decontamination, token ids.

Each stage works on all rows that the one before it kept and is written as Parquet to the session's shared folder.
All stages but the last return the columns of ``documents``. A null text is an empty text to every stage, and a row
with one is kept; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bpe, decontaminate, ngram_join, toxicity
from spendlens.llm.queries import TOXIC, byte_bpe, table
from spendlens.llm.work import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below ``TOXIC``, by a classifier learnt from ``labels`` and these rows."""
    classifier = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), classifier).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram Jaccard links join: that of the smallest doc_id.

    Rows without words are no copies of each other and stay. Repeated rows with the smallest id are one row; rows
    whose component has no id stay.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.near_duplicate_groups(rows.withColumn("doc_id", F.col("_row")))
    kept = groups.where("key is null").select(F.col("doc_id").alias("_kept"))
    first = groups.where("key is not null").join(rows.select("_row", F.col("doc_id").alias("own")),
                                                 F.col("doc_id") == F.col("_row")) \
        .groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("own").isNull(), "own", "_row")).alias("_kept"))
    return rows.join(kept.union(first.select("_kept")), F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in 13-word windows of ``benchmark``."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where(decontaminate.is_contaminated()).select("key").distinct()
    with_key = decontaminate.with_key(docs.select(*COLUMNS))
    return with_key.join(bad, "key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of the whole text in the public byte-level vocabulary."""
    ids = bpe.encode(docs, byte_bpe(), keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("byte_bpe", encode)]

#: SQL cannot express the classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
