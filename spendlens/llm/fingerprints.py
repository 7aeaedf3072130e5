"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text, in DataFrame functions only.

A text is cut at blank lines into sections and at line ends into paragraphs; joining them again gives the text. A
paragraph's node is its SHA-256, a section's node hashes those of its paragraphs, and the root, the fingerprint,
hashes those of the sections: equal texts have equal roots, and differing branches locate an edit. Under a paragraph,
pieces of a sentence of at most 48 characters are its leaves; the likeness of two fingerprints is the Jaccard
similarity of their sets of leaves, 1 for equal roots.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION, PARAGRAPH = "\n\n", "\n"
PIECES = r"[^.!?\n]{1,48}[.!?\n]*|[.!?\n]+"
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 10_000


def paragraph_hashes(text: Column) -> Column:
    """array<array<string>>: the node of every paragraph, by section."""
    return F.transform(F.split(text, SECTION, -1),
                       lambda s: F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(p, 256)))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda p: F.sha2(F.concat_ws(",", p), 256))


def root(text: Column) -> Column:
    """The fingerprint of a text; a null text has that of an empty one."""
    return F.sha2(F.concat_ws(",", section_hashes(paragraph_hashes(F.coalesce(text, F.lit(""))))), 256)


def leaves(text: Column) -> Column:
    """The distinct 64-bit hashes of a text's leaves; none for a null or empty text."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), 0)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """0 to 1: shared leaves among all leaves of two trees."""
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, F.lit(1.0)) \
        .otherwise(F.coalesce(F.try_divide(common, F.size(leaves_a) + F.size(leaves_b) - common), F.lit(0.0)))


def differing_branches(text_a: Column, text_b: Column) -> Column:
    """array<struct<section, paragraph>>, from 0: the paragraphs at which two trees differ, absent ones included.

    Only sections whose nodes differ are descended into; equal texts give an empty array.
    """
    a, b = (paragraph_hashes(F.coalesce(t, F.lit(""))) for t in (text_a, text_b))
    none = F.array().cast("array<string>")

    def differ(section: Column) -> Column:
        pa, pb = F.coalesce(F.get(a, section), none), F.coalesce(F.get(b, section), none)
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(pa), F.size(pb)) - 1),
                          lambda i: ~F.get(pa, i).eqNullSafe(F.get(pb, i)))
        return F.when(pa == pb, F.array().cast("array<struct<section: int, paragraph: int>>")).otherwise(
            F.transform(places, lambda i: F.struct(section.alias("section"), i.alias("paragraph"))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), differ))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``df`` and ``out``; a column of that name is replaced. Repeated and null rows stay."""
    return df.withColumn(out, root(df[text]))


def with_next_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, next_text, leaves, next_leaves): every row with the one after it by descending doc_id.

    The last row is followed by the first one. Null texts count as empty; null ids come last, and rows with one id
    follow each other by text. The ids are cut into buckets at quantiles, one per ``bucket_bytes`` of text; each text
    is shuffled once, to its bucket, and each bucket also gets, as a marked row, the first text of the bucket after it.
    """
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-size // bucket_bytes)))
    bounds: list[int] = []
    if buckets > 1:
        cuts = [i / buckets for i in range(1, buckets)]
        bounds = rows.agg(F.percentile_approx("doc_id", cuts, F.lit(10 * buckets + 10_000))).first()[0] or []
    splits = [float("-inf"), *(sorted({float(b) for b in bounds}) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep")
    # ascending: buckets from the largest ids to the smallest, then the one of null ids
    rows = cut.transform(rows.withColumn("_id", F.col("doc_id").cast("double"))) \
        .withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-F.col("_bucket").cast("int"))) \
        .select("bucket", "doc_id", "text")

    top = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # a row per bucket
    heads = rows.alias("r").join(F.broadcast(top).alias("t"), F.expr("r.bucket = t.bucket AND r.doc_id <=> t.top")) \
        .groupBy("r.bucket").agg(F.min("text").alias("text"))
    in_order = Window.partitionBy().orderBy("bucket")
    after = heads.select("bucket", F.lead("text").over(in_order).alias("lead"),
                         F.first("text").over(in_order).alias("first"))
    marked = after.select("bucket", F.lit(None).cast("long").alias("doc_id"),
                          F.coalesce("lead", "first").alias("text"), F.lit(True).alias("mark"))
    laid = rows.withColumn("mark", F.lit(False)).union(marked).repartition("bucket")
    w = Window.partitionBy("bucket").orderBy("mark", F.col("doc_id").desc_nulls_last(), "text")
    return laid.withColumn("leaves", leaves(F.col("text"))) \
        .select("doc_id", "text", "mark", "leaves", F.lead("text").over(w).alias("next_text"),
                F.lead("leaves").over(w).alias("next_leaves")).where("NOT mark").drop("mark")


def edited_text(text: Column, next_text: Column) -> Column:
    """The text with its last third (rounded down) replaced by as many first characters of the next text."""
    n = F.char_length(text)
    third = (n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))
