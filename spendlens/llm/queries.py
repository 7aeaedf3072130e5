"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, clusters, decontaminate, fim, fingerprints, licences, ngram_join, sharding, simhash, token_files,
               toxicity, warc)
from .work import new_path, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> bpe.Vocabulary:
    """The public byte-level vocabulary of ranks; ``path`` names another rank file."""
    import public_tokenizers
    return bpe.Vocabulary.from_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def library_tokenizer(path: str | None = None, added_tokens: bool = False) -> token_files.LibraryTokenizer:
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_files.LibraryTokenizer(f.read(), public_tokenizers.PATTERN, added_tokens)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.pages(warc.read(spark, path))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), byte_bpe()
    ids = bpe.encode(docs, vocabulary, keep=["doc_id"])
    back = bpe.decode(ids, vocabulary, keep=["doc_id", "ids"])
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_files.write_and_read(table(spark, sf_dir, "documents"), library_tokenizer(added_tokens=True))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


TOXIC = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train_on_labels(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next_text(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text"))) \
        .withColumn("fingerprint", fingerprints.root(F.col("text"))) \
        .withColumn("edited_fingerprint", fingerprints.root(F.col("edited"))) \
        .withColumn("next_fingerprint", fingerprints.root(F.col("next_text"))) \
        .withColumn("edited_leaves", fingerprints.leaves(F.col("edited")))
    near = lambda other: fingerprints.likeness(F.col("fingerprint"), F.col("leaves"), F.col(f"{other}_fingerprint"),
                                               F.col(f"{other}_leaves"))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       near("edited").alias("near_edited"), near("next").alias("near_next"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every row, the columns of its SQL; ``op9_licence_matches`` has all matches."""
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "licence", "dice", "part")


def op9_licence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # explode_outer: for explode, Spark makes a filter that repeats the whole expression of ``matches`` below it
    found = licences.scan(table(spark, sf_dir, "documents")).select("doc_id", F.explode_outer("matches").alias("m"))
    return found.where("m is not null").select("doc_id", "m.licence", "m.dice", "m.part")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.restored(fim.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_licence_scan": op9_licence_scan,
    "op9_licence_matches": op9_licence_matches,
    "op10_sharding": op10_sharding,
    "op11_clusters": op11_clusters,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash": op13_simhash,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _licence_sql() -> str:
    """Lines, sentences and windows of words as ``licences.scan`` has them, by joins of bigrams; the best match of a row."""
    known = [(name, grams) for name, t in licences.NOTICES if (grams := licences.template_bigrams(t))]
    reach = licences.THRESHOLD / (2 - licences.THRESHOLD)
    rows = ",\n    ".join(f"({k}, '{name}', {int(len(g) / reach + 1e-9)}, {g!r})" for k, (name, g) in enumerate(known))
    dice = "2.0::DOUBLE * len(list_intersect({0}, t.grams)) / (len({0}) + len(t.grams))"
    lower = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
    grams = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
    covers = "m.licence = w.licence AND m.dice >= w.dice AND contains(' ' || m.words || ' ', ' ' || w.words || ' ')"
    return f"""
WITH t(k, licence, most, grams) AS (VALUES
    {rows}),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
p AS (
  SELECT doc_id, line AS part FROM l
  UNION SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))) FROM l
),
g AS (
  SELECT doc_id, part, array_to_string(ws, ' ') AS words, list_distinct({grams}) AS own
  FROM (SELECT doc_id, part, {lower.format('part')} AS ws FROM p) WHERE len(ws) > 1
),
found AS (
  SELECT DISTINCT doc_id, licence, part, words, dice
  FROM (SELECT *, {dice.format('g.own')} AS dice FROM g CROSS JOIN t) WHERE dice >= {licences.THRESHOLD}
),
d AS (SELECT doc_id, ws, {grams} AS ps FROM (SELECT DISTINCT doc_id, {lower.format("coalesce(text, '')")} AS ws FROM documents)),
h AS (
  SELECT doc_id, ws, ps, k, i FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM d)
  JOIN (SELECT k, unnest(grams) AS gram FROM t) ON gram = ps[i]
),
s AS (
  SELECT a.doc_id, a.k, t.licence, a.i, b.i AS j, array_to_string(a.ws[a.i:b.i + 1], ' ') AS words,
         {dice.format('list_distinct(a.ps[a.i:b.i])')} AS dice
  FROM h a JOIN h b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.k = a.k AND b.ws = a.ws AND b.i >= a.i JOIN t ON t.k = a.k
  WHERE b.i - a.i < t.most
),
f AS (
  SELECT * FROM s WHERE dice >= {licences.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, k, i ORDER BY dice DESC, j) = 1
),
wide AS (
  SELECT DISTINCT doc_id, licence, words AS part, words, dice FROM f w
  WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id IS NOT DISTINCT FROM w.doc_id AND o.k = w.k AND o.i <= w.j AND o.j >= w.i
                    AND (o.dice, -o.i, -o.j) > (w.dice, -w.i, -w.j))
),
every AS (
  SELECT * FROM found
  UNION ALL SELECT * FROM wide w
  WHERE NOT EXISTS (SELECT 1 FROM found m WHERE m.doc_id IS NOT DISTINCT FROM w.doc_id AND {covers})
    AND NOT EXISTS (SELECT 1 FROM wide m WHERE m.doc_id IS NOT DISTINCT FROM w.doc_id AND m.words <> w.words AND {covers})
),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence, part) AS r FROM every)
SELECT d.doc_id, b.licence, coalesce(b.dice, 0.0) AS dice, b.part
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1"""


def _root_sql(text: str) -> str:
    return (f"sha256(array_to_string(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: "
            f"sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ','))), ','))")


def _near_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}_pieces, {b}_pieces))"
    return (f"CASE WHEN {a}_text = {b}_text THEN 1.0 ELSE coalesce({common} / "
            f"nullif(CAST(len({a}_pieces) + len({b}_pieces) - {common} AS DOUBLE), 0), 0.0) END")


_PIECES = "[^.!?\\n]{1,48}[.!?\\n]*|[.!?\\n]+"



def _clusters_sql() -> str:
    """Every round spelled out: a<t> assigns to the centroids c<t>, whose floored means are c<t + 1>."""
    def assigned(t: int) -> str:
        return f"""a{t} AS MATERIALIZED (
  SELECT r, x, min(struct_pack(d := CAST(list_sum(list_transform(range(1, {clusters.DIMS + 1}),
                                                                   lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT), c := c)) AS best
  FROM v CROSS JOIN c{t} GROUP BY r, x
)"""

    steps = []
    for t in range(clusters.ROUNDS):
        steps.append(f"""{assigned(t)},
s{t} AS (
  SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{t}, range(1, {clusters.DIMS + 1}) t(i) GROUP BY ALL
),
m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m{t}.m, c{t}.m) AS m FROM c{t} LEFT JOIN m{t} USING (c))""")
    last = clusters.ROUNDS
    return f"""
WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({clusters.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {clusters.DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id) NULLS LAST, x) AS r FROM k),
c0 AS MATERIALIZED (SELECT r - 1 AS c, x AS m FROM v WHERE r <= {clusters.K}),
{", ".join(steps)},
{assigned(last)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{last}.m, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} ON c{last}.c = a{last}.best.c"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (
  SELECT body, max(page_id) AS first_id FROM p WHERE octet_length(body) >= 1000 GROUP BY body HAVING count(*) > 1
)
SELECT p.page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN g.first_id IS DISTINCT FROM p.page_id AND g.first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first_id IS DISTINCT FROM p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON g.body = p.body""",
    "op5_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS own_text FROM documents),
n AS (
  SELECT *, coalesce(lead(own_text) OVER (ORDER BY doc_id DESC), first_value(own_text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM d
),
e AS (
  SELECT *, left(own_text, length(own_text) - length(own_text) // 3) || left(next_text, length(own_text) // 3) AS edited_text
  FROM n
),
p AS (
  SELECT *, list_distinct(regexp_extract_all(own_text, '{_PIECES}')) AS own_pieces,
         list_distinct(regexp_extract_all(next_text, '{_PIECES}')) AS next_pieces,
         list_distinct(regexp_extract_all(edited_text, '{_PIECES}')) AS edited_pieces FROM e
)
SELECT doc_id, CAST(length(own_text) AS BIGINT) AS n_chars, sha256(edited_text) AS edited_sha256,
       {_root_sql('own_text')} AS fingerprint, {_root_sql('edited_text')} AS edited_fingerprint,
       CAST({_near_sql('own', 'edited')} AS DOUBLE) AS near_edited, CAST({_near_sql('own', 'next')} AS DOUBLE) AS near_next
FROM p""",
    "op11_clusters": _clusters_sql(),
    "op12_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS whole, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents
),
u AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS c2,
         whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>')
         OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 100 AS is_plain,
         CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 AS suffix_first
  FROM d
),
p AS (
  SELECT *, coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS pre,
         coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS mid,
         coalesce(array_to_string(units[greatest(c1, c2) + 1:], ''), '') AS suf
  FROM u
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN is_plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT is_plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT is_plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN is_plain THEN whole WHEN suffix_first THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                   ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM p""",
    "op8_chat_format": f"""
WITH l AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id
),
proper AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM l) x),
m AS (SELECT min(conv_id) AS conv_id, turns FROM l GROUP BY turns),
b AS (
  SELECT conv_id, part, turns[part * {chat.BLOCK} + 1:(part + 1) * {chat.BLOCK}] AS turns
  FROM (SELECT *, unnest(range((len(turns) - 1) // {chat.BLOCK} + 1)) AS part
        FROM m WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.turns = m.turns))
)
SELECT conv_id, part, CAST(len(turns) AS BIGINT) AS n_turns,
       array_to_string(list_transform(turns, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '')
                                                 || '<|end|>' || chr(10)), '') AS rendered
FROM b""",
    "op9_licence_scan": _licence_sql(),
    "op6_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams
  FROM w
),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON c.a = s.doc_id""",
    "op7_decontaminate": f"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM benchmark
),
il AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM iw WHERE len(ws) > 0),
ig AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(ws) - size + 2),
                                                       lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS gram
  FROM il
),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws
  FROM documents
),
dg AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos,
         unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS gram
  FROM dw CROSS JOIN (SELECT DISTINCT size FROM ig) z WHERE len(ws) >= size
),
m AS (SELECT dg.doc_id, dg.pos, dg.size, ig.item_id FROM dg JOIN ig ON ig.gram = dg.gram AND ig.size = dg.size),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS p FROM m) x GROUP BY doc_id
),
n AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) x GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN n ON n.doc_id = dw.doc_id""",
}
