"""WARC archives: records written by Spark's text writer, read back with boundary-chain verification.

A record ends with two line ends, which is the row separator of the writer, so a part file is a WARC file. To read,
files are cut into segments at every "WARC/1." and each segment is a candidate record: its header gives its length,
and so the offset of its successor. A payload may hold that text too, so candidates count only if the chain from the
file's start leads to them: reachable offsets are found by pointer jumping, which doubles every pointer each round
and takes log2(records of a file) rounds over rows of a few integers. Segments off the chain belong to the payload of
the record before them. Large files are split: a task reads a block, and offsets are added up over blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import sliced
from .work import broadcast_up_to, drop, offsets, store, stored

MAGIC = "WARC/1."
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 1000
RECORDS_A_FILE = 50_000
MOST_BROADCAST = 200_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)


def _header(value: Column) -> Column:
    """A header value on one line; a null is empty."""
    one_line = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(one_line, F.lit(""))


def with_revisits(df: DataFrame, page_id: str, payload: str) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the largest page_id of equal payloads, for all but its own rows.

    Digests are grouped, not payloads; up to ``MOST_BROADCAST`` groups of copies are broadcast, and more are joined by a
    shuffle. Payloads are equal if length and SHA-256 are; those under ``LEAST_REVISIT`` bytes refer to none. Rows that tie for
    the largest id are all responses; a null id is never the largest, and refers if any id is known.
    """
    rows = df.withColumn("_key", F.sha2(payload, 256)).withColumn("_size", F.octet_length(payload))
    groups = stored(rows.where(F.col("_size") >= LEAST_REVISIT).groupBy("_key", "_size")
                    .agg(F.max(page_id).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "payloads")
    return rows.join(broadcast_up_to(groups, MOST_BROADCAST), ["_key", "_size"], "left") \
        .withColumn("refers_to", F.when(~F.col(page_id).eqNullSafe(F.col("_first")), F.col("_first"))) \
        .drop("_key", "_size", "_first")


def write(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          date: str = DATE) -> None:
    """A record per row under ``path``: an HTTP response with the html in UTF-8, or a revisit of an equal payload.

    Null html is an empty payload, null ids and urls are empty headers; line ends in a url are percent-encoded.
    Repeated rows get a record each. Spark's committer publishes the files.
    """
    rows = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"),
                     F.coalesce(df[html], F.lit("")).alias("payload"))
    rows = with_revisits(rows, "page_id", "payload")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), _header(F.col("page_id")),
        F.lit(">\r\nWARC-Date: "), F.lit(date), F.lit("\r\nWARC-Target-URI: "), _header(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(F.col("payload").cast("binary")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                                 F.lit(f">\r\nWARC-Profile: {REVISIT_PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("body").cast("string"), F.lit(END))
    rows.withColumn("body", body).select(F.concat(head, F.col("body")).alias("value")) \
        .write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between two magics, in file order within a block that one task reads."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """file, block, byte after the start of the block's first segment, and bytes of each segment."""
    at, rel = None, 0
    for batch in sliced(batches):
        files, blocks, values = (batch.column(i) for i in range(3))
        files, blocks, places, data = files.to_pylist(), blocks.to_pylist(), [], []
        for f, b, v in zip(files, blocks, values):
            if (f, b) != at:
                at, rel = (f, b), 0
            raw = v.as_buffer()
            places.append(rel)
            data.append(raw)
            rel += len(raw) + len(MAGIC)
        yield files, blocks, places, data


def record_length(raw: bytes) -> int | None:
    """Bytes from a record's magic to its successor, by its header; ``raw`` starts after the magic."""
    end = raw.find(END.encode())
    if end < 0 or raw[1:3] != b"\r\n" or not raw[:1].isdigit():
        return None
    found = _LENGTH.search(raw, 0, end + 2)
    return None if found is None else len(MAGIC) + end + len(END) + int(found[1]) + len(END)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, rel, off, size, succ) of every segment after a magic: offset, bytes, and successor or null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, blocks, places, data in _placed(batches):
            lengths = [record_length(bytes(raw)) for raw in data]
            columns = (files, blocks, places, [len(raw) + len(MAGIC) for raw in data], lengths)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["file", "block", "rel", "size", "length"])

    found = stored(_segments(spark, path).mapInArrow(run, "file long, block long, rel long, size long, length long"),
                   "segments")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("n"))
    base = offsets(blocks, ["file"], [F.col("block")], "n", "base").drop("n")
    off = F.col("base") + F.col("rel") - len(MAGIC)
    return found.join(base, ["file", "block"]).withColumn("off", off).where("off >= 0") \
        .select("file", "block", "rel", "off", "size", (F.col("off") + F.col("length")).alias("succ"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) of the records that the chain from offset 0 of their file leads to, by pointer jumping.

    ``links``: file, off, succ, one row per candidate. After round r the first 2^r records of every file are marked
    and every pointer leads 2^r records on. A round's rows are written to the shared folder.
    """
    spark = links.sparkSession
    now, path = store(links.select("file", "off", F.col("succ").alias("jump"), (F.col("off") == 0).alias("reached")),
                      "chain")
    marked = now.where("reached").count()
    while True:
        target = now.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("jump").alias("next"))
        met = now.join(target, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("o")), "left")
        own = F.struct("off", F.col("next").alias("jump"), "reached")
        mark = F.struct(F.col("o").alias("off"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("reached"))
        rows = met.select("file", F.explode(F.when(F.col("reached") & F.col("o").isNotNull(), F.array(own, mark))
                                            .otherwise(F.array(own))).alias("r")).select("file", "r.*")
        new, new_path = store(rows.groupBy("file", "off").agg(F.max("jump").alias("jump"),
                                                              F.max("reached").alias("reached")), "chain")
        count = new.where("reached").count()
        drop(spark, path)
        now, path = new, new_path
        if count == marked:
            return now.where("reached").select("file", "off")
        marked = count


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, off, and the columns of ``parse``.

    Only records on the chain from their file's start whose bytes are all there; after a broken link the rest of that
    file is off the chain. A folder without records gives an empty table. Payloads are shuffled only for records
    whose payload holds a magic; the tables beside them have a row per block of a file, or per such segment, and are
    broadcast up to ``MOST_BROADCAST`` rows.
    """
    found = stored(candidates(spark, path), "candidates")
    chain = stored(reachable(found), "reached").withColumn("on", F.lit(True))
    known = found.join(chain, ["file", "off"], "left")
    by_file = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    odd_files = known.where("on IS NULL OR succ IS NULL OR succ <> off + size").select("file").distinct()
    # files with other than whole records in one segment each: their segments, with the record each belongs to
    odd = known.join(odd_files, "file", "left_semi").withColumn("owner", F.last(F.expr("IF(on, off, NULL)"), True).over(by_file)) \
        .withColumn("owner_end", F.last(F.expr("IF(on, succ, NULL)"), True).over(by_file)) \
        .where("on IS NULL OR succ IS NULL OR succ <> off + size")
    odd = stored(odd.select("file", "block", "rel", "off", "owner", "owner_end"), "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, blocks, places, data in _placed(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (files, blocks, places)),
                                              pa.array([bytes(r) for r in data], pa.binary())],
                                             names=["file", "block", "rel", "value"])

    starts = stored(found.groupBy("file", "block").agg(F.min(F.expr("off - rel")).alias("base")), "starts")
    segments = _segments(spark, path).mapInArrow(run, "file long, block long, rel long, value binary")
    at = ["file", "block", "rel"]
    whole = segments.join(broadcast_up_to(starts, MOST_BROADCAST), ["file", "block"]).where("base + rel >= 0")
    if odd.isEmpty():
        return parse(whole.select("file", F.expr("base + rel").alias("off"), "value"))
    whole = whole.join(broadcast_up_to(odd.select(*at), MOST_BROADCAST), at, "left_anti") \
        .select("file", F.expr("base + rel").alias("off"), "value")
    held = odd.where("owner IS NOT NULL AND owner_end IS NOT NULL AND off < owner_end")
    inside = segments.join(broadcast_up_to(held, MOST_BROADCAST), at)
    part = F.struct("off", F.concat(F.when(F.col("off") == F.col("owner"), F.lit(b"")).otherwise(F.lit(MAGIC.encode())),
                                    F.col("value")).alias("value"))
    joined_parts = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b""), lambda a, p: F.concat(a, p["value"]))
    mended = inside.groupBy("file", F.col("owner").alias("off")).agg(joined_parts.alias("value"))
    return parse(whole.union(mended))


def parse(raw: DataFrame) -> DataFrame:
    """Records from their bytes (``value``, after the magic): record_type, record_id, target_uri, refers_to, payload_digest
    (as headers have them, or null) and payload, the body of the HTTP message. A record cut short is left out.
    """
    names = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for f, off, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = value.as_py()
                end, length = data.find(END.encode()), record_length(data)
                if length is None or len(MAGIC) + len(data) < length:
                    continue
                lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
                own = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                block = data[end + len(END):length - len(MAGIC) - len(END)]
                _, _, payload = block.partition(END.encode())
                rows.append((f, off, *(own.get(n) for n in names), payload))
            kinds = [pa.int64()] * 2 + [pa.string()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["file", "off", *COLUMNS])

    return raw.select("file", "off", "value").mapInArrow(
        run, "file long, off long, " + ", ".join(f"{c} string" for c in COLUMNS[:-1]) + ", payload binary")


COLUMNS = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload"]


def page_of(urn: str) -> Column:
    """The number in a page's record id; null for none."""
    return F.expr(f"try_cast(regexp_extract({urn}, '<urn:page:(-?[0-9]+)>', 1) AS bigint)")


def pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits with the figures of their response.

    A revisit whose response is not among the records has null figures.
    """
    rows = stored(records.select(page_of("record_id").alias("page_id"), "record_type",
                                 page_of("refers_to").alias("refers_to"),
                                 F.regexp_extract("payload_digest", "sha1:(.*)", 1).alias("named"),
                                 F.octet_length("payload").cast("long").alias("payload_bytes"),
                                 F.sha1("payload").alias("payload_digest")), "pages")
    response = rows.where("record_type = 'response'")
    revisit = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "named")
    referred = response.where("page_id IS NOT NULL").select(F.col("page_id").alias("r"), "payload_bytes", "payload_digest") \
        .distinct()
    full = revisit.join(referred, (F.col("refers_to") == F.col("r")) & (F.col("named") == F.col("payload_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(*columns).union(full.select(*columns))
