"""Byte-level BPE and token files against the public tokenizer libraries."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spendlens.llm import bpe, queries, token_files
from spendlens.llm.pretoken import BYTE_LEVEL, splitter, starts
from spendlens.llm.work import new_path

SF = "/root/testdata/sf0.01"
TRICKY = ["", " ", "\n\n  x", "don't we'll I'm", "a" * 5000, " " * 3000 + "b", "naïve café №5 ½ 中文 😀\x85\xa0x", "\x1c\x1d a",
          "<|endoftext|> tail", "ab cd　e", "x\r\n\ty  ", "\x00\x7f", "ÀÉ²³ µª'S 'RE", "1234567890 " * 50]


@pytest.fixture(scope="module")
def vocabulary():
    return queries.byte_bpe()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks,
                             special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    h = vocabulary.hash
    assert sorted(h.slots) == sorted(vocabulary.ranks) and len(h.slots) == len(vocabulary.ranks)
    assert all(h.slots[h.find(t)] == t for t in vocabulary.ranks)
    assert h.find(b"no such token at all") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_latin_split_equals_full_pattern():
    full = regex.compile(public_tokenizers.PATTERN).findall
    for a in range(256):
        for around in ("{}", "a{}b", " {} 1", "{}{}  ", "'{}s"):
            text = around.replace("{}", chr(a))
            assert splitter(public_tokenizers.PATTERN)(text) == full(text), repr(text)


def test_every_code_point_splits_as_the_library(vocabulary, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}\n" for c in points[low:low + 20_000] if regex.match(
            r"[\s\p{Z}\p{C}--\p{Cn}\p{P}]", chr(c), regex.V1))
        assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab c'\nsé1", max_size=80))
def test_encode_equals_tiktoken(text):
    v = queries.byte_bpe()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    ids = v.encode(text).tolist()
    assert ids == own.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_encode_query_equals_tiktoken(spark, library):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op2_byte_bpe(spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_odd_rows(spark, vocabulary, library):
    rows = [(i, t, 7) for i, t in enumerate(TRICKY)] + [(None, None, None), (3, "same", 1), (3, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode(df, vocabulary).collect()
    assert got[0].__fields__ == ["doc_id", "text", "ids"] and len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "")
    back = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.encode(df.limit(0), vocabulary).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nulls, vocabulary).first().decoded) == b""


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack(data, bits, 1001) == ids).all()
    for first, count in ((0, 0), (7, 1), (333, 500), (1000, 1)):
        assert (token_files.unpack(data, bits, count, first) == ids[first:first + count]).all()


def test_bits():
    assert [token_files.bits_for(n) for n in (0, 1, 2, 3, 50257, 65536, 65537)] == [1, 1, 1, 2, 16, 16, 17]


def test_token_files_query(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start, want = 0, []
    for r in queries.table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op3_token_files(spark, SF).collect())) == want


def test_token_files_odd_rows(spark):
    own, t = queries.library_tokenizer(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, s) for i, s in enumerate(TRICKY)] + [(None, "null id"), (2, None), (9, "again"), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = new_path(spark, "test-tokens")
    token_files.write(df, path, own, shard_text_bytes=2000)
    docs = token_files.global_starts(token_files.read(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in docs] == sorted([i for i, _ in rows], key=lambda i: -1 if i is None else i)
    assert len({r.shard for r in docs}) > 2
    want = sorted(((-1 if i is None else i), tuple(t.encode(s or "", add_special_tokens=False).ids) + (0,)) for i, s in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), tuple(r.ids)) for r in docs) == want
    at = 0
    for r in docs:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    r = max(docs, key=lambda r: r.n_tokens)
    assert token_files.lookup(spark, path, r.shard, r.shard_start + 1, 3) == r.ids[1:4]
    empty = new_path(spark, "test-none")
    token_files.write(df.limit(0), empty, own)
    assert token_files.read(spark, empty).collect() == []


def test_lookup_reads_only_the_blocks_asked_for(spark, monkeypatch):
    own = queries.library_tokenizer()
    rng = np.random.default_rng(7)
    words = [" " + "".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows = [(i, "".join(rng.choice(words, 6000))) for i in range(40)]
    path = new_path(spark, "test-lookup")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, own, shard_text_bytes=900_000)
    docs = token_files.read(spark, path).orderBy("shard", "shard_start").collect()
    of_shard = {}
    for r in docs:
        of_shard.setdefault(r.shard, []).extend(r.ids)
    assert len(of_shard) > 1 and min(map(len, of_shard.values())) > 3 * token_files.BLOCK_IDS
    touched = []
    plain = token_files._bytes_at
    monkeypatch.setattr(token_files, "_bytes_at", lambda stream, at, n: touched.append(n) or plain(stream, at, n))
    for shard, ids in of_shard.items():
        for first, count in ((0, 1), (token_files.BLOCK_IDS - 5, 10), (len(ids) - 1, 1), (100_000, 1000), (7, 0)):
            touched.clear()
            assert token_files.lookup(spark, path, shard, first, count) == ids[first:first + count]
            assert sum(touched) <= 8 + 64 + 2 * (8 + 64) + 2 * count + 4
        for first, count in ((len(ids), 1), (0, len(ids) + 1), (-1, 1)):
            with pytest.raises(IndexError):
                token_files.lookup(spark, path, shard, first, count)
    with pytest.raises(IndexError):
        token_files.lookup(spark, path, 99, 0, 1)


def test_batches_equal_the_library(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    letters = list("abcdeéß漢𝒳ñÀ'’1 2\n-.")
    texts = ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(300)] + TRICKY + ADDED
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for beside, room in ((256, 1 << 18), (1, 0), (7, 50)):
        monkeypatch.setattr(token_files, "WORDS_BESIDE", beside)
        monkeypatch.setattr(token_files, "REMEMBERED", room)
        own = queries.library_tokenizer(added_tokens=True)
        assert [x.tolist() for x in own.encode_all(texts)] == want
        assert [x.tolist() for x in own.encode_all(texts)] == want and len(own.memo) <= room


ADDED = ["a <|endoftext|> tail", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x \n <|endoftext|>  y<|endoftext|>é", "<|endoftext"]


def test_added_tokens_equal_the_unmodified_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, t = queries.library_tokenizer(added_tokens=True), Tokenizer.from_file(path)
    assert own.encode(ADDED[0]).tolist() == [64, 220, 50256, 7894]
    for text in TRICKY + ADDED:
        assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({"id": 50257, "content": "<|end", "single_word": False, "lstrip": True, "rstrip": True,
                                 "normalized": False, "special": False})
    own = token_files.LibraryTokenizer(json.dumps(spec), public_tokenizers.PATTERN)
    t = Tokenizer.from_str(json.dumps(spec))
    for text in TRICKY + ADDED:
        assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files_query_with_added_tokens(spark, tmp_path):
    rows = list(enumerate(ADDED))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op3_token_files(spark, str(tmp_path)).collect())) == want


def test_blocks_span_documents(spark, monkeypatch):
    s = token_files._Shard(4, 13)
    rng, docs = np.random.default_rng(1), []
    frames = []
    for i in range(300):
        docs.append(rng.integers(0, 1 << 13, int(rng.integers(0, 2000))).astype(np.uint32))
        s.add(i, docs[-1])
        frames += s.take()
    data = b"".join(f + b"\n" for f in frames + s.close())
    (shard, base, table, blocks), = token_files.shards_in(data)
    assert (shard, base, len(table)) == (4, 0, 300) and len(blocks) > 2
    flat = np.concatenate(docs)
    for first, count in ((0, len(flat)), (65_530, 20), (100_000, 1), (len(flat) - 1, 1)):
        assert (token_files.read_span(data, blocks, first, count) == flat[first:first + count]).all()


def split_at_once(texts):
    text = "".join(texts)
    points, bounds = np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), np.cumsum([0, *map(len, texts)])
    first = np.zeros(len(points), dtype=bool)
    first[bounds[bounds < len(points)]] = True
    cuts = [*np.flatnonzero(starts(points, first)).tolist(), len(points)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def test_texts_split_at_once_as_the_pattern():
    assert BYTE_LEVEL == public_tokenizers.PATTERN
    full, rng = regex.compile(BYTE_LEVEL).findall, np.random.default_rng(11)
    letters = list("stremvld''  \n\t1aé½中!-\x85\xa0\x1c　𝒳")
    sets = [["".join(rng.choice(letters, rng.integers(0, 9))) for _ in range(6)] for _ in range(3000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    sets += [[f"a{c} {c}{c}'s{c}\n{c}" for c in points[low:low + 50_000]] for low in range(0, len(points), 50_000)]
    for texts in [*sets, TRICKY, ["'", "s"], ["a ", "b", "", " ", " c"], ["x'", "'ll", "'l", "l"]]:
        assert split_at_once(texts) == [w for t in texts for w in full(t)]


def test_a_batch_looks_up_each_word_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

    t, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ["a b a b's, a 中 12"] * 100 + ADDED
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for at_once in (1, 1 << 21):
        monkeypatch.setattr(token_files, "POINTS_AT_ONCE", at_once)
        own = queries.library_tokenizer(added_tokens=True)
        own._ready()
        own.memo = Counted()
        assert [x.tolist() for x in own.encode_all(texts)] == want
    assert own.memo.asked <= 30


def test_another_pattern_encodes_whole_texts():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = token_files.LibraryTokenizer(t.to_str(), r"\S+")
    assert [x.tolist() for x in own.encode_all(TRICKY)] == [t.encode(x, add_special_tokens=False).ids for x in TRICKY]
