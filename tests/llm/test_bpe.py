import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from lodewatch.llm import bpe


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2028, 0x202F, 0x3000, 0x200B)]
    letters = ["a", "The", "é", "ß", "中", "文字", "👩‍👩‍👧", "12", "٣", "'s", "'ll", "#", "$$$", "<|endoftext|>", "\x00", "\x7f", "ñ", "é", "\U0010ffff"]
    made = ["".join(rng.choice(spaces if rng.random() < 0.45 else letters) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    every = ["".join(chr(c) + " " + chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3400, 256)]
    return [None, "", " ", "  ", "\n", "x" * 30000, "word " * 30000, *made, *every]


def test_same_ids_as_by_rank_and_exact_round_trip(spark):
    ranks, own = reference()
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids), repr(text)[:200]
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(text)[:200]
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_vocabulary_equals_the_ranks():
    ranks, _ = reference()
    codec = bpe.Codec(P.path("byte_bpe_50k.json"))
    assert {codec.bytes[codec.starts[i] : codec.starts[i] + codec.lengths[i]].tobytes(): i for i in ranks.values()} == ranks


def test_offsets_match_the_library(spark):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(["Hello wörld", "naïve 👩‍👩‍👧 text", "中文字 x", "", "a b"])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, offsets="offsets").collect()}
    for i, text in rows:
        want = plain.encode(text, add_special_tokens=False)
        assert got[i].ids == want.ids
        assert all(0 <= a < b <= len(text) for a, b in got[i].offsets)
        if text.isascii():
            joined = "".join(text[a:b] for a, b in got[i].offsets)
            assert joined == text


def test_decoding_keeps_split_characters_and_marks_bad_bytes(spark):
    _, own = reference()
    ids = own.encode_ordinary("👩‍👩‍👧")
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: (r.text, bytes(r.decoded)) for r in bpe.decode(df).withColumn("text", bpe.readable("decoded")).collect()}
    assert got[1][0] == "👩‍👩‍👧"
    assert "�" in got[2][0]
    assert got[3] == ("", b"") and got[4] == ("", b"")


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decoding_in_the_same_pass_needs_one_worker_and_gives_the_same_bytes(spark):
    rows = spark.createDataFrame([(1, "Größe  a\n b"), (2, ""), (3, None), (4, "x" * 2000)], "doc_id long, text string")
    once = bpe.encode(rows, decoded="decoded")
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in once.collect()} == {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(rows)).collect()}
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_round_trip_takes_one_pass(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert bpe.round_trip(rows)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
