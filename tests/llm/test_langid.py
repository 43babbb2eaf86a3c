import math
import subprocess
import sys

import numpy as np

from lodewatch.llm import langid


def every_segmentation(word, chance):
    """The sum over all cuts by plain recursion; a byte that is no piece costs STRAY."""
    if not word:
        return 1.0
    total = langid.STRAY * every_segmentation(word[1:], chance)
    for n in range(1, min(langid.vocabulary(langid.PIECES).longest, len(word)) + 1):
        if word[:n] in chance:
            total += chance[word[:n]] * every_segmentation(word[n:], chance)
    return total


def test_forward_pass_sums_all_segmentations():
    own = langid.vocabulary(langid.PIECES)
    rng = np.random.default_rng(0)
    table = rng.random((len(own.pieces), 2)) * 1e-3
    for word in ["the", "straße", "naïve", "zz", "internation", "été"]:
        data = (" " + word).encode()
        rows = np.frombuffer(data, np.uint8)[None, :]
        logs = langid.forward(own, rows, table)[0]
        for k in range(2):
            chance = {p: table[i, k] for i, p in enumerate(own.pieces)}
            assert math.isclose(logs[k], math.log(every_segmentation(data, chance)), rel_tol=1e-9)


def test_long_words_do_not_underflow():
    own = langid.vocabulary(langid.PIECES)
    table = np.full((len(own.pieces), 2), 1e-5)
    rows = np.frombuffer((" " + "qz" * 3000).encode(), np.uint8)[None, :]
    assert np.isfinite(langid.forward(own, rows, table)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 250
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_and_without_training(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", None), (4, "中文字" * 50, "zh"), (5, "the cat and the dog", "en"), (6, "é", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    languages, chances = langid.train(docs)
    assert languages == ["en", "zh"]
    got = {r.doc_id: r for r in langid.predict(docs, languages, chances).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "zh", "en"]
    assert got[1].score == 0.0 and got[6].lang_pred in languages
    nothing = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, *nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), languages, chances).count() == 0


def test_stretches_of_long_words_equal_one_pass():
    own = langid.vocabulary(langid.PIECES)
    rng = np.random.default_rng(1)
    table = rng.random((len(own.pieces), 3)) * 1e-3
    table[rng.random(table.shape) < 0.3] = 0
    pieces = [p.decode().strip() for p in own.pieces]
    texts = ["".join(rng.choice(pieces, k)) for k in (1, 3, 40, 200, 900)] + ["a" * 3000, "中" * 700, "q"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in texts])
    starts = ends - [len(x.encode()) for x in texts]
    want = np.array([langid.forward(own, np.concatenate([[32], data[a:b]]).astype(np.uint8)[None], table)[0] for a, b in zip(starts, ends, strict=True)])
    for stretch in (22, 64, 512):
        assert np.allclose(langid.forward_long(own, data, starts, ends, table, stretch), want, rtol=1e-11)
    for part, rows, lengths in langid.by_size(data, starts, ends):
        assert np.allclose(langid.forward(own, rows, table, lengths), want[part], rtol=1e-12)


LONG_RUN = """
import resource, time, numpy as np, pyarrow as pa
from lodewatch.llm import langid
from lodewatch.llm.words import blocks
own, rng = langid.vocabulary(langid.PIECES), np.random.default_rng(0)
table = rng.random((len(own.pieces), 4)) * 1e-3
text = pa.array([rng.integers(97, 123, 5_000_000).astype(np.uint8).tobytes().decode()])
began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for block in blocks(text, langid.BLOCK):
    langid.Scorer(own, table).texts(block)
print(time.time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_a_run_of_five_million_letters_takes_seconds_and_little_memory():
    out = subprocess.run([sys.executable, "-c", LONG_RUN], capture_output=True, text=True, check=True, timeout=120)
    seconds, megabytes = map(float, out.stdout.split())
    assert seconds < 60 and megabytes < 200


def test_long_texts_null_ids_and_clashing_names(spark):
    rows = [(None, "the cat and the dog " * 20, "en"), (None, None, None), (3, "der Hund und die Katze " * 20, "de"), (3, "derhundunddiekatze" * 400, "de"), (4, "the dog", "en")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, letters int, _letters int")
    languages, chances = langid.train(docs)
    got = langid.predict(docs, languages, chances).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.letters, r["_letters"]) for r in got) == [("3", "de", 1, 2), ("3", "de", 1, 2), ("4", "en", 1, 2), ("None", "en", 1, 2), ("None", "und", 1, 2)]
