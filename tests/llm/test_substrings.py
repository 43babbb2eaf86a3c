import hashlib
import random
import re

import pytest

from lodewatch.llm.substrings import deduplicated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    seen = {}
    out = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - size + 1):
            window = tuple(words[s : s + size])
            if window in seen:
                gone.update(range(s, s + size))
            else:
                seen[window] = (i, s)
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def corpus(seed, size):
    rng = random.Random(seed)
    shared = [[f"p{k}x{rng.randrange(50)}" for _ in range(rng.randrange(size, 4 * size))] for k in range(6)]
    rows = [(-5, None), (-4, ""), (-3, " \n"), (-2, "a " * 300), (-1, "a " * 50), (900, "a " * size), (901, "a " * (size - 1))]
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(shared)
            elif kind < 0.6:
                part = rng.choice(shared)
                a = rng.randrange(len(part))
                words += part[a : a + rng.randrange(1, 3 * size)]
            else:
                words += [f"é{rng.randrange(100000)}" for _ in range(rng.randrange(0, 2 * size))]
        text = rng.choice([" ", "\n", " \t"]).join(words)
        rows.append((i, text))
        if rng.random() < 0.2:
            rows.append((500 + i, text))
    return rows


@pytest.mark.parametrize("size", [20, 7])
def test_against_brute_force(spark, size):
    rows = corpus(size, size)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in deduplicated(docs, size).collect()}
    assert got == brute(rows, size)


def test_repeated_rows_of_one_document_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = sorted(((r.doc_id or 0), r.n_removed) for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digest_of_kept_words(spark):
    from pyspark.sql import functions as F

    got = deduplicated(spark.createDataFrame([(1, " a  b\n")], "doc_id long, text string")).select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"a b").hexdigest()


def test_a_collision_of_one_hash_removes_nothing():
    import numpy as np
    import pyarrow as pa

    from lodewatch.llm.substrings import firsts, stretches, window_hashes
    from lodewatch.llm.words import blocks

    text = " ".join(f"w{i}" for i in range(60))
    for spoiled in ("hashes", "second"):
        words = next(blocks(pa.array([text, text]))).words(lower=False, twice=True)
        getattr(words, spoiled)[:] = 7  # every word has one of its hashes in common with all others
        at, one, two = window_hashes(words, 20)
        owner = np.searchsorted(words.offsets, at, "right") - 1
        lead = firsts(owner, at, one, two)
        assert lead.tolist() == (owner == 0).tolist()  # all windows of the first text, none of the second
        starts, counts, anchors, content, second = stretches(words, 20, 5)
        owner = np.searchsorted(words.offsets, starts, "right") - 1
        same = firsts(owner, starts, anchors * np.uint64(0), content, second)
        assert counts.sum() == 82 and same[owner == 0].all() and not same[owner == 1].any()


def test_a_passage_of_every_row_and_a_very_long_text(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"a{i} {shared} b{i} " + " ".join(f"c{i}x{k}" for k in range(25))) for i in range(2000)]
    rows.append((5000, " ".join(f"long{k % 70_000}" for k in range(150_000)) + f" {shared}"))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).select("doc_id", "n_words", "n_removed").collect()}
    assert got[0] == (57, 0) and all(got[i] == (57, 30) for i in range(1, 2000))
    assert got[5000] == (150_030, 80_030)
