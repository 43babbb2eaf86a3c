import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lodewatch.llm.winnowing import GRAM, WINDOW, beside_next, block_firsts, chosen, fingerprinted


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    rows = [(-7, None), (-3, ""), (0, "one"), (1, "one"), (4, " \n"), (9, "Ünï 👩‍👩‍👧 x")]
    for i in range(60):
        rows.append((20 + 3 * i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.choice([1, 2, 5, 10, 40, 300])))))
    return rows


def winnowed(text, hash_of):
    """Positions that a plain reading of the method picks, given a hash of each gram."""
    tokens = text.lower().split()
    if not tokens:
        return []
    grams = [tuple(tokens[i : i + GRAM]) for i in range(max(1, len(tokens) - GRAM + 1))]
    picked = []
    for i in range(max(1, len(grams) - WINDOW + 1)):
        part = range(i, min(i + WINDOW, len(grams)))
        best = min(part, key=lambda p: (hash_of[grams[p]], -p))
        if best not in picked:
            picked.append(best)
    return [(hash_of[grams[p]], p) for p in picked]


def parsed(fingerprint):
    return [(int(h, 16), int(p)) for h, p in (x.split("@") for x in fingerprint.split(",") if x)]


def test_edits_neighbours_and_likeness(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, next_text string").repartition(5)
    got = {r.doc_id: r for r in fingerprinted(docs).collect()}
    order = sorted(rows)
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {(t or ""): got[i].fingerprint for i, t in rows}
    for (i, text), (j, after) in zip(order, [*order[1:], order[0]], strict=True):
        a = {h for h, _ in parsed(got[i].fingerprint)}
        for near, other in ((got[i].near_edited, got[i].edited_fingerprint), (got[i].near_next, got[j].fingerprint)):
            b = {h for h, _ in parsed(other)}
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        assert by_text[text or ""] == got[i].fingerprint


def test_windows_take_the_smallest_hash_and_the_rightmost_tie(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(n)) for n in (1, 2, 3, 7, 10, 11, 60, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # every gram as a text of its own gives its hash
    grams = sorted({tuple(t.split()[i : i + GRAM]) for t in texts for i in range(max(1, len(t.split()) - GRAM + 1))})
    alone = fingerprinted(spark.createDataFrame([(i, " ".join(g)) for i, g in enumerate(grams)], "doc_id long, text string")).collect()
    hash_of = {grams[r.doc_id]: parsed(r.fingerprint)[0][0] for r in alone}
    for r in fingerprinted(docs).collect():
        assert parsed(r.fingerprint) == winnowed(texts[r.doc_id], hash_of)


def test_shared_passages_of_the_guaranteed_length_are_met(spark):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(GRAM + WINDOW - 1)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randrange(40))] + shared + [f"y{rng.random()}" for _ in range(rng.randrange(40))])) for i in range(20)]
    sets = [{h for h, _ in parsed(r.fingerprint)} for r in fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_one_row_and_none(spark):
    assert fingerprinted(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprinted(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one[0].near_next == 1.0


def test_texts_beyond_the_packed_positions_choose_the_same(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(n)) for n in (1, 5, 10, 60, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = docs.select(chosen(docs.text).alias("packed"), chosen(docs.text, place_bits=3).alias("far")).collect()
    assert all(r.packed == r.far and r.packed for r in rows)


def test_many_small_blocks_give_the_same_neighbours(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(400) if k % 7 else None, f"t{k}" * rng.randrange(1, 30)) for k in range(600)]
    rows += [(5000, "same")] * 40 + [(rng.randrange(4_000_000_000_000), "far")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(6)
    order = sorted(((i is not None, i or 0, d, t) for i, t, d in ((r.id, r.text, r.digest) for r in docs.withColumn("digest", F.xxhash64("text")).collect())))
    want = Counter((a[3], b[3]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for block, fan in ((200, 2), (200, 512), (10**9, 512)):
        got = beside_next(docs, "id", ["text"], F.length("text"), block, fan)
        assert Counter((r.text, r.next_text) for r in got.collect()) == want
    assert block_firsts(docs, F.struct(F.col("id").alias("key"), F.xxhash64("text").alias("digest")), F.length("text"), 200).count() > 50
    assert "Python" not in got._jdf.queryExecution().toString()
