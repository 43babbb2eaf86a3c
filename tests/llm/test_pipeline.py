"""run() against the five stages in plain Python, on a table with null ids, repeated rows, empty and long texts."""

import random
import re

import corpus_pipeline
from lodewatch.llm import bpe, langid, mixing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(rng):
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te") for b in ("ran", "sol", "dur", "vex") for c in ("", "en", "is", "um")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(None, None, "en", "a"), (1, "", None, "a"), (2, "123 456 ... 789", "en", None), (None, "no id has this " + say(30), "en", "b"), (3, say(40_000), "en", "a")]
    for i in range(60):
        text = say(rng.choice([4, 30, 200]))
        rows.append((10 + i, text, rng.choice(["en", None]), rng.choice(["a", "a", "b", None])))
        if i % 5 == 0:
            rows.append((100 + i, text.upper(), "en", "b"))
            rows.append((10 + i, text, "en", "a"))
        if i % 7 == 0:
            rows.append((10 + i, "same id " + say(25) + f" mail me{i}@site.org or +1 499 555 6503", "en", "a"))
    return rows


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows, copies_of):
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        rank = (r[0] is None, r[0] or 0)
        best.setdefault(g, []).append((rank, r[0], r[1]))
    kept = [(x[1], x[2]) for members in best.values() for x in [min(members)]]
    out = []
    for doc_id, text in kept:
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", text)
        text = re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "<PHONE>", text)
        out += [(doc_id, text)] * copies_of(doc_id)
    return out


def test_run_against_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    rows = tables(rng)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert all(r.lang == "en" for r in got)
    tokens = bpe.codec(bpe.VOCABULARY).tokenizer
    assert all(r.ids == tokens.encode(r.text, add_special_tokens=False).ids for r in got if len(r.text) < 2000)
    # the draw of the mixing stage, by its own rates over what the stages before it kept
    stages = dict(corpus_pipeline.STAGES)
    before = docs
    for name in ("language_id", "minhash_near_dedup", "private_data"):
        before = stages[name](spark, before, str(tmp_path))
    kept = before.collect()
    rates = {r.source: r.rate for r in mixing.rates(before).collect()}
    source = {(r.doc_id, r.text): r.source for r in kept}
    from .test_mixing import drawn

    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for i, t in plain(rows, lambda i: 1))
    want = [(i, t) for i, t in plain(rows, lambda i: 1) for _ in range(drawn("null" if i is None else i, rates[source[i, t] or ""]))]
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((i or -1, t) for i, t in want)


def test_language_stage_keeps_every_text_with_a_letter(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s"), (2, "12", "en", "s"), (None, "déf", "en", None), (3, None, "en", "s"), (4, "abc", "en", "s")], "doc_id long, text string, lang string, source string")
    got = langid.keep_identified(spark, docs, "")
    assert got.columns == docs.columns and {r.text for r in got.collect()} == {"abc", "déf"}


def test_redaction_leaves_clean_rows_alone(spark):
    docs = spark.createDataFrame([(1, "clean", "en", "s", 99), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.text) for r in pii.without_private_data(spark, docs, "").collect()} == {(1, "clean"), (2, None)}
