import random

from lodewatch.llm.automata import Automaton, maximal, reference_spans


def brute(words, texts, least):
    """The maximal spans by marking every window of `least` words that stands in a text."""
    windows = {tuple(t.split()[i : i + least]) for t in texts for i in range(len(t.split()) - least + 1)}
    marks = [False] * len(words)
    joined = [False] * len(words)  # whether a word and the one before it are in one window
    for i in range(len(words) - least + 1):
        if tuple(words[i : i + least]) in windows:
            for j in range(i, i + least):
                joined[j] |= j > i
                marks[j] = True
    return marks


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(12)]
    docs = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [texts[0], "", "  \n"]
    return texts, docs


def test_statistics_and_spans_against_brute_force():
    for seed in range(20):
        texts, docs = made(seed)
        own = Automaton(texts).opened()
        runs = {tuple(t.split()[i:j]) for t in texts for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1)}
        for doc in docs:
            words = doc.split()
            sizes = own.statistics(words)
            assert sizes == [max((n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in runs or n == 0), default=0) for i in range(len(words))]
            covered = [False] * len(words)
            for start, n in maximal(sizes, 4):
                covered[start : start + n] = [True] * n
            assert covered == brute(words, texts, 4)


def test_documents_stream_past_all_shards(spark):
    texts, docs = made(99)
    reference = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    rows = [(i, d) for i, d in enumerate(docs)] + [(1000, None)]
    for most in (1, 1 << 20):
        got = reference_spans(spark.createDataFrame(rows, "doc_id long, text string"), reference, 5, shard_words=40, most=most).collect()
        for i, doc in enumerate(docs):
            covered = [False] * len(doc.split())
            for r in got:
                if r.doc_id == i:
                    covered[r.start : r.start + r.words] = [True] * r.words
            assert covered == brute(doc.split(), texts, 5)
    assert reference_spans(spark.createDataFrame(rows, "doc_id long, text string"), reference.where("false"), 5).count() == 0
