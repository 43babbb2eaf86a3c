import math
import random
import re
from collections import Counter

from lodewatch.llm import quality
from lodewatch.llm.quality import judged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(1)
    made = [None, "", " \n\n", "one", "a b c d e " * 40, "é#ü $x\n" * 5, "l1 x\nl1 x\n\n \n \nl1 x\t", "w w w w w w", "x\ry\x0bz q   r"]
    for _ in range(200):
        made.append("".join(rng.choice(["a", "b", "cc", "é", " ", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randrange(0, 300))))
    made.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(60000)))
    return made


def test_counts_against_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged(docs).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}


def test_limits_follow_language_and_source(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(3, 8) + str(rng.randrange(900)) for _ in range(80))
    code = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(3, 8) + str(rng.randrange(900)) + "<>|" * rng.randrange(0, 2) for _ in range(80))
    rows = [(i, plain(), "en", "prose") for i in range(300)] + [(1000 + i, code(), "en", "code") for i in range(300)] + [(2000, code(), "en", "prose"), (2001, "THIS IS SHOUTED " + plain().upper(), "en", "prose"), (2002, plain(), None, None), (2003, None, None, "prose")]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))
    assert not got[2000].kept and got[2000].over == ["symbol_share"]
    assert not got[2001].kept and "capital_share" in got[2001].over
    assert got[2002].kept and not got[2003].kept
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def value_of(number):
    return 0.0 if number <= 0 else math.expm1((number + 0.5) * math.log(quality.RATIO)) * quality.UNIT


def brute_limits(values):
    """The limit of one group by sorting its buckets."""
    order = sorted(math.floor(math.log1p(v / quality.UNIT) / math.log(quality.RATIO)) for v in values)
    low, high = (value_of(order[math.ceil(q * len(order) / 4) - 1]) for q in (1, 3))
    return high + quality.SPREADS * (high - low)


def test_verdicts_against_brute_force_and_on_every_run(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), ("en", "few")]) if i % 50 else ("xx", f"s{i % 3}")
        text = " ".join(rng.choice(["word", "WORD", "#%", "longerword", f"n{rng.randrange(400)}"]) for _ in range(rng.randrange(15, 60)))
        rows.append((i, text if rng.random() < 0.9 else (text + "\n") * 2, lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = [{r.doc_id: (r.kept, tuple(r.over)) for r in judged(docs.repartition(n)).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]

    def shares(text):
        words, chars, symbols, dup, repeat, _ = brute(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        return {"symbol_share": symbols / chars, "dup_line_share": dup / lines, "repeat_share": repeat / words, "capital_share": sum("A" <= c <= "Z" for c in text) / chars, "mean_word": chars / words}

    have = {i: shares(t) for i, t, _, _ in rows}
    for i, text, lang, source in rows:
        own = [j for j, _, x, y in rows if (x, y) == (lang, source)]
        same = [j for j, _, x, _ in rows if x == lang]
        group = own if len(own) >= quality.LEAST_ROWS else same if len(same) >= quality.LEAST_ROWS else list(have)
        over = [m for m, slack in quality.MEASURES.items() if have[i][m] > brute_limits([have[j][m] for j in group]) + slack]
        assert list(runs[0][i][1]) == over
        assert runs[0][i][0] == (not over and not brute(text)[5])
