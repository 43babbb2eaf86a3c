import hashlib
import math
from collections import Counter

from lodewatch.llm import mixing


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def drawn(doc_id, rate):
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for part in range(1, parts + 1):
        x, mean, k, c = u(mixing.SEED, doc_id, part), rate / parts, 0, 0.0
        while True:
            c += math.exp(-mean) * mean**k / math.factorial(k)
            if x < c or k > mixing.TERMS:
                break
            k += 1
        total += k
    return total


def test_copies_follow_the_inverted_draw(spark):
    rows = [(i, "x" * 10, "big") for i in range(3000)] + [(5000 + i, "y" * 10, "small") for i in range(30)] + [(9000, "z", None), (9001, None, "big"), (9002, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"big": 0.5, "small": 0.5, "": 0.0}
    rates = {r.source: r.rate for r in mixing.rates(docs, weights).collect()}
    assert abs(rates["big"] - 0.5 * 30301 / 30000) < 1e-5 and abs(rates["small"] - 0.5 * 30301 / 300) < 1e-5 and rates["none"] == 0.0
    got = Counter(r.doc_id for r in mixing.mix(docs, weights).collect())
    want = {i: drawn(i, rates[s or ""]) for i, _, s in rows}
    assert got == Counter({k: v for k, v in want.items() if v})
    shares = Counter()
    for i, text, s in rows:
        shares[s] += got[i] * len(text or "")
    assert abs(shares["small"] / (shares["small"] + shares["big"]) - 0.5) < 0.03


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_and_extra_columns(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    docs = spark.createDataFrame([(None, "abc", "s", 7, "k")] * 40, "doc_id long, text string, source string, rate int, parts string")
    got = mixing.mix(docs).collect()
    assert all(r.parts == "k" and r.rate == 1.0 for r in got)
