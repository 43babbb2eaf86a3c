import math
from collections import Counter

from pyspark.sql import functions as F

from lodewatch.functions.text import entropy


def test_entropy_of_whole_texts(spark):
    texts = ["", None, "aaaa", "aé😀b" * 3, "a" * 100_000 + "".join(chr(0x4E00 + i) for i in range(20_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.e for r in rows.select("i", entropy(F.col("text")).alias("e")).collect()}
    for i, text in enumerate(texts):
        want = text if text is None else -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
        assert got[i] == want or abs(got[i] - want) < 1e-9
