import itertools
import re
from collections import Counter

import numpy as np

from lodewatch.llm import filter_audit
from tests.compare import connect, differences


def bits(docs):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        yield i, source or "", {f for f, bad in fails.items() if bad}


def plain(docs, labels):
    """Every order run over every document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    marked = list(bits(docs))
    out = {}
    for part in {p for _, p, _ in marked}:
        rows = [(i, fails) for i, p, fails in marked if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                all_fail = [x for _, x in rows if f in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_fail) - len(gone), sum(x == {f} for x in all_fail), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


WORDS = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS, "b"), (3, WORDS, "b"), (4, None, None), (5, "", ""), (6, "   \n", "a"), (None, WORDS, "a"), (None, None, None),
    (7, "x y " * 40, "a"), (8, "LOUD " * 60, "a"), (9, WORDS + " $", "b"), (10, WORDS.upper() + " #", "b"), (11, "äöü ß " * 30, "a"), (12, WORDS + " \x0b| é", "a"),
    (13, "Aaaaaaaaaaaaaaaaaaaa", "c"), (14, "Aaaaaaaaaaaaaaaaaaa", "c"), (15, WORDS + " " + "Z" * 9, "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1), (9, 0, 0)]


def frames(spark, docs=DOCS, labels=LABELS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_every_order_run_over_every_document(spark):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(*frames(spark)).collect()}
    assert got == plain(DOCS, LABELS)


def test_walk_visits_every_order_by_one_swap():
    counts = np.random.default_rng(0).integers(0, 9, (3, 32, 3))
    orders, steps, shapley = filter_audit.walk(counts)
    assert len({tuple(o) for o in orders}) == 120 == len(orders)
    for a, b in itertools.pairwise(orders):
        assert sum(x != y for x, y in zip(a, b, strict=True)) == 2
    assert (steps[:, :, :, 1].sum(axis=(0, 1)) == shapley.sum(axis=0)).all()


def test_empty_tables_and_clashing_columns(spark):
    docs, labels = frames(spark, [], [])
    assert filter_audit.audit(docs, labels).count() == 0
    some, none = frames(spark, DOCS, [])
    wide = some.selectExpr("*", "1 as part", "'x' as digest", "2 as mask", "3 as quality", "4 as first")
    got = filter_audit.audit(wide, none).collect()
    assert len(got) == 4 * 120 * 5 and not any(r.good_lost or r.toxic_lost for r in got)


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(spark, connect(sf_dir), filter_audit.op13_filter_audit, filter_audit.SQL, sf_dir) == ""
