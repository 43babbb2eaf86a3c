import random
import re

from lodewatch.llm.minhash import keep_first_of_group, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one TWO "), (1005, "é x"), (1006, "É x"), (1007, "w " * 5000), (1008, "w " * 4000)]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 40, 200]))
        rows.append((i * 10, " ".join(words)))
        for j in range(rng.choice([0, 1, 3])):
            copy = words[:]
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + 1 + j, "\n".join(copy)))
    # a chain in which only neighbours are alike, behind one hub that is like none of them
    base = [f"c{i}" for i in range(400)]
    for j in range(12):
        rows.append((2000 + j, " ".join(base[: j * 24] + [f"d{i}" for i in range(j * 24)] + base[j * 24 :])))
    return rows


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_few_bands_lose_no_link_inside_a_bucket(spark):
    """With one row a band, unlike documents share buckets and centres; still no link is lost."""
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, bands=30, rows=1).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_null_and_repeated_ids(spark):
    same, other = "a b c d e f g h", "one two three four five six seven"
    rows = [(None, same), (3, same), (7, same), (7, other), (7, other), (None, other + " x"), (None, "alone in this place at all"), (None, "alone in this place at all"), (None, None), (9, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(None, 4, 3, False), (3, 4, 3, True), (7, 4, 3, False), (7, 3, 7, True), (7, 3, 7, True), (None, 4, 7, False), (None, 2, None, True), (None, 2, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_document_of_each_group_stays(spark):
    same = "a b c d e f g h"
    rows = [(None, same, "x"), (3, same, "x"), (7, same, "y"), (7, "another text that is no copy", "y"), (None, "no id has this one text", "z"), (None, "no id has this one text", "z"), (5, None, "z"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = keep_first_of_group(spark, docs, "")
    assert got.columns == docs.columns
    text = lambda r: (r[1] is not None, r[1])
    assert sorted(map(tuple, got.collect()), key=text) == sorted([rows[1], rows[3], rows[4], rows[6], rows[7]], key=text)


def test_many_template_pages_in_one_bucket(spark):
    """Pages that share two thirds of their words meet in many buckets; none of them is a link."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(40)])) for i in range(3000)]
    rows += [(10_000 + i, rows[i][1] + " end") for i in range(0, 3000, 100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i - 10_000 if i >= 10_000 else i) for i, _ in rows)


def test_links_at_the_limit_are_found(spark):
    """Pairs of 400 shingles that share exactly 75 of 100: the least that is a link."""
    rows = []
    for i in range(300):
        shared = [f"s{i}.{j}" for j in range(304)]
        rows += [(2 * i, " ".join(shared + [f"p{i}.{j}" for j in range(50)])), (2 * i + 1, " ".join(shared + [f"q{i}.{j}" for j in range(50)]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").count()
    assert got == 300
