import itertools
import math
import random

from lodewatch.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def made():
    rng = random.Random(3)
    hosts = ["net", "NET", "a.net", "xnet", "example.net", "A.Example.NET", "badexample.net", "example.com", "m.example.com", "example.org", "org", "ÄB.org", "", "h:80", "u@x.net"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/1", "/DE/1", "/fr/", "/fr/a/b.html", "?q=/en/", "#/fr/", "/x?y=1#z", "/a\nb/c"]
    rows = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "x:y://", "://") for h in hosts for p in paths]
    return [None, "", "nothing", "/en/x", "http:/a.net/", "a://b://c.net/", *rows, *(f"http://{rng.choice(hosts)}/{i}" for i in range(20))]


def test_fixed_rules_against_brute_force(spark):
    rows = list(enumerate(made()))
    pages = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, labels).collect()}
    assert got == {i: (*brute(u)[:3], brute(u)[3] or "allow") for i, u in rows}


def test_mined_rules_block_what_labels_show(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2000):
        kind = rng.choice(["pills", "news", "casino", "blog"])
        bad = kind == "pills" or (kind == "casino" and i % 2)
        rows.append((i, f"https://www.{kind}-shop.com/{'win' if kind == 'casino' and i % 2 else 'read'}/{i}?page=1"))
        if i < 1000:
            labels.append((i, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judged(pages, marks).collect()}
    for i, url in rows:
        bad = "pills" in url or "/win/" in url
        assert (got[i] == "block") == bad, url
    # no rule within another
    labelled = urls.parts(pages).withColumn("tokens", urls.tokens(urls.F.col("url"), urls.F.col("host"), urls.F.col("path"))).join(marks.withColumnRenamed("doc_id", "page_id"), "page_id")
    rules = [set(r.antecedent) for r in urls.mined(labelled.select("tokens", (urls.F.col("quality") == 0).alias("blocked"))).collect()]
    assert rules and not any(a < b for a in rules for b in rules)


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(pages, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")).count() == 0


def brute_rules(rows, support, confidence, least):
    """The shortest token sets that lead to blocking, over all subsets of the tokens of blocked rows."""
    enough = max(least, math.ceil(support * len(rows)))
    sets = {frozenset(c) for tokens, blocked in rows if blocked for n in range(1, len(tokens) + 1) for c in itertools.combinations(tokens, n)}
    good = set()
    for x in sets:
        hit = [blocked for tokens, blocked in rows if x <= set(tokens)]
        if sum(hit) >= enough and sum(hit) >= confidence * len(hit) and len(hit) < len(rows):
            good.add(x)
    short = [x for x in good if not any(y < x for y in good)]
    covers = lambda x: frozenset(i for i, (tokens, _) in enumerate(rows) if x <= set(tokens))
    return {covers(x) for x in short}


def test_mined_rules_against_brute_force(spark):
    """Rules by the rows they cover: tokens that always occur together stand in one rule, not in several."""
    rng = random.Random(12)
    for support, confidence, least in ((0.0, 0.7, 3), (0.05, 0.6, 2)):
        rows = []
        for _ in range(120):
            tokens = [t for t in "abcdefg" if rng.random() < 0.4]
            if "a" in tokens:
                tokens.append("a2")
            tokens.append("all")
            rows.append((tokens, ("a" in tokens and "b" in tokens and rng.random() < 0.9) or "g" in tokens and "c" in tokens or rng.random() < 0.2))
        got = urls.mined(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), support, confidence, least).collect()
        found = {frozenset(i for i, (tokens, _) in enumerate(rows) if set(r.antecedent) <= set(tokens)) for r in got}
        assert found == brute_rules(rows, support, confidence, least)
        assert all(("a" in r.antecedent) == ("a2" in r.antecedent) and r.pivot in r.antecedent for r in got)


def test_a_long_url_that_repeats_is_one_item(spark):
    rng = random.Random(13)
    long = "/".join(f"p{i}x" for i in range(60))
    rows = [(i, f"http://long.example/{long}?id={i}" if i % 100 < 2 else f"http://h{rng.randrange(50)}.example/t{rng.randrange(20)}") for i in range(3000)]
    labels = [(i, int(i % 100 >= 2 and rng.random() < 0.9), 0) for i in range(3000)]
    got = {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == "block" for i in range(3000) if i % 100 < 2)
    assert sum(v == "block" for v in got.values()) < 400


def test_clashing_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", "p", 3, "v")] * 2 + [(None, None, None, None, None, None)], "page_id long, url string, host string, path string, tokens int, verdict string")
    labels = spark.createDataFrame([(None, None, None), (1, None, 1)], "doc_id long, quality int, toxic int")
    got = sorted(((r.page_id or 0), r.host, r.path, r.verdict) for r in urls.judged(pages, labels).collect())
    assert got == [(0, "", "", "allow"), (1, "a.net", "/x", "block"), (1, "a.net", "/x", "block")]
