import hashlib
import random
import re

from lodewatch.llm import pii

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def brute(text):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text) if valid(kind, m[0])]
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def texts():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "@x.de", ".", "-", "_", "+", "+4", "1", "12", "255", "256", "0", " ", "\n", "(", ")", "é", "😀", "%", "x@y.z.w", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "\x01", "٣", "token = \"", "9" * 13]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    fixed = [None, "", "a@b.c_d@e.f.g", "a@b@c.d@e.f", "1.2.3.4.5.6.7.8", "001.0002.3.0255", "1.2.3.99999999999999999999", "9" * 20000, "a." * 20000, "a" * 50000 + "@", "+1" + " 2" * 7, "+" * 500, "1 " * 20000, "x@y" + ".z" * 5000]
    return fixed + made


def test_base_spans_against_brute_force(spark):
    rows = [(i, t, "e") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(4)
    got = {r.doc_id: r.found for r in pii.private_spans(docs.drop("base")).select("doc_id", pii.listed(pii.F.col("base")).alias("found")).collect()}
    for i, text, _ in rows:
        assert got[i] == ",".join(brute(text)), repr(text)[:300]


def identifiers(n):
    return [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(n)]


def test_trusted_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f'Some words before token = "{key}" and after.') for i, key in enumerate(identifiers(40))]
    rows += [(100 + i, f"Write to mail: user{i}@example.org today") for i in range(30)]
    rows += [(200, 'also token = "ACME-77-XQ9-new" here'), (201, "Write to mail: jane(at)example7 today"), (202, "room 1234567 chapter: abc1234"), (203, "nothing")]
    rows += [(300 + i, f"chapter: part{rng.randrange(10**6)}x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.found for r in pii.private_spans(docs).select("doc_id", pii.listed(pii.F.col("spans")).alias("found")).collect()}
    text = dict(rows)

    def values(i):
        return [text[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].split(",") if x)]

    assert all(values(i) == [key] for i, key in enumerate(identifiers(40)))
    assert values(200) == ["ACME-77-XQ9-new"] and values(201) == ["jane(at)example7"]
    assert got[202] == got[203] == "" and all(got[300 + i] == "" for i in range(30))


def test_redaction(spark):
    rows = [(1, "é me@x.org and +1 (499) 555-6503.", "en", "s", 30), (2, None, "en", "s", 0), (3, "clean", "en", "s", 5), (None, "ip 1.2.3.4", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.without_private_data(spark, docs, "").collect()}
    assert got == {1: ("é <EMAIL> and <PHONE>.", 22), 2: (None, None), 3: ("clean", 5), None: ("ip <IP>", 7)}


def test_no_python_in_the_plan_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.private_spans(docs).count() == 0
    plan = pii.base_spans(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def values_in(spark, texts):
    found = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r.candidates for r in found.collect()}
    return [[t[c.start : c.end] for c in rows[i]] for i, t in enumerate(texts)]


def test_long_identifiers_are_taken_whole(spark):
    keys = [hashlib.sha512(str(i).encode()).hexdigest() for i in range(8)]
    late = "x" * 90 + "7"
    rows = [(i, f'set token = "{key}" now', "en", "s", 0) for i, key in enumerate(keys)] + [(8, f'set token = "{late}" now', "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r.doc_id: r.found for r in pii.private_spans(docs).select("doc_id", pii.listed(pii.F.col("spans")).alias("found")).collect()}
    assert [spans[i].split(",")[-1] for i in range(8)] == ["id:13:141"] * 8 and spans[8] == "id:13:104"
    assert {r.text for r in pii.without_private_data(spark, docs, "").collect()} == {'set token = "<ID>" now'}


def test_candidates_have_a_digit_of_their_own_in_linear_time(spark):
    run = "ab:cd/" * 50_000
    assert values_in(spark, ['see: token: abc1234', 'name=token="abc123def"', 'token="abcdefgh",1', f"{run}key: abc1234", f'{run}key="abc1234"', f"{run}1", "token=" + "." * 100_000 + "a1", "token=a" + "." * 200_000 + "1.)"]) == [
        ["abc1234"], ["abc123def"], [], ["abc1234"], ["abc1234"], [run[3:] + "1"], [], ["a" + "." * 200_000 + "1"]
    ]


def brute_accepted(pairs):
    """Patterns accepted among (pattern, value, seed), round by round."""
    sure = {v: 0.0 for _, v, _ in pairs} | {v: 1.0 for _, v, seed in pairs if seed}
    accepted = {}
    while True:
        new = {}
        for p in {p for p, _, _ in pairs} - set(accepted):
            has = [sure[v] for v in {v for q, v, _ in pairs if q == p}]
            score = sum(has) / (len(has) + pii.DOUBT)
            if score >= pii.LEAST_SCORE and sum(c >= pii.LEAST_SCORE for c in has) >= pii.LEAST_SEEDS:
                new[p] = score
        if not new:
            return set(accepted)
        accepted |= new
        for p, v, _ in pairs:
            sure[v] = max(sure[v], new.get(p, 0.0))


def test_bootstrapping_goes_on_from_found_instances_only(spark):
    keys = identifiers(200)
    # plain values trusted through `token:` alone; `serial:` and then `badge:` have no seed themselves
    plain = [f"AC-{i}-zz" for i in range(20)]
    more = [f"BD-{i}-yy" for i in range(3)]
    uses = [("token:", k) for k in keys] + [("token:", v) for v in plain] + [("serial:", v) for v in [*plain, *more]]
    last = [f"CE-{i}-xx" for i in range(2)]
    uses += [("badge:", v) for v in [*plain, *more, *last]]
    # a third of the values are seeds: no round may make this label trusted
    uses += [("chapter:", k) for k in identifiers(220)[200:]] + [("chapter:", f"part{i}x") for i in range(40)]
    docs = spark.createDataFrame([(i, f"some {label} {value}") for i, (label, value) in enumerate(uses)], "doc_id long, text string")
    got = {r.pattern.strip() for r in pii.accepted_patterns(pii.marked(pii.base_spans(docs).withColumn("__row", pii.F.monotonically_increasing_id()))).collect()}
    hexes = set(keys) | set(identifiers(220))
    assert got == brute_accepted([(p, v, v in hexes) for p, v in uses]) and "chapter:" not in got and got == {"token:", "serial:", "badge:"}


def test_rows_that_share_an_id_keep_their_own_text(spark):
    rows = [(1, "write to aa@b.org now", "s"), (1, "another text without it at all ok", "s"), (None, "ip 1.2.3.4", "s"), (1, "write to aa@b.org now", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").selectExpr("doc_id", "text", "'en' lang", "base as source", "1L n_chars", "7 base", "'k' spans")
    got = pii.without_private_data(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == ["another text without it at all ok", "ip <IP>", "write to <EMAIL> now", "write to <EMAIL> now"]


def test_a_text_with_very_many_matches(spark):
    text = " ".join(f"u{i}@x.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.private_spans(docs).select(pii.listed(pii.F.col("base")).alias("found")).first().found
    assert spans == ",".join(brute(text))
