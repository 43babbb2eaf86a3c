import random
import re

from pyspark.sql import functions as F

from lodewatch.operators import supply


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def allowed(n, steps):
    return next(e for longest, e in steps if longest is None or n <= longest)


def words(n, seed, letters="abc"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)})


def test_similar_equals_all_pairs_compared(spark):
    for steps in (supply.EDITS, supply.ANY_LENGTH):
        names, targets = words(150, 1), words(150, 2)
        a = spark.createDataFrame([(x,) for x in [*names, names[3], None]], "name string")
        b = spark.createDataFrame([(x,) for x in [*targets, None]], "target string")
        got = {(r.name, r.target): r.distance for r in supply.similar(a, b, steps=steps).collect()}
        assert got == {(x, y): edits(x, y) for x in names for y in targets if edits(x, y) <= allowed(max(len(x), len(y)), steps)}


def test_a_million_names_meet_a_hundred_thousand_without_nested_loops(spark):
    name = F.concat(F.sha2(F.col("id").cast("string"), 256).substr(1, 8), F.lit("-pkg"))
    names, targets = spark.range(1_000_000).select(name.alias("name")), spark.range(100_000).select(name.alias("target"))
    plan = supply.similar(names, targets)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_typosquats_and_lookalikes(spark):
    popular = spark.createDataFrame([(x,) for x in ("lodash", "moment", "express", "React", "mom", "chalk", "l1st")], "target string")
    names = spark.createDataFrame([(x,) for x in ("lodahs", "Lodash", "@react", "rnoment", "expres", "xyz", "list", "", "moрment", None, "rnorn")], "name string")
    squats = {(r.name, r.target, r.distance) for r in supply.typosquats(names, popular).collect()}
    assert squats == {("lodahs", "lodash", 2), ("rnoment", "moment", 2), ("expres", "express", 1), ("list", "l1st", 1), ("moрment", "moment", 1)}
    like = {(r.name, r.target): (r.distance, r.severity) for r in supply.lookalikes(names, popular).collect()}
    assert like["rnoment", "moment"] == (0, "HIGH") and like["list", "l1st"] == (0, "HIGH") and like["lodahs", "lodash"] == (2, "LOW") and ("rnorn", "mom") not in like
    assert supply.lookalikes(names.limit(0), popular).count() == supply.typosquats(names, popular.limit(0)).count() == 0


PATHS = ["a.js", "src/a.js", "src/x/a.js", "src/x/b.ts", "srcs/a.js", "docs/src/a.js", "src", "lib/1/2/3/x.js", "lib\\1\\y.js", "a+b(c).js", ""]
PATTERNS = ["*", "*.js", "src", "src/", "src/**", "**/a.js", "**/src", "**/*.js", "src/*/a.js", "src/**/a.js", "lib/*/?/3/*.js", "a+b(c).*", "lib/1", "**/", "s*/x/b.ts", "/**", "src/x/b.??"]


def matches(pattern, path):
    path = path.replace("\\", "/")
    if pattern.startswith("**/"):
        return path.endswith(pattern[3:]) or "/" + pattern[3:] in path
    if pattern.endswith("/**"):
        return path.startswith(pattern[:-3])
    if "*" in pattern:
        rx = re.sub(r"([.+^$(){}|\[\]])", r"\\\1", pattern).replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", ".")
        return re.fullmatch(rx, path) is not None
    return path == pattern or path.startswith(pattern + "/")


def test_owned_equals_every_pattern_tested_on_every_path(spark):
    paths = spark.createDataFrame([(p, 1) for p in [*PATHS, PATHS[0], None]], "path string, kind int")
    patterns = spark.createDataFrame([(k, p, f"@t{k % 3}") for k, p in enumerate(PATTERNS)], "seq long, pattern string, owner string")
    found = supply.owned(paths, patterns)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.path, r.seq) for r in found.collect()}
    want = {(p, k) for p in PATHS if p for k, x in enumerate(PATTERNS) if matches(x, p)}
    assert {g for g in got if g[0]} == want
    last = {r.path: r.pattern for r in supply.last_owner(found).collect() if r.path}
    assert last == {p: PATTERNS[max(k for q, k in want if q == p)] for p in {q for q, _ in want}}
    authored = spark.createDataFrame([("src/a.js", "x", 5, 10), ("src/x/a.js", "x", 5, 10), ("src/x/a.js", "y", 1, 2), ("a.js", "z", 7, 7)], "path string, author string, findings long, risk long")
    held = spark.createDataFrame([("src/a.js", "@t"), ("src/a.js", "@t"), ("src/x/a.js", "@t"), ("a.js", "@u")], "path string, owner string")
    assert {tuple(r) for r in supply.teams(held, authored).collect()} == {("@t", 2, 11, 22), ("@u", 1, 7, 7)}
