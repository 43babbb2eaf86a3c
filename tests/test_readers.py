import json

from pyspark.sql import functions as F

from lodewatch.operators import scan
from lodewatch.sources import readers, writers

DIFF = """diff --git a/x.js b/x.js
--- a/x.js
+++ b/x.js
@@ -1,3 +10,4 @@
 same
-old
+eval(a)
+b
diff --git a/y.txt b/y.txt
--- a/y.txt
+++ b/y.txt
@@ -1 +1 @@
+hello
"""


def test_diff_to_findings(spark):
    df = readers.unified_diff(spark.createDataFrame([(1, DIFF)], "pr int, raw string"), "raw", "pr")
    lines = scan.patch_lines(df, "patch", "pr", "file")
    assert sorted((r.file, r.line, r.content) for r in lines.collect()) == [("x.js", 11, "eval(a)"), ("x.js", 12, "b"), ("y.txt", 1, "hello")]
    from lodewatch.operators.rules import LINE_RULES

    assert [r.subcode for r in scan.match(lines, LINE_RULES).collect()] == ["SAST-EVAL"]


def test_lock_files(spark):
    npm = json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.2", "resolved": "r", "integrity": "i"}, "node_modules/a/node_modules/@s/b": {"version": "2"}}})
    yarn = '# yarn lockfile v1\n\n"@s/b@^2":\n  version "2.1"\n  resolved "u"\n\na@^1, a@^1.1:\n  version "1.9"\n'
    df = spark.createDataFrame([("n", npm), ("y", yarn)], "file string, content string")
    from pyspark.sql import functions as F

    assert {r.file: r.f for r in df.select("file", readers.lock_format(F.col("content")).alias("f")).collect()} == {"n": "npm", "y": "yarn"}
    got = sorted((r.name, r.version) for r in readers.npm_lock(df.where("file = 'n'"), "content", "file").collect())
    assert got == [("@s/b", "2"), ("a", "1.2")]
    got = sorted((r.name, r.version) for r in readers.yarn_lock(df.where("file = 'y'"), "content", "file").collect())
    assert got == [("@s/b", "2.1"), ("a", "1.9")]


def test_audit_and_owners(spark):
    raw = json.dumps({"vulnerabilities": {"x": {"severity": "moderate", "via": [{"title": "T", "url": "https://e/GHSA-aaaa-bbbb", "severity": "high"}], "fixAvailable": True}}})
    r = readers.npm_audit(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.name, r.severity, r.title, r.advisory) == ("x", "HIGH", "T", "GHSA-aaaa-bbbb")
    owners = readers.codeowners(spark.createDataFrame([("# c\n*.js @a @b\n\nsrc/ mail@x\n",)], "content string")).collect()
    assert [(r.pattern, r.owner) for r in owners] == [("*.js", "@a"), ("*.js", "@b")]


def test_sarif_and_upsert(spark):
    findings = spark.createDataFrame([("f", 3, "S", "malware", "HIGH", 70), ("f", 4, "Z", "x", "LOW", 0)], "file string, line int, subcode string, category string, severity string, risk_score int")
    got = [json.loads(r.value) for r in writers.sarif_results(findings).collect()]
    assert len(got) == 1 and got[0]["level"] == "error" and got[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in writers.upsert(table, changes, ["k"], ["t"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_sessions_and_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"format": "v1", "metadata": {"id": "s1", "recordedAt": "2024-01-01T00:00:00Z"}, "events": [{"type": "flow", "data": "{}"}, {"type": "proc", "data": "{}"}]}))
    got = readers.sessions(spark, str(tmp_path / "s.json")).collect()
    assert [(r.session, r.seq, r.type) for r in got] == [("s1", 0, "flow"), ("s1", 1, "proc")]
    (tmp_path / "code" / "node_modules").mkdir(parents=True)
    (tmp_path / "code" / "a.js").write_text("x")
    (tmp_path / "code" / "node_modules" / "b.js").write_text("y")
    assert [r.content for r in readers.text_files(spark, str(tmp_path / "code"), "*.js").collect()] == ["x"]


def test_walks_count_only_what_is_below_their_root(spark, tmp_path):
    root = tmp_path / "node_modules" / "build" / "repo"
    paths = ["a.js", "src/a.js", "tests/a.js", "src/Docs/a.js", "node_modules/x/a.js", ".git/config", ".github/workflows/ci.yml", ".cursorrules", ".x.mdc", "src/.env", "a/b/c/d/e.sh", "a/b/c/e.sh", "package.json", "a/readme"]
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    seen = lambda kind: {r.content for r in readers.text_files(spark, str(root), kind=kind).collect()}
    hidden = {".cursorrules", ".x.mdc", "src/.env"}  # Spark lists no file whose name begins with a dot
    assert seen("corpus") == set(paths) - hidden
    assert seen("project") == set(paths) - hidden - {"tests/a.js", "src/Docs/a.js", "node_modules/x/a.js", ".git/config"}
    assert seen("package") == {"a.js", "src/a.js", "tests/a.js", "src/Docs/a.js", "a/b/c/d/e.sh", "a/b/c/e.sh", "package.json", "a/readme"}
    assert seen("dependency") == {"a.js", "src/a.js", "tests/a.js", "src/Docs/a.js", "a/b/c/e.sh", "package.json"}
    assert seen("tool") == {"a.js", "src/a.js", "tests/a.js", "src/Docs/a.js", "package.json"}
    assert [r.content for r in readers.text_files(spark, str(root) + "/", "*.sh", 10, "corpus").collect()] == ["a/b/c/e.sh"]


def test_times_at_any_depth(spark):
    text = '{"recordedAt": "2026-01-02T03:04:05Z", "at": "x", "a": [{"timestamp" : "2026-01-02", "b": {"closedAt": "no time", "note": "\\"timestamp\\": \\"2020-01-01\\""}}], "nAt": 5, "metaAt": {"timestamp": "2026-02-03 00:00:00"}}'
    rows = spark.createDataFrame([(text,), (None,), ("[]",)], "j string").select(readers.timestamps(F.col("j")).alias("t")).collect()
    assert [(p.key, p.value, p.at and p.at.isoformat()) for p in rows[0].t] == [
        ("recordedAt", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05"), ("timestamp", "2026-01-02", "2026-01-02T00:00:00"), ("closedAt", "no time", None), ("timestamp", "2026-02-03 00:00:00", "2026-02-03T00:00:00"),
    ]
    assert rows[1].t is None and rows[2].t == []
