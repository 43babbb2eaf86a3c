import re
import time

from lodewatch.operators import scan
from lodewatch.operators.rules import LANGUAGE_RULES, LINE_RULES
from lodewatch.plans.scan import AGENT_TEXT, CORPUS_RULES, PAGE_RULES


def codes(spark, line, rules):
    rows = scan.lines(spark.createDataFrame([(1, line)], "file int, text string"), "text", "file")
    return sorted(r.subcode for r in scan.match(rows, rules).collect())


def test_rules_see_whole_lines(spark):
    far = "x " * 6_000
    assert codes(spark, far + "eval(a)", LINE_RULES) == ["SAST-EVAL"]
    assert codes(spark, far + "me@x.org", CORPUS_RULES) == ["TXT-EMAIL"]
    assert codes(spark, "x" * 9_999 + "?" + far, AGENT_TEXT) == []
    patch = spark.createDataFrame([("f", f"@@ -0,0 +1 @@\n+{far}eval(a)")], "file string, patch string")
    assert [r.content for r in scan.patch_lines(patch, "patch", "file").collect()] == [f"{far}eval(a)"]


def test_long_runs_cost_no_square_time(spark):
    rules = [*LINE_RULES, *CORPUS_RULES, *PAGE_RULES, *AGENT_TEXT, *(r for found in LANGUAGE_RULES.values() for r in found)]
    start = time.monotonic()
    assert codes(spark, "a" * 200_000, rules) == []
    assert codes(spark, "a" * 200_000 + "@x.org", rules) == ["TXT-EMAIL"]
    assert codes(spark, r"\x41" * 20_000, rules) == ["OBF-PAYLOAD"]
    assert time.monotonic() - start < 40


def test_tested_patterns():
    assert scan.tested(r"[a-z.+-]+@[a-z]+") == r"[a-z.+-]@[a-z]+"
    assert [scan.tested(p) for p in (r"[a]++b", r"[a]+?b", r"a+b", r"^[a]+b")] == [r"[a]++b", r"[a]+?b", r"a+b", r"^[a]+b"]


def test_files_are_matched_once_for_lines_and_their_tokens(spark):
    from lodewatch.operators import scan

    rows = spark.createDataFrame([("a.js", "x = 'ghp_" + "a1" * 18 + "'")], "path string, text string")
    found = scan.scan_files(rows, "path", "text")
    assert sorted((r.phase, r.subcode, r.line) for r in found.collect()) == [(1, "SEC-GITHUB-TOKEN", 1), (3, "TOK-CLASS", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_lines_hold_what_their_patterns_need(spark):
    from lodewatch.plans.code import LANGUAGE_LINES, SAMPLES

    rules = [*LINE_RULES, *[r for own in LANGUAGE_RULES.values() for r in own]]
    for text in [*SAMPLES, *LANGUAGE_LINES]:
        for line in text.split("\n"):
            for r in rules:
                if re.search(r.pattern.replace(r"\z", r"\Z"), line) and (sure := scan.needed(r.pattern)):
                    assert any(t in line.lower() for t in sure), (r.subcode, line)
    assert scan.needed(r"(?i)Sudo\s+(?:alpha|beta)") == ["sudo"] and scan.needed(r"(?:alpha)?\s*(?:beta|g.)") == [] and scan.needed(r"(?:alpha)*b|c") == []
    assert sum(bool(scan.needed(r.pattern)) for r in LINE_RULES) > 40
    plan = scan.match(spark.createDataFrame([(1, "x = EVAL(y)")], "file long, content string"), LINE_RULES)
    assert plan.collect() == []
