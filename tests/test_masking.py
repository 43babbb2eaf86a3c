import random

from lodewatch.operators import masking

PIECES = ["a", "b", " ", "/", "*", "/*", "*/", "'", '"', "`", "\\", "#", "\n", "\n", " #", "//", "eval(x)"]


def plain(text):
    """A character at a time over the whole text."""
    out, state, depth, i = [], "code", 0, 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        n = 1
        if c == "\n":
            if state in ("line", "'", '"'):
                state = "code"
            out.append(c)
        elif state == "code" and two == "//" or state == "code" and c == "#" and (i == 0 or text[i - 1] in " \t\n"):
            state = "line"
            out.append(" ")
        elif state == "code" and two == "/*" or state == "comment" and two in ("/*", "*/"):
            depth, n = depth + (1 if two == "/*" else -1), 2
            state = "comment" if depth else "code"
            out.append("  ")
        elif c == "\\" and state != "comment" and state != "line":
            n = 2
            out.append(two if state == "code" else "".join(x if x == "\n" else " " for x in two.replace("\\", " ", 1)))
        elif c in "'\"`" and state in ("code", c):
            state = c if state == "code" else "code"
            out.append(" ")
        else:
            out.append(c if state == "code" else " ")
        i += n
    return "".join(out)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_lines_and_their_functions_equal_one_pass_over_the_text():
    for text in texts(4000):
        state, total, out = masking.CODE, masking.IDENTITY, []
        for line in text.split("\n"):
            assert masking.applied(total, masking.CODE) == state
            assert [masking.applied(masking.function(line), s) for s in range(9)] == [masking.scan(line, s)[1] for s in range(9)]
            total = masking.composed(total, masking.function(line))
            code, state = masking.scan(line, state)
            out.append(code)
        assert "\n".join(out) == plain(text), repr(text)


def test_masked_lines_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(masking.entry_states, "__defaults__", (3,))
    files = dict(enumerate(texts(60, 2)))
    files[1000] = "\n".join(texts(200, 3))
    rows = [(f, k, line, "x") for f, text in files.items() for k, line in enumerate(text.split("\n"))] + [(5000, 1, "`", "x"), (5000, 2, None, "x"), (5000, 3, "eval(y)", "x"), (None, 1, "/*", "x")]
    frame = spark.createDataFrame(rows, "file long, line int, content string, block string")
    got = {}
    for r in masking.masked_lines(frame, ["file"]).collect():
        assert r.block == "x"
        got.setdefault(r.file, {})[r.line] = r.code
    for f, text in files.items():
        assert "\n".join(code for _, code in sorted(got[f].items())) == plain(text)
    assert got[5000] == {1: " ", 2: "", 3: " " * 7}
    assert masking.masked_lines(frame.limit(0), ["file"]).count() == 0


LINES = ["const a = 1 /* eval(x)", "eval(y) */ b", "s = 'curl x'", "eval(z)", "k.regex: /eval/", "process.env.HOME", "fetch(process.env.HOME)"]
FINDINGS = [
    ("src/a.js", 1, "UNSAFE_EVAL", "exec", False, "string or comment"), ("src/a.js", 2, "UNSAFE_EVAL", "exec", False, "string or comment"), ("src/a.js", 3, "NETWORK_ACTIVITY", "net", False, "string or comment"),
    ("src/b.js", 1, "UNSAFE_EVAL", "exec", True, "may be run"), ("src/b.js", 4, "UNSAFE_EVAL", "exec", True, "code"), ("src/b.js", 5, "UNSAFE_EVAL", "exec", False, "pattern defined"),
    ("src/b.js", 6, "ENV_READ", "env", False, "harmless read"), ("src/b.js", 7, "ENV_READ", "env", True, "code"), ("src/b.js", 0, "UNSAFE_EVAL", "exec", True, "whole file"), ("src/b.js", 99, "UNSAFE_EVAL", "exec", True, "no line"),
    ("test/b.js", 4, "UNSAFE_EVAL", "exec", False, "test path"), ("src/b.spec.js", 4, "TOKEN_RISK", "token", False, "test path"), ("src/b.js", 3, "TOKEN_RISK", "token", True, "secret"), ("src/b.js", None, None, None, True, "whole file"),
]


def test_filter_drops_what_stands_in_masked_text(spark):
    lines = [(p, k, x) for p, n in (("src/a.js", 3), ("src/b.js", 7), ("test/b.js", 7)) for k, x in enumerate(LINES[:n], 1)]
    found = spark.createDataFrame([(*f[:4], i) for i, f in enumerate(FINDINGS)], "path string, line int, type string, category string, i int")
    got = {r.i: (r.keep, r.reason) for r in masking.semantic_filter(found, spark.createDataFrame(lines, "path string, line int, content string"), ["path"]).collect()}
    assert got == {i: (f[4], f[5]) for i, f in enumerate(FINDINGS)}


def test_groups_are_streamed_and_not_handed_over_whole(spark):
    rows = spark.createDataFrame([(1, k, "`" if k == 2 else "x") for k in range(1, 9)], "file long, line int, content string")
    masked = masking.masked_lines(rows, ["file"])
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    assert [r.code for r in masked.orderBy("line").collect()] == ["x", *[" "] * 7]
