"""Code without its strings and comments, over the lines of a file, and the filter that needs it.

What a line leaves open (a template, a block comment, a string whose last character escapes the line
end) goes on in the next. A line is a function from the state it is entered in to the state it is
left in. Where a file has several blocks of lines, the functions are composed block by block and the
blocks in turn, which gives the state that each block is entered in; then every block is masked line by
line. A task sees a block's lines in order, a batch at a time, so it holds neither a block nor a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import settle

#: States: code, the three kinds of quotes, and from COMMENT on block comments by their depth.
CODE, COMMENT = 0, 4
QUOTES = {"'": 1, '"': 2, "`": 3}
TEMPLATE = 3
_STOPS = {
    CODE: re.compile(r"//|/\*|(?:(?<=[ \t])|^)#|['\"`]|\\"),
    **{state: re.compile(rf"\\|{mark}") for mark, state in QUOTES.items()},
    COMMENT: re.compile(r"/\*|\*/"),
}
_ANY = re.compile(r"[/'\"`#\\*]")

#: Lines whose functions are composed in one task.
BLOCK = 4096


def scan(line: str, state: int) -> tuple[str, int]:
    """The line with what is no code blanked, and the state of the next line."""
    out: list[str] = []
    at, end = 0, len(line)
    while at < end:
        stop = _STOPS[min(state, COMMENT)].search(line, at)
        to = stop.start() if stop else end
        out.append(line[at:to] if state == CODE else " " * (to - at))
        if not stop:
            at = end
            break
        mark, at = stop[0], stop.end()
        if mark == "\\":
            escaped = line[at : at + 1]
            out.append(mark + escaped if state == CODE else " " * (1 + len(escaped)))
            at += 1  # beyond the end if it is the line's end that is escaped
            continue
        out.append(" " * len(mark))
        if mark in ("//", "#"):
            out.append(" " * (end - at))
            at = end
        elif mark == "/*":
            state = state + 1 if state >= COMMENT else COMMENT
        elif mark == "*/":
            state = state - 1 if state > COMMENT else CODE
        else:
            state = CODE if state else QUOTES[mark]
    goes_on = state == CODE or state >= TEMPLATE or at > end
    return "".join(out), state if goes_on else CODE


def function(line: str) -> list[int]:
    """[change of depth, exit of state 0, of state 1, ...]: deeper comments than listed only change their depth."""
    if not _ANY.search(line):
        return [0, CODE, CODE, CODE, TEMPLATE]
    depths = line.count("*/") + 1
    exits = [scan(line, state)[1] for state in range(COMMENT + depths)]
    return trimmed([exits[-1] - (COMMENT + depths - 1), *exits])


def trimmed(f: list[int]) -> list[int]:
    """Without the listed depths that the change alone gives."""
    while len(f) > 1 + COMMENT and f[-1] == len(f) - 2 + f[0] and f[-1] >= COMMENT:
        f = f[:-1]
    return f


def applied(f: Sequence[int], state: int) -> int:
    return f[state + 1] if state + 1 < len(f) else state + f[0]


def composed(f: Sequence[int], g: Sequence[int]) -> list[int]:
    """First f, then g."""
    depths = len(f) - 1 - COMMENT + max(len(g) - 1 - COMMENT, 0)
    return trimmed([f[0] + g[0], *(applied(g, applied(f, s)) for s in range(COMMENT + depths))])


IDENTITY = [0, 0, 1, 2, 3]


def in_turn(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run gives for the rows, which it sees dealt by the keys and sorted by keys and order: those of a group follow each other, over batches."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def keyed(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple]:
    return zip(*(batch.column(k).to_pylist() for k in keys), strict=True)


def kinds(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def entry_states(lines: DataFrame, by: Sequence[str], line: str, content: str, block: int = BLOCK) -> DataFrame:
    """lines with `__block`, and a row more, of by, `__block` and the state `__entered`, for each block that is not entered as code.

    Only files of more than one block are composed: a block in a task, then the blocks of a file in turn.
    """
    by = list(by)
    keys = [*by, "__block"]
    rows = lines.withColumn("__block", F.floor(F.col(line) / block))
    span = rows.groupBy(*[F.col(k).alias(f"__of_{k}") for k in by]).agg(F.min("__block").alias("__low"), F.max("__block").alias("__high")).where("__low < __high")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in by])
    long = rows.select(*keys, line, content).join(span, same, "left_semi")

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, IDENTITY
        for batch in batches:
            done: list[tuple[tuple, list[int]]] = []
            for key, text in zip(keyed(batch, keys), batch.column(content).to_pylist(), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, total))
                    last, total = key, IDENTITY
                total = composed(total, function(text or ""))
            yield of(done)
        if last is not None:
            yield of([(last, total)])

    def of(done: list[tuple[tuple, list[int]]]) -> pa.RecordBatch:
        named = [pa.array([key[i] for key, _ in done], arrow[k]) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*named, pa.array([f for _, f in done], pa.list_(pa.int32()))], names=[*keys, "f"])

    arrow = {k: to_arrow_type(rows.schema[k].dataType) for k in keys}
    blocks = in_turn(long, keys, [F.col(line)], of_blocks, f"{kinds(rows, keys)}, f array<int>")

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, CODE
        for batch in batches:
            states = []
            for key, f in zip(keyed(batch, by), batch.column("f").to_pylist(), strict=True):
                if key != last:
                    last, state = key, CODE
                states.append(state)
                state = applied(f, state)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(states, pa.int32())], names=[*keys, "__entered"])

    starts = in_turn(blocks, by, [F.col("__block")], of_files, f"{kinds(rows, keys)}, __entered int").where(F.col("__entered") != CODE)
    return rows.unionByName(starts, allowMissingColumns=True)


def masked_lines(lines: DataFrame, by: Sequence[str], line: str = "line", content: str = "content") -> DataFrame:
    """lines with `entered`, the state a line is entered in, and `code`, the line with strings and comments blanked.

    Blanks stand one to one for what they cover. `//` and a `#` that stands first or after a blank
    end a line's code, `/* */` nest, quotes end with their line unless its end is escaped, templates
    and comments go on. A null line is empty. by and line number the lines of a file from any number
    on; repeated numbers of one file are undefined, as is their order. An empty table gives no rows.
    """
    names = [c for c in lines.columns if c not in ("entered", "code")]
    keys = [*by, "__block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, CODE
        for batch in batches:
            kept, entered, code = [], [], []
            for key, text, begun in zip(keyed(batch, keys), batch.column(content).to_pylist(), batch.column("__entered").to_pylist(), strict=True):
                if key != last:
                    last, state = key, CODE
                kept.append(begun is None)
                if begun is not None:  # no line: the state of the block's first
                    state = begun
                    continue
                text = text or ""
                entered.append(state)
                if state != CODE or _ANY.search(text):
                    text, state = scan(text, state)
                code.append(text)
            own = batch if all(kept) else batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(entered, pa.int32()), pa.array(code, pa.string())], names=[*names, "entered", "code"])

    rows = entry_states(lines.select(*names), by, line, content)
    return in_turn(rows, keys, [F.col("__entered").asc_nulls_last(), F.col(line)], run, f"{kinds(lines, names)}, entered int, code string")


# Folders and names of tests, kinds that must stand in code, words of attacks and of calls that run things.
TEST_FOLDERS = ("__tests__", "__mocks__", "__snapshots__", "test", "tests", "fixtures", "mocks", "examples", "example", "benchmarks")
TEST_NAME = r"(?i)\.(?:test|spec|fixture|stories?)\."
CODE_KINDS = (
    "NETWORK_ACTIVITY", "WORKFLOW_RISK", "OS_CAPABILITY", "OS_COMMAND", "UNSAFE_EVAL", "LIFECYCLE_CURL_BASH", "SHELL_PIVOT", "DYNAMIC_CODE",
    "EXEC_RISK", "PERSISTENCE", "MALICIOUS", "INJECTION", "SUSPICIOUS",
)
ATTACK_WORDS = (
    "curl", "wget", "eval", "exec", "execSync", "execFile", "execFileSync", "execFileAsync", "spawn", "spawnSync", "spawnAsync", "popen", "subprocess",
    "fetch", "axios", "websocket", "xmlhttprequest", "bash", "sh", "powershell", "cmd.exe", "cmd /c", "iwr", "invoke-webrequest", "child_process", "node -e",
    "base64", "fromcharcode", "readfile", "writefile", "unlink", "screenshot", "clipboard", "smtp",
)
ATTACK_PIECES = ("system(", "fork(", "http.", "https.", "net.", "require(", "function(")
RUNS = r"(?i)\b(?:exec(?:Sync|File(?:Sync|Async)?|Async)?|eval|spawn(?:Sync|Async)?|popen|system|child_process|subprocess)\b"
SECRET_CATEGORIES = ("secret", "secrets", "token")
SECRET_KINDS = r"^(?:SECRET|TOKEN|CREDENTIAL|PASSWORD|API_?KEY|ENV_FILE|SSH)"
ENV_READ, ENV_USED = r"process\.env\.[A-Za-z_][A-Za-z0-9_]*", r"console\.(?:log|error|warn)\s*\(|fetch\s*\(|\.writeFile|exec\s*\(|spawn\s*\("
PATTERN_DEFINED = r"\bregex\s*:|\bRegExp\s*\("


def in_tests(path: Column) -> Column:
    folders = F.split(F.lower(path), r"[\\/]")
    return F.coalesce(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in TEST_FOLDERS])) | path.rlike(TEST_NAME), F.lit(False))


def has_attack_word(code: Column) -> Column:
    words = "|".join(re.escape(w) for w in ATTACK_WORDS)
    pieces = "|".join(re.escape(p) for p in ATTACK_PIECES)
    return code.rlike(rf"(?i)\b(?:{words})\b|{pieces}")


def semantic_filter(findings: DataFrame, lines: DataFrame, by: Sequence[str], line: str = "line", content: str = "content") -> DataFrame:
    """findings with `keep` and `reason`: those in tests, in detectors' own patterns, in harmless reads or only in strings and comments go.

    findings have by, line, type, category; the last of by is the path. lines are all lines of the files.
    Findings of the whole file (line 0 or null) and those whose line is missing or blank stay. If a
    file's code runs things anywhere, a word of an attack in a string stays: it may be what is run.
    """
    path = F.col(by[-1])
    code = masked_lines(lines.select(*by, line, content), by, line, content)
    at = settle(code.select(*by, line, F.col(content).alias("__line"), has_attack_word(F.col("code")).alias("__attack"), F.col("code").rlike(RUNS).alias("__run")))  # read twice, masked once
    runs = at.groupBy(*by).agg(F.bool_or("__run").alias("__runs"))
    rows = findings.join(at.drop("__run"), [*by, line], "left").join(runs, list(by), "left")
    kind, text, attack = F.upper(F.coalesce("type", F.lit(""))), F.coalesce("__line", F.lit("")), F.coalesce("__attack", F.lit(False))
    secret = F.lower(F.coalesce("category", F.lit(""))).isin(*SECRET_CATEGORIES) | kind.rlike(SECRET_KINDS)
    in_data = kind.isin(*CODE_KINDS) & ~attack
    reason = (
        F.when(in_tests(path), "test path")
        .when(secret, "secret")
        .when(F.coalesce(F.col(line), F.lit(0)) == 0, "whole file")
        .when(F.trim(text) == "", "no line")
        .when(text.rlike(PATTERN_DEFINED), "pattern defined")
        .when(kind.contains("ENV") & text.rlike(ENV_READ) & ~text.rlike(ENV_USED), "harmless read")
        .when(in_data & has_attack_word(text) & F.coalesce("__runs", F.lit(False)), "may be run")
        .when(in_data, "string or comment")
        .otherwise("code")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("keep", ~F.col("reason").isin("test path", "pattern defined", "harmless read", "string or comment")).select(*findings.columns, "keep", "reason")
