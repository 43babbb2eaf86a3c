"""Process trees, timelines and compiler calls of many builds at once.

processes: (by, pid, ppid, name, command, ts, ...); pid is unique within a build. Trees are walked a
level a round for all builds together, to a given depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from ..functions.text import basename

DEEPEST = 10
# Compilers and linkers, flags that weaken a program, and endings of their inputs.
COMPILERS = ["gcc", "g++", "cc", "c++", "clang", "clang++", "rustc", "javac", "go", "tsc", "cl", "cl.exe", "ld", "ld.lld", "lld-link", "link", "link.exe", "ar"]
WEAK_FLAGS = ["-fplugin", "-fmodules", "-fno-stack-protector", "-fno-pie", "-no-pie", "-z execstack", "-Wl,--enable-new-dtags", "-Wl,-rpath,"]
INPUTS = ["c", "cc", "cpp", "cxx", "c++", "m", "mm", "rs", "java", "go", "s", "asm", "o", "obj", "a", "lib", "rlib"]
# What a tool does in a build.
TOOL_STEPS = {
    "configure": "configure", "autoconf": "configure", "automake": "configure", "cmake": "configure", "meson": "configure", "gcc": "compile", "g++": "compile", "clang": "compile", "clang++": "compile", "cc": "compile", "c++": "compile",
    "ld": "link", "link": "link", "ld.lld": "link", "lld-link": "link", "ar": "archive", "lib.exe": "archive", "ranlib": "archive", "strip": "strip", "objcopy": "strip", "make": "build-system", "ninja": "build-system", "nmake": "build-system",
    "python": "generate-script", "python3": "generate-script", "node": "generate-script", "curl": "download", "wget": "download", "docker": "containerize", "podman": "containerize", "tar": "package", "zip": "package",
}
# Stages by the elapsed share of a build.
STAGES = [(0.1, "initialization"), (0.3, "configuration"), (0.7, "compilation"), (None, "finalization")]
UPLOAD_BYTES = 4096


def spawned(processes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, src, dst, confidence, degradation: parent to child, where the parent was seen first."""
    parent = processes.select(*by, F.col("pid").alias("ppid"), F.col("ts").alias("parent_ts"))
    rows = processes.where("ppid <> pid").join(parent, [*by, "ppid"]).where("parent_ts <= ts")
    return rows.select(*by, F.col("ppid").alias("src"), F.col("pid").alias("dst"), F.lit(95).alias("confidence"), F.lit(0.05).alias("degradation"))


def tree(processes: DataFrame, by: Sequence[str], deepest: int = DEEPEST) -> DataFrame:
    """by, pid, name, depth, root, place: each process below a root (one whose parent is not there), to a depth.

    place orders a build's processes as a walk does that takes a parent before its children and
    children by time, then pid.
    """
    by = list(by)
    rows = settle(processes.select(*by, "pid", "ppid", "name", "ts"))
    step = F.format_string("%020d.%012d/", "ts", "pid")
    known = rows.select(*by, F.col("pid").alias("ppid"))
    roots = rows.where("ppid <> pid").join(known, [*by, "ppid"], "left_anti").unionByName(rows.where("ppid = pid"))
    level = settle(roots.select(*by, "pid", "name", F.lit(0).alias("depth"), F.col("pid").alias("root"), step.alias("place")))
    levels = [level]
    for n in range(1, deepest + 1):
        above = level.select(*by, F.col("pid").alias("ppid"), "root", F.col("place").alias("above"))
        below = rows.where("ppid <> pid").join(above, [*by, "ppid"])
        level = settle(below.select(*by, "pid", "name", F.lit(n).alias("depth"), "root", F.concat("above", step).alias("place")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def descendants(placed: DataFrame, by: Sequence[str], roots: DataFrame) -> DataFrame:
    """The processes below chosen roots (by, root), themselves included."""
    return placed.join(roots.select(*by, "root").distinct(), [*by, "root"], "left_semi")


def tree_signature(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, dna: a hash of the names of a build's tree in the order of a walk, each after as many blanks as it is deep."""
    listed = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "depth", "name"))).alias("t"))  # a row a process of one build
    lines = F.transform("t", lambda x: F.concat(F.repeat(F.lit(" "), x["depth"]), x["name"]))
    return listed.select(*by, F.size("t").alias("processes"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("dna"))


def chain_strings(placed: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, leaf, chain: the names from a root to each process that started no other."""
    by = list(by)
    parents = edges.select(*by, F.col("src").alias("pid")).distinct()
    pids = F.transform(F.filter(F.split("place", "/"), lambda x: x != ""), lambda x: F.element_at(F.split(x, r"\."), 2).cast("long"))
    leaves = placed.join(parents, [*by, "pid"], "left_anti").select(*by, F.col("pid").alias("leaf"), F.posexplode(pids).alias("pos", "pid"))
    named = leaves.join(placed.select(*by, "pid", "name"), [*by, "pid"])
    return named.groupBy(*by, "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " > ").alias("chain"))  # as long as a tree is deep


def timelines(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Events (by, pid, ts, seq, kind) with idx, their place in the process's timeline."""
    return events.withColumn("idx", F.row_number().over(Window.partitionBy(*by, "pid").orderBy("ts", "seq")) - 1)


def exfil_timelines(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, pid, secrets, uploads, bytes, span: processes that read a secret and used the network."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    rows = events.groupBy(*by, "pid").agg(n("SECRET_READ").alias("secrets"), n("NETWORK_UPLOAD").alias("uploads"), (F.max("ts") - F.min("ts")).alias("span"))
    return rows.where("secrets > 0 and uploads > 0").select(*by, "pid", "secrets", "uploads", (F.col("uploads") * UPLOAD_BYTES).alias("bytes"), "span")


def stage(share: Column) -> Column:
    out = F.lit(STAGES[-1][1])
    for least, name in reversed(STAGES[:-1]):
        out = F.when(share < least, name).otherwise(out)
    return out


def exits(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, sample, gone: the pids of the sample before that a sample no longer has; samples have the array pids."""
    before = F.lag("pids").over(Window.partitionBy(*by).orderBy("sample"))
    gone = F.array_sort(F.array_except("before", "pids"))
    return samples.withColumn("before", before).where("before is not null").select(*by, "sample", F.array_join(gone.cast("array<string>"), ",").alias("gone")).where("gone <> ''")


def arguments(command: Column) -> Column:
    """array<string>: the words of a command line; quotes keep blanks together and go."""
    words = F.regexp_extract_all(command, F.lit(r"((?:[^ \"']|\"[^\"]*\"|'[^']*')+)"), F.lit(1))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[\"']", "")), lambda w: w != "")


def compiler_calls(processes: DataFrame, *keys: str) -> DataFrame:
    """keys, tool and the arrays flags, defines, includes, inputs, outputs, response of each compiler or linker call; stdin, memfd."""
    rows = processes.where(F.col("name").isin(*COMPILERS)).select(*keys, F.col("name").alias("tool"), "command", arguments(F.col("command")).alias("argv"))
    at = lambda test: F.filter("argv", test)
    ending = lambda a: F.lower(F.element_at(F.split(a, r"\."), -1))
    plain = lambda a: ~a.startswith("-") & ~a.startswith("@") & ~a.startswith("/Fo") & ~a.startswith("/I")
    dash_o = F.array_position("argv", "-o")
    named = F.when(dash_o > 0, F.array_compact(F.array(F.try_element_at("argv", (dash_o + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "response": at(lambda a: a.startswith("@")),
            "defines": at(lambda a: a.startswith("-D")),
            "includes": at(lambda a: a.startswith("-I") | a.startswith("/I")),
            "flags": at(lambda a: a.startswith("-") & ~a.startswith("-D") & ~a.startswith("-I") & (a != "-o")),
            "inputs": at(lambda a: plain(a) & a.contains(".") & ending(a).isin(*INPUTS)),
            "outputs": F.concat(F.transform(at(lambda a: a.startswith("/Fo")), lambda a: F.substr(a, F.lit(4))), named),
        }
    )
    stdin = F.array_contains("argv", "-") | F.col("command").contains(" -c ") | F.col("command").contains(" -x c")
    rows = rows.withColumn("stdin", stdin).withColumn("memfd", (F.size("inputs") == 0) & ~F.col("stdin") & (F.size("argv") > 1))
    return rows.drop("argv", "command")


def weak_flags(calls: DataFrame, *keys: str) -> DataFrame:
    """keys, tool, flag: each weakening flag that a call has."""
    has = lambda f: F.exists("flags", lambda a: a.contains(f))
    return calls.select(*keys, "tool", F.explode(F.array_compact(F.array(*[F.when(has(f), F.lit(f)) for f in WEAK_FLAGS]))).alias("flag"))


def tool_chain(processes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, chain: what a build does, step by step, each at its first tool."""
    from .scan import lookup

    rows = processes.withColumn("step", lookup(F.col("name"), TOOL_STEPS, None)).where("step is not null and pid <> 0")
    first = rows.groupBy(*by, "step").agg(F.min(F.struct("ts", "pid")).alias("at"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"]), ">").alias("chain"))  # a row a step


def producers(artifacts: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, artifact, producer: the first edge (by seq) whose label is the artifact's file name."""
    named = artifacts.withColumn("label", basename(F.col("artifact")))
    first = edges.groupBy(*by, "label").agg(F.min_by("src", "seq").alias("producer"))
    return named.join(first, [*by, "label"], "left").select(*by, "artifact", "producer")


# What an edge from a tool to what it wrote is called, by the tool's step.
EDGE_KINDS = {"compile": "compiled", "link": "linked", "archive": "archived", "generate-script": "generated", "download": "downloaded"}


def provenance(reads: DataFrame, writes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, src, dst, kind, n: files to the tools that read them, and tools to the files they wrote, by what the tool does.

    reads and writes: (by, tool, file).
    """
    from .scan import lookup

    step = lookup(F.col("tool"), TOOL_STEPS, "")
    into = reads.select(*by, F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("tool:"), "tool").alias("dst"), F.lit("read").alias("kind"))
    out = writes.select(*by, F.concat(F.lit("tool:"), "tool").alias("src"), F.concat(F.lit("file:"), "file").alias("dst"), lookup(step, EDGE_KINDS, "produced").alias("kind"))
    return into.unionByName(out).groupBy(*by, "src", "dst", "kind").agg(F.count("*").alias("n"))


def causal_dag(placed: DataFrame, by: Sequence[str], attached: dict[str, DataFrame]) -> DataFrame:
    """by, kind, label, parent, depth: the process tree with what hangs on its processes, one deeper.

    attached: a kind and its rows (by, pid, label), such as files, artifacts and connections.
    """
    own = placed.select(*by, F.lit("process").alias("kind"), F.col("name").alias("label"), F.col("pid").alias("parent"), "depth")
    at = placed.select(*by, "pid", (F.col("depth") + 1).alias("depth"))
    more = [df.join(at, [*by, "pid"]).select(*by, F.lit(kind).alias("kind"), "label", F.col("pid").alias("parent"), "depth") for kind, df in attached.items()]
    return reduce(DataFrame.unionByName, more, own)
