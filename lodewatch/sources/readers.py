"""Readers: texts, diffs, sessions, lock files, audits and ownership files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What each kind of walk leaves out below its root: folder and file names, dot entries but some, depths, endings.
DOT_KEPT = r"^(?:\.github|\.cursorrules|\.windsurfrules|\..*\.mdc)$"
WALKS = {
    "project": {"skipped": ("test", "tests", "example", "examples", "benchmark", "docs", "node_modules"), "dots": DOT_KEPT},
    "package": {"skipped": ("node_modules",), "deepest": 10},
    "dependency": {"skipped": ("node_modules", ".bin"), "deepest": 3, "files": r"\.(?:js|ts|mjs|cjs|gyp|sh)$|^package\.json$"},
    "tool": {"skipped": ("node_modules",), "deepest": 8, "files": r"\.(?:js|ts|mjs|cjs|json)$"},
    "corpus": {"skipped": (), "dots": "."},
}

SESSION = """format string, metadata struct<id:string,recordedAt:timestamp,durationMs:bigint,platform:string,tags:array<string>>,
  events array<struct<type:string,data:string>>"""


def walked(path: Column, kind: str) -> Column:
    """Whether a walk of that kind comes to a file, by its path below the root."""
    rule = WALKS[kind]
    parts = F.split(path, "/")
    skipped = F.exists(parts, lambda p: (F.lower(p) if kind == "project" else p).isin(*rule["skipped"])) if rule["skipped"] else F.lit(False)
    dotted = F.exists(parts, lambda p: p.startswith(".") & ~p.rlike(rule.get("dots", r"\A\z")))
    near = F.size(parts) <= rule["deepest"] + 1 if "deepest" in rule else F.lit(True)
    wanted = F.element_at(parts, -1).rlike(rule["files"]) if "files" in rule else F.lit(True)
    return ~skipped & ~dotted & near & wanted


def text_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None, kind: str = "project") -> DataFrame:
    """file, content of the files below a folder that a walk of that kind comes to, and, if asked for, none above a size.

    Only what is below the folder counts: names in the folder's own path leave nothing out. Spark
    lists nothing that begins with a dot: dot folders of the folder itself are asked for by name, dot
    files and deeper dot folders are not seen.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(place).toString().rstrip("/")
    dots = [str(s.getPath().toString()) for s in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root + "/.*")) or [] if s.isDirectory()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load([path, *dots])
    below = F.regexp_replace(F.substr("path", F.lit(len(root) + 1)), "^/+", "")
    small = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    return files.where(small).withColumn("__below", below).where(walked(F.col("__below"), kind)).select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"))


#: A string of JSON with the string that follows as its value, if one does.
JSON_STRINGS = r'"(?:[^"\\]|\\.)*+"(?:\s*+:\s*+"(?:[^"\\]|\\.)*+")?'


def timestamps(json: Column) -> Column:
    """array<struct<key, value, at>>: the texts under `timestamp` or a key that ends in `At`, at any depth, and the times they say.

    In the order of the text; a text that is no time has a null one. Strings are taken whole, so a key
    inside another string is none. Null JSON gives null.
    """
    pairs = F.filter(F.regexp_extract_all(json, F.lit(JSON_STRINGS), F.lit(0)), lambda t: t.rlike(r'^"(?:timestamp|(?:[^"\\]|\\.)*At)"\s*:'))
    parts = lambda t: F.struct(F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1).alias("key"), F.regexp_extract(t, r':\s*"((?:[^"\\]|\\.)*)"$', 1).alias("value"))
    return F.transform(F.transform(pairs, parts), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), F.try_to_timestamp(p["value"]).alias("at")))


def unified_diff(df: DataFrame, raw: str, *keys: str) -> DataFrame:
    """keys, file, patch: a diff split into the patch of each file."""
    parts = df.select(*keys, F.explode(F.split(F.col(raw), r"(?m)(?=^diff --git )")).alias("patch"))
    named = F.regexp_extract("patch", r"(?m)^\+\+\+ b/(.+)$", 1)
    header = F.regexp_extract("patch", r"^diff --git a/\S+ b/(\S+)", 1)
    file = F.when(header != "", header).otherwise(named)
    return parts.select(*keys, file.alias("file"), "patch").where("file <> ''")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, recorded, seq, type, data: the events of session files; files of another format are left out."""
    raw = spark.read.schema(SESSION).json(path, multiLine=True).where("format is not null and metadata.id is not null")
    return raw.select(F.col("metadata.id").alias("session"), F.col("metadata.recordedAt").alias("recorded"), F.posexplode("events").alias("seq", "e")).select("session", "recorded", "seq", "e.type", "e.data")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are not JSON are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def npm_lock(df: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """keys, name, version, resolved, integrity of lock files with a `packages` or a `dependencies` map."""
    entry = "map<string,struct<version:string,resolved:string,integrity:string>>"
    parsed = df.select(*keys, F.from_json(content, f"packages {entry}, dependencies {entry}").alias("j"))
    rows = parsed.select(*keys, F.explode(F.coalesce("j.packages", "j.dependencies")).alias("path", "p")).where("path <> ''")
    return rows.select(*keys, F.regexp_replace("path", "^.*node_modules/", "").alias("name"), "p.*")


def yarn_lock(df: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """keys, name, version, resolved, integrity of yarn lock files of version 1."""
    df = df.withColumn("__file", F.monotonically_increasing_id())
    lines = df.select(*keys, "__file", F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line")).where("trim(line) <> '' and not startswith(line, '#')")
    w = Window.partitionBy("__file").orderBy("pos")
    head = ~F.col("line").startswith(" ")
    rows = lines.withColumn("block", F.sum(head.cast("int")).over(w))
    value = lambda key: F.max(F.when(F.trim("line").startswith(f"{key} "), F.regexp_extract(F.trim("line"), r"^\w+ \"?([^\"]+)\"?$", 1)))
    name = F.max(F.when(head, F.regexp_extract("line", r"^\"?(@?[^@\"]+)@", 1)))
    return rows.groupBy(*keys, "__file", "block").agg(name.alias("name"), value("version").alias("version"), value("resolved").alias("resolved"), value("integrity").alias("integrity")).drop("__file", "block")


def lock_format(content: Column) -> Column:
    """The format of a lock file by its content: npm, yarn or unknown."""
    return F.when(F.trim(content).startswith("{") & content.contains("lockfileVersion"), "npm").when(content.rlike(r"(?m)^# yarn lockfile v1"), "yarn").otherwise("unknown")


def npm_audit(df: DataFrame, raw: str = "raw", *keys: str) -> DataFrame:
    """keys, name, severity, title, advisory, fix of an audit report."""
    via = "array<string>"
    schema = f"vulnerabilities map<string,struct<severity:string,via:{via},fixAvailable:string>>"
    rows = df.select(*keys, F.explode(F.from_json(raw, schema)["vulnerabilities"]).alias("name", "v")).select(*keys, "name", "v.severity", F.explode_outer("v.via").alias("via"), F.col("v.fixAvailable").alias("fix"))
    detail = F.from_json("via", "title string, url string, severity string")
    severity = F.upper(F.regexp_replace(F.coalesce(detail["severity"], "severity"), "moderate", "medium"))
    return rows.select(*keys, "name", severity.alias("severity"), detail["title"].alias("title"), F.regexp_extract(F.coalesce(detail["url"], F.lit("")), r"(GHSA-[a-z0-9-]+|CVE-\d+-\d+)", 1).alias("advisory"), "fix")


def codeowners(df: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """keys, seq, pattern, owner of ownership files; comments and lines without an @owner are skipped."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(content), "\n")).alias("seq", "line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    parts = lines.withColumn("parts", F.split(F.trim("line"), r"\s+"))
    return parts.select(*keys, "seq", F.col("parts")[0].alias("pattern"), F.explode(F.filter(F.slice("parts", F.lit(2), F.size("parts")), lambda x: x.startswith("@"))).alias("owner"))


def newest(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The newest rows of each key: a history that keeps so many entries."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def snapshots_within(df: DataFrame, by: list[str], ts: str, days: int) -> DataFrame:
    """The snapshots of the last days before each key's newest."""
    now = df.groupBy(*by).agg(F.max(ts).alias("__now"))
    return df.join(now, by).where(F.col(ts) > F.col("__now") - F.expr(f"interval {days} days")).drop("__now")


def baseline_snapshot(df: DataFrame, by: list[str], ts: str, branch: str = "branch") -> DataFrame:
    """The newest snapshot of each key on a main branch."""
    return newest(df.where(F.col(branch).isin("main", "master")), by, [ts], 1)


def replay_datasets(df: DataFrame, platform: str | None = None, campaign: str | None = None) -> DataFrame:
    """Stored datasets by platform and campaign, where given."""
    for column, wanted in (("platform", platform), ("campaign", campaign)):
        df = df if wanted is None else df.where(F.col(column) == wanted)
    return df


def build_inputs(files: DataFrame, deepest: int = 6) -> DataFrame:
    """file, kind, depth, size, sha256, text: inputs of a build below a depth, without dot entries, by the kind of their name.

    files has file (a relative path) and content (binary).
    """
    parts = F.split("file", "/")
    name = F.lower(F.element_at(parts, -1))
    kind = (
        F.when(name.isin("package-lock.json", "yarn.lock", "cargo.lock", "go.sum", "poetry.lock"), "lockfile")
        .when(name.isin("package.json", "cargo.toml", "go.mod", "pyproject.toml", "pom.xml"), "manifest")
        .when(name.isin("makefile", "cmakelists.txt", "build.gradle", "dockerfile"), "build_script")
        .when(name.rlike(r"\.(?:ya?ml|json|toml|ini|cfg)\z"), "config")
        .when(name.rlike(r"\.(?:c|cc|cpp|h|hpp|rs|go|js|ts|py|java)\z"), "source")
        .otherwise("other")
    )
    rows = files.where((F.size(parts) <= deepest) & ~F.exists(parts, lambda p: p.startswith(".")))
    return rows.select("file", kind.alias("kind"), F.size(parts).alias("depth"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("text"))


def artifact_format(content: Column) -> Column:
    """The format of a binary by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "7F454C46", "elf").when(head.startswith("4D5A"), "pe").when(head.isin("CFFAEDFE", "CEFAEDFE", "FEEDFACE", "FEEDFACF", "CAFEBABE"), "macho").when(head == "504B0304", "zip").otherwise("unknown")


def manifest_hardening(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds what a package manager's settings harden: scripts off, exact versions, a registry of its own, strict TLS."""
    setting = lambda key: F.regexp_extract(content, rf"(?m)^\s*{key}\s*=\s*(\S+)", 1)
    return df.withColumns({"scripts_off": setting("ignore-scripts") == "true", "exact": setting("save-exact") == "true", "registry": setting("registry"), "strict_tls": setting("strict-ssl") != "false"})
