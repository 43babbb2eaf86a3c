"""Masking over lines and the filter that drops findings, bound to pages and to files made of sample lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masking, scan
from . import code
from .scan import lines_sql, quoted
from .tables import read

#: What stands before and after a file's third line, by the file's number: comments and templates over lines.
WRAPS = [("/* was:", "*/"), ("const t = `", "`;"), ("", ""), ("x = 'a\\", "' // end"), ("# note", "")]


def files(spark, sf_dir: str) -> DataFrame:
    """project, path, text: the sample files, some below a folder of tests, with one line wrapped."""
    rows = code.files(spark, sf_dir)
    k = F.length("text") % len(WRAPS)
    wrap = lambda i: F.get(F.array(*[F.lit(w[i]) for w in WRAPS]), k)
    parts = F.split("text", "\n")
    text = F.array_join(F.concat(F.slice(parts, 1, 2), F.array(wrap(0)), F.slice(parts, 3, 1), F.array(wrap(1)), F.slice(parts, F.lit(4), F.size(parts))), "\n")
    path = F.when(F.col("project") % 5 == 0, F.regexp_replace("path", "^([^/]+)/", "$1/tests/")).otherwise(F.col("path"))
    return rows.select("project", path.alias("path"), text.alias("text"))


FILES = f"""(SELECT project, CASE WHEN project % 5 = 0 THEN regexp_replace(path, '^([^/]+)/', '\\1/tests/') ELSE path END AS path,
  array_to_string(list_concat(list_concat(list_concat(parts[1:2], [[{', '.join(quoted(a) for a, _ in WRAPS)}][k]]), list_concat(parts[3:3], [[{', '.join(quoted(b) for _, b in WRAPS)}][k]])), parts[4:]), chr(10)) AS text
  FROM (SELECT project, path, string_split(text, chr(10)) AS parts, length(text) % {len(WRAPS)} + 1 AS k FROM {code.FILES}))"""

#: The automaton as one pattern over a whole text, comments not nested: what is no code, then an escaped or single character of code.
PIECES = (
    r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*(?s:.*)|'(?:[^'\\\n]|\\(?s:.))*'?|\"(?:[^\"\\\n]|\\(?s:.))*\"?|`(?:[^`\\]|\\(?s:.))*`?|(?m:^)#[^\n]*|[ \t]#[^\n]*|\\(?s:.)|(?s:.)"
)


def masked_sql(rows: str) -> str:
    """The rows with `code`, their text with strings and comments blanked."""
    blank = "CASE WHEN length(p) > 1 AND p[1] <> '\\' OR p IN ('''', '\"', '`') THEN regexp_replace(p, '[^\\n]', ' ', 'g') ELSE p END"
    return f"(SELECT *, array_to_string(list_transform(regexp_extract_all(text, {quoted(PIECES)}), lambda p: {blank}), '') AS code FROM {rows})"


def masked_pages(spark, sf_dir):
    """Lines of pages that strings, comments or templates of their own or of lines before cover in part: how much code is left."""
    lines = masking.masked_lines(scan.lines(read(spark, sf_dir, "pages"), "html", "page_id"), ["page_id"])
    return lines.where("code <> content").select("page_id", "line", F.length("content").alias("chars"), F.length(F.replace("code", F.lit(" "), F.lit(""))).alias("code_chars"), F.sha2(F.col("code").cast("binary"), 256).alias("code_sha256"))


PAGES = "(SELECT page_id, coalesce(html, '') AS text FROM pages)"
PAGES_SQL = f"""SELECT page_id, line::INT AS line, length(content)::INT AS chars, length(replace(code_line, ' ', ''))::INT AS code_chars, sha256(code_line) AS code_sha256
  FROM (SELECT page_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS content, unnest(b) AS code_line
    FROM (SELECT page_id, string_split(text, chr(10)) AS a, string_split(code, chr(10)) AS b FROM {masked_sql(PAGES)})) WHERE content <> code_line"""


def semantic_filter(spark, sf_dir):
    """Findings of all files and what the filter says to each."""
    rows = files(spark, sf_dir)
    found = scan.scan_files(rows, "path", "text", "project")
    return masking.semantic_filter(found, scan.lines(rows, "text", "project", "path"), ["project", "path"]).select("project", "path", "line", "type", "subcode", "phase", "rule_no", "keep", "reason")


def wrapped(sql: str) -> str:
    """SQL over the plain sample files, over the wrapped ones."""
    return sql.replace(code.FILES, FILES)


ATTACK = "(?i)\\b(?:" + "|".join(w.replace(".", "\\.") for w in masking.ATTACK_WORDS) + ")\\b|" + "|".join(p.replace(".", "\\.").replace("(", "\\(") for p in masking.ATTACK_PIECES)
FILTER_SQL = f"""WITH lined AS (
  SELECT project, path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS content, unnest(b) AS code_line
  FROM (SELECT project, path, string_split(text, chr(10)) AS a, string_split(code, chr(10)) AS b FROM {masked_sql(FILES)})
), runs AS (
  SELECT project, path, bool_or(regexp_matches(code_line, {quoted(masking.RUNS)})) AS runs FROM lined GROUP BY ALL
), judged AS (
  SELECT f.*, coalesce(l.content, '') AS content, coalesce(code_line, '') AS code_line, runs,
    type IN ({', '.join(map(quoted, masking.CODE_KINDS))}) AND NOT regexp_matches(coalesce(code_line, ''), {quoted(ATTACK)}) AS in_data
  FROM {wrapped(code.CODE)} f LEFT JOIN lined l USING (project, path, line) LEFT JOIN runs USING (project, path)
), reasons AS (
  SELECT *, CASE WHEN list_has_any(string_split(lower(path), '/'), [{', '.join(map(quoted, masking.TEST_FOLDERS))}]) OR regexp_matches(path, {quoted(masking.TEST_NAME)}) THEN 'test path'
    WHEN lower(category) IN ({', '.join(map(quoted, masking.SECRET_CATEGORIES))}) OR regexp_matches(type, {quoted(masking.SECRET_KINDS)}) THEN 'secret'
    WHEN line = 0 THEN 'whole file' WHEN trim(content) = '' THEN 'no line' WHEN regexp_matches(content, {quoted(masking.PATTERN_DEFINED)}) THEN 'pattern defined'
    WHEN contains(type, 'ENV') AND regexp_matches(content, {quoted(masking.ENV_READ)}) AND NOT regexp_matches(content, {quoted(masking.ENV_USED)}) THEN 'harmless read'
    WHEN in_data AND regexp_matches(content, {quoted(ATTACK)}) AND runs THEN 'may be run' WHEN in_data THEN 'string or comment' ELSE 'code' END AS reason FROM judged
) SELECT project, path, line, type, subcode, phase, rule_no, reason NOT IN ('test path', 'pattern defined', 'harmless read', 'string or comment') AS keep, reason FROM reasons"""

QUERIES = {f.__name__: f for f in (masked_pages, semantic_filter)}
ORACLE_SQL = {"masked_pages": PAGES_SQL, "semantic_filter": FILTER_SQL}
