"""Packages: look-alike names, reputation, bills of materials, ownership."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Edits allowed by the length of the longer name; look-alikes of Latin letters, one of them of two letters.
EDITS = ((5, 1), (10, 2), (None, 3))
ANY_LENGTH = ((None, 2),)
LOOKALIKE_LETTERS = {
    "a": "\u0430àáâãäå", "e": "\u0435èéêëė", "o": "\u043eòóôõöø0", "c": "\u0441çčć", "p": "\u0440þ", "y": "\u0443ÿý", "x": "\u0445×", "i": "\u0456ìíîï1l", "s": "\u0455śš", "b": "\u044c\u044a",
    "k": "\u03ba\u043a", "m": "\u043c", "n": "\u043fñ", "r": "\u0433ř", "t": "\u0442ŧ", "u": "\u03c5ùúû", "d": "\u0501ɗ", "h": "\u04bbḥ", "w": "\u051dŵ",
}
LOOKALIKE_PAIRS = {"rn": "m"}


def _edits(n: Column, steps: tuple) -> Column:
    out = F.lit(steps[-1][1])
    for longest, most in reversed(steps[:-1]):
        out = F.when(n <= longest, most).otherwise(out)
    return out


def _cut(m: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of `parts` even pieces of m characters; the longer ones are last."""
    short = parts - m % parts
    size = F.floor(m / parts) + F.when(i >= short, 1).otherwise(0)
    return i * F.floor(m / parts) + F.greatest(F.lit(i) - short, F.lit(0)), size


def similar(names: DataFrame, targets: DataFrame, name: str = "name", target: str = "target", steps: tuple = EDITS) -> DataFrame:
    """name, target, distance: all pairs a few edits apart, as many as the longer one's length allows; equal ones have 0.

    An equi-join on pieces: a target is cut into one piece more than the edits allowed, so one piece
    at least is left whole and stands in the name, shifted by no more than the edits beside it. Names
    look their pieces up for each length and shift that can hold one; what meets is then measured.
    Nulls are similar to nothing, repeated names count once, empty names are near the shortest ones.
    """
    left = names.select(F.col(name).alias("__a")).where("__a is not null").distinct().withColumn("__n", F.length("__a"))
    right = targets.select(F.col(target).alias("__b")).where("__b is not null").distinct().withColumn("__m", F.length("__b"))
    most = sorted({most for _, most in steps})
    piece = lambda e, m, i, text, size, at: F.struct(F.lit(e).alias("e"), m.cast("int").alias("m"), F.lit(i).alias("i"), F.substring(text, at.cast("int") + 1, size.cast("int")).alias("p"))
    kept, asked = [], []
    for e in most:
        m = F.col("__m")
        may_have = F.lit(False)
        for d in range(-e, e + 1):
            may_have |= _edits(F.greatest(m, m + d), steps) == e
        kept += [F.when(may_have, F.array(*[piece(e, m, i, F.col("__b"), *reversed(_cut(m, e + 1, i))) for i in range(e + 1)]))]
        for d in range(-e, e + 1):
            m = F.col("__n") - d
            fits = (m >= 0) & (_edits(F.greatest(F.col("__n"), m), steps) == e)
            for i in range(e + 1):
                at, size = _cut(m, e + 1, i)
                low = F.greatest(at - i, at + d - (e - i), F.lit(0))
                high = F.least(at + i, at + d + (e - i), F.col("__n") - size)
                shifts = F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))
                asked.append(F.when(fits & (low <= high), F.transform(shifts, partial(piece, e, m, i, F.col("__a"), size))))
    each = lambda rows, text, arrays: rows.select(text, F.explode(F.flatten(F.filter(F.array(*arrays), lambda x: x.isNotNull()))).alias("k")).select(text, "k.*").distinct()
    met = each(left, "__a", asked).join(each(right, "__b", kept), ["e", "m", "i", "p"])
    near = met.select("__a", "__b", F.levenshtein("__a", "__b", most[-1]).alias("distance"))
    near = near.where((F.col("distance") >= 0) & (F.col("distance") <= _edits(F.greatest(F.length("__a"), F.length("__b")), steps))).distinct()
    return near.select(F.col("__a").alias(name), F.col("__b").alias(target), "distance")


def _nearest(pairs: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("name").orderBy("distance", "target")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _sureness() -> Column:
    return F.round(1 - F.col("distance") / F.greatest(F.length("name"), F.length("target")), 2)


def plain_name(name: Column) -> Column:
    """In lower case, without the mark of a scope."""
    return F.regexp_replace(F.lower(name), "^@", "")


def typosquats(names: DataFrame, popular: DataFrame, name: str = "name", most: int = 3) -> DataFrame:
    """name, target, distance, confidence, rank: the `most` popular names nearest to a name that is not popular itself.

    Both are taken in lower case, without the mark of a scope. popular has target.
    """
    rows = names.select(plain_name(F.col(name)).alias("name")).distinct()
    known = popular.select(F.lower("target").alias("target")).distinct()
    odd = rows.join(known, rows["name"] == known["target"], "left_anti")
    return _nearest(similar(odd, known), most).withColumn("confidence", _sureness()).select("name", "target", "distance", "confidence", "rank")


def lookalike_forms(name: Column) -> Column:
    """array<string>: the name with one letter as a look-alike of it, or with one pair as the letter it looks like."""
    letters = F.create_map(*[F.lit(x) for k, v in LOOKALIKE_LETTERS.items() for x in (k, v)])
    put = lambda at, new, n: F.concat(F.substring(name, F.lit(1), at), new, F.substr(name, at + n + 1))
    places = F.filter(F.sequence(F.lit(0), F.length(name)), lambda at: at < F.length(name))
    letter = lambda at: F.substring(name, at + 1, F.lit(1))
    one = lambda at: F.transform(F.filter(F.split(F.coalesce(letters[letter(at)], F.lit("")), ""), lambda c: c != ""), lambda c: put(at, c, 1))
    pair = lambda p, x: F.transform(F.filter(places, lambda at: F.substring(name, at + 1, F.lit(len(p))) == p), lambda at: put(at, F.lit(x), len(p)))
    two = [pair(p, x) for p, x in LOOKALIKE_PAIRS.items()]
    return F.array_distinct(F.concat(F.flatten(F.transform(places, one)), *two))


def lookalikes(names: DataFrame, popular: DataFrame, name: str = "name", most: int = 5) -> DataFrame:
    """name, target, distance, severity, confidence, rank: popular names that a name looks like (0) or is at most two edits from.

    confidence is that of the name's best match. A name in the list is like none.
    """
    rows = names.select(plain_name(F.col(name)).alias("name")).where("name <> ''").distinct()
    known = popular.select(plain_name(F.col("target")).alias("target")).distinct()
    odd = rows.join(known, rows["name"] == known["target"], "left_anti")
    forms = odd.select("name", F.explode(lookalike_forms(F.col("name"))).alias("target")).join(known, "target").select("name", "target", F.lit(0).alias("distance"))
    pairs = forms.unionByName(similar(odd, known, steps=ANY_LENGTH)).groupBy("name", "target").agg(F.min("distance").alias("distance"))
    severity = F.when(F.col("distance") == 0, "HIGH").when(F.col("distance") == 1, "MEDIUM").otherwise("LOW")
    best = F.first(_sureness()).over(Window.partitionBy("name").orderBy("rank"))
    return _nearest(pairs, most).withColumns({"severity": severity, "confidence": best}).select("name", "target", "distance", "severity", "confidence", "rank")


def reputation(packages: DataFrame, age_days: Column, maintainers: Column, deprecated: Column, described: Column) -> DataFrame:
    """Adds score, label and factors."""
    parts = [
        ("old", F.when(age_days > 365, 20)), ("new", F.when(age_days < 30, -30)), ("maintained", F.when(maintainers >= 3, 20)),
        ("alone", F.when(maintainers <= 1, -10)), ("deprecated", F.when(deprecated, -40)), ("described", F.when(described, 10)),
    ]
    score = sum((F.coalesce(v, F.lit(0)) for _, v in parts), F.lit(0))
    label = F.when(score >= 50, "TRUSTED").when(score >= 0, "NEUTRAL").when(score >= -30, "SUSPICIOUS").otherwise("DANGEROUS")
    factors = F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in parts])), ",")
    return packages.withColumns({"score": score, "label": label, "factors": factors})


def bill_of_materials(components: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """name, version, vulnerabilities, worst: components with what is known about them."""
    known = vulnerabilities.groupBy("name", "version").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max("score").alias("worst"))
    return components.join(known, ["name", "version"], "left").select("name", "version", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("vulnerabilities"), F.coalesce("worst", F.lit(0.0)).alias("worst"))


def ownership(findings: DataFrame, authors: DataFrame) -> DataFrame:
    """author, files, findings, risk: findings by file first, then by who wrote the file."""
    per_file = findings.groupBy("file").agg(F.count("*").alias("findings"), F.max("risk_score").alias("risk"))
    return authors.distinct().join(per_file, "file").groupBy("author").agg(F.countDistinct("file").alias("files"), F.sum("findings").alias("findings"), F.sum("risk").alias("risk"))


def glob_regex(pattern: Column) -> Column:
    """A pattern with a `*` that is neither a leading `**/` nor a trailing `/**`, as a regular expression of whole paths."""
    quoted = F.regexp_replace(F.replace(pattern, F.lit("\\"), F.lit("/")), r"([.+^$(){}|\[\]])", r"\\$1")
    deep = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*"))
    return F.concat(F.lit(r"\A"), F.replace(deep, F.lit("?"), F.lit(".")), F.lit(r"\z"))


def indexed(patterns: DataFrame) -> DataFrame:
    """patterns with kind, key and glob: how a pattern is looked up.

    `**/x` is `under` (x ends the path or stands after a slash), `x/**` and text without `*` are
    `path` (the key is the path or folder), any other is `glob`, by the folders before its first
    wildcard.
    """
    p = F.col("pattern")
    fixed = F.regexp_extract(F.replace(p, F.lit("\\"), F.lit("/")), r"^((?:[^*?/]*/)*)[^/]*[*?]", 1)
    tail = p.startswith("**/")
    folder = p.endswith("/**") & ~tail
    kind = F.when(tail, "under").when(folder, "folder").when(p.contains("*"), "glob").otherwise("path")
    key = F.when(tail, F.substr(p, F.lit(4))).when(folder, F.regexp_replace(p, r"/\*\*\z", "")).when(kind == "glob", fixed).otherwise(p)
    return patterns.withColumns({"kind": kind, "key": key, "glob": F.when(kind == "glob", glob_regex(p))})


def owned(files: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """path, seq, pattern, owner: every ownership pattern that matches a file.

    patterns: (seq, pattern, owner). Patterns are indexed by the folders that they name; a file asks
    for its own folders and endings only, so the join is on equal keys and no list has to be short.
    Only a pattern with a `*` inside is then tested as an expression, on the files below its fixed
    folders. A pattern that begins with `*` and no folder is met by every file, and is tested on each.
    Nulls match nothing; repeated paths count once.
    """
    rows = files.select(F.regexp_replace(F.col(path), r"\\", "/").alias("__p"), F.col(path).alias(path)).where("__p is not null").distinct()
    parts = F.split("__p", "/")
    n = F.size(parts)
    heads = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = F.concat(F.array(F.lit("")), F.transform(F.filter(heads, lambda h: h != F.col("__p")), lambda h: F.concat(h, F.lit("/"))))
    ask = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    asked = rows.select(path, "__p", F.explode(F.array_distinct(F.concat(ask("path", heads), ask("glob", folders)))).alias("k")).select(path, "__p", "k.*")
    found = asked.join(indexed(patterns).where("kind in ('path', 'glob')"), ["kind", "key"]).where("kind = 'path' or __p rlike glob")
    return found.select(path, "seq", "pattern", "owner").unionByName(_under(rows, patterns, path)).unionByName(_below(rows, patterns, path)).distinct()


def lengths(keyed: DataFrame) -> Column:
    """The lengths that keys have: as many numbers at most as the longest key has characters."""
    found = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())
    return F.array(*[F.lit(n) for n in found]).cast("array<int>")


def _under(rows: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """`**/x`: the path ends with x, or x stands after one of its slashes.

    The first holds for whole endings at a slash and for x as the end of a name: both are looked up
    by x's length among the endings and beginnings that the file has.
    """
    under = indexed(patterns).where("kind = 'under'")
    sizes, p = lengths(under), F.col("__p")
    ends = F.transform(F.filter(sizes, lambda s: s <= F.length(p)), lambda s: F.substr(p, F.length(p) - s + 1, s))
    slashes = F.filter(F.sequence(F.lit(1), F.length(p)), lambda k: F.substr(p, k, F.lit(1)) == "/")
    inside = F.flatten(F.transform(slashes, lambda k: F.transform(F.filter(sizes, lambda s: k + s <= F.length(p)), lambda s: F.substr(p, k + 1, s))))
    asked = rows.where("__p <> ''").select(path, F.explode(F.array_distinct(F.concat(ends, inside))).alias("key"))
    return asked.join(under, "key").select(path, "seq", "pattern", "owner")


def _below(rows: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """`x/**`: the path begins with x, looked up by x's length among the beginnings that the file has."""
    below = indexed(patterns).where("kind = 'folder'")
    p = F.col("__p")
    starts = F.transform(F.filter(lengths(below), lambda s: s <= F.length(p)), lambda s: F.substr(p, F.lit(1), s))
    return rows.select(path, F.explode(F.array_distinct(starts)).alias("key")).join(below, "key").select(path, "seq", "pattern", "owner")


def last_owner(matches: DataFrame, path: str = "path") -> DataFrame:
    """path, pattern, owner: of all patterns that match a file the last one."""
    return matches.groupBy(path).agg(F.max_by(F.struct("pattern", "owner"), "seq").alias("m")).select(path, "m.pattern", "m.owner")


def teams(matches: DataFrame, authored: DataFrame, path: str = "path") -> DataFrame:
    """team, files, findings, risk: totals of the authors of a team's files, an author's again for each of their files.

    matches: of `owned`, the owner a team. authored: (path, author, findings, risk), the totals of
    the author beside each file; repeated rows count once.
    """
    held = matches.select(F.col("owner").alias("team"), path).distinct()
    rows = held.join(authored.select(path, "author", "findings", "risk").distinct(), path)
    return rows.groupBy("team").agg(F.countDistinct(path).alias("files"), F.sum("findings").alias("findings"), F.sum("risk").alias("risk"))
