"""Headers of binaries (ELF and PE) read from their bytes at fixed offsets, and what changed between two.

Every number is a slice of the content, so a file is parsed where it lies, by expressions. What a
truncated or forged header points at beyond the content's end is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .readers import artifact_format

# The machines by their numbers, the imports that load code at run time, what an entropy of code may be.
ELF_MACHINES = {3: "x86", 40: "arm", 62: "x86-64", 183: "aarch64", 243: "riscv"}
PE_MACHINES = {0x14C: "x86", 0x1C0: "arm", 0x8664: "x86-64", 0xAA64: "aarch64"}
LOADERS = r"(?i)dlopen|dlsym|LoadLibrary|GetProcAddress"
DENSE, DENSE_CODE, RISEN = 7.5, 7.8, 0.5
#: Sections, imports and characters of a name that a header may have here: format limits, or far beyond any real file.
MOST_SECTIONS, MOST_IMPORTS, NAME = 65_535, 65_535, 256


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of bytes in bits, to two places, by one pass of counts; null for null."""

    @F.pandas_udf("double")
    def bits(parts: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> float | None:
            if data is None:
                return None
            counts = np.bincount(np.frombuffer(data, np.uint8), minlength=1)
            p = counts[counts > 0] / max(len(data), 1)
            return float(-(p * np.log2(p)).sum()) + 0.0

        return pd.Series([one(p) for p in parts], dtype="Float64")

    return half_up(bits(content), 2)


def number(content: Column, at: Column, size: int, little: Column | bool = True) -> Column:
    """The unsigned number of so many bytes at an offset from 0; null beyond the end or above a long."""
    digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    digits = turned if little is True else F.when(little, turned).otherwise(digits)
    fits = (at >= 0) & (at + size <= F.octet_length(content))
    return F.when(fits, F.conv(digits, 16, 10).cast("decimal(20,0)").try_cast("long"))


def name_at(content: Column, at: Column) -> Column:
    """The characters from an offset up to a zero byte."""
    return F.when((at >= 0) & (at < F.octet_length(content)), F.substring_index(F.substring(content, at.cast("int") + 1, F.lit(NAME)).cast("string"), "\x00", 1))


def let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def elf_sections(c: Column) -> Column:
    """array<struct<name, kind, at, size, executable>> of an ELF file of either class and byte order."""
    wide, little = F.hex(F.substring(c, 5, 1)) == "02", F.hex(F.substring(c, 6, 1)) != "02"
    pick = lambda a, b, n, m: F.when(wide, number(c, F.lit(a), n, little)).otherwise(number(c, F.lit(b), m, little))
    head = F.struct(pick(0x28, 0x20, 8, 4).alias("at"), pick(0x3A, 0x2E, 2, 2).alias("size"), pick(0x3C, 0x30, 2, 2).alias("n"), pick(0x3E, 0x32, 2, 2).alias("names"))

    def table(h: Column) -> Column:
        def one(i: Column) -> Column:
            at = h["at"] + i * h["size"]
            field = lambda a, b, n, m: F.when(wide, number(c, at + a, n, little)).otherwise(number(c, at + b, m, little))
            return F.struct(number(c, at, 4, little).alias("name"), number(c, at + 4, 4, little).alias("kind"), field(24, 16, 8, 4).alias("at"), field(32, 20, 8, 4).alias("size"), field(8, 8, 8, 4).alias("flags"))

        rows = F.when(h["n"] > 0, F.transform(F.sequence(F.lit(0), F.least(h["n"], F.lit(MOST_SECTIONS)).cast("int") - 1), one))
        named = lambda all_: F.transform(all_, lambda s: F.struct(name_at(c, F.get(all_, h["names"].cast("int"))["at"] + s["name"]).alias("name"), s["kind"].alias("kind"), s["at"].alias("at"), s["size"].alias("size"), (s["flags"].bitwiseAND(F.lit(4)) > 0).alias("executable")))
        return let(rows, named)

    return let(head, table)


def elf_imports(c: Column, sections: Column) -> Column:
    """The libraries that the dynamic section asks for."""
    wide, little = F.hex(F.substring(c, 5, 1)) == "02", F.hex(F.substring(c, 6, 1)) != "02"
    dynamic = F.get(F.filter(sections, lambda s: s["kind"] == 6), F.lit(0))
    strings = F.get(F.filter(sections, lambda s: s["name"] == ".dynstr"), F.lit(0))["at"]
    step = F.when(wide, 16).otherwise(8)
    n = F.least(F.floor(dynamic["size"] / step), F.lit(MOST_IMPORTS)).cast("int")

    def wanted(k: Column) -> Column:
        at = dynamic["at"] + k * step
        read = lambda a: F.when(wide, number(c, at + 2 * a, 8, little)).otherwise(number(c, at + a, 4, little))
        return F.when(read(0) == 1, name_at(c, strings + read(4)))

    return F.coalesce(F.when(n > 0, F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), wanted))), F.array().cast("array<string>"))


def pe_sections(c: Column) -> Column:
    """array<struct<name, kind, at, size, executable>> of a PE file; kind is the section's address in memory."""
    pe = number(c, F.lit(0x3C), 4)
    table = pe + 24 + number(c, pe + 20, 2)

    def one(i: Column) -> Column:
        at = table + i * 40
        return F.struct(
            F.substring_index(F.substring(c, at.cast("int") + 1, F.lit(8)).cast("string"), "\x00", 1).alias("name"), number(c, at + 12, 4).alias("kind"), number(c, at + 20, 4).alias("at"),
            number(c, at + 16, 4).alias("size"), (number(c, at + 36, 4).bitwiseAND(F.lit(0x20000000)) > 0).alias("executable"),
        )

    n = F.when(F.hex(F.substring(c, pe.cast("int") + 1, F.lit(4))) == "50450000", number(c, pe + 6, 2))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one))


def pe_imports(c: Column, sections: Column) -> Column:
    """The libraries of the import directory."""
    optional = number(c, F.lit(0x3C), 4) + 24
    directory = optional + F.when(number(c, optional, 2) == 0x20B, 112).otherwise(96) + 8

    def place(address: Column) -> Column:
        home = F.get(F.filter(sections, lambda s: (s["kind"] <= address) & (address < s["kind"] + s["size"])), F.lit(0))
        return address - home["kind"] + home["at"]

    start, n = place(number(c, directory, 4)), F.least(F.floor(number(c, directory + 4, 4) / 20), F.lit(MOST_IMPORTS)).cast("int")
    one = lambda k: let(number(c, start + k * 20 + 12, 4), lambda name: F.when(name > 0, name_at(c, place(name))))
    return F.coalesce(F.when(n > 0, F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), one))), F.array().cast("array<string>"))


def machine(c: Column, kind: Column) -> Column:
    little = F.hex(F.substring(c, 6, 1)) != "02"
    named = lambda x, table: F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x.cast("int")]
    return F.coalesce(F.when(kind == "elf", named(number(c, F.lit(0x12), 2, little), ELF_MACHINES)).when(kind == "pe", named(number(c, number(c, F.lit(0x3C), 4) + 4, 2), PE_MACHINES)), F.lit("unknown"))


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with format, machine, entropy, sections and imports in place of the content.

    A file of another format, a truncated one and a null one have no sections and no imports; null
    content has format `unknown` and a null entropy. Names that the header points at beyond the end are null.
    """
    names = [c for c in files.columns if c not in (content, "format", "machine", "entropy", "sections", "imports")]
    c = F.col(content)
    rows = files.withColumn("format", F.coalesce(artifact_format(c), F.lit("unknown")))
    none = F.array().cast("array<struct<name:string,kind:bigint,at:bigint,size:bigint,executable:boolean>>")
    rows = rows.withColumn("sections", F.coalesce(F.when(F.col("format") == "elf", elf_sections(c)).when(F.col("format") == "pe", pe_sections(c)), none))
    imports = F.when(F.col("format") == "elf", elf_imports(c, F.col("sections"))).when(F.col("format") == "pe", pe_imports(c, F.col("sections"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*names, "format", machine(c, F.col("format")).alias("machine"), byte_entropy(c).alias("entropy"), "sections", imports.alias("imports"), content)


def section_rows(artifacts: DataFrame, content: str = "content") -> DataFrame:
    """A row a section: the columns beside, section, size, executable and the entropy of its bytes (null beyond the end)."""
    names = [c for c in artifacts.columns if c not in (content, "format", "machine", "entropy", "sections", "imports")]
    rows = artifacts.select(*names, content, F.explode("sections").alias("s"))
    inside = (F.col("s.at") >= 0) & (F.col("s.at") + F.col("s.size") <= F.octet_length(content))
    part = F.when(inside, F.substring(F.col(content), F.col("s.at").cast("int") + 1, F.col("s.size").cast("int")))
    return rows.select(*names, F.col("s.name").alias("section"), F.col("s.size").alias("size"), F.col("s.executable").alias("executable"), byte_entropy(part).alias("entropy"))


def artifact_diff(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, added, removed, changed (names with sizes), imports_added, imports_removed, entropy_delta, findings of artifacts in both."""
    side = lambda df, x: df.select(by, *[F.col(c).alias(f"{c}_{x}") for c in ("sections", "imports", "entropy")])
    rows = side(before, "a").join(side(after, "b"), by)
    names = lambda x: F.transform(f"sections_{x}", lambda s: s["name"])
    size_a = F.map_from_entries(F.transform(F.array_distinct(names("a")), lambda n: F.struct(n, F.get(F.filter("sections_a", lambda s: s["name"] == n), F.lit(0))["size"])))
    rows = rows.withColumn("sizes_a", size_a)
    resized = F.filter("sections_b", lambda s: F.col("sizes_a")[s["name"]].isNotNull() & (F.col("sizes_a")[s["name"]] != s["size"]))
    changed = F.transform(resized, lambda s: F.concat(s["name"], F.lit(" ("), F.col("sizes_a")[s["name"]].cast("string"), F.lit(" to "), s["size"].cast("string"), F.lit(")")))
    rows = rows.withColumns(
        {
            "added": F.array_sort(F.array_except(names("b"), names("a"))), "removed": F.array_sort(F.array_except(names("a"), names("b"))), "changed": F.array_sort(changed),
            "imports_added": F.array_sort(F.array_except("imports_b", "imports_a")), "imports_removed": F.array_sort(F.array_except("imports_a", "imports_b")),
            "entropy_delta": F.round(F.col("entropy_b") - F.col("entropy_a"), 2),
        }
    )
    findings = [
        ("new section", F.size("added") > 0), ("section resized", F.size("changed") > 0), ("loads code at run time", F.exists("imports_added", lambda i: i.rlike(LOADERS))), ("denser", F.col("entropy_delta") > RISEN),
    ]
    found = F.array_compact(F.array(*[F.when(met, F.lit(name)) for name, met in findings]))
    return rows.select(by, "added", "removed", "changed", "imports_added", "imports_removed", "entropy_delta", found.alias("findings"))
