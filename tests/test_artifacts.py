import math
import struct
from collections import Counter

from lodewatch.plans import processes
from lodewatch.sources import artifacts


def bits(data):
    return round(-sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) + 1e-12, 2) if data else 0.0


def elf(sections, needed=(), wide=True, little=True):
    """sections: (name, flags, bytes); a table of names and the dynamic section come last."""
    end = "<" if little else ">"
    dynstr = b"\0" + b"".join(n.encode() + b"\0" for n in needed)
    entry = end + ("QQ" if wide else "II")
    at, tags = 1, b""
    for n in needed:
        tags += struct.pack(entry, 1, at)
        at += len(n) + 1
    all_ = [("", 0, 0, b""), *((n, 1, f, d) for n, f, d in sections), (".dynstr", 3, 2, dynstr), (".dynamic", 6, 3, tags + struct.pack(entry, 0, 0))]
    names = b"".join(n.encode() + b"\0" for n, *_ in all_) + b".shstrtab\0"
    all_.append((".shstrtab", 3, 0, names))
    body, rows, head = b"", b"", 64 if wide else 52
    for n, kind, flags, data in all_:
        fields = (names.index(n.encode() + b"\0"), kind, flags, 0, head + len(body), len(data), 0, 0, 0, 0)
        rows += struct.pack(end + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), *fields)
        body += data
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if little else 2, 1]) + b"\0" * 9
    table = head + len(body)
    rest = struct.pack(end + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 2, 62 if wide else 3, 1, 0, 0, table, 0, head, 0, 0, 64 if wide else 40, len(all_), len(all_) - 1)
    return ident + rest + body + rows


def pe(sections, needed, wide):
    """An import directory in a section .idata of its own, at address 0x5000."""
    names = b"".join(n.encode() + b"\0" for n in needed)
    directory, at = b"", 20 * (len(needed) + 1)
    for n in needed:
        directory += struct.pack("<IIIII", 0, 0, 0, 0x5000 + at, 0)
        at += len(n) + 1
    idata = directory + b"\0" * 20 + names
    all_ = [*sections, (".idata", 0x40000000, idata)]
    optional = (struct.pack("<H", 0x20B) + b"\0" * 110 if wide else struct.pack("<H", 0x10B) + b"\0" * 94) + struct.pack("<IIII", 0, 0, 0x5000, 20 * (len(needed) + 1))
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, len(all_), 0, 0, 0, len(optional), 0) + optional
    body, rows, start = b"", b"", len(head) + 40 * len(all_)
    for k, (n, flags, data) in enumerate(all_):
        address = 0x5000 if n == ".idata" else 0x1000 * (k + 1)
        rows += n.encode().ljust(8, b"\0") + struct.pack("<IIIIIIHHI", len(data), address, len(data), start + len(body), 0, 0, 0, 0, flags)
        body += data
    return head + rows + body


CODE, DATA = bytes(range(256)) * 4, b"hello world" * 9
FILES = {
    "elf64": elf([(".text", 6, CODE), (".data", 3, DATA)], ["libc.so.6", "libdl.so.2"]), "elf32": elf([(".text", 6, CODE)], ["libm.so"], wide=False), "big": elf([(".text", 6, DATA)], ["libbig.so"], little=False),
    "pe64": pe([(".text", 0x20000020, CODE), (".data", 0xC0000040, DATA)], ["KERNEL32.dll", "a.dll"], True), "pe32": pe([(".text", 0x20000020, DATA)], ["b.dll"], False),
    "cut": elf([(".text", 6, CODE)], [])[:-30], "head": b"\x7fELF\x02\x01", "mz": b"MZ", "text": b"plain", "empty": b"", "null": None,
}


def test_headers_made_by_hand(spark):
    rows = artifacts.parsed(spark.createDataFrame(list(FILES.items()), "file string, content binary"))
    got = {r.file: r for r in rows.collect()}
    named = lambda f: {(s.name, s.size, s.executable) for s in got[f].sections}
    assert {("", 0, False), (".text", 1024, True), (".data", 99, False)} < named("elf64") and got["elf64"].imports == ["libc.so.6", "libdl.so.2"] and got["elf64"].machine == "x86-64"
    assert (".text", 1024, True) in named("elf32") and got["elf32"].imports == ["libm.so"] and got["elf32"].machine == "x86"
    assert (".text", 99, True) in named("big") and got["big"].imports == ["libbig.so"] and got["big"].machine == "x86-64"
    assert {(".text", 1024, True), (".data", 99, False)} < named("pe64") and got["pe64"].imports == ["KERNEL32.dll", "a.dll"] and got["pe64"].machine == "x86-64"
    assert (".text", 99, True) in named("pe32") and got["pe32"].imports == ["b.dll"] and got["pe32"].machine == "x86"
    for f in ("head", "mz", "text", "empty", "null"):
        assert got[f].sections == [] and got[f].imports == []
    assert [got[f].format for f in ("elf64", "pe32", "text", "null")] == ["elf", "pe", "unknown", "unknown"]
    assert got["cut"].sections[-1].size is None and got["cut"].sections[1].size == 1024
    assert all(got[f].entropy == (None if d is None else bits(d)) for f, d in FILES.items())
    parts = {(r.file, r.section): r.entropy for r in artifacts.section_rows(rows).collect()}
    assert parts["elf64", ".text"] == 8.0 and parts["pe64", ".data"] == bits(DATA) and parts["big", ".text"] == bits(DATA)


def test_differences_of_two_artifacts(spark):
    before = spark.createDataFrame([("a", elf([(".text", 6, DATA), (".old", 2, b"x")], ["libc.so"])), ("b", FILES["elf64"]), ("gone", b"")], "file string, content binary")
    after = spark.createDataFrame([("a", elf([(".text", 6, CODE), (".new", 2, b"x")], ["libdlopen.so"])), ("b", FILES["elf64"])], "file string, content binary")
    got = {r.file: r for r in artifacts.artifact_diff(artifacts.parsed(before), artifacts.parsed(after), "file").collect()}
    assert set(got) == {"a", "b"} and got["b"].findings == [] and got["b"].entropy_delta == 0.0 and got["b"].changed == []
    a = got["a"]
    assert (a.added, a.removed, a.imports_added, a.imports_removed) == ([".new"], [".old"], ["libdlopen.so"], ["libc.so"]) and ".text (99 to 1024)" in a.changed
    assert a.findings == ["new section", "section resized", "loads code at run time", "denser"]


def test_pages_as_binaries(spark):
    sf_dir = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in artifacts.parsed(processes.image(spark, sf_dir)).collect()}
    for i, html in pages.items():
        assert got[i].machine == "x86-64" and [(s.name, s.size) for s in got[i].sections][1] == (".text", len(html))
        assert got[i].imports == ["libc.so", "libdl_dlopen.so" if i % 2 else "libc.so"]
    changes = {r.page_id: r for r in processes.artifact_changes(spark, sf_dir).collect()}
    assert set(changes) == {i for i in pages if i - 1 in pages}
    for i, r in changes.items():
        a, b = pages[i - 1], pages[i]
        assert r.changed == ("" if len(a) == len(b) else f".text ({len(a)} to {len(b)})")
        assert r.imports_added == ("libdl_dlopen.so" if i % 2 else "") and ("loads code at run time" in r.findings) == bool(i % 2)
