import base64
import glob
import gzip
import hashlib

from pyspark.sql.functions import lit

from lodewatch.llm import warc


def pages():
    big = "é" * 700_000
    rows = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, None), (3, "http://b/\r\nX: 1", ""), (4, "u", "<p>é</p>"), (0, "u0", "<p>é</p>"), (5, "u5", "a\r\n\r\nb"), (6, "u6", big), (7, "u7", big), (8, "u8", "\r\n\r\n")]
    return rows + [(100 + i, f"http://h/{i}", "common" if i % 3 else f"own {i}") for i in range(300)]


def brute(rows, least=0):
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault((html or "").encode(), i)
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        to = first[data] if first[data] != i and len(data) >= least else None
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to)
    return out


def test_round_trip(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/archives"
    index = warc.write(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string").withColumn("size", lit(1)).repartition(4), folder)
    got = {r.page_id: r for r in warc.read(index, folder).collect()}
    want = brute(rows)
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == want
    for i, _, html in rows:
        payload = got[i].payload
        assert (payload is None) == (want[i][2] == "revisit")
        assert payload is None or bytes(payload) == (html or "").encode()
    # the archives are the records end to end, each a gzip member, at the places the index gives
    for path in glob.glob(f"{tmp_path}/archives/*.warc.gz"):
        data = open(path, "rb").read()
        at = 0
        for r in index.where(index.archive == path.rsplit("/", 1)[1]).orderBy("offset").collect():
            one = gzip.decompress(data[at : at + r.length])
            assert r.offset == at and one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
            at += r.length
        assert at == len(data)


def test_selected_records_and_small_payloads(spark, tmp_path):
    rows = pages()
    folder = f"file://{tmp_path}/archives"
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, least_bytes=7)
    got = {r.page_id: r.record_type for r in warc.read(index.where("page_id % 7 = 0"), folder).collect()}
    want = brute(rows, 7)
    assert got == {i: want[i][2] for i in want if i % 7 == 0}


def test_repeated_rows_and_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type) for r in warc.read(warc.write(df, folder), folder).collect())
    assert got == [(-1, "response"), (1, "response"), (1, "response"), (2, "revisit")]
    none = warc.write(df.where("false"), folder)
    assert warc.read(none, folder).count() == 0
