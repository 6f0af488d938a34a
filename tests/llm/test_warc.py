import io
import zipfile

import duckdb
import pyarrow.fs as fs
from pyspark.sql import functions as F

from barlake.llm import zipped
from barlake.llm.q_warc import SQL, op9_warc
from barlake.llm.warc import ARCHIVE, INDEX, digest, package_folder, read_packages, write_packages

SF = "/root/testdata/sf0.01"


def test_op9_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(SQL).fetchall()
    assert sorted(tuple(r) for r in op9_warc(spark, SF).collect()) == sorted(want)


def rows_of(spark, rows, **kw):
    folder = package_folder(spark)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash")).withColumn("n", F.lit(1))
    manifest = write_packages(df, folder, **kw)
    return folder, manifest, read_packages(manifest, folder).collect()


def test_round_trip_of_odd_pages(spark):
    long = "<p>ü</p>\r\n\r\n" * 300_000
    rows = [(1, "http://a/ü x\r\ny", long), (2, None, None), (3, "", ""), (4, "http://b", "same"), (5, "http://c", "same"), (5, "http://c", "same"),
            (4, "http://b", "same"), (None, "http://d", "same"), (6, "x", "WARC/1.1\r\n\r\n")]
    folder, manifest, got = rows_of(spark, rows)
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert bytes(by["1"][0].payload).decode() == long and by["1"][0].payload_digest == digest(long.encode())
    assert by["2"][0].record_type == "response" and by["3"][0].refers_to == "2" and by["3"][0].payload_bytes == 0
    assert [r.record_type for r in by["4"]] == ["response"] * 2 and [r.refers_to for r in by["5"]] == ["4"] * 2
    assert by[None][0].record_type == "response" and by["5"][0].payload_digest == digest(b"same") and by["5"][0].payload is None
    assert bytes(by["6"][0].payload) == b"WARC/1.1\r\n\r\n"
    _, _, got = rows_of(spark, rows, least_bytes=4)
    assert {r.record_type for r in got if r.page_id == "3"} == {"response"}
    assert rows_of(spark, [])[2] == []


def test_packages_are_plain_zip_files(spark):
    folder, manifest, _ = rows_of(spark, [(i, "http://a", f"page {i}") for i in range(2000)])
    system, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    n = 0
    for r in manifest.collect():
        raw = system.open_input_file(f"{base}/{r.name}").read()
        assert len(raw) == r.size
        z = zipfile.ZipFile(io.BytesIO(raw))
        assert z.testzip() is None and {ARCHIVE, INDEX, "datapackage.json"} == set(z.namelist())
        n += len(z.read(INDEX).splitlines())
        found = zipped.members(lambda at, k: raw[at:at + k], len(raw))
        assert raw[found[INDEX][0]:][:found[INDEX][1]] == z.read(INDEX)
    assert n == 2000


def test_reader_takes_other_writers_archives():
    for force in (False, True):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
            for i in range(70_000 if force else 5):  # beyond 65,535 members the end record is ZIP64
                with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=force) as f:
                    f.write(b"x" * (i % 7))
            z.comment = b"PK\x05\x06 in a comment"
        raw = buf.getvalue()
        got = zipped.members(lambda at, k: raw[at:at + k], len(raw))
        assert len(got) == (70_000 if force else 5) and raw[got["m4"][0]:][:got["m4"][1]] == b"xxxx"
