import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from readalike.llm import warc_zip as wz

PAGES = "page_id long, url string, html string"


def read(pages, store, least=0):
    return wz.read_records(wz.record_ranges(wz.write_packages(pages, store, least)))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, store, monkeypatch):
    monkeypatch.setattr(wz, "PACKAGE_BYTES", 20_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifest = wz.write_packages(pages, store)
    records = wz.read_records(wz.record_ranges(manifest))
    tasks = {r[0] for r in records.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) == manifest.count() > 3
    found = {r["page_id"]: r for r in records.collect()}
    for page in pages.collect():
        r = found.pop(page["page_id"])
        assert r["payload"].decode() == page["html"] and r["url"] == page["url"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(page["html"].encode()), digest(page["html"]))
    assert not found


def test_odd_rows(spark, store):
    rows = [(1, "http://a/\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (2, "v", "x"), (5, "u", "é" * 3_000_000)]
    found = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                    for r in read(spark.createDataFrame([(*r, "d") for r in rows], PAGES + ", digest string"), store).collect()), key=str)
    kinds = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    assert found == sorted(((i, len((h or "").encode()), digest(h), *kinds[i]) for i, _, h in rows), key=str)
    longer = {r["page_id"]: r["record_type"] for r in read(spark.createDataFrame(rows, PAGES), store, least=1).collect()}
    assert longer[3] == longer[4] == "response" and longer[1] == "revisit"
    assert read(spark.createDataFrame([], PAGES), store).count() == 0


def test_directory_with_zip64_fields_and_comment(tmp_path, monkeypatch):
    import pyarrow.fs as fs
    out = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as target:
        target.writestr("first", b"a" * 100)
        with target.open("second", "w", force_zip64=True) as member:
            member.write(b"b" * 50)
        target.comment = b"a remark"
    (tmp_path / "x.zip").write_bytes(out.getvalue())
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.zip")) as source:
        found = wz.members(source)
        assert {name: source.read_at(size, place) for name, (place, size) in found.items()} == {"first": b"a" * 100, "second": b"b" * 50}


def test_damaged_and_compressed_files_are_refused(tmp_path):
    import pyarrow.fs as fs
    (tmp_path / "x.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "y.zip", "w", zipfile.ZIP_DEFLATED) as target:
        target.writestr("member", "text " * 100)
    for name in ("x.zip", "y.zip"):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as source, pytest.raises(ValueError):
            wz.members(source)
