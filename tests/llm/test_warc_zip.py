import base64
import hashlib
import io
import zipfile

from peeratlas.llm import warc_zip

PAGES = "page_id long, url string, html string, text string, refers_to long"


def test_records_come_back(spark):
    same = "<p>same</p>" * 50
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else f"<p>{i}é</p>", "clash", 5) for i in range(60)]
    rows += [(100, None, None, "", 0), (101, "http://a\r\nWARC-Type: x", "", "", 0), (102, "u", "\r\n\r\n", "", 0), (103, "u", "long " * 40_000, "", 0), (None, "u", same, "", 0)]
    archives = warc_zip.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), records_an_archive=16)
    assert archives.count() >= 4
    found = {r.page_id: r for r in warc_zip.read_archives(spark, archives, with_payload=True).collect()}
    largest = {}
    for i, _, html, *_ in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", -1), i)
    for i, url, html, *_ in rows:
        body, r = (html or "").encode(), found[i]
        to = None if i is None or largest[html or ""] == i else largest[html or ""]
        assert (r.payload_bytes, r.refers_to, r.record_type) == (len(body), to, "response" if to is None else "revisit")
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload is None if to is not None else bytes(r.payload) == body
    assert found[101].url == "http://a%0D%0AWARC-Type: x" and found[100].url is None


def test_small_payloads_may_all_be_responses(spark):
    table = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcdef", "", 0), (4, "u", "abcdef", "", 0), (4, "u", "abcdef", "", 0)], PAGES)
    kinds = sorted((r.page_id, r.record_type) for r in warc_zip.read_archives(spark, warc_zip.write_archives(table, least_bytes=3)).collect())
    assert kinds == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]


def test_directories_with_and_without_zip64():
    for force in (False, True):
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for name in ("a.txt", "dir/b.bin"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
                    f.write(name.encode() * 10)
            z.writestr("packed", "x" * 100, zipfile.ZIP_DEFLATED)
            z.comment = b"PK comment"
        raw = body.getvalue()
        found = {m.name: m for m in warc_zip.members(body, len(raw))}
        for name in ("a.txt", "dir/b.bin"):
            m = found[name]
            assert m.stored and raw[m.start : m.start + m.size] == name.encode() * 10
        assert not found["packed"].stored


def test_zip64_end_of_directory():
    import struct

    name, data = b"archive/x", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), len(name), 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(central)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + central + end64 + tail
    (m,) = warc_zip.members(io.BytesIO(raw), len(raw))
    assert m.name == "archive/x" and raw[m.start : m.start + m.size] == data


def test_one_id_with_two_payloads(spark):
    table = spark.createDataFrame([(1, "u", "AA", "", 0), (1, "v", "BB", "", 0), (2, "u", "AA", "", 0), (3, "u", "BB", "", 0), (1, "w", "own", "", 0)], PAGES)
    found = [(r.page_id, bytes(r.payload) if r.payload is not None else None, r.record_type, r.refers_to) for r in warc_zip.read_archives(spark, warc_zip.write_archives(table), with_payload=True).collect()]
    assert sorted(found, key=str) == sorted([(1, None, "revisit", 2), (1, None, "revisit", 3), (2, b"AA", "response", None), (3, b"BB", "response", None), (1, b"own", "response", None)], key=str)


def test_ranges_are_read_by_many_tasks(spark):
    from pyspark.sql import functions as F

    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    archives = warc_zip.write_archives(pages.coalesce(2), records_an_archive=20)
    found = warc_zip.read_archives(spark, archives, task_bytes=4000).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 4 and found.count() == 400


def test_empty_table(spark):
    assert warc_zip.read_archives(spark, warc_zip.write_archives(spark.createDataFrame([], PAGES))).count() == 0
