import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from maskwright.llm import warc
from maskwright.llm.common import shared_path

PAGES = "page_id bigint, url string, html string"


def rows_of(spark, pages):
    path = shared_path(spark, "t")
    return {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, path), path).collect()}


def test_round_trip_and_revisits(spark):
    big = "b" * 1200
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "u", "small"), (5, "u\r\nX: y", "small"), (6, "é", None), (7, "e", ""), (8, "z", "ü" * 600)], PAGES)
    got = rows_of(spark, pages)
    assert len(got) == 8
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3)] == [("revisit", 3), ("revisit", 3), ("response", None)]
    assert all(got[i]["record_type"] == "response" for i in (4, 5, 6, 7, 8))
    assert got[8]["payload_bytes"] == 1200 and got[6]["payload_bytes"] == 0
    assert got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and got[1]["payload_bytes"] == 1200 and got[1]["payload"] is None
    assert bytes(got[3]["payload"]) == big.encode() and got[5]["url"] == "u%0D%0AX:%20y"


def test_repeated_and_missing_ids(spark):
    big = "c" * 2000
    pages = spark.createDataFrame([(5, "a", big), (5, "b", big), (None, "c", big), (2, "d", big)], PAGES)
    path = shared_path(spark, "t")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in warc.read_archives(warc.write_archives(pages, path), path).collect())
    assert got == [(-1, "revisit", 5), (2, "revisit", 5), (5, "response", -1), (5, "response", -1)]


def test_empty_table(spark):
    path = shared_path(spark, "t")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES), path), path).count() == 0


def archive(records, dictionary=b""):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.opening(dictionary) + b"".join(c.compress(r) for r in records)


HEADERS = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "1970-01-01T00:00:00Z"}


def test_dictionary_frames_and_compressed_dictionary():
    samples = [f"<html><p>page {i} of many</p></html>".encode() * 20 for i in range(200)]
    dictionary = warc.train(samples)
    assert dictionary[:4] == warc.DICTIONARY
    records = [warc.pack(HEADERS, warc.http_block(s, len(s))) for s in samples[:5]]
    raw = archive(records, dictionary)
    assert [r.payload() for r in warc.Reader(io.BytesIO(raw))] == samples[:5]
    held = zstandard.ZstdCompressor().compress(dictionary)
    other = struct.pack("<II", warc.SKIPPABLE, len(held)) + held + raw[8 + len(dictionary) :]
    assert [r.payload() for r in warc.Reader(io.BytesIO(other))] == samples[:5]


@pytest.mark.parametrize("spoil", [lambda r: r[:-1], lambda r: r[3:], lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8"), lambda r: r.replace(b"WARC-Date", b"Other"), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), lambda r: r.replace(b"Content-Length: 7", b"Content-Length: x")])
def test_broken_records(spoil):
    with pytest.raises(warc.WarcError):
        list(warc.Reader(io.BytesIO(archive([spoil(warc.pack(HEADERS, b"payload"))]))))


@pytest.mark.parametrize("raw", [b"", b"abcdefgh", struct.pack("<II", warc.SKIPPABLE, 99) + b"x", struct.pack("<II", warc.SKIPPABLE, 4) + b"junk"])
def test_broken_openings(raw):
    with pytest.raises(warc.WarcError):
        warc.Reader(io.BytesIO(raw))


def test_cut_off_frame():
    with pytest.raises(warc.WarcError):
        list(warc.Reader(io.BytesIO(archive([warc.pack(HEADERS, b"payload")])[:-5])))


def test_wrong_count_is_noticed(spark):
    path = shared_path(spark, "t")
    manifest = warc.write_archives(spark.createDataFrame([(1, "a", "x")], PAGES), path).withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records"):
        warc.read_archives(manifest, path).collect()


def test_payloads_beyond_a_batch_and_archives_that_roll(spark, monkeypatch):
    """A payload of many megabytes, ids of other types, and archives of a few records each."""
    monkeypatch.setattr(warc, "ROLL", 2000)
    big = "".join(chr(97 + i * i % 26) for i in range(300_000)) * 10
    rows = [(f"id {i}\n", f"http://a/{i}", big if i in (3, 7) else f"<p>{i}</p>" * 100) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    path = shared_path(spark, "t")
    manifest = warc.write_archives(pages, path)
    assert manifest.count() > 3 and sum(r["records"] for r in manifest.collect()) == 40
    got = {r["page_id"]: r for r in warc.read_archives(manifest, path, "string").collect()}
    assert set(got) == {i for i, *_ in rows} and got["id 3\n"]["refers_to"] == "id 7\n" and bytes(got["id 7\n"]["payload"]).decode() == big
    numbers = pages.selectExpr("cast(cast(substring(url, 10) as int) as decimal(20,0)) as page_id", "url", "html")
    path = shared_path(spark, "t")
    back = warc.read_archives(warc.write_archives(numbers, path), path, "decimal(20,0)")
    assert back.schema["page_id"].dataType == numbers.schema["page_id"].dataType and {int(r["page_id"]) for r in back.collect()} == set(range(40))


def test_a_collision_of_sha1_merges_nothing(spark, monkeypatch):
    real = warc._payload
    monkeypatch.setattr(warc, "_payload", lambda: real() | {"digest": F.lit("0" * 40)})
    rows = [(1, "u", "a" * 2000), (2, "u", "b" * 2000), (3, "u", "b" * 2000)]
    got = {r["page_id"]: r["first"] for r in warc.decided(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: None, 2: 3, 3: None}
