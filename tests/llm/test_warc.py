import base64
import hashlib
import random
import struct

import duckdb
import pytest
import zstandard

from sievewatch.llm import queries, warc
from sievewatch.llm.common import work_path

PAGE = "page_id long, url string, html string"


def plain(rows):
    """(id, bytes, digest, type, refers to) of each row, by definition."""
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "").encode() == payload]
        first = min((j for j in equal if j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "response" if i == first else "revisit", None if i == first else first))
    return out


def odd_rows():
    rng = random.Random(4)
    shared = "<html>" + "the same page " * 40
    rows = [(n, f"http://h{n % 7}.example/{n}", "<html><body>" + " ".join(rng.choices("alpha beta gamma delta é 𝄞".split(), k=rng.choice([3, 40, 900])))) for n in range(300)]
    rows += [(n, "http://copy.example/", shared) for n in range(1000, 1200)]
    rows += [
        (2000, None, None), (2001, "", ""), (2002, "http://x/ a\r\nWARC-Type: no", "a\r\n\r\nWARC/1.1\r\n\r\n"), (2003, "http://x/b", "x" * 3_000_000), (2004, "é", "P*M\x18\0\0\0\0" * 9),
        (None, "http://x/null", shared), (None, "http://x/alone", "only null ids"), (None, "http://x/alone", "only null ids"), (2005, "u", "twice"), (2005, "u", "twice"), (2006, "u", "twice"),
    ]
    return rows


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(odd_rows(), PAGE).selectExpr("*", "'x' AS id", "'y' AS payload", "1 AS digest", "2 AS file")


def test_records_come_back(spark, pages):
    path = work_path(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path, file_bytes=40_000, sample_bytes=100_000)
    got = warc.read_archives(spark, path).collect()
    rows = odd_rows()
    assert sorted(map(repr, ((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, plain(rows)))
    by_id = {i: (u, h) for i, u, h in rows if i is not None}
    for r in got:
        if r.record_type == "response" and r.id is not None:
            assert bytes(r.payload).decode() == (by_id[r.id][1] or "")
        if r.record_type == "revisit":
            assert r.payload is None
    assert {r.id: r.target_uri for r in got if r.id in (0, 2000, 2001, 2002)} == {0: "http://h0.example/0", 2000: None, 2001: "", 2002: "http://x/%20a%0D%0AWARC-Type:%20no"}


def test_files_are_plain_zstandard_with_the_dictionary_first(spark, pages):
    path = work_path(spark, "warc-test")
    warc.write_archives(pages.repartition(2), path, file_bytes=40_000, sample_bytes=100_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    assert len(files) > 2
    for f in files:
        data = bytes(f.content)
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8: 8 + size]))
        # any decoder that knows the dictionary reads the whole file as one stream
        whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size:], read_across_frames=True).read()
        records = list(warc.archive_records(memoryview(data)))
        assert whole == b"".join(records)
        assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)


def test_dictionary_makes_records_smaller():
    rng = random.Random(1)
    samples = [f"<html><head><title>{rng.random()}</title></head><body class='page'>{' '.join(rng.choices('one two three four five'.split(), k=30))}</body></html>".encode() for _ in range(3000)]
    dictionary = warc.build_dictionary(samples)
    assert dictionary.as_bytes()[:4] == struct.pack("<I", 0xEC30A437)  # a trained one
    with_, without = (sum(len(p.compress(s)) for s in samples) for p in (zstandard.ZstdCompressor(level=3, dict_data=dictionary), zstandard.ZstdCompressor(level=3)))
    assert with_ < 0.7 * without


def test_damage_is_noticed(spark, pages):
    record = warc.page_record(1, "u", b"payload", False, None, "2026-01-01T00:00:00Z")
    assert warc.parse_record(record)[:3] == (1, "u", 7)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload\r\n", b"payloa\r\n"))


def test_short_payloads_are_never_revisits(spark, pages):
    path = work_path(spark, "warc-test")
    warc.write_archives(pages, path, least=10)
    got = warc.read_archives(spark, path, payloads=False).collect()
    assert {r.record_type for r in got if r.payload_bytes < 10} == {"response"}
    assert sum(r.record_type == "revisit" for r in got) == sum(r[3] == "revisit" for r in plain(odd_rows()) if r[1] >= 10)


def test_empty_table(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGE)).count() == 0


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    expected = con.execute(warc.ARCHIVE_SQL).fetchall()
    got = queries.op11_warc_archives(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
