import hashlib
import base64

import numpy as np
import pytest
from oracle_check import compare, duck
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tidemark.llm import warc

SF = "/root/testdata/sf0.001"
FORGED = warc.record(9, "u", b"inner", warc.base32_sha1(b"inner"), None, "1970-01-01T00:00:00Z").decode()
PAGES = [
    (5, "http://a/ b", "same payload", "x"),
    (3, "http://b", "same payload", "x"),
    (4, None, "same payload", None),
    (None, "http://n", "same payload", None),
    (7, "http://e", None, None),
    (8, "http://e", "", None),
    (10, "http://f", f"before {FORGED}{FORGED} after WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", None),
    (11, "http://g", "é" * 300_000 + "WARC/1.0\r\n" * 1000, None),
    (12, "http://h\r\nContent-Length: 7", "x", None),
    (12, "http://h", "x", None),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    files = warc.write_archives(pages(spark), file_bytes=1 << 18)
    made = sorted(map(tuple, warc.read_archives(files).drop("url").collect()), key=repr)
    first = {}
    for i, _, html, _ in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kept = first[html or ""] == i
        expected.append((i, len(data), digest, "response" if kept else "revisit", None if kept else first[html or ""], bytearray(data) if kept else None))
    assert made == sorted(expected, key=repr)


def test_urls_of_any_length_and_content_come_back(spark):
    urls = ["http://long/" + "a" * 100_000, "http://magic/" + "WARC/1.0\r\n" * 20_000, "http://a b%20c/\x00\x7f\u2028é\"", "", " ", None, "http://plain/%2520"]
    frame = spark.createDataFrame([(i, u, f"page {i % 3}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    files = warc.write_archives(frame)
    made = {r["page_id"]: r["url"] for r in warc.read_archives(files).collect()}
    assert made == dict(enumerate(urls))
    assert warc.boundaries(files, 4096).selectExpr("sum(length(offsets) div 8) as n").first().n == len(urls)


def test_many_magics_without_an_empty_line_are_searched_once():
    payload = b"WARC/1.0\r\nContent-Length: 1\r\n" * 100_000
    data = warc.record(1, "u", payload, warc.base32_sha1(payload), None, "1970-01-01T00:00:00Z")
    offsets, after = warc.candidates(data, 0, len(data))
    assert len(offsets) == 100_001 and after[0] == len(data) and set(after[1:]) == {-1}


def test_small_ranges_find_the_same_records(spark):
    files = warc.write_archives(pages(spark))
    for size in (17, 1000):
        small = [tuple(r) for r in warc.boundaries(files, size).collect()]
        found = sorted((p, o) for p, x in small for o in np.frombuffer(x, np.int64).tolist())
        whole = sorted((p, o) for p, x in map(tuple, warc.boundaries(files).collect()) for o in np.frombuffer(x, np.int64).tolist())
        assert found == whole and len(found) == len(PAGES)


def test_a_broken_chain_is_an_error(spark):
    files = warc.write_archives(pages(spark).limit(3).coalesce(1))
    path = files.where("size > 0").first()["path"]
    with open(path, "r+b") as file:
        file.truncate(100)
    with pytest.raises((PySparkException, Py4JJavaError, ValueError), match="breaks off|mmap"):
        warc.read_archives(files).collect()


def test_pointer_jumping_equals_a_walk():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 50):
        offsets = np.cumsum(random.integers(5, 20, n)) - 0
        offsets = np.r_[0, offsets]
        true = np.r_[0, np.sort(random.choice(np.arange(1, n + 1), n // 2, replace=False))].astype(int)
        after = np.full(n + 1, -1)
        size = int(offsets[-1]) + 30
        after[true] = np.r_[offsets[true[1:]], size]
        assert np.flatnonzero(warc.reachable(offsets, after, size)).tolist() == true.tolist()


def test_threshold_and_empty_table(spark):
    made = warc.read_archives(warc.write_archives(pages(spark), min_bytes=5)).where("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in made} == {4, 5, None}
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0))).count() == 0


def test_query_matches_oracle(spark):
    assert compare(warc.query(spark, SF), duck(SF), warc.ORACLE) is None
