import base64
import hashlib
import random

from sparkbars.llm import warc
from sparkbars.llm.common import work_path

KIND = "page_id bigint, url string, html string"


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_round_trip(spark):
    rows = [(i, f"http://h{i % 5}.net/p{i % 9}", f"<p>{i % 12}</p>" * (i % 12 * 300)) for i in range(80)]
    rows += [(200, None, None), (201, "", ""), (202, "http://a.b/\r\nX: y", "é漢"), (203, "http://a.b/é?q=1#f", "\r\n\r\n" * 5), (204, "http://big/", "x" * 3_000_000), (-3, "http://h/", "n")]
    pages = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS run", "2 AS sha", "3 AS refers_to")
    got = warc.archive_and_index(pages).collect()
    first = {}
    for i, _, html in sorted(rows):
        data = (html or "").encode()
        first.setdefault(data, i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if first[(h or "").encode()] == i else "revisit", None if first[(h or "").encode()] == i else first[(h or "").encode()]) for i, _, h in rows)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert [(r.url_key, r.timestamp) for r in got] == sorted((r.url_key, r.timestamp) for r in got)


def test_minimum_size_ties_and_empty(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_index(spark.createDataFrame(rows, KIND), min_bytes=3).collect()), key=str)
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (None, "revisit", 3)], key=str)
    assert warc.archive_and_index(spark.createDataFrame([], KIND)).count() == 0


def test_archives_are_readable_files(spark):
    folder = work_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, f"http://x/{i}", "text" * i) for i in range(30)], KIND)
    files = warc.write_archives(pages, folder, most_bytes=2000).collect()
    assert sum(f.records for f in files) == 30 and len(files) > 2
    fs, path = warc.opened(files[0].archive)
    with fs.open_input_stream(path, compression=None) as stream:
        found = list(warc.members(stream))
    assert len(found) == files[0].records and all(d.startswith(b"WARC/1.1\r\n") for _, _, d in found)
    assert sum(n for _, n, _ in found) == files[0].bytes
