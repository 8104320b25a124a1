import gzip
import hashlib
import io
from collections import defaultdict

from pyspark.sql import functions as F

from ampertide.llm import warc as W
from ampertide.session import scratch_path

BIG = "<p>é</p>" * 150
ROWS = [
    (1, "http://a/x", BIG), (2, "http://b/ y\r\nEvil: 1", BIG), (3, None, BIG + "z"), (4, "http://c", None), (5, "http://c", ""),
    (6, "http://d", "small"), (7, "http://d", "small"), (8, "http://e", "WARC/1.1\r\n\r\n\r\n\r\n" + "\r\n" * 800), (9, "u", BIG),
    (9, "u", BIG), (None, "http://n", BIG), (None, "http://n", "q" * 2000), (10, "http://t", "y" * 999), (11, "http://t", "y" * 999),
    (12, "http://t", "y" * 1000), (13, "http://t", "y" * 1000), (14, "l", "long " * 400_000),
]


def pages(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    return d.withColumns({c: F.lit(1) for c in ("digest", "nth", "payload", "original", "record", "block", "page")})


def test_index_equals_brute_force(spark):
    got = W.archive_round_trip(pages(spark).repartition(3)).collect()
    groups = defaultdict(list)
    for p, _, h in ROWS:
        groups[h or ""].append(p)
    want = []
    for h, ids in groups.items():
        data = h.encode()
        sha = hashlib.sha1(data).hexdigest()
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for p in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            again = len(data) >= 1000 and not first
            first = False
            want.append((p, len(data), sha, "revisit" if again else "response", top if again else None))
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_archives_are_valid_records(spark):
    folder = scratch_path(spark, "warc-test")
    W.write_archives(pages(spark), folder, file_records=4)
    files = spark.read.format("binaryFile").load(folder).select("content", "length").collect()
    assert len(files) >= 4
    types, responses, refers = [], set(), set()
    for f in files:
        for head, http, payload in W.records_in(bytes(f.content)):
            types.append(head["warc-type"])
            if head["warc-type"] == "response":
                responses.add(head["warc-record-id"])
                assert int(http["content-length"]) == len(payload)
            else:
                refers.add(head["warc-refers-to"])
                assert payload == b"" and head["warc-profile"] == W.PROFILE
            assert "evil" not in head
    assert len(types) == len(ROWS) and refers <= responses and len(responses) == types.count("response")


def test_reader_takes_member_gzip():
    rec = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab\r\n\r\n"
    data = gzip.compress(rec) + gzip.compress(rec)
    assert [p for _, _, p in W.records_in(data)] == [b"ab", b"ab"]
    assert io.BytesIO(data).read(2) == b"\x1f\x8b"


def test_empty_table(spark):
    assert W.archive_round_trip(pages(spark, [])).count() == 0
