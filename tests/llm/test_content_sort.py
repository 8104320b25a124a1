import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ampertide.llm import content_sort as C

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (None, "a\nb"), (7, " "), (8, "\t \n"), (None, "solo"), (4, "a\u00a0b"),
    (6, "x" * 300_000), (11, "x" * 300_000), (12, "x" * 299_999), (13, "twin"), (13, "twin"), (14, "A B"),
]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return {k: (min((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


HOT = pytest.mark.parametrize("hot_rows", [0, 1, C.HOT_ROWS])  # every repeated text, some, none sorted apart


@HOT
def test_groups_equal_brute_force(docs_of, hot_rows):
    got = C.content_groups(docs_of(ROWS), cuts=4, hot_rows=hot_rows).collect()
    want = brute(ROWS)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@HOT
@pytest.mark.parametrize("blind", ["_digest", "_hash", "both"])
def test_groups_need_neither_digest_nor_hash(docs_of, monkeypatch, hot_rows, blind):
    if blind != "_hash":
        monkeypatch.setattr(C, "_digest", lambda norm: F.lit("same"))
    if blind != "_digest":
        monkeypatch.setattr(C, "_hash", lambda norm: F.lit(7).cast("long"))
    rows = [r for r in ROWS if r[0] is not None and r[0] != 13]
    docs = docs_of(rows)
    want = {i: brute(rows)[norm(t)] for i, t in rows}
    got = C.content_groups(docs, cuts=4, hot_rows=hot_rows).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert {r.doc_id for r in got if r.kept} == {v[0] for v in want.values()}
    assert {r.doc_id for r in C.drop_copies(docs, cuts=4, hot_rows=hot_rows).collect()} == {v[0] for v in want.values()}


def test_one_text_is_split_over_partitions(spark, docs_of):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(200)]
    docs = docs_of(rows).repartition(7)
    for hot_rows in (10, C.HOT_ROWS):
        got = C.content_groups(docs, hot_rows=hot_rows).collect()
        assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 400} == {(0, 400)}
        assert sorted(r.doc_id for r in got if r.kept) == [0, *range(1000, 1200)]
    plain, hot = C._split_hot(docs, "text", 10)
    assert (plain.count(), hot.count()) == (200, 400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = C._sorted_ranges(hot, "doc_id", "text", False, C.CUTS).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 6 and max(r["count"] for r in held) < 120


@HOT
def test_drop_copies_keeps_whole_rows(docs_of, hot_rows):
    d = docs_of(ROWS)
    kept = C.drop_copies(d, cuts=4, hot_rows=hot_rows)
    assert kept.columns == d.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(brute(ROWS))
    want = brute(ROWS)
    for i, t in rows:
        assert i == want[norm(t)][0]


def test_empty_table(docs_of):
    assert C.content_groups(docs_of([])).count() == 0
    assert C.drop_copies(docs_of([])).count() == 0
