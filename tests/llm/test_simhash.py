import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ampertide.llm import simhash as S


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    nodes = sorted(set(fps.values()))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, v in fps.items():
        low[find(v)] = min(low.get(find(v), k), k)
    return {k: low[find(v)] for k, v in fps.items()}


def docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(900)]
    out = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one", 5: "one two", 6: "ONE TWO three", 7: "ÉA b c", 8: "éa b c"}
    for i in range(10, 60):
        w = list(base)
        w[rng.randrange(900)] = "changed"
        out[i] = " ".join(w)
    for i in range(60, 90):
        out[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
    out[90], out[91] = out[60], out[61].upper()
    out[95] = " ".join(base * 100)
    return out


def test_fingerprints_by_definition():
    for t in docs().values():
        assert S.fingerprint(t or "") == brute_fp(t)


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_components_equal_brute_force(docs_of, crowd):
    rows = docs()
    got = S.simhash_components(docs_of(list(rows.items())), crowd=crowd).collect()
    fps = {k: brute_fp(t) for k, t in rows.items()}
    want = brute_components(fps)
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("crowd", [2, 40])
def test_dense_and_chained_fingerprints(spark, crowd):
    rng = random.Random(8)
    fps = set()
    x = rng.getrandbits(64)
    for _ in range(60):  # a long chain of steps of two bits
        fps.add(x)
        x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    y = rng.getrandbits(64)
    fps |= {y ^ (1 << i) for i in range(64)} | {rng.getrandbits(64) for _ in range(50)}
    ids = {i: v for i, v in enumerate(sorted(fps, key=lambda v: v * 7919 % 1009))}
    want = brute_components(ids)
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in ids.items()]
    nodes = spark.createDataFrame(signed, "node long, label long")
    links = S.close_pairs(nodes.select(F.col("node").alias("fp")), crowd)
    got = {r.node: r.label for r in S.components(links, nodes).collect()}
    for v, i in signed:
        assert got.get(v, i) == want[i]


def test_nulls_and_repeated_rows(docs_of):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other words here now"), (None, "lonely text"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(docs_of(rows)).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=str)
    d = docs_of(rows)
    kept = S.keep_one(d)
    assert kept.columns == d.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(4, "a b c d"), (4, "other words here now"), (None, "lonely text"), (9, None)], key=str
    )


def test_empty_table(docs_of):
    assert S.simhash_components(docs_of([])).count() == 0
    assert S.keep_one(docs_of([])).count() == 0
