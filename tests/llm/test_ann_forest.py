import numpy as np
import pytest
from pyspark.sql import functions as F

from ampertide.llm import ann_forest as A


def table(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return d.withColumns({c: F.lit(0) for c in ("v", "row", "dim", "block", "label")})


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is None or i % 50:
            continue
        s = [(-(v @ q) / (np.sqrt(v @ v) * np.sqrt(q @ q)), j) for b, (j, v) in enumerate(ok) if b != a and len(v) == len(q)]
        out.append((i, [(j, -x) for x, j in sorted(s)[:k]]))
    return out


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return {k: sorted(v, key=lambda r: r["rank"]) for k, v in out.items()}


def test_edge_cases_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(0, 200, 10)]
    rows += [(201, None), (202, [0.0] * 6), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (300, [float("inf")] + [0.0] * 5)]
    rows += [(350, [1.0, 2.0]), (351, [2.0, 4.0]), (352, [-1.0, 0.5]), (400, [3.0] * 9)]
    same = rng.normal(size=6)
    rows += [(500 + i, (same * 2.0 ** (i % 3)).tolist()) for i in range(40)]
    got = collect(A.nearest(table(spark, rows)))
    for q, want in brute(rows, 5):
        if not want:
            assert q not in got
            continue
        assert [r["rank"] for r in got[q]] == list(range(1, len(want) + 1))
        assert [r.score for r in got[q]] == pytest.approx([s for _, s in want], abs=1e-12)
        assert [r.vec_id for r in got[q]] == [j for j, _ in want]
    assert set(got) == {q for q, w in brute(rows, 5) if w}


def test_equal_vectors_go_by_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 0, -1)]
    got = collect(A.nearest(table(spark, rows)))
    assert [r.vec_id for r in got[50]] == [1, 2, 3, 4, 5] and [r.vec_id for r in got[100]] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("spread", [0.2, None])
def test_recall_over_many_blocks(spark, spread):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    if spread:
        x = x[rng.integers(40, size=6000)] + spread * rng.normal(size=(6000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collect(A.nearest(table(spark, rows), block_rows=1500, query_block=50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hit += len({r.vec_id for r in got[q]} & set(np.argsort(-s)[:5].tolist()))
    assert hit / 600 >= 0.9


def test_ranges_hold_exactly_the_rows_with_the_prefix():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    h = A.hash_strings(unit)
    order = np.argsort(h, axis=0, kind="stable").astype(np.uint32)
    rec = {
        "dim": 8, "ids": np.arange(300).tobytes(), "rows": np.arange(300).tobytes(), "vecs": v.tobytes(),
        "strings": np.ascontiguousarray(np.take_along_axis(h, order, 0).T).tobytes(), "places": np.ascontiguousarray(order.T).tobytes(),
    }
    block = A._Block(rec)
    depth = rng.integers(0, 8, 20)
    mask = block.ascend(h[:20], depth)
    for i in range(20):
        want = [any(int(h[i, t]) >> (32 - d) == int(h[j, t]) >> (32 - d) for t in range(A.TREES)) for j in range(300) for d in [int(depth[i])]]
        assert mask[i].tolist() == want


def test_empty_table(spark):
    assert A.nearest(table(spark, [])).count() == 0


def test_extreme_magnitudes_take_part(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    power = [0, 1000, -1000, 600, -1060, 1020]
    rows = [(i, np.ldexp(v, power[i % 6]).tolist()) for i, v in enumerate(x)]
    got = collect(A.nearest(table(spark, rows)))
    plain = collect(A.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    for q in (0, 50):
        assert [r.vec_id for r in got[q]] == [r.vec_id for r in plain[q]]
        assert [r.score for r in got[q]] == pytest.approx([r.score for r in plain[q]], abs=1e-3)  # 2 ** -1060 leaves few digits
        assert all(np.isfinite(r.score) for r in got[q])


def test_driver_sees_no_vectors(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows brought to the driver")

    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    t = table(spark, rows)
    for name in ("collect", "toArrow", "toPandas", "head"):
        monkeypatch.setattr(type(t), name, refuse)
    found = A.nearest(t, block_rows=50, query_block=2)
    monkeypatch.undo()
    got = collect(found)
    for q, want in brute(rows, 5):
        assert [r.vec_id for r in got[q]] == [j for j, _ in want]
