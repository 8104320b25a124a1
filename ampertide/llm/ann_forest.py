"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets one long string of sign bits of random projections per tree. Rows are dealt by
hash into blocks of about `BLOCK_ROWS`; per block and tree the strings form one sorted array, in
which all rows that share a prefix with a query are one contiguous range. The index is
written as a table with one row per block.

Queries are packed into blocks of `QUERY_BLOCK` rows, `QUERY_GROUP` of them to a group. A task gets
one index block and one group of queries, joined on their numbers, so its size is fixed, and
the driver sees no vector. A query first descends: in each tree its place in the sorted array shows the rows with the longest common prefix, whose
length varies with the data. The best five of these give a lower bound on the fifth-best
cosine. Then all trees ascend together, to the depth at which a row of that cosine shares a prefix
with the query in at least one tree with probability `TARGET`; all rows of these ranges are
candidates, none are capped, and are compared in double precision. Clustered data
stop at long prefixes; data without near neighbours ascend far, as they must for that recall.
Should fewer than the asked neighbours turn up, the query ascends to the root.

Vectors are scaled by a power of two before anything else, so that norms neither overflow nor
vanish; cosines are those of the original vectors to the last digit.

The descent looks at `PROBE_BLOCKS` blocks at most; fewer blocks give a lower bound, hence a
further ascent, never fewer candidates.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no
part; vectors meet only vectors of the same length; equal scores go by smaller vec_id; rows of one
vec_id are rows of their own, each a candidate of the others; without valid rows the result is
empty; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampertide.session import cut

TREES, BITS = 32, 32
BLOCK_ROWS = 1 << 14
QUERY_BLOCK = 1 << 11
QUERY_GROUP = 8
PROBE_BLOCKS = 64
TARGET = 0.95
SIDE = 2
SLICE = 128

_PLANES: dict[int, np.ndarray] = {}


def planes(dim: int) -> np.ndarray:
    if dim not in _PLANES:
        _PLANES[dim] = np.random.default_rng(20_000 + dim).standard_normal((dim, TREES * BITS)).astype(np.float32)
    return _PLANES[dim]


def hash_strings(unit: np.ndarray) -> np.ndarray:
    """(rows, TREES) sign-bit strings, first projection in the highest bit."""
    signs = unit.astype(np.float32) @ planes(unit.shape[1]) > 0
    packed = np.packbits(signs.reshape(len(unit), TREES, BITS), axis=2)
    return packed.reshape(len(unit), TREES, BITS // 8).copy().view(">u4").reshape(len(unit), TREES).astype(np.uint32)


def level(v: np.ndarray) -> np.ndarray:
    """Rows with the largest component brought to [0.5, 1) by a power of two."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, row, dim, v array<double>) of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & fine).withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids, vectors and, per tree, the sorted strings and their order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        v = level(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        h = hash_strings(v / np.linalg.norm(v, axis=1, keepdims=True))
        order = np.argsort(h, axis=0, kind="stable").astype(np.uint32)
        strings = np.take_along_axis(h, order, axis=0)
        return pd.DataFrame(
            {
                "dim": [v.shape[1]], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "vecs": [v.tobytes()],
                "strings": [np.ascontiguousarray(strings.T).tobytes()], "places": [np.ascontiguousarray(order.T).tobytes()],
            }
        )

    dealt = rows.withColumn("block", _dealt(blocks))
    schema = "dim int, block int, ids binary, rows binary, vecs binary, strings binary, places binary"
    return dealt.groupBy("dim", "block").applyInPandas(build, schema)


def _dealt(n: int):
    return F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")


def pack_queries(asked: DataFrame, blocks: int) -> DataFrame:
    """One row per block of queries: ids, vectors, and the lower bounds of the k-th cosine."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = level(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame(
            {
                "dim": [v.shape[1]], "qblock": [int(pdf["qblock"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "vecs": [v.tobytes()],
                "bounds": [pdf["bound"].to_numpy(np.float64).tobytes()],
            }
        )

    schema = "dim int, qblock int, ids binary, rows binary, vecs binary, bounds binary"
    return asked.withColumn("qblock", _dealt(blocks)).groupBy("dim", "qblock").applyInPandas(pack, schema)


class _Block:
    def __init__(self, rec):
        self.ids, self.rows = (np.frombuffer(rec[k], np.int64) for k in ("ids", "rows"))
        n = len(self.ids)
        self.vecs = np.frombuffer(rec["vecs"], np.float64).reshape(n, rec["dim"])
        self.unit = self.vecs / np.linalg.norm(self.vecs, axis=1, keepdims=True)
        self.strings = np.frombuffer(rec["strings"], np.uint32).reshape(TREES, n)
        self.places = np.frombuffer(rec["places"], np.uint32).reshape(TREES, n)

    def descend(self, q: np.ndarray):
        """Per query the rows beside its place in every tree: those of the longest prefixes."""
        n = len(self.ids)
        near = []
        for t in range(TREES):
            at = np.searchsorted(self.strings[t], q[:, t])
            for o in range(-SIDE, SIDE):
                near.append(self.places[t][np.clip(at + o, 0, n - 1)])
        return [np.unique(x) for x in np.stack(near, axis=1)]

    def ascend(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Per query a mask of the rows that share its first `depth` bits in some tree."""
        mask = np.zeros((len(q), len(self.ids)), dtype=bool)
        low = (np.uint64(0xFFFFFFFF) << (BITS - depth).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        for t in range(TREES):
            a = q[:, t].astype(np.uint64) & low
            z = a | (~low & np.uint64(0xFFFFFFFF))
            lo = np.searchsorted(self.strings[t], a.astype(np.uint32), "left")
            hi = np.searchsorted(self.strings[t], z.astype(np.uint32), "right")
            for i in range(len(q)):
                mask[i, self.places[t][lo[i] : hi[i]]] = True
        return mask


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, equal scores by smaller id; ties at the end are all looked at."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= edge)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))][:k]


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", v, q) / (np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(q @ q))


def _search_block(block: _Block, rec, k: int, ascend: bool):
    """(query_id, query_row, vec_id, row, score): the k best of every query of one block of queries."""
    ids, rows = (np.frombuffer(rec[c], np.int64) for c in ("ids", "rows"))
    vecs = np.frombuffer(rec["vecs"], np.float64).reshape(len(ids), rec["dim"])
    bounds = np.frombuffer(rec["bounds"], np.float64)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    strings = hash_strings(unit)
    # A query without k neighbours so far ascends to the root.
    depth = np.where(np.isfinite(bounds), depth_for(bounds), 0)
    for lo in range(0, len(ids), SLICE):
        part = slice(lo, lo + SLICE)
        if ascend:
            mask = block.ascend(strings[part], depth[part])
            rough = unit[part] @ block.unit.T if mask.mean() > 0.125 else None
            near = [np.flatnonzero(m) for m in mask]
        else:
            near, rough = block.descend(strings[part]), None
        for j, cand in enumerate(near):
            i = lo + j
            cand = cand[block.rows[cand] != rows[i]]
            s = rough[j, cand] if rough is not None else block.unit[cand] @ unit[i]
            # Rough scores are within rounding of the exact ones: keep a margin.
            least = max(bounds[i], np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf) - 1e-9
            cand = cand[s >= least]
            exact = _cosines(vecs[i], block.vecs[cand])
            best = _best(exact, block.ids[cand], k)
            yield ids[i], rows[i], block.ids[cand[best]], block.rows[cand[best]], exact[best]


def _search(index: DataFrame, queries: DataFrame, numbers: range, qblocks: int, k: int, ascend: bool) -> DataFrame:
    """(query_id, query_row, vec_id, row, score): per index block the k best of each query's
    candidates. Every index block of `numbers` meets every group of query blocks in a task of its own."""
    groups = -(-qblocks // QUERY_GROUP)
    cols = ["query_id", "query_row", "vec_id", "row", "score"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left):
            block = _Block(left.iloc[0])
            for q in right.to_dict("records"):
                for query_id, query_row, vec_id, row, score in _search_block(block, q, k, ascend):
                    found.append(pd.DataFrame({"query_id": query_id, "query_row": query_row, "vec_id": vec_id, "row": row, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in cols})

    keys = ["dim", "block", "group"]
    # A stated number of tasks keeps runtime coalescing, which sees bytes only, from joining them.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(numbers) * groups, 1 << 16))
    each = F.sequence(F.lit(numbers.start), F.lit(numbers.stop - 1), F.lit(numbers.step))
    left = index.filter(F.col("block") % numbers.step == 0).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumns({"group": F.floor(F.col("qblock") / QUERY_GROUP).cast("int"), "block": F.explode(each)})
    both = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
    return both.applyInPandas(run, "query_id long, query_row long, vec_id long, row long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def depth_for(cosine: np.ndarray, target: float = TARGET) -> np.ndarray:
    """The longest prefix that a row of this cosine shares in some tree with probability target."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore"):
        need = 1 - (1 - target) ** (1 / TREES)
        d = np.floor(np.log(need) / np.log(np.clip(p, 1e-12, 1 - 1e-9)))
    return np.clip(d, 0, BITS).astype(np.int64)


def nearest(
    table: DataFrame, k: int = 5, query_step: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id query_step divides."""
    rows = cut(valid_vectors(table, id_col, vec_col))
    blocks = max(1, -(-rows.count() // block_rows))
    index = cut(build_index(rows, blocks))
    asked = rows.filter(F.col("vec_id") % query_step == 0)
    qblocks = max(1, -(-asked.count() // query_block))

    first = cut(pack_queries(asked.withColumn("bound", F.lit(float("-inf"))), qblocks))
    probed = range(0, blocks, -(-blocks // PROBE_BLOCKS))
    kth = _top(_search(index, first, probed, qblocks, k, False), k).groupBy("query_row")
    kth = kth.agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    bound = F.coalesce("least", F.lit(float("-inf")))
    bounded = asked.join(kth, F.col("row") == F.col("query_row"), "left").select("vec_id", "row", "dim", "v", bound.alias("bound"))
    queries = cut(pack_queries(bounded, qblocks))
    found = _search(index, queries, range(blocks), qblocks, k, True)
    return cut(_top(found, k).select("query_id", "rank", "vec_id", "score"))
