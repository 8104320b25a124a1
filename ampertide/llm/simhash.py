"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks.

Fingerprints are made where documents are read. Equal ones are one node, so copies are never
paired. Four quarters of 16 bits: two fingerprints within 2 bits agree on at least two
quarters, so each fingerprint is filed under its 6 pairs of quarters and pairs are sought
within a block of 32 equal bits only; every pair is verified by its Hamming distance.

A block with few members joins with itself. In a crowded one (a family of near copies
shares it) that would emit all pairs, so its members are filed once more under their other
32 bits with each single bit flipped: members that share such a key are within two bits
of each other, a key has at most 33 members, and linking each to the smallest of its key
keeps every connection. Both ways are exact; the size of a block only decides the cheaper.

Components: smallest label along links with label shortcuts, each round a written table.

Defined results: null text is empty; no words gives fingerprint zero, linked like any other;
null identifiers take part and lose against any other; repeated rows get a row each; an empty
table gives an empty result; further columns are ignored (passed on by `keep_one`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertide.session import cut

from .common import packed_row, text_of, unpacked

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CROWD = 32
QUARTERS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each the majority over the hashes of the text's word shingles."""
    # On bytes, split() splits at exactly the ASCII white space and lower() changes A-Z only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    h = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist())
        hashes = np.fromiter((h(joined[a:b], seed) for a, b in spans), np.uint64, hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): the fingerprint as a signed long; the hash tells rows of one id apart."""
    text = text_of(text_col)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            cols = [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text_hash", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def _quarter(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _blocks(fps: DataFrame) -> DataFrame:
    """(kind, key, fp): the six pairs of quarters of each fingerprint."""
    fp = F.col("fp")
    filed = [
        F.struct(F.lit(k).alias("kind"), (_quarter(fp, a) * 65536 + _quarter(fp, b)).alias("key"))
        for k, (a, b) in enumerate(QUARTERS)
    ]
    return fps.select("fp", F.explode(F.array(*filed)).alias("b")).select("b.kind", "b.key", "fp")


def _rest(kind: Column, fp: Column) -> Column:
    """The 32 bits outside a block's two quarters."""
    out = F.lit(None).cast("long")
    for k, pair in enumerate(QUARTERS):
        c, d = [q for q in range(4) if q not in pair]
        out = F.when(kind == k, _quarter(fp, c) * 65536 + _quarter(fp, d)).otherwise(out)
    return out


def close_pairs(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints within MAX_BITS; not all of a crowd's pairs,
    but enough to connect all that are connected."""
    blocks = _blocks(fps)
    sizes = blocks.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = cut(blocks.join(sizes, ["kind", "key"]))
    few = filed.filter(F.col("n") <= crowd)
    left, right = few.select("kind", "key", F.col("fp").alias("a")), few.select("kind", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["kind", "key"]).filter("a < b").select("a", "b")
    many = filed.filter(F.col("n") > crowd).withColumn("rest", _rest(F.col("kind"), F.col("fp")))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    keys = many.select("kind", "key", "fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("rest")))).alias("near"))
    families = keys.groupBy("kind", "key", "near").agg(F.array_sort(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = families.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return pairs.unionByName(stars).filter(near).distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest label that links reach. links: (a, b); nodes: (node, label),
    at least those that links name; labels are of any ordered type."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = both.select(F.col("a").alias("node")).distinct()
    # The root beside a label is a node, so that a shortcut can follow it.
    state = cut(nodes.join(linked, "node").select("node", F.struct("label", F.col("node").alias("root")).alias("at")))
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "at"), "b").groupBy("a").agg(F.min("at").alias("seen"))
        near = state.join(seen, state["node"] == seen["a"])
        step = cut(near.select("node", F.col("at").alias("old"), F.least("at", "seen").alias("at")))
        tops = step.select(F.col("node").alias("root"), F.col("at").alias("top"))
        jump = step.withColumn("root", F.col("at.root")).join(tops, "root")
        jump = cut(jump.select("node", "old", F.least("at", "top").alias("at")))
        state = jump.select("node", "at")
        if jump.filter(F.col("old.root") != F.col("at.root")).isEmpty():
            return state.select("node", F.col("at.label").alias("label"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, crowd: int) -> DataFrame:
    """(id, text_hash, fp, label); a label is the first (none, id, text_hash) of a component."""
    marks = cut(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    nodes = cut(marks.groupBy(F.col("fp").alias("node")).agg(first.alias("label")))
    links = cut(close_pairs(nodes.select(F.col("node").alias("fp")), crowd))
    moved = components(links, nodes).withColumnRenamed("label", "lower")
    final = nodes.join(moved, "node", "left").select(F.col("node").alias("fp"), F.coalesce("lower", "label").alias("label"))
    return marks.join(final, "fp")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD
) -> DataFrame:
    """One row per document: identifier, fingerprint, component_id."""
    return _labelled(docs, id_col, text_col, shingle, crowd).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("label.id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """The table with one document of each component, the smallest identifier."""
    marks = _labelled(docs, id_col, text_col, shingle, crowd)
    stays = F.col("id").eqNullSafe(F.col("label.id")) & (F.col("text_hash") == F.col("label.text_hash"))
    lost = marks.filter(~stays).select(F.col("id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).distinct()
    rows = docs.select(packed_row(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    left = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left_anti")
    # Fully repeated rows: one of them stays.
    nth = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.lit(0)))
    return unpacked(left.withColumn("nth", nth).filter("nth = 1"), docs.schema)
