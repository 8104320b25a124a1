"""Best-fit packing by sums of squares.

Documents are encoded where they are read; only (piece, start, length, checksum) go on. Pieces
are dealt by hash into groups of about `group_pieces`, so a group is bounded whatever the
input, and each group is packed on its own: a piece goes to the open sequence for which the
sum of squared counts of open sequences per residual gap becomes smallest, and to a fresh one
when none has room. Within a group, pieces come longest first, so the short ones are left to
close gaps; a group then ends within a sequence or two of the bound ceil(tokens / capacity)
unless most pieces are over half the capacity.

Defined results: a null or empty text is its closing id alone; documents over the capacity are
cut into full pieces, the remainder first; repeated rows are documents of their own; an empty
table gives no pieces; further columns are ignored. Placement is a function of the rows'
identifiers and lengths, so a recomputed task gives the same sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertide.session import cut

from .bpe import default_path, encoder
from .common import text_of

CAPACITY = 2048
GROUP_PIECES = 20_000
END_ID = 0
PIECES = "id {id}, row long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what full pieces leave."""
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def encode_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """A row per piece; `row` tells rows of one identifier apart."""
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text")
    )
    id_type = src.schema["id"].dataType

    def run(batches):
        enc = encoder(path)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                ids = np.concatenate([enc.encode(text).astype("<u4", copy=False), end])
                for k, (s, n) in enumerate(cut_lengths(len(ids), capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return src.mapInArrow(run, PIECES.format(id=id_type.simpleString()))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the given order.

    Moving a piece of size s into a sequence of gap g changes the sum of squared counts by
    2*(n[g-s] - n[g] + 1), closing one exactly by 1 - 2*n[g]. Equal changes prefer the
    smaller gap."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        counts = n[s:capacity]
        some = np.flatnonzero(counts)
        if len(some):
            change = 2 * (n[some] - counts[some] + 1)
            if some[0] == 0:
                change[0] = 1 - 2 * counts[0]
            gap = int(some[change.argmin()]) + s
            b = stacks[gap].pop()
            n[gap] -= 1
        else:
            b, gap, opened = opened, capacity, opened + 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            n[gap - s] += 1
    return where, offset


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares over the pieces, longest first; results in the given order."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    where[order], offset[order] = sum_of_squares(lengths[order], capacity)
    return where, offset


def _pack_groups(pieces: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Adds sequence_id and offset."""
    names = pieces.columns
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row", "piece"], kind="stable", ignore_index=True)
        where, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
        out = pdf[names].copy()
        out["sequence_id"] = (int(pdf["grp"].iloc[0]) << 24) + where
        out["offset"] = offset
        return out

    deal = F.pmod(F.xxhash64("id", "row", "piece"), F.lit(groups))
    dealt = pieces.withColumn("grp", deal)
    return dealt.groupBy("grp").applyInPandas(run, base + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    path: str | None = None, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: identifier, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(encode_pieces(docs, capacity, id_col, text_col, path or default_path()))
    full = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.lit(-1).cast("long") - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    loose = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // group_pieces))
    out = full.unionByName(_pack_groups(loose, groups, capacity))
    return out.drop("row").withColumnRenamed("id", id_col)
