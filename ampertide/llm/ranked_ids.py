"""Token ids in binary files: frequency ranks, one to four bytes each, lengths in control bytes.

Ids are replaced by their rank by frequency over the whole corpus, so that the commonest take one
byte. Per document, the lengths of all ranks come first (two bits each, four to a control byte), then
the bytes of the ranks, little-endian. Decoding has no branch: a control byte looks up where the
bytes of its four ranks lie, and one gather takes them.

A file is a run of records, one per document, each ended by a line feed:

    u32 length of the identifier (0xFFFFFFFF: null) | u32 number of ids | u32 number of rank bytes |
    identifier as text in UTF-8 | control bytes | rank bytes | 0x0A

Files stand in `part=<i>/chunk=<j>`, ascending in (i, j), and documents ascend within a file. The
rank table (id of each rank, u32) lies beside them in `ranks`. Spark's text writer writes the records
and `binaryFile` reads them back, so any store that Spark reaches will do, and lost tasks are
written again by the usual commit rules.

Documents are encoded once, into a table with their ids, which also gives the counts per id; the
driver takes the rank table, bounded by the vocabulary. A range exchange by identifier moves the ids
once. A range is cut into chunks by its running count of ids, so a file holds at most
`file_tokens` ids and one document more; that document alone must stay under 2 GB.

Defined results: a null or empty text has the end id alone; null identifiers come first; documents of
one identifier follow in the order of length, checksum and place in the table; an empty table writes
no records and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampertide.operators.ordered import running_total
from ampertide.session import cut, scratch_path

from .bpe import default_path, encoder
from .common import text_of, written

END_ID = 2
FILE_TOKENS = 1 << 22
SLICE = 1 << 18  # ids coded at a time; a multiple of four
HEAD = "<III"
NO_ID = 0xFFFFFFFF


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per control byte: bytes of its four ranks, place of each of the 16 result bytes, and which
    of these are present."""
    lengths = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
    begins = np.cumsum(lengths, 1) - lengths
    byte = np.arange(4)
    present = byte < lengths[..., None]
    places = np.where(present, begins[..., None] + byte, 0)
    return lengths.sum(1), places.reshape(256, 16), np.where(present, 255, 0).astype(np.uint8).reshape(256, 16)


LENGTHS, PLACES, PRESENT = _tables()


def code_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes."""
    control, data = [], []
    for at in range(0, len(ranks), SLICE):
        r = ranks[at : at + SLICE].astype("<u4", copy=False)
        extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
        data.append(r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes())
        quads = np.zeros(-(-len(r) // 4) * 4, np.uint8)
        quads[: len(r)] = extra
        control.append((quads.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8).tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint32)
    at = 0
    for q in range(0, len(control), SLICE // 4):
        c = control[q : q + SLICE // 4]
        ends = np.cumsum(LENGTHS[c])
        held = np.zeros(int(ends[-1]) + 16, np.uint8)
        some = data[at : at + int(ends[-1])]
        held[: len(some)] = some
        four = held[(ends - LENGTHS[c])[:, None] + PLACES[c]] & PRESENT[c]
        part = out[4 * q : 4 * (q + len(c))]
        part[:] = four.view("<u4").reshape(-1)[: len(part)]
        at += int(ends[-1])
    return out


def record(ident: str | None, ranks: np.ndarray) -> bytes:
    """A document's record without the line feed that ends it."""
    name = b"" if ident is None else ident.encode("utf-8")
    control, data = code_ranks(ranks)
    return struct.pack(HEAD, NO_ID if ident is None else len(name), len(ranks), len(data)) + name + control + data


def records_in(data: bytes):
    """(identifier, ranks) of each record of a file."""
    view = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(data):
        size, n, held = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        ident = None if size == NO_ID else data[at : at + size].decode("utf-8")
        at += 0 if ident is None else size
        middle = at + -(-n // 4)
        end = middle + held
        if end >= len(data) or data[end] != 0x0A:
            raise ValueError("a record does not end where its lengths say")
        yield ident, decode_ranks(view[at:middle], view[middle:end], n)
        at = end + 1


def encode_ids(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = END_ID) -> DataFrame:
    """(id, row, n, crc, ids) per document and, once per task, (tokens, counts): how often each id
    occurs there. ids are two bytes each where all fit, else four."""
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text")
    )
    id_type = src.schema["id"].dataType.simpleString()
    names = ["id", "row", "n", "crc", "ids", "tokens", "counts"]
    lists = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches):
        enc = encoder(path)
        seen = np.zeros(0, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            n, crc, out, new = [], [], [], []
            for t in batch.column(2):
                ids = np.append(enc.encode(t.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                new.append(ids)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                out.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes())
            if new:
                found = np.bincount(np.concatenate(new), minlength=len(seen))
                found[: len(seen)] += seen
                seen = found
            void = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary()),
                 void.cast(lists[0]), void.cast(lists[1])],
                names=names,
            )
        held = np.flatnonzero(seen)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()),
                 pa.array([held.astype(np.int32)], lists[0]), pa.array([seen[held]], lists[1])],
                names=names,
            )

    return written(src.mapInArrow(run, f"id {id_type}, row long, n long, crc long, ids binary, tokens array<int>, counts array<long>"))


def rank_table(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by falling frequency, then id, and the number of ids in all. At most a vocabulary's size."""
    each = encoded.filter("tokens IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    counts = each.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n")).toArrow()
    token, n = counts["token"].to_numpy(), counts["n"].to_numpy()
    return token[np.lexsort((token, -n))].astype("<u4"), int(n.sum())


def write_ids(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    end_id: int = END_ID, file_tokens: int = FILE_TOKENS,
) -> None:
    """Writes the files of ids, in ascending order of the identifier, and their rank table."""
    spark = docs.sparkSession
    encoded = encode_ids(docs, id_col, text_col, path or default_path(), end_id)
    ranked, total = rank_table(encoded)
    table = spark.createDataFrame([(bytearray(ranked.tobytes()),)], "value binary")
    table.select(F.col("value").cast("string")).coalesce(1).write.text(f"{folder}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    known = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        from pyspark import TaskContext

        part, before, nth = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            chunk, out = [], []
            for ident, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                chunk.append(before // file_tokens)
                out.append(record(ident, known.value[np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")]))
                before += n
            m = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array(chunk, pa.int32()), pa.array(range(nth, nth + m), pa.int64()), pa.array(out, pa.binary())],
                names=["part", "chunk", "nth", "value"],
            )
            nth += m

    order = ["id", "n", "crc", "row"]
    rows = encoded.filter("n IS NOT NULL").select(*order, "ids")
    placed = rows.repartitionByRange(max(1, -(-total // file_tokens)), *order).sortWithinPartitions(*order)
    made = placed.select(F.col("id").cast("string"), "n", "ids").mapInArrow(run, "part int, chunk int, nth long, value binary")
    # The writer wants its folders in order; nth keeps the order of the documents under it.
    made = made.sortWithinPartitions("part", "chunk", "nth").select("part", "chunk", F.col("value").cast("string").alias("value"))
    made.write.partitionBy("part", "chunk").text(f"{folder}/files")


def read_ids(spark: SparkSession, folder: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """(part, chunk, before, id, n_tokens, ids_crc32, ids) per document: `before` counts the ids
    before it in its file, ids are little-endian u32."""
    held = spark.read.format("binaryFile").load(f"{folder}/ranks").filter("length > 0").select("content").collect()
    ranked = spark.sparkContext.broadcast(np.frombuffer(bytes(held[0]["content"])[:-1] if held else b"", "<u4"))
    files = spark.read.format("binaryFile").load(f"{folder}/files").select(
        *[F.regexp_extract("path", r"/part=(\d+)/chunk=(\d+)/", k).cast("int") for k in (1, 2)], "content"
    )

    def run(batches):
        for batch in batches:
            for part, chunk, data in zip(*(batch.column(i) for i in range(3))):
                rows, before = [], 0
                stream = records_in(data.as_py())
                done = False
                while not done:
                    for ident, ranks in stream:
                        ids = ranked.value[ranks]
                        raw = ids.tobytes()
                        rows.append((before, ident, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        before += len(ids)
                        if len(rows) >= 256:
                            break
                    else:
                        done = True
                    cols = list(zip(*rows)) or [()] * 5
                    types = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.as_py()] * len(rows), pa.int32()), pa.array([chunk.as_py()] * len(rows), pa.int32()),
                         *[pa.array(c, t) for c, t in zip(cols, types)]],
                        names=["part", "chunk", "before", "id", "n_tokens", "ids_crc32", "ids"],
                    )
                    rows = []

    schema = "part int, chunk int, before long, id string, n_tokens long, ids_crc32 long, ids binary"
    return files.mapInArrow(run, schema).withColumn("id", F.col("id").cast(id_type))


def document_spans(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: identifier, start (ids of all documents before it), n_tokens, ids_crc32."""
    seen = cut(read_ids(spark, folder, id_type, with_ids=False).drop("ids"))
    files = seen.groupBy("part", "chunk").agg(F.max(F.col("before") + F.col("n_tokens")).alias("held"))
    files = running_total(files, [], ["part", "chunk"], ["held"], F.floor(F.col("part") / 256))
    begins = files.select("part", "chunk", (F.col("cum_held") - F.col("held")).alias("begin"))
    return seen.join(begins, ["part", "chunk"]).select(
        F.col("id").alias(id_col), (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def id_file_round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Writes the files in the shared folder and reads each document's place and checksum from them."""
    folder = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, folder, id_col, text_col, path, end_id, file_tokens)
    return document_spans(docs.sparkSession, folder, id_col, docs.schema[id_col].dataType.simpleString())
