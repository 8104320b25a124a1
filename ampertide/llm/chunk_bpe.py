"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts every text where the content says so, so a passage
that documents share is cut alike in all of them. Chunk hashes are counted over the whole
corpus; the chunks that occur more than once are encoded once, in one table, and documents
that hold them take their ids from there. Stretches of chunks that nobody shares are encoded
in place, and documents without any shared chunk never leave the task that read them.

Which chunks may be shared is told to the tasks by a bitmap of `filter_bits` bits, a fixed size
whatever the corpus: a chunk that hits a set bit by chance is only encoded in the table
for nothing. On a corpus so large that the bitmap fills up, all chunks take that way.

Joins are repaired exactly. A place where a space stands between two ASCII letters starts a
new pre-token in any context that shows these three bytes, so ids of a stretch are final
between its first and its last such place. What lies between the last agreed place of one
stretch and the first of a later one is encoded anew as one text; a stretch without an
agreed place is re-encoded as part of its neighbours. Boundaries count as agreed only if the
stretch's own tokens end there. The result equals the encoding of the whole text.

Defined results: null text is empty and has no ids; repeated rows get a row each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, default_path, encoder
from .common import text_of, written

MIN_BYTES, MEAN_BITS, MAX_BYTES = 128, 9, 4096
FILTER_BITS = 1 << 27
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks, on character boundaries."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        h = nxt
    starts = (raw[1:] & 0xC0) != 0x80
    marks = np.flatnonzero(((h[:-1] >> np.uint32(32 - MEAN_BITS)) == 0) & starts) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX_BYTES:
            to = last + MAX_BYTES
            while (raw[to] & 0xC0) == 0x80:
                to -= 1
            ends.append(to)
            last = to
        if m - last >= MIN_BYTES or m == n:
            if m > last:
                ends.append(m)
                last = m
    return ends


def spans_of(data: bytes) -> list[tuple[int, int]]:
    ends = chunk_ends(data)
    return list(zip([0, *ends[:-1]], ends))


def _short(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _agreed_places(data: bytes) -> np.ndarray:
    """Offsets of spaces between two ASCII letters."""
    raw = np.frombuffer(data, dtype=np.uint8)
    low = raw | 0x20
    letter = (low >= 97) & (low <= 122)
    return np.flatnonzero(letter[:-2] & (raw[1:-1] == 32) & letter[2:]) + 1 if len(raw) > 2 else np.empty(0, np.int64)


def join_stretches(data: bytes, stretches: list[tuple[int, int, np.ndarray]], enc: Encoder, sizes: np.ndarray) -> np.ndarray:
    """Ids of the whole text from ids of the stretches (start, end, ids) it is made of."""
    places = _agreed_places(data)
    out: list[np.ndarray] = []
    done = 0  # everything before is final
    last = len(stretches) - 1
    for k, (a, b, ids) in enumerate(stretches):
        ends = a + np.cumsum(sizes[ids])
        inner = places[np.searchsorted(places, a + 1) : np.searchsorted(places, b - 1)]
        at = np.searchsorted(ends, inner)
        inner, at = (x[ends[np.minimum(at, len(ends) - 1)] == inner] for x in (inner, at)) if len(ends) else (inner[:0], at[:0])
        left, from_ = (a, 0) if k == 0 else (int(inner[0]), int(at[0]) + 1) if len(inner) else (None, 0)
        right, to = (b, len(ids)) if k == last else (int(inner[-1]), int(at[-1]) + 1) if len(inner) else (None, 0)
        if left is None or right is None:
            continue
        if left > done:
            out.append(enc.encode(data[done:left].decode("utf-8")))
        out.append(ids[from_:to])
        done = right
    if done < len(data):
        out.append(enc.encode(data[done:].decode("utf-8")))
    return np.concatenate(out).astype("<u4", copy=False) if out else np.empty(0, "<u4")


def token_sizes(enc: Encoder) -> np.ndarray:
    sizes = np.zeros(max(enc.table) + 1, dtype=np.int64)
    for i, t in enc.table.items():
        sizes[i] = len(t)
    return sizes


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit; the first byte tells the width."""
    small = len(ids) == 0 or int(ids.max()) < 1 << 16
    return (b"2" if small else b"4") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"2" else "<u4", offset=1).astype("<u4")


def _digests(ids: np.ndarray, enc: Encoder) -> tuple[int, str, str]:
    text = enc.decode(ids)
    return len(ids), hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()


def _maybe(bitmap: np.ndarray, h: int) -> bool:
    at = (h % (1 << 64)) % (len(bitmap) * 64)
    return bool(int(bitmap[at >> 6]) >> (at & 63) & 1)


def _shared_bitmap(texts: DataFrame, filter_bits: int) -> np.ndarray:
    """Bits of all chunk hashes that occur more than once in the corpus."""

    def hashes(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                data = t.encode("utf-8")
                out += [_short(data[a:b]) for a, b in spans_of(data)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])

    counts = texts.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # filter_bits is a power of two, so the low bits of the signed hash are its unsigned remainder.
    at = F.col("h").bitwiseAND(F.lit(filter_bits - 1))
    words = counts.filter("n > 1").select(
        F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((h & {filter_bits - 1}) & 63 as int))").alias("bit")
    )
    # At most filter_bits / 64 rows come back, whatever the corpus.
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(filter_bits // 64, dtype=np.uint64)
    bitmap[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return bitmap


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """One row per document: identifier, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    bitmap = spark.sparkContext.broadcast(_shared_bitmap(texts, filter_bits))

    def first(batches):
        """Digests of documents without shared chunks; the others go on with their text."""
        enc, bits = encoder(path), bitmap.value
        for batch in batches:
            n, a, d, text = [], [], [], []
            for t in batch.column(2).to_pylist():
                data = t.encode("utf-8")
                if enc.reusable and any(_maybe(bits, _short(data[x:y])) for x, y in spans_of(data)):
                    got, keep = (None, None, None), t
                else:
                    got, keep = _digests(enc.encode(t), enc), None
                n.append(got[0])
                a.append(got[1])
                d.append(got[2])
                text.append(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(text, pa.string())],
                names=["id", "row", "n_tokens", "ids_sha256", "decoded_sha256", "text"],
            )

    digest_cols = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    seen = written(texts.mapInArrow(first, f"id {id_type}, row long, {digest_cols}, text string"))
    done = seen.filter("text IS NULL").select("id", "n_tokens", "ids_sha256", "decoded_sha256")
    waiting = seen.filter("text IS NOT NULL").select("id", "row", "text")

    def shared_chunks(data: bytes) -> dict[bytes, bytes]:
        return {xxhash.xxh3_128_digest(data[x:y]): data[x:y] for x, y in spans_of(data) if _maybe(bitmap.value, _short(data[x:y]))}

    def refs_of(batches):
        """(row, key): the chunks of each document that may be shared."""
        for batch in batches:
            keys = [list(shared_chunks(t.encode("utf-8"))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.binary()))], names=["row", "keys"])

    def chunks_of(batches):
        """(key, chunk): each such chunk once per batch."""
        for batch in batches:
            once: dict[bytes, bytes] = {}
            for t in batch.column(0).to_pylist():
                once |= shared_chunks(t.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(list(once.keys()), pa.binary()), pa.array(list(once.values()), pa.binary())], names=["key", "chunk"])

    refs = waiting.select("row", "text").mapInArrow(refs_of, "row long, keys array<binary>").select("row", F.explode("keys").alias("key"))
    single = waiting.select("text").mapInArrow(chunks_of, "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))

    def encode_once(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [pack_ids(enc.encode(c.decode("utf-8"))) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    encoded = written(single.mapInArrow(encode_once, "key binary, ids binary"))
    found = refs.join(encoded, "key")
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("key", "ids")).alias("known"))

    def finish(batches):
        enc = encoder(path)
        sizes = token_sizes(enc)
        for batch in batches:
            n, a, d = [], [], []
            for t, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = t.encode("utf-8")
                table = {x["key"]: unpack_ids(x["ids"]) for x in known or []}
                stretches: list[tuple[int, int, np.ndarray | None]] = []
                for x, y in spans_of(data):
                    ids = table.get(xxhash.xxh3_128_digest(data[x:y]))
                    if ids is None and stretches and stretches[-1][2] is None:
                        stretches[-1] = (stretches[-1][0], y, None)
                    else:
                        stretches.append((x, y, ids))
                ready = [(x, y, enc.encode(data[x:y].decode("utf-8")) if ids is None else ids) for x, y, ids in stretches]
                got = _digests(join_stretches(data, ready, enc, sizes), enc)
                n.append(got[0])
                a.append(got[1])
                d.append(got[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    joined = waiting.join(by_row, "row", "left").select("id", "text", "known")
    out = done.unionByName(joined.mapInArrow(finish, f"id {id_type}, {digest_cols}"))
    return out.withColumnRenamed("id", id_col)
