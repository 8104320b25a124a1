"""Audit of how filters interact: what each one removes under every order of applying them.

Each document is read once, where it lies, for its failure mask: a bit per filter. What is shuffled
is one row of some 80 bytes per document; after that only cells (part, mask) with counts remain.
Per part, a Gray-code walk visits all 2^k subsets of filters, one toggle at a time: each mask cell
keeps a counter of its active failures, and the running number of survivors changes only when a
counter leaves or reaches zero. The stored states answer every step of every order by a difference
of two.

The filters: A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of
the code points; D any of `#$%&*|`; E equal to the text of a smaller identifier, anywhere in the
table. Texts are told apart by SHA-256. Whether a copy is the smallest is asked by a join on (digest,
identifier), so a text that a third of all rows hold is no hot key; the smallest identifier per text
is an aggregate that tasks reduce before the shuffle.

Defined results: a null text is the empty text, a null source the empty part; words are maximal runs
of `[^\\x20\\x09-\\x0D]`; a null identifier is neither smaller nor larger than another, so such rows
pass E and make no other row fail; repeated rows of one identifier are documents of their own and
not copies of each other; a document without a label is neither good nor toxic, one with several
labels is good (toxic) if any says so; an empty table has no parts and gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertide.session import cut

from .common import text_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
COUNTS = ("n", "good", "toxic")
STEPS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: str) -> tuple[int, bytes]:
    """Bits A to D of the failure mask, and the digest by which E compares."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space: 0x20 and 0x09 to 0x0D
    mask = (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)) << 2
    mask |= (len(raw.translate(None, MARKS)) < len(raw)) << 3
    return mask, hashlib.sha256(raw).digest()


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, digest) per document, bits A to D; written, since it is read three times."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            made = [text_failures(t.as_py()) for t in batch.column(2)]
            masks, digests = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["id", "part", "mask", "digest"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"id {id_type}, part string, mask int, digest binary"))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failure mask, E included."""
    rows = document_masks(docs, id_col, text_col, part_col)
    marks = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0)) > 0
    smallest = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    first = rows.join(smallest, ["digest", "id"], "left_semi").unionByName(rows.filter("id IS NULL"))

    def counts(some: DataFrame, name: str) -> DataFrame:
        plain = some.groupBy("part", "mask").agg(F.count(F.lit(1)).alias(name))
        told = some.join(marks.filter(known), "id").groupBy("part", "mask").agg(
            F.sum(F.coalesce("good", F.lit(0)).cast("long")).alias(f"{name}_good"),
            F.sum(F.coalesce("toxic", F.lit(0)).cast("long")).alias(f"{name}_toxic"),
        )
        return plain.join(told, ["part", "mask"], "left").fillna(0)

    cells = counts(rows, "all").join(counts(first, "first"), ["part", "mask"], "left").fillna(0)
    spare = [F.col(f"all{s}") - F.col(f"first{s}") for s in ("", "_good", "_toxic")]
    passing = cells.select("part", "mask", *[F.col(f"first{s}").alias(c) for s, c in zip(("", "_good", "_toxic"), COUNTS)])
    copies = cells.select("part", (F.col("mask") + COPY).alias("mask"), *[s.alias(c) for s, c in zip(spare, COUNTS)])
    return passing.unionByName(copies).filter("n > 0")


def gray_states(cells: np.ndarray) -> np.ndarray:
    """Survivors for every subset of filters. cells: (..., 2^k, counts), by failure mask.

    Step i of the Gray code toggles the filter at the lowest set bit of i."""
    size = cells.shape[-2]
    active = np.zeros(size, np.int64)  # failures of each mask under the filters now on
    survivors = cells.sum(-2)
    states = np.empty(cells.shape, cells.dtype)
    states[..., 0, :] = survivors
    on = 0
    for i in range(1, size):
        bit = i & -i
        on ^= bit
        failing = np.arange(size) & bit != 0
        if on & bit:
            changed = failing & (active == 0)
            survivors = survivors - cells[..., changed, :].sum(-2)
            active[failing] += 1
        else:
            active[failing] -= 1
            changed = failing & (active == 0)
            survivors = survivors + cells[..., changed, :].sum(-2)
        states[..., on, :] = survivors
    return states


def order_steps(filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per (order, step): the order's name, the subset on before the step, the step's filter."""
    names, before, which = [], [], []
    for order in permutations(range(len(filters))):
        on = 0
        for f in order:
            names.append("".join(filters[x] for x in order))
            before.append(on)
            which.append(f)
            on |= 1 << f
    return names, np.array(before), np.array(which)


def audit_cells(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, ...): every step of every order, from cells (part, mask, n, good, toxic).

    A part's cells, at most 2^k of them, are gathered into one row; many parts are walked at once."""
    k = len(filters)
    names, before, which = order_steps(filters)
    rows = len(names)
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield steps(batch.slice(at, 64))

    def steps(batch):
        parts = batch.num_rows
        held = np.zeros((parts, 1 << k, len(COUNTS)), np.int64)
        for p, cell in enumerate(batch.column(1).to_pylist()):
            for c in cell:
                held[p, c["mask"]] += [c[x] for x in COUNTS]
        states = gray_states(held)
        after = before | 1 << which
        lost = states[:, before] - states[:, after]  # parts, steps, counts
        n = states[..., 0]
        full = (1 << k) - 1
        fails = n[:, :1] - n[:, [1 << f for f in range(k)]]
        alone = n[:, [full ^ 1 << f for f in range(k)]] - n[:, [full]]
        shapley = np.stack([lost[:, which == f, 0].sum(1) for f in range(k)], 1)
        cols = [n[:, after], lost[..., 0], fails[:, which] - lost[..., 0], alone[:, which], lost[..., 1], lost[..., 2], shapley[:, which]]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(parts), rows))),
                pa.array(names * parts, pa.string()), pa.array(np.tile(np.arange(rows) % k + 1, parts), pa.int32()),
                *[pa.array(c.reshape(-1), pa.int64()) for c in cols],
            ],
            names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
        )

    return gathered.mapInArrow(run, f"part string, {STEPS}")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    return audit_cells(cut(mask_cells(docs, labels, id_col, text_col, part_col)))


SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), fails AS (
  SELECT doc_id, part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit,
    unnest([0, bits[1], bits[1] + bits[2], bits[1] + bits[2] + bits[3], 31 - bits[5]]) AS before
  FROM orders
), seen AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM seen
"""
