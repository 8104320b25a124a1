"""Exact dedup by content sort, in DataFrame operations only.

Splitters that Spark samples deal the rows out by the order of their normalised bytes; each
task sorts its range externally (spilling to disk), which places equal texts side by side,
and a window over the sorted neighbours, split where the full text changes, keeps the
smallest identifier.

The splitter key is (first characters, hash) of a text, never the text itself, so what the driver samples
is bounded however long the texts are. Equality is always decided on the full text; SHA-256 is a
column of the result and nothing else.

Rows of one hash stay in one range, so a text that very many rows hold needs more: hashes with over
`hot_rows` rows and over 1/HOT_PARTS of the table (so at most HOT_PARTS of them, counted over all
rows) are sorted apart, with the range cut further by the identifier. Of each cut's run of equal
texts, the first row goes on with its text; these few meet in a second sort, compared in full again.

Defined results: a null text is the empty text; a null identifier loses against any other and
wins only in a group that has nothing else; fully repeated rows are rows of their own, and
exactly one row of a group is kept; an empty table gives an empty result; further columns
of the table, whatever their names, are ignored (or passed through by `drop_copies`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertide.session import cut

from .common import packed_row, text_of, unpacked

SPACES = r"[\x20\x09-\x0D]+"
HEAD_CHARS = 48
CUTS = 64
HOT_PARTS = 512
HOT_ROWS = 1000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACES, " ")


def _hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _split_hot(docs: DataFrame, text_col: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary hashes, rows of hot ones), as (row, h)."""
    rows = docs.select(packed_row(docs).alias("row"), _hash(normalised(text_of(text_col))).alias("h"))
    counts = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).head()[0] or 0
    # Fewer than HOT_PARTS rows by construction.
    hot = F.broadcast(counts.filter(F.col("n") > max(hot_rows, total // HOT_PARTS)).select("h"))
    return rows.join(hot, "h", "left_anti"), rows.join(hot, "h", "left_semi")


def _sorted_ranges(rows: DataFrame, id_col: str, text_col: str, carry: bool, cuts: int) -> DataFrame:
    """Rows in ranges of content, with their place in the run of equal neighbours: nth, and the run's
    smallest identifier and length. With cuts, a run ends at the cut."""
    ident = F.col(f"row.`{id_col}`")
    norm = normalised(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    keyed = rows.select(
        ident.alias("id"), "row" if carry else norm.alias("norm"), F.substring(norm, 1, HEAD_CHARS).alias("head"), "h",
        (F.pmod(F.hash(ident), F.lit(cuts)) if cuts > 1 else F.lit(0)).alias("cut"),
    )
    keys = ["head", "h"] + (["cut"] if cuts > 1 else [])
    placed = keyed.repartitionByRange(*keys)
    if carry:
        placed = placed.withColumn("norm", norm)
    # The range partitioning already keeps these keys together: no further exchange.
    same = Window.partitionBy(*keys, "norm")
    return placed.withColumns(
        {
            "nth": F.row_number().over(same.orderBy(F.col("id").asc_nulls_last())),
            "run_min": F.min("id").over(same),
            "run_rows": F.count(F.lit(1)).over(same),
        }
    )


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: int = CUTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per document: identifier, keep_id, group_size, kept, text_sha256."""
    plain, hot = _split_hot(docs.select(f"`{id_col}`", f"`{text_col}`"), text_col, hot_rows)
    sha = _digest(F.col("norm")).alias("text_sha256")
    done = _sorted_ranges(plain, id_col, text_col, False, 1).select(
        "id", F.col("run_min").alias("keep_id"), F.col("run_rows").alias("group_size"), (F.col("nth") == 1).alias("kept"), sha
    )
    runs = _sorted_ranges(hot, id_col, text_col, False, cuts).withColumn("place", F.monotonically_increasing_id())
    one = Window.partitionBy("head", "h", "cut", "norm")
    runs = cut(runs.select(
        "id", "nth", "run_min", "run_rows", F.min("place").over(one).alias("run"), sha,
        F.when(F.col("nth") == 1, F.col("norm")).alias("first_text"),
    ))
    whole = Window.partitionBy("first_text")
    totals = runs.filter("nth = 1").select(
        "run", F.min("run_min").over(whole).alias("keep_id"), F.sum("run_rows").over(whole).alias("group_size")
    )
    joined = runs.drop("first_text").join(totals, "run").select(
        "id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )
    return done.unionByName(joined).withColumnRenamed("id", id_col)


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: int = CUTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The table without copies: of equal texts, the row with the smallest identifier stays."""
    plain, hot = _split_hot(docs, text_col, hot_rows)
    done = _sorted_ranges(plain, id_col, text_col, True, 1).filter("nth = 1").select("row")
    firsts = _sorted_ranges(hot, id_col, text_col, True, cuts).filter("nth = 1")
    whole = Window.partitionBy("norm").orderBy(F.col("id").asc_nulls_last(), "cut")
    best = firsts.withColumn("best", F.row_number().over(whole)).filter("best = 1").select("row")
    return unpacked(done.unionByName(best), docs.schema)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
  sha256(t) AS text_sha256
FROM d
"""
