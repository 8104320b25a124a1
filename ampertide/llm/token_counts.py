"""Exact length histogram of encoded documents.

Each task encodes its documents and counts lengths before anything is shuffled, so one row
per distinct length leaves a task. Suffix sums over the histogram then answer, for every
context limit at once, how many documents fit, how many tokens they hold, and what
remains after truncation. Between two lengths that occur, all answers are linear in the limit,
so one row per occurring length answers every limit (`totals_at`).

The suffix sums run in two levels, blocks of lengths and lengths within a block; the number
of blocks depends on the longest document, not on the number of documents.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count
each time; an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampertide.session import cut

from .bpe import default_path, encoder
from .common import text_of

BLOCK = 256


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, docs): how many documents have each encoded length."""
    path = path or default_path()

    def count(batches):
        enc, seen = encoder(path), Counter()
        for batch in batches:
            seen.update(len(enc.encode(t)) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array(list(seen.keys()), pa.int64()), "docs": pa.array(list(seen.values()), pa.int64())}
        )

    part = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "length long, docs long")
    return part.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per occurring length, read as a context limit: documents and tokens that fit,
    documents that are longer, the total after truncation and the share that fits."""
    # Read twice below; without a table the documents would be encoded twice.
    h = cut(hist).withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("docs")})
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        "block", F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("bd").over(Window.partitionBy()).alias("docs_total"), F.sum("bt").over(Window.partitionBy()).alias("tokens_total"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(later, "block").select(
        "length", "docs", "docs_total", "tokens_total",
        (F.col("docs_above") + F.coalesce(F.sum("docs").over(longer), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))).alias("tokens_longer"),
    )
    fitting = F.col("tokens_total") - F.col("tokens_longer")
    return s.select(
        "length", "docs", (F.col("docs_total") - F.col("docs_longer")).alias("docs_fitting"), "docs_longer",
        fitting.alias("tokens_fitting"), "tokens_longer",
        (fitting + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for stated context limits: (context_limit, docs_fitting, truncated_total).

    Within the suffix sums the row of the longest length that fits answers a limit; a limit
    below every length cuts all documents."""
    docs = F.coalesce(F.sum("docs"), F.lit(0))
    rows = []
    for limit in limits:
        last = F.max_by(F.struct("docs_fitting", "docs_longer", "tokens_fitting"), F.when(F.col("length") <= limit, F.col("length")))
        fits = F.coalesce(last["docs_fitting"], F.lit(0))
        cut = F.coalesce(last["tokens_fitting"], F.lit(0)) + F.lit(int(limit)) * F.coalesce(last["docs_longer"], docs)
        rows.append(F.struct(F.lit(int(limit)).alias("context_limit"), fits.alias("docs_fitting"), cut.alias("truncated_total")))
    return sums.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("x")).select("x.*")


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length within which that share of documents fits."""
    picks = [F.min(F.when(F.col("quantile") >= p, F.col("length"))) for p in shares]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("share"), c.alias("length")) for p, c in zip(shares, picks)])
    return sums.agg(rows.alias("r")).select(F.explode("r").alias("x")).select("x.share", "x.length")
