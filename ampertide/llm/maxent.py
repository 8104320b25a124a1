"""Language-model scores by a hashed maximum-entropy model.

A token's probability is class-factored: P(class | context) * P(token | class). The classes are
the end mark, the most frequent words one by one, and spelling classes for all other words.
P(class | context) is a softmax over hashed features of the context: the previous word, the
words two and three places back (skips), and the pair of the two previous words.
P(token | class, context) is a softmax factored further: the frequent words of a spelling class and
one leaf for all its other words stand in a binary tree (Huffman's, by discounted counts), and each
turn is a logistic model of the same context features, hashed with the tree's node into `CELLS`
weights. Without weights it is the discounted share of the token's training count; the discount is
the class's mass for words that training has not seen. Words behind the shared leaf have their
shares of it, so all known tokens and one unknown token per class sum to one in every context.

Training makes `ROUNDS` passes over disjoint parts of the training documents, which together are
all of them. In a pass every task adds up observed and expected feature counts of some `SHARE`
tokens; the sums meet in two levels of groups, and the driver moves the fixed-size weights along
the gradient, scaled by the counts. Counts of words are over the whole training part and stay in a table; only
the `VOCAB` most frequent words are sent to tasks (a fixed number). All other words are scored by
a join of the documents' rare words with the table of counts.

Defined results: null and empty texts are the end mark alone; documents of a null id train (no
remainder is 1); repeated rows train and are scored each; without training documents every token
is unknown and the base score is 0; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertide.session import cut

from .common import text_of

VOCAB = 65_000
ALONE, SPELLING = 15, 16
CLASSES = 1 + ALONE + SPELLING
ROWS = 1 << 15
CELLS = 1 << 20
ROUNDS = 4
RATE, PRIOR = 0.4, 4.0
START = 65_535
TOKENS = 1 << 15
SHARE = 1 << 22
WEIGHTS = ROWS * CLASSES + CELLS
BLOCKS = 32
FLUSH = 400_000
LOG10 = float(np.log(10.0))


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z only, split at ASCII white space."""
    return text.encode("utf-8").lower().split()


def spelling(word: bytes) -> int:
    return (word[0] * 31 + word[-1]) % SPELLING


def _spelling_column(column: str):
    first, last = (F.conv(F.hex(F.substring(column, at, 1)), 16, 10).cast("int") for at in (1, -1))
    return F.pmod(first * 31 + last, F.lit(SPELLING))


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n) over all training texts, counted in the tasks first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The VOCAB first words by (highest count, word), or all if there are fewer. Counts are grouped
    by sixteenths of their logarithm, so that the limit is found on a few hundred rows; the level
    that passes it is narrowed to one count, and that to one beginning of words, until what is left
    has at most VOCAB words. No task sends more than its share of the words."""
    level, room = F.floor(F.log2("n") * 16), VOCAB

    def whole(df, key, down):
        """Groups taken whole, in order; the first group that does not fit, and its size."""
        nonlocal room
        sizes = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("words")).collect()
        for r in sorted(sizes, key=lambda r: r["key"], reverse=down):
            if r["words"] > room:
                return r["key"], r["words"]
            room -= r["words"]
        return None, 0

    last, words = whole(counts, level, True)
    if last is None:
        taken, rest = counts, None
    else:
        taken, rest = counts.filter(level > last), counts.filter(level == last)
        n, words = whole(rest, F.col("n"), True)
        taken, rest = taken.unionByName(rest.filter(F.col("n") > n)), rest.filter(F.col("n") == n)
        length = 0
        while room and words > VOCAB:
            length += 1
            head, words = whole(rest, F.substring("word", 1, length), False)
            head = F.lit(bytes(head))
            taken = taken.unionByName(rest.filter(F.substring("word", 1, length) < head))
            rest = rest.filter(F.substring("word", 1, length) == head)
    by = lambda x: (-x[1], x[0])
    rows = sorted(((bytes(r["word"]), r["n"]) for r in taken.collect()), key=by)  # at most VOCAB
    if rest is not None and room:
        rows += sorted(((bytes(r["word"]), r["n"]) for r in rest.collect()), key=by)[:room]  # at most VOCAB
    return rows


class Lexicon:
    """What tasks need to know about frequent words; bounded by VOCAB entries."""

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, ends: int, discount: float, mass: np.ndarray, kinds: np.ndarray):
        self.n, self.v, self.ends, self.discount = n, v, ends, discount
        self.mass, self.kinds = mass, kinds  # per spelling class: tokens and distinct words in training
        self.ids = {w: i + 1 for i, (w, _) in enumerate(top)}
        counts = np.zeros(START + 1)
        counts[0] = ends
        counts[1 : 1 + len(top)] = [c for _, c in top]
        cls = np.zeros(START + 1, dtype=np.int64)
        within = np.zeros(START + 1)
        for i, (w, c) in enumerate(top):
            if i < ALONE:
                cls[i + 1] = i + 1
            else:
                m = spelling(w)
                cls[i + 1] = 1 + ALONE + m
                within[i + 1] = np.log10((c - discount) / mass[m])
        rare = VOCAB + 1 + np.arange(SPELLING)
        cls[rare] = 1 + ALONE + np.arange(SPELLING)
        self.cls, self.within = cls, within
        self.base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        self.base[rare] = 0.0  # by the join
        self.known = counts > 0
        prior = np.zeros(CLASSES)
        prior[0] = ends
        prior[1 : 1 + min(ALONE, len(top))] = [c for _, c in top[:ALONE]]
        prior[1 + ALONE :] = mass
        used = prior > 0
        used[1 + ALONE :] = True
        used[0] = True
        self._grow(discount)
        self.bias = np.where(used, np.log((prior + 0.5) / (prior.sum() + 0.5)), -1e9).astype(np.float32)


    def _grow(self, discount: float) -> None:
        """Paths of all ids through the trees of their classes: id i turns at `nodes` to `sides`, from
        place at[i], turns[i] times; `lean` is a node's log odds of side 1, `plain` an id's log10 share."""
        share = 10**self.within
        parent, weight = [], []
        for m in range(SPELLING):
            leaf = VOCAB + 1 + m
            words = np.array([i for i in self.ids.values() if self.cls[i] == 1 + ALONE + m], np.int64)
            if not len(words):
                continue
            rest = discount * self.kinds[m] / self.mass[m] if self.kinds[m] == len(words) else 1 - share[words].sum()
            rest = max(rest, 0.5 * discount / self.mass[m])
            heap = [(rest, leaf), *((share[i], int(i)) for i in words)]
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
                node = START + 1 + len(weight)
                parent += [(left, node), (right, node)]
                weight.append((a, b))
                heapq.heappush(heap, (a + b, node))
        above, side = np.full(START + 1 + len(weight), -1), np.zeros(START + 1 + len(weight), bool)
        if parent:
            below, over = np.array(parent).T
            above[below] = over
            side[below[1::2]] = True
        odds = np.array(weight).reshape(-1, 2)
        self.lean = np.log(odds[:, 1] / odds[:, 0]).astype(np.float32)
        self.mixed = (np.arange(1, len(odds) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)
        at = ids = np.flatnonzero(above[: START + 1] >= 0)
        turns = []
        while len(ids):
            turns.append((ids, above[at] - START - 1, side[at]))
            at = above[at]
            on = above[at] >= 0
            ids, at = ids[on], at[on]
        ids, nodes, sides = (np.concatenate([t[k] for t in turns]) if turns else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(ids, kind="stable")
        self.nodes, self.sides = nodes[order].astype(np.int32), sides[order].astype(bool)
        self.turns = np.bincount(ids, minlength=START + 1)
        self.at = np.cumsum(self.turns) - self.turns
        z = np.where(self.sides, self.lean[self.nodes], -self.lean[self.nodes]).astype(float)
        self.plain = np.bincount(ids[order], -np.logaddexp(0.0, -z), START + 1) / LOG10


def encode_streams(docs: DataFrame, lexicon) -> DataFrame:
    """Per document: token stream as 16-bit ids, and its rare words with their counts."""

    def run(batches):
        lex = lexicon.value
        get = lex.ids.get
        for batch in batches:
            ids, n, rare, tf = [], [], [], []
            for t in batch.column(3).to_pylist():
                words = words_of(t)
                a = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                odd: Counter = Counter()
                for i in np.flatnonzero(a < 0).tolist():
                    w = words[i]
                    a[i] = VOCAB + 1 + spelling(w)
                    odd[w] += 1
                ids.append(np.append(a, 0).astype("<u2").tobytes())
                n.append(len(words) + 1)
                rare.append(list(odd.keys()))
                tf.append(list(odd.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(rare, pa.list_(pa.binary())), pa.array(tf, pa.list_(pa.int64())),
                ],
                names=["id", "row", "held_out", "n_tokens", "ids", "rare", "tf"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, row long, held_out boolean, n_tokens long, ids binary, rare array<binary>, tf array<long>")


def _context_keys(streams: list[bytes]):
    """Tokens of several documents in slices: (targets, feature keys, document numbers)."""
    parts, owner = [], []
    pad = np.full(3, START, dtype=np.int64)
    for k, s in enumerate(streams):
        ids = np.frombuffer(s, "<u2").astype(np.int64)
        parts += [pad, ids]
        owner += [np.full(3, -1), np.full(len(ids), k)]
    if not parts:
        return
    x, own = np.concatenate(parts), np.concatenate(owner)
    at = np.flatnonzero(own >= 0)
    for lo in range(0, len(at), TOKENS):
        i = at[lo : lo + TOKENS]
        a, b, c = x[i - 1], x[i - 2], x[i - 3]
        keys = (a, b + (1 << 20), c + (1 << 21), a * 65_537 + b + (1 << 40))
        yield x[i], keys, own[i]


def _rows(keys) -> list[np.ndarray]:
    return [((k * 0x9E3779B1) >> 13) % ROWS for k in keys]


def _contexts(streams: list[bytes]):
    """Tokens of several documents in slices: (targets, feature rows, document numbers)."""
    for x, keys, own in _context_keys(streams):
        yield x, _rows(keys), own


def _turns(lex: Lexicon, words: np.ndarray, x: np.ndarray, keys):
    """The turns of tokens in the trees of their classes: (token, cells of each feature, side, log odds)."""
    n = lex.turns[x]
    token = np.repeat(np.arange(len(x)), n)
    place = np.arange(len(token)) + np.repeat(lex.at[x] - (np.cumsum(n) - n), n)
    node = lex.nodes[place]
    z, mixed, cells = lex.lean[node], lex.mixed[node], []
    for k in keys:
        h = np.repeat(((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32), n)
        h ^= mixed
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(12)  # 20 bits: CELLS
        h = h.astype(np.intp)
        cells.append(h)
        z += words.take(h, mode="clip")
    return token, cells, lex.sides[place], z


def _word_gain(lex: Lexicon, words: np.ndarray, x: np.ndarray, keys) -> np.ndarray:
    """log10 P(token | class, context) less its share without context."""
    token, _, side, z = _turns(lex, words, x, keys)
    lost = np.log1p(np.exp(np.minimum(np.where(side, -z, z), 80.0)))
    return -np.bincount(token, lost, len(x)) / LOG10 - lex.plain[x]


def _logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of weights and bias per token and class, of a size that exp takes."""
    z = weights.take(rows[0], axis=0)
    more = np.empty_like(z)
    for r in rows[1:]:
        z += weights.take(r, axis=0, out=more, mode="clip")
    z += bias
    if len(rows) * max(weights.max(), -weights.min()) > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def _log_softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = _logits(weights, bias, rows)
    p = np.exp(z)
    z -= np.log(p @ np.ones(p.shape[1], p.dtype))[:, None]
    return z


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    p = _logits(weights, bias, rows)
    np.exp(p, out=p)
    p /= (p @ np.ones(p.shape[1], p.dtype))[:, None]
    return p


def _expect(meant: np.ndarray, rows: list[np.ndarray], p: np.ndarray) -> None:
    """Adds the tokens' probabilities of classes to their feature rows; meant is by (class, row), so
    that the sums of one class stay in the cache."""
    r = np.concatenate(rows)
    for c in range(CLASSES):
        meant[c] += np.bincount(r, np.tile(p[:, c], len(rows)), ROWS)


def _split(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (feature row, class), and of turns by cell."""
    return weights[: ROWS * CLASSES].reshape(ROWS, CLASSES), weights[ROWS * CLASSES :]


def feature_sums(streams: DataFrame, lexicon, weights, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of (feature row, class), then what the turns of each cell lack on
    side 1 and on side 0, over all given streams, by at most the given number of tasks."""
    step = WEIGHTS // BLOCKS
    groups = math.isqrt(tasks)

    def run(batches):
        lex, (w, words) = lexicon.value, _split(weights.value)
        seen, meant = np.zeros(ROWS * CLASSES), np.zeros((CLASSES, ROWS))
        lacks = np.zeros(2 * CELLS)
        empty = True
        for batch in batches:
            for x, keys, _ in _context_keys(batch.column(0).to_pylist()):
                empty, rows = False, _rows(keys)
                _expect(meant, rows, _softmax(w, lex.bias, rows))
                c = lex.cls[x]
                np.add.at(seen, np.concatenate([r * CLASSES + c for r in rows]), 1.0)
                _, cells, side, z = _turns(lex, words, x, keys)
                p = (1.0 / (1.0 + np.exp(np.minimum(np.where(side, z, -z), 80.0)))).astype(float)  # of the side not taken
                other = np.where(side, 0, CELLS)
                for k in cells:
                    np.add.at(lacks, k + other, p)
        if not empty:
            seen, meant = np.concatenate([seen, lacks[:CELLS]]), np.concatenate([meant.T.ravel(), lacks[CELLS:]])
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() % groups
            for b in range(BLOCKS):
                cut_ = slice(b * step, (b + 1) * step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([seen[cut_].astype("<f4").tobytes()], pa.binary()), pa.array([meant[cut_].astype("<f4").tobytes()], pa.binary())],
                    names=["block", "part", "seen", "meant"],
                )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        for name in ("seen", "meant"):
            total = np.zeros(step)
            for v in pdf[name]:
                total += np.frombuffer(v, "<f4")
            out[name] = [total.astype("<f4").tobytes()]
        return out

    schema = "block int, part int, seen binary, meant binary"
    sums = streams.select("ids").coalesce(tasks).mapInArrow(run, schema)
    tree = sums.groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    seen, meant = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for r in tree.collect():  # BLOCKS rows of a fixed size
        cut_ = slice(r["block"] * step, (r["block"] + 1) * step)
        seen[cut_] = np.frombuffer(r["seen"], "<f4")
        meant[cut_] = np.frombuffer(r["meant"], "<f4")
    return seen, meant


def train_weights(streams: DataFrame, lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Gradient steps on disjoint parts of the training streams, scaled by feature counts; weights of
    classes, then of turns."""
    sc = streams.sparkSession.sparkContext
    weights = np.zeros(WEIGHTS, dtype=np.float32)
    # What a task sends has a fixed size, so the tasks follow the tokens of a part.
    tasks = max(1, math.ceil(lexicon.value.n / rounds / SHARE))
    for r in range(rounds):
        part = streams.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)
        sent = sc.broadcast(weights)
        seen, meant = feature_sums(part, lexicon, sent, tasks)
        sent.unpersist()
        weights = weights + (RATE * (seen - meant) / (0.5 * (seen + meant) + PRIOR)).astype(np.float32)
    return weights


def score_streams(streams: DataFrame, lexicon, weights) -> DataFrame:
    """(id, row, held_out, n_tokens, known, base, model) without the rare words' own terms."""

    def run(batches):
        lex, (w, words) = lexicon.value, _split(weights.value)
        for batch in batches:
            data = batch.column(4).to_pylist()
            known, base, model = np.zeros(len(data), np.int64), np.zeros(len(data)), np.zeros(len(data))
            for x, keys, own in _context_keys(data):
                z = _log_softmax(w, lex.bias, _rows(keys))
                lp = z[np.arange(len(x)), lex.cls[x]].astype(np.float64) / LOG10 + lex.within[x]
                lp += _word_gain(lex, words, x, keys)
                model += np.bincount(own, lp, len(data))
                base += np.bincount(own, lex.base[x], len(data))
                known += np.bincount(own, lex.known[x], len(data)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(known), pa.array(base), pa.array(model)],
                names=["id", "row", "held_out", "n_tokens", "known", "base", "model"],
            )

    kind = streams.schema["id"].dataType.simpleString()
    cols = streams.select("id", "row", "held_out", "n_tokens", "ids")
    return cols.mapInArrow(run, f"id {kind}, row long, held_out boolean, n_tokens long, known long, base double, model double")


def maxent_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: identifier, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ident = F.col(f"`{id_col}`")
    held = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select(ident.alias("id"), F.monotonically_increasing_id().alias("row"), held.alias("held_out"), text_of(text_col).alias("text"))
    train = rows.filter("NOT held_out")
    counts = cut(word_counts(train))
    ends = train.count()
    top = frequent_words(counts)
    alone = [w for w, _ in top[:ALONE]]
    spelled = counts.filter(~F.col("word").isin(alone)) if alone else counts
    spread = spelled.groupBy(_spelling_column("word").alias("m")).agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("kinds"))
    mass, kinds = np.zeros(SPELLING), np.zeros(SPELLING)
    for r in spread.collect():
        mass[r["m"]], kinds[r["m"]] = r["mass"], r["kinds"]
    whole = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    ).head()
    n, v = whole["n"] + ends, whole["v"] + (ends > 0)
    discount = min(0.9, max(0.1, whole["once"] / max(1, whole["once"] + 2 * whole["twice"])))
    lex = Lexicon(top, n, v, ends, discount, mass, kinds)
    lexicon = sc.broadcast(lex)
    streams = cut(encode_streams(rows, lexicon))
    weights = sc.broadcast(train_weights(streams.filter("NOT held_out").select("row", "ids"), lexicon, rounds))
    scored = score_streams(streams, lexicon, weights)

    odd = streams.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.tf").alias("tf"))
    got = odd.join(counts, "word", "left").withColumn("m", _spelling_column("word"))

    def by_class(values):
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("m") + 1)

    c = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    unseen = F.when(by_class(mass) > 0, F.log10(F.lit(discount) * by_class(kinds) / by_class(mass))).otherwise(0.0)
    terms = got.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("r_known"),
        F.sum(F.col("tf") * F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("r_base"),
        F.sum(F.col("tf") * F.when(c > 0, F.log10((c - discount) / by_class(mass))).otherwise(unseen)).alias("r_model"),
    )
    zero = F.lit(0)
    return scored.join(terms, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("r_known", zero)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("r_model", F.lit(0.0))).alias("score"),
    )
