import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ampertide.llm import maxent as M


def rows():
    rng = np.random.default_rng(1)
    out = [(0, None), (1, ""), (2, " \n"), (None, "null id"), (3, "Ünï Ab aB"), (4, "x " * 50_000)]
    for i in range(10, 200):
        a = "red green blue".split() if i % 2 else "uno dos tres cuatro".split()
        words = [a[j % len(a)] if rng.random() < 0.9 else f"odd{rng.integers(400)}" for j in range(rng.integers(5, 120))]
        out.append((i, " ".join(words)))
    return out + [(10, "red again"), (10, "red again")]


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in toks
    ]


@pytest.mark.parametrize("vocab", [20, M.VOCAB])
def test_counts_and_base_equal_brute_force(docs_of, monkeypatch, vocab):
    full = M.VOCAB
    got = _scores(docs_of, monkeypatch, vocab)
    key = lambda r: (str(r[0]), r[2], r[5])
    for r, w in zip(sorted(got, key=key), sorted(brute(rows()), key=key)):
        assert tuple(r[:5]) == w[:5]
        assert r.base_score == pytest.approx(w[5], abs=1e-6)
        assert r.score < 0
    assert full == 65_000


def _scores(docs_of, monkeypatch, vocab):
    if vocab != M.VOCAB:
        # A short list of frequent words sends most words through the join.
        whole = M.Lexicon.__init__

        def short(self, top, *rest):
            whole(self, top[:vocab], *rest)

        monkeypatch.setattr(M.Lexicon, "__init__", short)
    return M.maxent_scores(docs_of(rows())).collect()


def test_held_out_text_is_better_than_the_base(docs_of):
    got = [r for r in M.maxent_scores(docs_of(rows())).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 100


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts = sorted(((f"{chr(97 + k % 26)}{k}".encode(), int(c)) for k, c in enumerate(rng.integers(1, 90, 300))), key=lambda x: -x[1])
    d, mass, kinds = 0.4, np.zeros(M.SPELLING), np.zeros(M.SPELLING)
    for w, c in counts[M.ALONE :]:
        mass[M.spelling(w)] += c
        kinds[M.spelling(w)] += 1
    lex = M.Lexicon(counts, sum(c for _, c in counts) + 50, len(counts) + 1, 50, d, mass, kinds)
    weights = rng.normal(size=(M.ROWS, M.CLASSES)).astype(np.float32)
    (_, feats, _), = M._contexts([np.array([5, 9, 200, 0], "<u2").tobytes()])
    p = np.exp(M._log_softmax(weights, lex.bias, feats).astype(float))
    known = np.arange(len(counts) + 1)
    unseen = [d * k / m if m else 1.0 for k, m in zip(kinds, mass)]
    for row in p:
        total = sum(row[lex.cls[i]] * 10 ** lex.within[i] for i in known) + sum(row[1 + M.ALONE + m] * u for m, u in enumerate(unseen))
        assert total == pytest.approx(1.0, abs=1e-4)


def test_gradient_is_observed_minus_expected():
    rng = np.random.default_rng(3)
    bias = rng.normal(size=M.CLASSES).astype(np.float32)
    w = rng.normal(size=(M.ROWS, M.CLASSES)) * 0.3
    (x, feats, _), = M._contexts([np.array([5, 9, 5, 9, 0], "<u2").tobytes()])
    target = np.array([1, 4, 1, 4, 0])

    def value(w):
        return M._log_softmax(w.copy(), bias, feats)[np.arange(5), target].sum()

    p = np.exp(M._log_softmax(w.copy(), bias, feats))
    r, c, h = feats[0][1], 4, 1e-5
    up, down = w.copy(), w.copy()
    up[r, c] += h
    down[r, c] -= h
    hits = sum((f == r).astype(float) for f in feats)
    want = (hits * ((target == c) - p[:, c])).sum()
    assert (value(up) - value(down)) / (2 * h) == pytest.approx(want, rel=1e-3)


def test_without_training_documents(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = M.maxent_scores(docs_of([(held, "some words")])).head()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert M.maxent_scores(docs_of([])).count() == 0


def test_frequent_words_fill_the_last_level(spark, monkeypatch):
    from ampertide.llm import maxent

    def first(words, vocab):
        monkeypatch.setattr(maxent, "VOCAB", vocab)
        df = spark.createDataFrame([(bytearray(w), n) for w, n in words], "word binary, n long")
        got = maxent.frequent_words(df)
        assert got == sorted(words, key=lambda x: (-x[1], x[0]))[:vocab]

    flat = [(b"w%03d" % i, 7) for i in range(300)] + [(b"w", 7), (b"\xc3\xa9", 7)]
    mixed = [(b"top", 5000), (b"a", 1009), (b"b", 1008), (b"c", 1008), (b"d", 1007)] + flat
    for vocab in (1, 3, 20, 250, 400):
        first(flat, vocab)
        first(mixed, vocab)
    first([], 5)


def test_words_of_a_class_sum_to_one_with_weights():
    rng = np.random.default_rng(4)
    top = sorted(((b"a%dz" % k, int(c)) for k, c in enumerate(rng.integers(2, 90, 200))), key=lambda x: (-x[1], x[0]))
    d, m = 0.4, M.spelling(b"a0z")
    mass, kinds = np.zeros(M.SPELLING), np.zeros(M.SPELLING)
    mass[m], kinds[m] = sum(c for _, c in top[M.ALONE :]) + 30, len(top) - M.ALONE + 11
    lex = M.Lexicon(top, 10_000, 200, 50, d, mass, kinds)
    leaves = np.array([*range(M.ALONE + 1, len(top) + 1), M.VOCAB + 1 + m])
    keys = [np.full(len(leaves), k) for k in (7, 8 + (1 << 20), 9, 10)]
    share = lex.within.copy()
    share[leaves[-1]] = np.log10(1 - (10 ** lex.within[leaves[:-1]]).sum())
    assert np.allclose(lex.plain[leaves], share[leaves], atol=1e-6)
    weights = rng.normal(size=M.CELLS).astype(np.float32)
    p = 10 ** (share[leaves] + M._word_gain(lex, weights, leaves, keys))
    assert p.sum() == pytest.approx(1.0, abs=1e-5) and abs(p - 10 ** share[leaves]).max() > 0.01


def test_context_tells_words_of_one_class_apart(docs_of):
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    fill = " ".join(f"f{k}" for k in range(M.ALONE - 2))
    docs = [(i, f"{fill} red blue " + ("red a1z " * 3 if k % 2 else "blue a2z " * 3)) for k, i in enumerate(train[:400])]
    tests = [(held[0], "red a1z"), (held[1], "red a2z"), (held[2], "blue a1z"), (held[3], "blue a2z")]
    got = {r.doc_id: r.score for r in M.maxent_scores(docs_of(docs + tests)).collect()}
    assert got[held[0]] > got[held[1]] + 0.1 and got[held[3]] > got[held[2]] + 0.1


def test_gradient_tasks_follow_the_tokens(docs_of, monkeypatch):
    docs = docs_of([(i, "some words of a text " * 5) for i in range(400)]).repartition(6)
    asked, coalesce = [], type(docs).coalesce
    monkeypatch.setattr(type(docs), "coalesce", lambda df, n: asked.append(n) or coalesce(df, n))
    few = {r.doc_id: r.score for r in M.maxent_scores(docs).collect()}
    assert asked == [1] * M.ROUNDS
    tokens = M.maxent_scores(docs).head().train_tokens
    monkeypatch.setattr(M, "SHARE", math.ceil(tokens / M.ROUNDS / 3))
    asked.clear()
    many = {r.doc_id: r.score for r in M.maxent_scores(docs).collect()}
    assert asked == [3] * M.ROUNDS
    assert few == pytest.approx(many, abs=1e-3)


def test_sums_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    top = [(b"a%dz" % k, 300 - k) for k in range(100)]
    mass, kinds = np.zeros(M.SPELLING), np.zeros(M.SPELLING)
    mass[M.spelling(b"a0z")], kinds[M.spelling(b"a0z")] = sum(c for _, c in top[M.ALONE :]), 85
    sc = spark.sparkContext
    lex = M.Lexicon(top, 30_000, 101, 50, 0.4, mass, kinds)
    weights = rng.normal(size=M.WEIGHTS).astype(np.float32)
    streams = [rng.integers(0, 101, 60).astype("<u2").tobytes() for _ in range(40)]
    df = spark.createDataFrame([(bytearray(s),) for s in streams], "ids binary").repartition(4)
    seen, meant = M.feature_sums(df, sc.broadcast(lex), sc.broadcast(weights), 4)
    w, cells = M._split(weights.astype(float))
    want, hope = np.zeros((2, M.ROWS, M.CLASSES)), np.zeros(2)
    for s in streams:
        (x, keys, _), = M._context_keys([s])
        feats = M._rows(keys)
        for i, word in enumerate(x):
            z = sum(w[r[i]] for r in feats) + lex.bias
            p = np.exp(z - z.max())
            for r in feats:
                want[0, r[i], lex.cls[word]] += 1
                want[1, r[i]] += p / p.sum()
        _, places, side, z = M._turns(lex, cells, x, keys)
        lost = 1 / (1 + np.exp(np.where(side, z, -z)))
        hope += 4 * np.array([lost[side].sum(), lost[~side].sum()])
    k = M.ROWS * M.CLASSES
    assert np.array_equal(seen[:k].reshape(M.ROWS, M.CLASSES), want[0])
    assert np.allclose(meant[:k].reshape(M.ROWS, M.CLASSES), want[1], atol=1e-3)
    assert [seen[k:].sum(), meant[k:].sum()] == pytest.approx(hope.tolist(), rel=1e-4)


@pytest.mark.parametrize("size", [0.3, 40.0])
def test_softmax_of_small_and_large_weights(size):
    rng = np.random.default_rng(6)
    w = (size * rng.normal(size=(M.ROWS, M.CLASSES))).astype(np.float32)
    bias = rng.normal(size=M.CLASSES).astype(np.float32)
    bias[3] = -1e9
    rows = [rng.integers(0, M.ROWS, 500) for _ in range(4)]
    z = sum(w[r].astype(float) for r in rows) + bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(M._softmax(w, bias, rows), np.exp(z), atol=1e-4)
    assert np.allclose(M._log_softmax(w, bias, rows)[:, :3], z[:, :3], rtol=1e-4, atol=1e-3)
