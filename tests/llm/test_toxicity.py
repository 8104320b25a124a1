import numpy as np
import pytest

from ampertide.llm import toxicity as X

BAD = ["scumling", "scumlet", "vilemort", "vilest"]


def data(n=900, seed=1):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(5, 200))]
        bad, low = i % 7 == 0, i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 60):
                words[rng.integers(len(words))] = BAD[rng.integers(len(BAD))].upper() + ","
        if low:
            words += ["click", "here", "now"]
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not low), int(bad)))
    return docs, labels


def frames(spark, docs_of, docs, labels):
    return docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs_of):
    docs, labels = data()
    d, lab = frames(spark, docs_of, docs, labels)
    got = {r.doc_id: r for r in X.toxicity(d, lab).collect()}
    unseen = [i for i, _ in docs if i % 2 == 0]
    assert np.mean([got[i].toxic == (i % 7 == 0) for i in unseen]) > 0.97
    assert np.mean([(got[i].p_low_quality > 0.5) == (i % 3 == 0) for i in unseen]) > 0.95


def test_later_models_see_out_of_fold_predictions(spark, docs_of):
    d, lab = frames(spark, docs_of, *data())
    models, sample = X.train_chain(d, lab, X.label_categories())
    assert [len(m.chain) for m in models] == [0, 1, 2]
    rows = sample.collect()
    assert all(len(r.oof) == 3 for r in rows) and len(rows) == len(data()[1])
    # Each prediction comes from a model of another fold, so it is not a perfect fit.
    p, y = np.array([r.oof[1] for r in rows]), np.array([r.y[1] for r in rows])
    limit = X.decision_threshold(sample, 1)
    assert np.mean((p > limit) == y) > 0.95


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(5)
    p, y, w = rng.random(300).round(2), rng.integers(0, 2, 300), rng.random(300) + 0.1

    def f1(t):
        called = p > t
        return 2 * (w * y)[called].sum() / (w[called].sum() + (w * y).sum())

    assert f1(X.best_threshold(p, y, w)) == pytest.approx(max(f1(t) for t in np.arange(-0.005, 1, 0.005)))
    assert X.best_threshold(p, np.zeros(300), w) == 0.5


def test_sample_is_bounded_and_weighted(spark, docs_of):
    d, lab = frames(spark, docs_of, *data())
    s = X.labelled_sample(d, lab, X.label_categories(), 20, "doc_id", "text").collect()
    combos = {}
    for r in s:
        combos.setdefault(tuple(r.y), []).append(r.weight)
    assert all(len(v) <= 20 for v in combos.values())
    assert sum(map(sum, combos.values())) == pytest.approx(len(data()[1]))


def test_logistic_fit_is_a_stationary_point():
    rng = np.random.default_rng(3)
    idx = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(400)]
    y = np.array([float((7 in i) ^ (rng.random() < 0.1)) for i in idx])
    m = X.fit_linear(idx, np.zeros((400, 0)), y, np.ones(400))
    top = np.argmax(m.weights)
    assert top == 7 and m.weights[7] > 0


def test_edge_cases(spark, docs_of):
    docs, labels = data(120)
    docs += [(1000, None), (1001, ""), (None, "w1 w2"), (5, "w1 again"), (1002, "w3 " * 100_000 + "scumling " * 3000)]
    labels += [(None, 1, 1), (3, None, 1), (5, 1, 0), (5, 1, 1), (99_999, 1, 1)]
    d, lab = frames(spark, docs_of, docs, labels)
    got = X.toxicity(d, lab).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.p_toxic <= 1 for r in got)
    kept = X.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(not r.toxic for r in got)
    assert next(r for r in kept.collect() if r.doc_id == 1000).text is None


def test_no_labels_reject_nothing(spark, docs_of):
    d, lab = frames(spark, docs_of, [(1, "a"), (2, None)], [])
    assert [r.toxic for r in X.toxicity(d, lab).collect()] == [False, False]
    d, lab = frames(spark, docs_of, [(1, "a"), (2, "b")], [(1, 1, 0), (2, 1, 0)])
    assert [r.toxic for r in X.toxicity(d, lab).collect()] == [False, False]
    assert X.toxicity(docs_of([]), lab).count() == 0
