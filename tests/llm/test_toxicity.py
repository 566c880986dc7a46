import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.llm import toxicity as X


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(1)
    table = r.standard_normal((40, 2))
    net = X.Network(table, dtype=np.float64)
    ids = r.integers(0, 40, (3, X.WINDOW, 4))
    mask = (np.arange(X.WINDOW) < np.array([5, 32, 1])[:, None]).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = X.sigmoid(net.forward(ids, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    cache = {}
    grads = net.backward(cache, X.sigmoid(net.forward(ids, mask, cache)) - y)
    rows, dense = grads["E"]
    full = np.zeros_like(table)
    full[rows] = dense
    grads["E"] = full
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert (up - down) / 2e-5 == pytest.approx(np.asarray(grads[name])[at], rel=1e-3, abs=1e-6), name


def test_windows_cover_all_words():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    row, first, length = X.windows_of(counts)
    base = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        mine = row == i
        covered = {w for f, k in zip(first[mine] - base[i], length[mine]) for w in range(f, f + k)}
        assert covered == set(range(n)) and mine.sum() >= 1


def sample(n, seed):
    r = random.Random(seed)
    words = [f"wo{i}rd" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 300))
        bad = r.random() < 0.2
        if bad:
            w[r.randrange(len(w))] = "nasty" + r.choice(words)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(docs_of, spark):
    rows, labels = sample(900, 2)
    more = [(5000, None), (5001, ""), (5002, "?!"), (None, "wo1rd"), (5003, "wo2rd " * 5000 + "nastyq " + "wo3rd " * 3000)]
    docs = docs_of(rows + more)
    got = X.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    caught = np.mean([r["predicted"] for r in held if truth[r["doc_id"]]])
    assert right > 0.97 and caught > 0.9
    assert next(r for r in got if r["doc_id"] == 5003)["predicted"] == 1


def test_without_labels_or_rows(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(docs_of([(1, "a b")]), none).first()["score"] == 0.5
    assert X.score(docs_of([]), none).count() == 0
    clash = docs_of([(1, "a", "x")], "doc_id long, text string, score string")
    assert isinstance(X.score(clash, none).select(F.col("score")).first()[0], float)


def test_words_and_their_characters():
    texts = ["Ab déjà ab", "", "привет x"]
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    w = X.words_of(buf, off)
    assert w.row.tolist() == [0, 0, 0, 2, 2] and w.at[0] == w.at[2] and len(w.key) == 4
    assert w.per[w.at].tolist() == [2, 4, 2, 6, 1] and len(w.grams) == w.per.sum()
    halves = X.joined([X.words_of(buf[: off[1]], off[:2]), X.words_of(buf[off[1] :], off[1:] - off[1])], [0, 1])
    assert all((getattr(halves, f) == getattr(w, f)).all() for f in ("key", "ids", "grams", "per", "at", "row"))
    got, owner = w.grams_of(w.at[[3, 1]])
    assert np.bincount(owner).tolist() == [6, 4] and got[:6].tolist() == w.grams[w.edge[w.at[3]] : w.edge[w.at[3]] + 6].tolist()
    assert len(X.joined([X.words_of(buf[:0], np.zeros(1, np.int64))], [0]).ids) == 1


def test_character_gradients_equal_finite_differences():
    r = np.random.default_rng(3)
    w = X.words_of(np.frombuffer(b"alpha beta alphabet xy", np.uint8), np.array([0, 22]))
    w.ids, w.grams = w.ids % 40, w.grams % 30
    net = X.Network(r.standard_normal((40, 2)), dtype=np.float64, chars=r.standard_normal((30, X.CHAR_SIZE)))
    k = r.integers(0, len(w.key), (3, X.WINDOW))
    mask = (np.arange(X.WINDOW) < np.array([7, 32, 2])[:, None]).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def run(cache=None):
        chosen, place = np.unique(k, return_inverse=True)
        chars, gram, owner = net.characters(w, chosen)
        return X.sigmoid(net.forward(w.ids[k], mask, cache, chars[place.reshape(k.shape)])), (k, gram, owner)

    def loss():
        p = run()[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    cache = {}
    p, grams = run(cache)
    grads = net.backward(cache, p - y, grams)
    for name in "EC":
        full = np.zeros_like(net.w[name])
        full[grads[name][0]] = grads[name][1]
        for row in grads[name][0][:8]:
            old = net.w[name][row, 1]
            net.w[name][row, 1] = old + 1e-5
            up = loss()
            net.w[name][row, 1] = old - 1e-5
            down = loss()
            net.w[name][row, 1] = old
            assert (up - down) / 2e-5 == pytest.approx(full[row, 1], rel=1e-3, abs=1e-6), name


def test_the_driver_does_not_train(docs_of, spark, monkeypatch):
    import os

    driver, train = os.getpid(), X.train

    def elsewhere(texts, y):
        assert os.getpid() != driver, "training rows reached the driver"
        return train(texts, y)

    monkeypatch.setattr(X, "train", elsewhere)
    rows, labels = sample(120, 5)
    got = X.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) > 10
