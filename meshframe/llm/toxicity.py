"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are embeddings of the word and of its first three, four and five bytes, each by hash, and the mean of
embeddings of its character n-grams: every character with the two behind it, as far as the word goes, whatever its
length. The first number of a word's or beginning's embedding starts as the smoothed log-odds of its bucket among the
training documents; those of character n-grams start at random. Both passes run over windows of WINDOW words, attention pools their states, and a document's score is its highest window: every
document is scored over all its overlapping windows, whole. Training knows labels of documents only, so each round
takes the highest window of each toxic document and the highest and some other windows of each clean one.

Training rows: at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents of at most TRAIN_BYTES (all are parameters), the
first by hash of doc_id. They meet in one task, which trains; the driver gets the weights alone.

Defined cases: a null or text without words has one empty window and its score; repeated rows get equal scores; without
labelled rows the score is one half; an empty table gives no rows; columns named like results are replaced.
"""

from __future__ import annotations

import os
import pickle
import subprocess
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import textops as T
from meshframe.llm.common import release

WINDOW, STRIDE = 32, 16
HIDDEN = 8
BUCKETS = 1 << 17
PREFIXES = (3, 4, 5)
#: Characters of an n-gram, buckets of n-grams, numbers in their embedding.
CHARS, CHAR_BUCKETS, CHAR_SIZE = 3, 1 << 16, 4
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 2500, 6000, 1 << 15
#: Weight of the prior in the log-odds of a bucket.
PRIOR = 6.0
THRESHOLD = 0.7
#: Rounds of choosing windows; in each, passes over them, but so many steps at least; windows a step; first step size.
ROUNDS, EPOCHS, STEPS, BATCH, RATE = 4, 3, 150, 256, 0.02

#: Part of the clean windows that are trained as a single repeated word.
REPEATED = 0.1


class Words:
    """Distinct words of some rows: `ids` (word, beginnings), n-grams end to end in `grams`, `per` of them a word; `at`
    is the distinct word and `row` the row of each word in turn."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, grams: np.ndarray, per: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        self.key, self.ids, self.grams, self.per, self.at, self.row = key, ids, grams, per, at, row
        self.edge = np.concatenate(([0], np.cumsum(per)))

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of the chosen distinct words, and the place of each one's word in the choice."""
        per = self.per[words]
        owner = np.repeat(np.arange(len(words)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        return self.grams[self.edge[words][owner] + within], owner


def words_of(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of rows, lower-cased; rows without any share one empty word that no row refers to."""
    low = T.LOWER[buf]
    start, end, row = T.words(low, off, T.ALNUM)
    key, one, at = np.unique(T.word_hashes(low, start, end), return_index=True, return_inverse=True)
    if not len(key):
        return Words(key, np.zeros((1, 1 + len(PREFIXES)), np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), row)
    size = (end - start)[one]
    first = np.cumsum(size) - size
    text = low[np.repeat(start[one] - first, size) + np.arange(size.sum())]
    last = first + size
    pre = T.prefix(T.byte_values()[text])
    ids = [(key % np.uint64(BUCKETS)).astype(np.int32)]
    ids += [(T.spans_hash(pre, first, np.minimum(first + k, last)) % np.uint64(BUCKETS)).astype(np.int32) + i * BUCKETS for i, k in enumerate(PREFIXES, 1)]
    begin = np.flatnonzero((text & 0xC0) != 0x80)
    owner = np.searchsorted(first, begin, "right") - 1
    until = np.minimum(np.concatenate((begin[CHARS:], np.full(min(CHARS, len(begin)), len(text)))), last[owner])
    grams = (T.spans_hash(pre, begin, until) % np.uint64(CHAR_BUCKETS)).astype(np.int32)
    return Words(key, np.stack(ids, 1), grams, np.bincount(owner, minlength=len(key)), at.reshape(-1).astype(np.int32), row)


def joined(parts: list[Words], rows: list[int]) -> Words:
    """Words of all parts as one; rows of a part begin at its number in `rows`."""
    key, one, same = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    if not len(key):
        return parts[0]
    parts, rows = zip(*((p, r) for p, r in zip(parts, rows) if len(p.key)))
    every = Words(key, np.concatenate([p.ids for p in parts]), np.concatenate([p.grams for p in parts]), np.concatenate([p.per for p in parts]), same, same)
    grams, _ = every.grams_of(one)
    base = np.cumsum([0] + [len(p.key) for p in parts])
    at = np.concatenate([same[b:][p.at] for b, p in zip(base, parts)]).astype(np.int32)
    return Words(key, every.ids[one], grams, every.per[one], at, np.concatenate([(p.row + r).astype(np.int32) for p, r in zip(parts, rows)]))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word (over all rows) and words of each window; each row has one at least."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    first = np.cumsum(counts) - counts
    return row, first[row] + at, np.clip(counts[row] - at, 0, WINDOW)


def gather(at: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of windows (window, word) and their mask."""
    step = np.arange(WINDOW)
    mask = step < length[:, None]
    got = at[np.minimum(first[:, None] + step, len(at) - 1)] if len(at) else np.zeros((len(first), WINDOW), np.int32)
    return got, mask.astype(np.float32)


def means(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean of the values of each of n owners; zero where there is none."""
    per = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, values[:, k], n) / per for k in range(values.shape[1])], 1).astype(values.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights: embeddings (also of character n-grams, if `chars` gives them), gates of both directions (update, reset,
    candidate), attention, output."""

    def __init__(self, table: np.ndarray, seed: int = 7, dtype: type = np.float32, chars: np.ndarray | None = None) -> None:
        r = np.random.default_rng(seed)
        d, h = table.shape[1] * (1 + len(PREFIXES)) + (0 if chars is None else chars.shape[1]), HIDDEN
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(dtype)
        self.w = {"E": table.astype(dtype), "Wf": init(d, 3 * h), "Uf": init(h, 3 * h), "bf": np.zeros(3 * h, dtype), "Wb": init(d, 3 * h), "Ub": init(h, 3 * h), "bb": np.zeros(3 * h, dtype), "A": init(2 * h, h), "v": init(h), "o": init(2 * h), "c": np.zeros(1, dtype)}
        if chars is not None:
            self.w["C"] = chars.astype(dtype)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States of one direction (step first), zero at masked steps."""
        h = HIDDEN
        W, U, b = self.w["W" + side], self.w["U" + side], self.w["b" + side]
        xs = (x.reshape(-1, x.shape[-1]) @ W + b).reshape(*x.shape[:2], 3 * h)
        out = np.zeros((x.shape[0], x.shape[1], h), x.dtype)
        state = np.zeros((x.shape[1], h), x.dtype)
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            hu = state @ U
            g = sigmoid(xs[t, :, : 2 * h] + hu[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            n = np.tanh(xs[t, :, 2 * h :] + r * hu[:, 2 * h :])
            new = (n + z * (state - n)) * mask[t][:, None]
            if keep is not None:
                keep.append((t, state, z, r, n, hu[:, 2 * h :]))
            state = out[t] = new
        return out

    def forward(self, ids: np.ndarray, mask: np.ndarray, cache: dict | None = None, chars: np.ndarray | None = None) -> np.ndarray:
        """Logits of windows; `chars` are the means over the n-grams of their words."""
        x = self.w["E"][ids].reshape(*ids.shape[:2], -1)
        x = (x if chars is None else np.concatenate((x, chars), 2)).transpose(1, 0, 2)
        m = mask.T
        kf, kb = ([], []) if cache is not None else (None, None)
        s = np.concatenate((self.run(x, m, "f", kf), self.run(x, m, "b", kb)), 2)
        u = np.tanh(s @ self.w["A"])
        e = u @ self.w["v"] + (m - 1) * 1e4
        e = np.exp(e - e.max(0))
        a = e / e.sum(0) * m.max(0)
        pooled = (a[:, :, None] * s).sum(0)
        if cache is not None:
            cache.update(x=x, m=m, kf=kf, kb=kb, s=s, u=u, a=a, pooled=pooled, ids=ids)
        return pooled @ self.w["o"] + self.w["c"][0]

    def backward(self, k: dict, dlogit: np.ndarray, grams: tuple | None = None) -> dict:
        """Slopes of all weights; `grams`: distinct word of each input, then n-grams and their words as in `grams_of`."""
        g = {"o": k["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], dlogit.dtype)}
        dp = dlogit[:, None] * self.w["o"]
        da = (k["s"] * dp).sum(2)
        ds = k["a"][:, :, None] * dp
        de = k["a"] * (da - (k["a"] * da).sum(0))
        g["v"] = np.einsum("tbh,tb->h", k["u"], de)
        du = de[:, :, None] * self.w["v"] * (1 - k["u"] ** 2)
        g["A"] = np.einsum("tbs,tbh->sh", k["s"], du)
        ds = ds + du @ self.w["A"].T
        dx = np.zeros_like(k["x"])
        h = HIDDEN
        for side, keep, part in (("f", k["kf"], ds[:, :, :h]), ("b", k["kb"], ds[:, :, h:])):
            W, U = self.w["W" + side], self.w["U" + side]
            gW, gU, gb = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * h, W.dtype)
            carry = np.zeros_like(part[0])
            for t, before, z, r, n, hn in reversed(keep):
                dh = (part[t] + carry) * k["m"][t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dg = np.concatenate((dz, dr, dn), 1)
                du_ = np.concatenate((dz, dr, dn * r), 1)
                gW += k["x"][t].T @ dg
                gb += dg.sum(0)
                gU += before.T @ du_
                dx[t] += dg @ W.T
                carry = dh * z + du_ @ U.T
            g["W" + side], g["U" + side], g["b" + side] = gW, gU, gb
        wide = k["ids"].shape[2] * self.w["E"].shape[1]
        g["E"] = summed(k["ids"].transpose(1, 0, 2).reshape(-1), dx[:, :, :wide].reshape(-1, self.w["E"].shape[1]))
        if grams is not None:
            word, gram, owner = grams
            _, per_word = summed(word.T.reshape(-1), dx[:, :, wide:].reshape(-1, self.w["C"].shape[1]))
            g["C"] = summed(gram, (per_word / np.maximum(np.bincount(owner, minlength=len(per_word)), 1)[:, None].astype(per_word.dtype))[owner])
        return g

    def characters(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means over the n-grams of distinct words, then these n-grams and their words."""
        gram, owner = words.grams_of(chosen)
        return means(self.w["C"][gram], owner, len(chosen)), gram, owner

    def scores(self, words: Words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Highest probability of each row, and the number of its window."""
        row, first, length = windows_of(counts)
        chars = self.characters(words, np.arange(len(words.ids)))[0]
        p = np.empty(len(row))
        for i in range(0, len(row), 2048):
            k, mask = gather(words.at, first[i : i + 2048], length[i : i + 2048])
            p[i : i + 2048] = sigmoid(self.forward(words.ids[k], mask, None, chars[k]).astype(np.float64))
        edge = np.searchsorted(row, np.arange(len(counts)))
        best = np.maximum.reduceat(p, edge) if len(counts) else p
        order = np.lexsort((np.arange(len(row)), -p, row))
        return best, order[edge], (row, first, length)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    one, where = np.unique(rows, return_inverse=True)
    where = where.reshape(-1)
    return one, np.stack([np.bincount(where, values[:, k], len(one)) for k in range(values.shape[1])], 1).astype(values.dtype)


class Adam:
    def __init__(self, w: dict) -> None:
        self.w, self.t = w, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, grads: dict, rate: float) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = slice(None)
            if isinstance(g, tuple):
                at, g = g
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.w[k][at] -= rate * fix * m / (np.sqrt(v) + 1e-7)


def log_odds(words: Words, y: np.ndarray) -> np.ndarray:
    """Embedding tables: smoothed log-odds of each bucket over documents, and a small random number."""
    size = BUCKETS * (1 + len(PREFIXES))
    seen = np.zeros((2, size))
    n = len(words.ids)
    once = np.unique(words.row.astype(np.int64) * n + words.at)
    for col in range(words.ids.shape[1]):
        pair = np.unique(once // n * size + words.ids[once % n, col])
        seen += np.stack([np.bincount(pair % size, y[pair // size] == c, size) for c in (0, 1)])
    base = y.mean()
    share = (seen[1] + PRIOR * base) / (seen.sum(0) + PRIOR)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    noise = np.random.default_rng(11).standard_normal(size) * 0.1
    return np.stack([np.clip(odds, -4, 4) / 2, noise], 1)


def train(texts: list[str], y: np.ndarray) -> Network | None:
    """A network from labelled documents; None where only one class is there."""
    y = np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        return None
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    cut = list(T.slices(off))
    parts = []
    for i, j in cut:
        parts.append(words_of(np.frombuffer("".join(texts[i:j]).encode(), np.uint8), off[i : j + 1] - off[i]))
        release()
    words = joined(parts, [i for i, _ in cut])
    del parts
    release()
    counts = np.bincount(words.row, minlength=len(y))
    start = np.random.default_rng(13).standard_normal((CHAR_BUCKETS, CHAR_SIZE)) * 0.1
    net = Network(log_odds(words, y), chars=start)
    adam, r = Adam(net.w), np.random.default_rng(5)
    wrow, first, length = windows_of(counts)
    edge = np.searchsorted(wrow, np.arange(len(y)))
    per = np.bincount(wrow, minlength=len(y))
    # the first choice of windows: the highest sum of positive log-odds
    odds = np.maximum(net.w["E"][words.ids, 0].sum(1), 0)[words.at]
    total = np.concatenate(([0], np.cumsum(odds)))
    rank = total[np.minimum(first + length, len(odds))] - total[np.minimum(first, len(odds))]
    top = np.lexsort((np.arange(len(wrow)), -rank, wrow))[edge]
    for turn in range(ROUNDS):
        if turn:
            top = net.scores(words, counts)[1]
        clean = np.flatnonzero(y == 0)
        some = edge[clean] + (r.random(len(clean)) * per[clean]).astype(np.int64)
        pick = np.concatenate((top, some))
        label = y[wrow[pick]]
        weight = np.where(label == 1, (label == 0).sum() / max((label == 1).sum(), 1) / 2, 1.0)
        steps = max(STEPS, EPOCHS * len(pick) // BATCH)
        order = np.concatenate([r.permutation(len(pick)) for _ in range(-(-steps * BATCH // len(pick)))])
        for step in range(steps):
            x = order[step * BATCH : (step + 1) * BATCH]
            cache: dict = {}
            k, m = gather(words.at, first[pick[x]], length[pick[x]])
            # some clean windows become one of their words over and over: repetition alone is no sign
            same = np.flatnonzero((label[x] == 0) & (length[pick[x]] > 0) & (r.random(len(x)) < REPEATED))
            k[same], m[same] = k[same][:, :1], 1
            chosen, place = np.unique(k, return_inverse=True)
            chars, gram, owner = net.characters(words, chosen)
            p = sigmoid(net.forward(words.ids[k], m, cache, chars[place.reshape(k.shape)]))
            slope = ((p - label[x]) * weight[x] / weight[x].sum()).astype(np.float32)
            adam.step(net.backward(cache, slope, (k, gram, owner)), RATE * (1 - 0.9 * (turn * steps + step) / (ROUNDS * steps)))
    return net


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str) -> DataFrame:
    """id, text, y: the bounded training sample, labelled rows outside the held-out fold."""
    may = labels.where((F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1) & F.col(toxic).isNotNull())
    one = may.groupBy(F.col(doc_id).alias("__mf_id")).agg(F.max(toxic).alias("__mf_y"))
    order = F.xxhash64("__mf_id")
    ids = one.where("__mf_y = 1").orderBy(order, "__mf_id").limit(TRAIN_TOXIC).unionByName(one.where("__mf_y = 0").orderBy(order, "__mf_id").limit(TRAIN_CLEAN))
    # at most TRAIN_TOXIC + TRAIN_CLEAN ids: a proven bound for the broadcast
    picked = docs.join(F.broadcast(ids), F.col(doc_id) == F.col("__mf_id")).where(F.octet_length(text) <= TRAIN_BYTES)
    return picked.select(F.col("__mf_id").alias("id"), F.col(text).alias("text"), F.col("__mf_y").cast("double").alias("y"))


def train_apart() -> None:
    """Texts and labels by standard input, the network by standard output."""
    sys.stdout.buffer.write(pickle.dumps(train(*pickle.load(sys.stdin.buffer))))


def trained(rows: DataFrame) -> Network | None:
    """The network of training rows, made in one task; its weights, of a fixed size, are all that reaches the driver.

    The task trains in a process of its own, for a Python worker lives on and would keep what training took.
    """

    def run(got: pa.Table) -> pa.Table:
        each = sorted(zip(*(got.column(c).to_pylist() for c in ("id", "y", "text"))))
        given = pickle.dumps(([r[2] for r in each], np.array([r[1] for r in each], np.float64)))
        del each
        env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in sys.path if x)}
        made = subprocess.run([sys.executable, "-c", "from meshframe.llm import toxicity; toxicity.train_apart()"], input=given, stdout=subprocess.PIPE, env=env, check=True).stdout
        del given
        release()
        return pa.table({"net": pa.array([made], pa.binary())})

    made = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "net binary").collect()
    return pickle.loads(made[0]["net"]) if made else None


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """Rows with held_out, score and predicted."""
    net = trained(training_rows(docs, labels, doc_id, text, toxic))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size

    @F.pandas_udf("double")
    def scored(column):
        import pandas as pd

        model = shared.value
        if model is None:
            return pd.Series(np.full(len(column), 0.5))
        buf, off = T.buffer(pa.array(column, pa.string(), from_pandas=True))
        out = np.zeros(len(off) - 1)
        for i, j in T.slices(off):
            words = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            out[i:j] = model.scores(words, np.bincount(words.row, minlength=j - i))[0]
        release()
        return pd.Series(out)

    held = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
    out = docs.withColumn("score", scored(text)).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
