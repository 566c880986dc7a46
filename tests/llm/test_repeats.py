import hashlib
import random
import zlib
import re

import numpy as np
import pytest

from meshframe.llm.repeats import Units
from meshframe.llm.substring_dedup import Automaton, substring_dedup
from meshframe.llm.suffix_dedup import decode, encode, merge, suffix_dedup
from pyspark.sql import functions as F


def brute_bytes(rows, window=100):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    for n, (d, text) in enumerate(ordered):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                gone[s : s + window] = [True] * window
            else:
                seen[w] = n
        out[n] = (d, len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(raw, gone) if not g))
    return sorted(out.values(), key=repr)


def brute_words(rows, window=13):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = lambda d: (d is None, d or 0)
    for d, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(d):
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    return sorted(out, key=repr)


def corpus(seed, n=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é" * 3, "ß", "日本"]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(14, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(passages) if r.random() < 0.6 else " ".join(r.choices(vocabulary, k=r.randint(1, 80))))
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 400), (n + 3, "x" * 500), (n + 4, "ab" * 300), (None, passages[0] + " tail"), (5, passages[1] + passages[2]), (5, rows[5][1]), (7, rows[3][1]), (8, "  \t\n ")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(docs_of, seed):
    rows = corpus(seed)
    got = suffix_dedup(docs_of(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == brute_bytes(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup_equals_brute_force(docs_of, seed):
    rows = corpus(seed)
    got = substring_dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=repr) == brute_words(rows)


def test_empty_tables_and_clashing_columns(docs_of):
    empty = docs_of([])
    assert suffix_dedup(empty).count() == 0 and substring_dedup(empty).count() == 0
    clash = docs_of([(1, "a b", 3, 4)], "doc_id long, text string, kept int, bucket int")
    row = suffix_dedup(clash).first()
    assert bytes(row["kept"]) == b"a b" and row["bucket"] == 4
    assert bytes(substring_dedup(clash).first()["kept"]) == b"a b"


def test_merge_keeps_order_and_shared_lengths():
    r = random.Random(5)
    runs = [sorted((bytes(r.choices(b"ab", k=r.randint(0, 12))), b"", i, 0, 0, 1) for i in range(r.randint(1, 30))) for _ in range(7)]
    out = list(merge([decode(encode(x)) for x in runs]))
    texts = [x[1] for x in out]
    assert texts == sorted(x[0] for run in runs for x in run)
    for a, b, shared in zip(texts, texts[1:], [x[0] for x in out[1:]]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared == n
    assert list(merge([])) == []


def test_automaton_knows_first_documents():
    r = random.Random(6)
    texts = [[r.randint(0, 2) for _ in range(r.randint(1, 40))] for _ in range(12)]
    auto, seen = Automaton(), {}
    for d, t in enumerate(texts):
        auto.add(t, d)
        for i in range(len(t) - 3):
            seen.setdefault(tuple(t[i : i + 4]), d)
    for _ in range(30):
        q = [r.randint(0, 2) for _ in range(20)]
        assert auto.firsts(q, 4) == [seen.get(tuple(q[i : i + 4]), -1) for i in range(17)]


def test_digest_of_removed_passage(docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    out = {r["doc_id"]: r for r in substring_dedup(docs_of([(1, passage), (2, "start " + passage + " end")])).withColumn("h", F.sha2("kept", 256)).collect()}
    assert out[2]["n_removed"] == 60 and out[2]["h"] == hashlib.sha256(b"start end").hexdigest()


def test_rows_of_one_id_meet_all_holders_of_their_words(docs_of):
    r = random.Random(7)
    passages = [" ".join(f"p{i}x{r.randint(0, 999)}" for _ in range(30)) for i in range(25)]
    rows = list(enumerate(passages)) + [(d, p + " " + " ".join(f"n{i}x{r.randint(0, 999)}" for _ in range(20))) for d in (None, 99) for i, p in enumerate(passages)]
    got = substring_dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(((x[0], x[1], x[2], bytes(x[3])) for x in got), key=repr) == brute_words(rows)


@pytest.mark.parametrize("by_word", [False, True])
def test_pieces_of_a_long_text_hold_each_window_once(by_word):
    r = random.Random(8)
    texts = [" ".join(r.choices(["aa", "b", "cé", "d" * 30, "ee\n"], k=r.randint(0, 400))).encode() for _ in range(6)] + [b"", b"x" * 900, b" " * 500 + b"y z " * 200]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    units = Units(13, 6, True) if by_word else Units(100, 40, False)

    def windows(limit):
        out = []
        for p in units.pieces(buf, off, limit):
            first, last, at = p.place(p.first, p.row), p.place(p.last, p.row), p.place(p.at, p.row)
            for row, a, b, c, h in zip(p.row, first, last, at, p.hash):
                out += [(int(row) + p.first_row, s, int(c), int(h)) for s in range(int(a), int(b) + 1)]
        assert len(set(out)) == len(out)
        return sorted(out)

    assert windows(150) == windows(10**9)


def test_very_long_repetitive_texts(docs_of):
    rows = [(1, "a" * 3_000_000), (2, "ha " * 900_000), (3, "ha " * 700_000 + "end"), (None, "a" * 2_500_000)]
    got = {r["doc_id"]: r for r in suffix_dedup(docs_of(rows)).collect()}
    assert [got[d]["n_removed"] for d in (1, 2, 3, None)] == [2_999_999, 2_699_997, 2_100_000, 2_500_000]
    assert [bytes(got[d]["kept"]) for d in (1, 2, 3, None)] == [b"a", b"ha ", b"end", b""]
    got = {r["doc_id"]: r for r in substring_dedup(docs_of(rows)).collect()}
    assert [got[d]["n_removed"] for d in (1, 2, 3, None)] == [0, 0, 700_000, 0]
    assert bytes(got[3]["kept"]) == b"end" and got[2]["n_words"] == 900_000


def test_many_rows_without_id(docs_of):
    r = random.Random(11)
    passages = [" ".join(f"p{i}x{r.randint(0, 99)}" for _ in range(40)) for i in range(12)]
    rows = [(None, r.choice(passages) + " " + " ".join(f"u{r.randint(0, 999)}" for _ in range(r.randint(0, 40)))) for _ in range(90)] + [(i, passages[i]) for i in range(6)] + [(None, None), (None, ""), (None, passages[1])] * 2
    got = substring_dedup(docs_of(rows).repartition(4)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(((x[0], x[1], x[2], bytes(x[3])) for x in got), key=repr) == brute_words(rows)
    raw = lambda t: (t or "").encode()
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, zlib.crc32(raw(x[1])) if x[0] is None else 0, raw(x[1])))
    numbered = [(i, t) for i, (_, t) in enumerate(ordered)]
    want = [(ordered[i][0], *rest) for i, *rest in brute_bytes(numbered)]
    got = suffix_dedup(docs_of(rows).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((x[0], x[1], x[2], x[3], bytes(x[4])) for x in got), key=repr) == sorted(want, key=repr)
