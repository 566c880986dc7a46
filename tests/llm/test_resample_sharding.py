import re
import zlib
from collections import Counter

import numpy as np
import pytest

from meshframe.llm import resample as R
from meshframe.llm import sharding


def brute_grams(text):
    w = re.findall(r"[A-Za-z0-9_\x80-\U0010FFFF]+|[!-/:-@\[-^`{-~]+", text or "")
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    return Counter(w) + Counter(zip(w, w[1:]))


def test_features_follow_words_and_pairs():
    texts = ["The cat, the CAT!! é_1 x", "", "a", "***", "a***b\ta"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    f, r = R.features(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, t in enumerate(texts):
        assert Counter(Counter(f[r == i].tolist()).values()) == Counter(brute_grams(t).values())


def test_resampling_prefers_target_like_text(docs_of):
    rows = [(i, "good calm words here " * 20, True if i % 2 else None) for i in range(60)] + [(100 + i, "*** spam ### junk " * 20, None) for i in range(40)]
    rows += [(None, None, None), (99, "", None)]
    got = R.resample(docs_of(rows, "doc_id long, text string, good boolean"), docs_of([r for r in rows if r[2]], "doc_id long, text string, good boolean"), 0.6).collect()
    assert len(got) == len(rows) and sum(r["selected"] for r in got) == round(0.6 * len(rows))
    assert sum(r["selected"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 100) == 0
    by_key = sorted(got, key=lambda r: (-r["sample_key"], r["doc_id"] if r["doc_id"] is not None else 1 << 63))
    assert all(r["selected"] for r in by_key[: round(0.6 * len(rows))])


def test_weights_equal_a_plain_computation(docs_of):
    rows = [(1, "a b c a", True), (2, "b c d", None), (3, "a a", True)]
    got = {r["doc_id"]: r["log_weight"] for r in R.resample(docs_of(rows, "doc_id long, text string, good boolean"), docs_of([r for r in rows if r[2]], "doc_id long, text string, good boolean"), 0.5).collect()}
    grams = {d: brute_grams(t) for d, t, _ in rows}
    raw, target = sum(grams.values(), Counter()), grams[1] + grams[3]
    m = R.BUCKETS
    ratio = lambda g: np.log((target[g] + 1) / (sum(target.values()) + m)) - np.log((raw[g] + 1) / (sum(raw.values()) + m))
    for d in grams:
        assert abs(got[d] - sum(n * ratio(g) for g, n in grams[d].items())) < 1e-9


def test_resampling_without_rows_or_target(docs_of):
    assert R.resample(docs_of([]), docs_of([]), 0.5).count() == 0
    got = R.resample(docs_of([(1, "a")]), docs_of([]), 1.0).first()
    assert got["log_weight"] == 0.0 and got["selected"]


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    mean, most = sum(total) / shards, max(size(t) for _, t in rows)
    assert max(abs(x - mean) for x in total) <= 2 * max(most, sharding.TOLERANCE * mean) + 1


def test_shards_have_equal_sizes_with_a_hot_text(docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(0, 300))) for i in range(1500)] + [(5000 + i, "hot text " * 10) for i in range(900)] + [(-4, None), (7000, ""), (7001, "é" * 50)]
    got = sharding.shard(docs_of(rows), shards=16, ranges=3).collect()
    check_shards(rows, got, 16)


def test_shards_of_few_or_no_rows(docs_of):
    assert sharding.shard(docs_of([])).count() == 0
    got = sharding.shard(docs_of([(1, "a"), (2, "b")])).collect()
    assert sorted(r["slot"] for r in got) == [0, 0] or sorted(r["slot"] for r in got) == [0, 1]
    clash = sharding.shard(docs_of([(1, "a", "z")], "doc_id long, text string, shard string")).first()
    assert isinstance(clash["shard"], int)
    # the law holds for repeated rows too: equal sizes, so none has two before each has one
    same = [r["shard"] for r in sharding.shard(docs_of([(1, "a")] * 16)).collect()]
    assert max(Counter(same).values()) <= 2


@pytest.mark.parametrize("hot", [[(1, "repeated row " * 9)] * 1500, [(None, "x")] * 900 + [(None, None)] * 900])
def test_repeated_rows_split_between_shards(docs_of, hot):
    rng = np.random.default_rng(4)
    rows = hot + [(10 + i, "y" * int(rng.integers(0, 200))) for i in range(1000)] + [(7, "z" * 3000)]
    for ranges in (1, 3):
        check_shards(rows, sharding.shard(docs_of(rows).repartition(6), shards=8, ranges=ranges).collect(), 8)


def test_boundaries_are_the_best_of_a_sorted_table(docs_of):
    """Rows below each boundary, held against a plain sort."""
    rng = np.random.default_rng(5)
    rows = [(i, "t" * int(rng.integers(0, 80))) for i in range(600)]
    got = sharding.shard(docs_of(rows), shards=5, ranges=1).collect()
    total = sum(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ends = np.cumsum([r["size"] for r in order])
    for k in range(1, 5):
        at = sum(r["shard"] < k for r in order)
        near = min(abs(int(e) - total * k / 5) for e in [0, *ends])
        assert abs(int(ends[at - 1]) - total * k / 5) <= max(near, sharding.TOLERANCE * total / 5) + 1e-9
    hashes = {}
    for r in order:
        hashes.setdefault(len(rows[r["doc_id"]][1]), set()).add(r["shard"])
    assert all(max(x) - min(x) <= 1 for x in hashes.values())  # equal texts stand together
