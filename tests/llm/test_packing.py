import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meshframe.llm import packing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def texts():
    r = random.Random(1)
    vocabulary = ["the", "and", "Straße", "naïve", "日本語", "don't", "<|endoftext|>", "12345", "  ", "\n\n", "\t", "!!!", "é", "🙂"]
    out = [" ".join(r.choices(vocabulary, k=r.randint(0, 900))) for _ in range(60)]
    return [*out, "", None, "word " * 6000, "x" * 3000, " " * 4000, "same text here", "same text here"]


def own_ids(values):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [x.ids for x in t.encode_batch(values, add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library():
    values = [t or "" for t in texts()]
    assert [x.tolist() for x in packing.encoder(PATH)(values)] == own_ids(values)


def check(rows, got, window=packing.WINDOW):
    ids = {d: np.array([*x, 1], "<u4") for (d, _), x in zip(rows, own_ids([t or "" for _, t in rows]), strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(ids[d][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[d])
    lengths = []
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths.append(at)
    assert max(lengths) <= window
    return lengths


def test_pieces_cover_each_document_once_with_little_padding(docs_of):
    rows = list(enumerate(texts()))
    lengths = check(rows, packing.pack_sequences(docs_of(rows), PATH).collect())
    assert sum(x < packing.WINDOW for x in lengths) <= 1


def test_hot_topic_is_spread_over_shards():
    first, parts = packing.deal({1: 5, 2: 30, 4: 4, 5: 7}, 10, 8)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1, 1, 1]


def test_neighbours_are_lexical():
    groups = [np.array([100 + g] * 20 + [5] * 20, np.uint16) for g in (0, 1, 0, 1)]
    df = np.zeros(200, np.int64)
    df[[100, 101]], df[5] = 2, 4
    out = list(packing.fill(groups, df, 4, 40.0, 80))
    assert [sorted(p[0] for p in s) for s in out] == [[0, 2], [1, 3]]


def test_added_tokens_inside_texts_are_ids_of_their_own():
    values = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "no token"]
    got = [x.tolist() for x in packing.encoder(PATH)(values)]
    assert got == own_ids(values) and 50256 in got[0] and 50256 not in got[3]


def test_index_gives_the_order_of_plain_bm25():
    r = np.random.default_rng(3)
    for equal in (False, True):
        tails = [np.array(r.integers(0, 12 if equal else 400, r.integers(1, 4 if equal else 30)), np.uint16) for _ in range(300)]
        df = np.zeros(400, np.int64)
        for t in tails:
            df[np.unique(t)] += 1
        mean = float(np.mean([len(t) for t in tails]))
        index = packing.Index(tails, df, len(tails), mean)
        for i in range(0, 200, 3):
            index.take(i)
        for seed in (0, 57, 299):
            index.used[seed] or index.take(seed)
            plain = []
            for j, t in enumerate(tails):
                both = np.setdiff1d(np.intersect1d(t, tails[seed]), [packing.END_ID])
                if len(both) and not index.used[j]:
                    tf = np.array([(t == x).sum() for x in both])
                    idf = np.log(1 + (len(tails) - df[both] + 0.5) / (df[both] + 0.5))
                    score = (idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(t) / mean))).sum()
                    plain.append((-score, j))
            got = []
            for j in index.neighbours(seed, 40):
                index.take(j)
                got.append(j)
            scores = {j: s for s, j in plain}
            want = sorted(plain)[: len(got)]
            assert len(got) >= min(40, len(plain)) and len(set(got)) == len(got)
            np.testing.assert_allclose([scores[j] for j in got], [s for s, _ in want], rtol=1e-5)


def test_many_short_tails_fill_in_linear_time():
    import time

    r = np.random.default_rng(4)
    for tails in (list(r.integers(2, 50000, (100_000, 2)).astype(np.uint16)), [np.array([7, 1], np.uint16)] * 100_000):
        df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=50257)
        began = time.perf_counter()
        got = list(packing.fill(tails, df, len(tails), 2.0, 2048))
        assert sum(len(x) for x in got) >= len(tails) and time.perf_counter() - began < 20
        assert sorted({p[0] for x in got for p in x}) == list(range(len(tails)))


def test_empty_table_and_ids(docs_of):
    assert packing.pack_sequences(docs_of([]), PATH).count() == 0
    row = packing.pack_sequences(docs_of([(None, "a b")]), PATH, with_ids=True).first()
    assert row["ids"] == [*own_ids(["a b"])[0], 1] and row["doc_id"] is None


def test_sizes_of_topics_count_every_row(docs_of, monkeypatch):
    rows = [(i, f"word{i % 7} " * (i + 1)) for i in range(40)] + [(None, "long " * 3000)] * 2
    sizes = []
    deal = packing.deal
    monkeypatch.setattr(packing, "deal", lambda s, *a: sizes.append(s) or deal(s, *a))
    packing.pack_sequences(docs_of(rows), PATH)
    assert sum(sizes[0].values()) == sum(len(x) + 1 for x in own_ids([t for _, t in rows]))


def test_a_seed_asks_with_all_of_its_tokens():
    rare = list(range(100, 112))
    tails = [np.array(x, np.uint16) for x in (rare + [50] * 8, rare + [60] * 8, [70] * 20, [50] * 20)]
    df = np.zeros(200, np.int64)
    df[rare], df[50], df[[60, 70]] = 2, 3, 1
    assert [[p[0] for p in s] for s in packing.fill(tails, df, 4, 20.0, 60)] == [[0, 1, 3], [2]]


def test_common_tokens_are_rows_and_give_the_same_sequences(monkeypatch):
    from meshframe.llm import packing as P

    r = np.random.default_rng(4)
    tails = [np.append(np.minimum(r.zipf(1.3, r.integers(1, 90)) + 1, 900), P.END_ID).astype("<u2") for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=1000)
    got = list(P.fill(tails, df, len(tails), 40.0, 128))
    # no posting of a token that a quarter of the classes have
    index = P.Index(tails, df, len(tails), 40.0)
    assert np.diff(index.edge).max() < len(index.terms) / 4
    monkeypatch.setattr(P, "ROW_CLASSES", 0)
    assert np.diff(P.Index(tails, df, len(tails), 40.0).edge).max() > len(index.terms) / 4
    assert list(P.fill(tails, df, len(tails), 40.0, 128)) == got


def test_pieces_found_at_once_are_those_of_the_usual_split():
    import tiktoken

    from meshframe.llm import packing as P

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {x: 256 + i for i, x in enumerate((b"  ", b"\n\n", b" \n", b"a ", b" a", b"'s", b"s ", b"1 ", b"  a"))}
    old, new = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("old", P.PIECES), ("new", P.PIECES_AT_ONCE)))
    r = np.random.default_rng(6)
    for _ in range(2000):
        text = "".join(r.choice([*" \n\t 　ab1'sld.Ж١"], r.integers(0, 14)))
        assert old.encode_ordinary(text) == new.encode_ordinary(text), repr(text)


def test_pieces_found_by_classes_give_the_ids_of_the_library(monkeypatch):
    r = np.random.default_rng(6)
    alphabet = [*" \n\t 　ab1'sld.Ж١rve🙂́\x1c", "'s", "'ll", "'re"]
    values = ["".join(r.choice(alphabet, r.integers(0, 300 if i % 9 == 0 else 14))) for i in range(3000)] + ["x" * 500, " " * 500, "𠀀 a  b", " 'll''s 've'", ""]
    want = own_ids(values)
    assert [x.tolist() for x in packing.encoder(PATH)(values)] == want
    # long texts are cut, and what is known of pieces is given up
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "KNOWN", 50)
    assert [x.tolist() for x in packing.encoder(PATH)(values)] == want


def test_index_shrinks_with_used_classes():
    r = np.random.default_rng(5)
    tails = [np.append(np.minimum(r.zipf(1.3, 40) + 1, 900), packing.END_ID).astype("<u2") for _ in range(400)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=1000)
    index = packing.Index(tails, df, len(tails), 40.0)
    wide = index.rows.shape
    for i in range(300):
        index.take(i)
    assert wide[0] and index.rows.shape[0] == wide[0] and index.rows.shape[1] <= wide[1] // 2 and index.rows.flags.c_contiguous
    index.take(399)
    got = []
    for i in index.neighbours(399, 5):
        index.take(i)
        got.append(i)
    assert len(got) >= 5 and len(set(got)) == len(got) and set(got) <= set(range(300, 399))
