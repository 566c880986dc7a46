import random
import re

import numpy as np
import pytest

from meshframe.llm import jaccard_join as J
from meshframe.llm.graph import components


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def brute(rows, n, num, den):
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    order = lambda d: (d is None, d or 0)
    top = {d: d for d, _ in rows}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = find(a), find(b)
                top[max(u, v, key=order)] = min(u, v, key=order)
    return sorted(((d, len(s), find(d)) for d, s in sets), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Ab"]
    rows = []
    for _ in range(14):
        base = r.choices(vocabulary, k=r.choice([1, 2, 4, 9, 20, 60, 150, 400]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, "A b c d e f"), (len(rows) + 3, "a B c d e f"), (None, "a b c d e f"), (3, "other text of a repeated id"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 4, 5), (3, 3, 90, 100)])
def test_join_equals_brute_force(docs_of, seed, n, num, den):
    rows = corpus(seed)
    got = J.jaccard_join(docs_of(rows).repartition(5), n=n, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, n, num, den)


def test_blocks_of_a_large_cluster(docs_of, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = J.jaccard_join(docs_of(rows), n=3, num=90, den=100).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, 3, 90, 100)


def test_every_link_shares_a_signature():
    r = random.Random(4)
    for num, den in ((9, 10), (4, 5)):
        families = J.Families(num, den)
        for _ in range(300):
            size = r.choice([1, 3, 8, 12, 40, 90, 333])
            a = {r.getrandbits(63) for _ in range(size)}
            b = set(a)
            while True:
                c = set(b)
                if r.random() < 0.5 and len(c) > 1:
                    c.remove(r.choice(sorted(c)))
                else:
                    c.add(r.getrandbits(63))
                if den * len(a & c) < num * len(a | c):
                    break
                b = c
            flat = np.array([*sorted(a), *sorted(b)], np.uint64)
            row = np.repeat([0, 1], [len(a), len(b)])
            sig, who = J.signatures(row, flat, families, 2)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_empty_table_and_components(docs_of, spark):
    assert J.jaccard_join(docs_of([])).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_odd_members_of_a_large_cluster(docs_of, monkeypatch):
    """A chain and groups that do not link with the hub of their cluster, over several blocks."""
    monkeypatch.setattr(J, "BLOCK", 5)
    r = random.Random(10)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each a small step from the one before
        base[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(base)))
    for k in (3, 4, 5, 6):
        for _ in range(12):
            w = rows[0][1].split()
            for j in range(0, 120, 120 // k):
                w[j] = f"y{k}{j}"
            w[r.randrange(120)] = f"z{r.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(None, rows[3][1] + " more"), (None, rows[3][1] + " words"), (None, "alone here"), (None, None)]
    for num, den in ((90, 100), (4, 5)):
        got = J.jaccard_join(docs_of(rows).repartition(3), n=3, num=num, den=den).collect()
        named = [(d if d is not None else 1 << 62 | i, t) for i, (d, t) in enumerate(rows)]
        strip = lambda x: None if x is None or x >= 1 << 62 else x
        want = sorted(((strip(d), n, strip(c)) for d, n, c in brute(named, 3, num, den)), key=repr)
        assert sorted((tuple(x) for x in got), key=repr) == want


def test_extra_columns_of_clashing_names_and_a_long_text(docs_of):
    rows = [(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y"), (3, " ".join(f"w{i}" for i in range(300_000)), 7, "z")]
    got = J.jaccard_join(docs_of(rows, "doc_id long, text string, node long, root string"), n=3, num=90, den=100).collect()
    assert sorted(tuple(x) for x in got) == [(1, 2, 1), (2, 2, 1), (3, 299_998, 3)]


def test_links_in_turns_equal_plain_intersections(monkeypatch):
    import numpy as np

    from meshframe.llm import jaccard_join as J

    r = np.random.default_rng(4)
    sets = [set(r.integers(0, 60, k).tolist()) for k in (0, 1, 20, 40, 40, 60, 200, 200)]
    sets += [set(sets[-1]), set(sets[2])]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.int32)
    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    size = np.bincount(row, minlength=len(sets))
    plain = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    for at_once in (1 << 20, 50, 7):
        monkeypatch.setattr(J, "_SORTED", at_once)
        assert J.links(row, h, size, 4, 5).tolist() == plain
