"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document is the set of hashes of its distinct word shingles. Two sets link when den * |A & B| >= num * |A | B|. Then
their symmetric difference is at most (|A| + |B|)(den - num)/(den + num), so:
* sizes fall into bands; in the family of a band (of the larger set's size) at most k elements differ;
* the element domain is dealt into n1 parts by hash, so in more than n1 - 1 - k/2 parts at most one element differs;
* each part is dealt into three, and each pair of the three is a signature: one such pair is equal in both sets.
So every link shares a signature. A few more parts than needed (slack) let signatures of nothing be left out: a set
with few empty ones needs none of them, and only sets with many emit them.

Signatures go as packed arrays to buckets. A passage that many documents share makes unlike sets share small
signatures, so the holders of one are compared by sketches first: counts of a set's elements in PARTS parts of the
domain, whose differences add up to no more than the sets' symmetric difference. Pairs too far apart by that bound
cannot link; components of the others, as stars, are clusters. A cluster's texts meet in blocks of bounded size, each
block with the cluster's hub, and intersections are counted exactly there. In clusters of several blocks, those that are
not in the largest group after that are compared with all others, block by block, so copies that lie near their hub cost
in proportion to their number. The links' components are the result. Sets that equal one already seen in the same task
send no signatures.

Defined cases: null, empty or white texts have no shingle and no link; with fewer words than a shingle the whole text is
one; rows of one doc_id are one document, linked when any of its rows is; rows without doc_id are documents by their
text, after all others, and a component of such rows alone has a null component_id; an empty table gives no rows;
columns named like results are replaced. Ids are less than 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.llm import repeats
from meshframe.llm import textops as T
from meshframe.llm.common import bucket_count, cut, pack, release, unpack
from meshframe.llm.graph import components, least_of

RATIO = 1.5
BLOCK = 256
#: Parts of the domain whose counts are a set's sketch.
PARTS = 256
_FLUSH = 1 << 21
#: Elements of a block that are sorted at once.
_SORTED = 1 << 20
_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)


#: Rows without doc_id are nodes from here on.
NAMELESS = 1 << 62


def node_of(doc_id: str, text: str) -> Column:
    """The number of a row's document: its id, or a hash of its text where it has none."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))


def shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, by row and hash."""
    start, end, row = T.words(buf, off, T.SPACED)
    h = T.word_hashes(T.LOWER[buf], start, end)
    if not len(h):
        return row, h
    pre = T.prefix(h)
    grams = T.grams_hash(pre, n)
    whole = row[: len(grams)] == row[n - 1 : n - 1 + len(grams)]
    words = np.bincount(row, minlength=len(off) - 1)
    few = np.flatnonzero((words > 0) & (words < n))
    first = np.searchsorted(row, few)
    rows = np.concatenate((row[: len(grams)][whole], few))
    hashes = np.concatenate((grams[whole], T.spans_hash(pre, first, first + words[few])))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])))
    return rows[new], hashes[new]


def sliced_shingles(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, with the working memory of one slice."""
    parts = []
    for i, j in T.slices(off):
        row, h = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
        parts.append(((row + i).astype(np.int32), h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Families:
    """Bands of sizes and the parts of their families."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 31:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        self.edges = np.array(edges, np.int64)
        self.k = 2 * (self.edges[1:] - 1) * (den - num) // (den + num)
        base = self.k // 2 + 1
        self.slack = np.where(base < 8, 0, np.maximum(1, base * 3 // 100))
        self.parts = base + self.slack

    def of(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sets (by number) and the family, for each family that a set of its size takes part in."""
        own = np.searchsorted(self.edges, size, "right") - 1
        top = np.searchsorted(self.edges, size * self.den // self.num, "right") - 1
        for step in range(int((top - own).max(initial=0)) + 1):
            which = np.flatnonzero((own + step <= top) & (size > 0))
            yield which, (own + step)[which]


def signatures(row: np.ndarray, h: np.ndarray, families: Families, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and row, for the sets of n rows; row ascends."""
    size = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(size)))
    # equality: a signature of the whole set
    whole = np.zeros(n, np.uint64)
    mixed = T.mix(h * _ONE)
    np.add.at(whole, row, mixed)
    some = np.flatnonzero(size)
    out, rows = [T.mix(whole[some] ^ _TWO)], [some]
    for which, family in families.of(size):
        busy = families.k[family] > 0
        which, family = which[busy], family[busy]
        if not len(which):
            continue
        parts = families.parts[family]
        count = size[which]
        at = np.repeat(first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x = T.mix(h[at] + _TWO)
        part = ((x >> np.uint64(32)) * np.repeat(parts, count).astype(np.uint64)) >> np.uint64(32)
        third = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
        base = np.cumsum(parts) - parts
        cell = (np.repeat(base, count).astype(np.uint64) + part) * np.uint64(3) + third
        cell = cell.astype(np.int64)
        total = np.zeros(int(parts.sum()) * 3, np.uint64)
        np.add.at(total, cell, mixed[at])
        held = np.bincount(cell, minlength=len(total)).reshape(-1, 3)
        total = total.reshape(-1, 3)
        owner = np.repeat(np.arange(len(which)), parts)
        number = np.arange(len(owner)) - np.repeat(base, parts)
        label = T.mix((number.astype(np.uint64) << np.uint64(8)) + np.repeat(family, parts).astype(np.uint64) + _ONE)
        pairs = ((0, 1), (0, 2), (1, 2))
        empty = np.stack([held[:, a] + held[:, b] == 0 for a, b in pairs], 1)
        bad = np.bincount(owner[empty.any(1)], minlength=len(which))
        all_of = (bad > families.slack[family])[owner]
        for i, (a, b) in enumerate(pairs):
            sig = T.mix(T.mix(total[:, a] + label) * np.uint64(3) + T.mix(total[:, b] ^ label) + np.uint64(i))
            take = ~empty[:, i] | all_of
            out.append(sig[take])
            rows.append(which[owner[take]])
    return np.concatenate(out), np.concatenate(rows)


def same_sets(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums over each set."""
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], row, T.mix(h + _ONE))
    np.add.at(out[:, 1], row, T.mix(h ^ _TWO))
    return out


def sketches(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Elements of each of n sets by part of the domain, 255 at most: that only lowers differences."""
    part = (T.mix(h ^ _ONE) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(row * PARTS + part, minlength=n * PARTS).reshape(n, PARTS), 255).astype(np.uint8)


def near(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with these sketches and sizes may link."""
    apart = np.abs(a.astype(np.int16) - b).sum(-1, dtype=np.int64)
    return apart * (den + num) <= (na + nb) * (den - num)


def ties(group: np.ndarray, at: np.ndarray, doc: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the sets of each group whose sketches are near one another.

    group, at: the sets (rows of doc, size, sketch) of each group; group ascends.
    """
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), [len(group)]))
    count = np.diff(edge)
    us, vs = [], []
    two = edge[:-1][count == 2]
    for i in range(0, len(two), 4096):
        a, b = at[two[i : i + 4096]], at[two[i : i + 4096] + 1]
        ok = near(sketch[a], size[a], sketch[b], size[b], num, den)
        us.append(doc[b][ok])
        vs.append(doc[a][ok])
    for a, m in zip(edge[:-1][count > 2].tolist(), count[count > 2].tolist(), strict=True):
        x = at[a : a + m]
        x = x[np.argsort(size[x], kind="stable")]
        sizes = size[x]
        open_ = np.ones(m, bool)
        # fronts of near sets: each set is compared once with all that are still open and of a size that may link
        for i in range(m):
            if not open_[i]:
                continue
            open_[i], front = False, [i]
            while front:
                k = front.pop()
                lo, hi = np.searchsorted(sizes, -(-sizes[k] * num // den)), np.searchsorted(sizes, sizes[k] * den // num, "right")
                rest = lo + np.flatnonzero(open_[lo:hi])
                for j in range(0, len(rest), 4096):
                    part = rest[j : j + 4096]
                    hit = part[near(sketch[x[part]], sizes[part], sketch[x[k]], sizes[k], num, den)]
                    open_[hit] = False
                    front += hit.tolist()
                    us.append(doc[x[hit]])
                    vs.append(np.full(len(hit), doc[x[i]]))
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    return u[u != v], v[u != v]


def links(row: np.ndarray, h: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Matrix of links between a few sets, with exact intersections."""
    m = len(size)
    both = np.zeros((m, m))
    width = max(1, (1 << 22) // m)
    # parts of the domain in turn: what is sorted at once does not grow with the texts
    turns = -(-len(h) // _SORTED)
    for turn in range(turns):
        mine = h % np.uint64(turns) == turn
        order = np.argsort(h[mine], kind="stable")
        x, holder = h[mine][order], row[mine][order]
        column = np.cumsum(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]) - 1
        shared = np.bincount(column, minlength=1) > 1
        keep = shared[column]
        holder, column = holder[keep], (np.cumsum(shared) - 1)[column[keep]]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            y = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + width))
            part = np.zeros((m, min(width, int(column[-1]) + 1 - lo)), np.float32)
            part[holder[y], column[y] - lo] = 1
            both += part @ part.T
    return den * both >= num * (size[:, None] + size[None, :] - both)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    m = len(linked)
    out = np.full(m, -1)
    for i in range(m):
        if out[i] >= 0:
            continue
        out[i], front = i, [i]
        while front:
            reach = np.flatnonzero(linked[front].any(0) & (out < 0))
            out[reach] = i
            front = reach.tolist()
    return out


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: components of links at a similarity of num/den on n-word shingles."""
    given = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    out = node_components(docs.select(node_of(doc_id, text).alias("node"), F.col(text).alias("text")), n, num, den)
    return out.select(given("node").alias("doc_id"), "n_shingles", given("root").alias("component_id"))


def node_components(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, n_shingles and root (the smallest node reached) for each row of rows (node, text)."""
    families = Families(num, den)
    buckets = bucket_count(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs by bucket: 0 signatures with their documents, 1 documents with sizes and sketches, 2 known links."""
        held: list[tuple] = []
        seen: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            sig, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            low = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return repeats.blobs((b, b"\0" + x) for b, x in repeats.by_bucket(((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), low, d))

        for batch in batches:
            ids = repeats.doc_ids(batch.column(0))
            buf, off = T.buffer(batch.column(1))
            for i, j in T.slices(off):
                row, h = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                part, size = ids[i:j], np.bincount(row, minlength=j - i)
                yield repeats.blobs((b, b"\1" + x) for b, x in repeats.by_bucket(part % buckets, part, size, sketches(row, h, j - i)))
                fresh, twins = np.zeros(j - i, bool), []
                for k, key in enumerate(map(tuple, same_sets(row, h, j - i).tolist())):
                    if size[k]:
                        first = seen.setdefault(key, int(part[k]))
                        fresh[k] = first == part[k]
                        if not fresh[k]:
                            twins.append((int(part[k]), first))
                if twins:
                    u, v = np.array(twins, np.int64).T
                    yield repeats.blobs((b, b"\2" + x) for b, x in repeats.by_bucket(u % buckets, u, v))
                if len(seen) > _FLUSH:
                    seen.clear()
                keep = fresh[row]
                sig, r = signatures(row[keep], h[keep], families, j - i)
                order = np.argsort(r, kind="stable")
                held.append((sig[order], part[r[order]]))
                if sum(len(x[0]) for x in held) >= _FLUSH:
                    yield flush()
                    release()
        if held:
            yield flush()
        release()

    def meet(got: pa.Table) -> pa.Table:
        """Groups that share a signature (3: group, document), to the documents' buckets; other blobs pass."""
        own = got.column("bucket")[0].as_py()
        out, sigs, ids = [], [], []
        for raw in (x.as_py() for x in got.column("blob")):
            if raw[0]:
                out.append((own, raw))
            else:
                s, d = unpack(raw[1:])
                sigs.append(s)
                ids.append(d)
        if sigs:
            s, d = np.concatenate(sigs), np.concatenate(ids)
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            once = np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))
            s, d = s[once], d[once]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            count = np.bincount(group)
            # signatures with the same holders are one group
            holders = np.zeros(len(first), np.uint64)
            np.add.at(holders, group, T.mix(d.astype(np.uint64) + _ONE))
            _, kept = np.unique(holders, return_index=True)
            keep = np.zeros(len(first), bool)
            keep[kept] = count[kept] > 1
            keep = keep[group]
            g, d = (group[keep] + (np.int64(own) << 32)), d[keep]
            if len(g):
                out += [(b, b"\3" + x) for b, x in repeats.by_bucket(d % buckets, g, d)]
        return pa.Table.from_batches([repeats.blobs(out)])

    def attach(got: pa.Table) -> pa.Table:
        """Groups with their documents' sizes and sketches (4), to the groups' buckets; other blobs pass."""
        own = got.column("bucket")[0].as_py()
        out, facts_, groups = [], [], []
        for raw in (x.as_py() for x in got.column("blob")):
            if raw[0] == 3:
                groups.append(np.stack(unpack(raw[1:]), 1))
            else:
                out.append((own, raw))
                if raw[0] == 1:
                    d, size, sketch = unpack(raw[1:])
                    facts_.append((d, size, sketch.reshape(-1, PARTS)))
        if groups and facts_:
            g, d = np.concatenate(groups).T
            cols = [np.concatenate(x) for x in zip(*facts_, strict=True)]
            order = np.argsort(cols[0], kind="stable")
            cols = [c[order] for c in cols]
            # a document that has several rows stands in its groups with each of them
            lo, hi = np.searchsorted(cols[0], d, "left"), np.searchsorted(cols[0], d, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            g = np.repeat(g, n)
            order = np.argsort(g >> 32, kind="stable")
            g, at = g[order], at[order]
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g >> 32)) + 1) if len(g) else []:
                # a document's sketch goes to a bucket once, whatever number of groups it has there
                some, number = np.unique(at[part], return_inverse=True)
                out.append((int(g[part[0]] >> 32), b"\4" + pack((g[part] & 0xFFFFFFFF).astype(np.uint32), number.astype(np.uint32), cols[0][some], cols[1][some], cols[2][some].reshape(-1))))
        release()
        return pa.Table.from_batches([repeats.blobs(out)])

    def judge(got: pa.Table) -> pa.Table:
        """A star for each component of near holders in a bucket (5: document, hub), to the documents' buckets."""
        own = got.column("bucket")[0].as_py()
        out, members, raws = [], [], []
        for raw in (x.as_py() for x in got.column("blob")):
            if raw[0] == 4:
                raws.append(raw)
                members.append(tuple(x.copy() for x in unpack(raw[1:])[:4]))
            else:
                out.append((own, raw))
        if members:
            base = np.cumsum([0] + [len(m[2]) for m in members])
            at = np.concatenate([m[1].astype(np.int64) + b for m, b in zip(members, base[:-1], strict=True)])
            g, d, size = (np.concatenate([m[k] for m in members]) for k in (0, 2, 3))
            # the sketches of the bucket are held once, and beside them those of one blob
            sketch = np.empty((base[-1], PARTS), np.uint8)
            for raw, lo, hi in zip(raws, base[:-1], base[1:], strict=True):
                sketch[lo:hi] = unpack(raw[1:])[4].reshape(-1, PARTS)
            del members, raws
            order = np.lexsort((d[at], g))
            u, v = least_of(*ties(g[order], at[order], d, size.astype(np.int64), sketch, num, den))
            out += [(b, b"\5" + x) for b, x in repeats.by_bucket(u % buckets, u, v)]
        release()
        return pa.Table.from_batches([repeats.blobs(out)])

    def settle(got: pa.Table) -> pa.Table:
        """Rows of what is known: 1 sizes, 2 equal sets, 5 stars, each once though many buckets have found it."""
        rows = {1: [], 2: [], 5: []}
        for raw in (x.as_py() for x in got.column("blob")):
            rows[raw[0]].append(np.stack([x.astype(np.int64) for x in unpack(raw[1:])[:2]], 1))
        kinds, flat = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for kind, parts in rows.items():
            if parts:
                x = np.concatenate(parts)
                x = np.unique(x, axis=0) if kind == 5 else x
                kinds.append(np.full(len(x), kind))
                flat.append(x)
        kind, x = np.concatenate(kinds), np.concatenate(flat)
        return pa.Table.from_arrays([pa.array(kind, pa.int64()), pa.array(x[:, 0], pa.int64()), pa.array(x[:, 1], pa.int64())], names=["kind", "u", "v"])

    blobs = rows.mapInArrow(send, repeats.BLOB)
    for step in (meet, attach, judge):
        blobs = repeats.dealt(blobs, buckets).applyInArrow(step, repeats.BLOB)
    facts = cut(repeats.dealt(blobs, buckets).applyInArrow(settle, "kind long, u long, v long"))
    clusters = components(facts.where("kind = 5").select("u", "v"))
    blocks = cut(clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("n")))
    members = clusters.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    hubs = blocks.where("n > 1").select(F.col("root").alias("node"), "root", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("own"))
    small = F.col("n") == 1
    met = members.where("n = 1 OR node <> root").unionByName(hubs).select(
        "node", "root", ((F.col("node") != F.col("root")) | small | (F.col("own") == 0)).alias("once"),
        # small clusters share tasks
        F.when(small, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root")).alias("place"), F.when(small, F.lit(-1)).otherwise(F.col("own")).alias("lo"), F.lit(0).cast("bigint").alias("hi"),
    )

    def compare(got: pa.Table) -> pa.Table:
        root = got.column("root").to_numpy()
        ids = got.column("node").to_numpy()
        order = np.lexsort((ids, root))
        root, ids, texts = root[order], ids[order], got.column("text")
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1]))), [len(root)]))
        us, vs = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            # only one cluster's texts are copied at a time
            row, h = sliced_shingles(*T.buffer(texts.take(pa.array(order[a:b]))), n)
            size = np.bincount(row, minlength=b - a)
            top = roots(links(row, h, size, num, den) & (size > 0)[:, None] & (size > 0)[None, :])
            us.append(ids[a:b])
            vs.append(ids[a:b][top])
        u, v = np.concatenate(us), np.concatenate(vs)
        release()
        return pa.Table.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    compared = lambda placed: placed.select("place", "lo", "hi", "root", "node", "text").groupBy("place", "lo", "hi").applyInArrow(compare, "u long, v long")
    # all texts are exchanged once, to find those of clusters
    placed = cut(rows.join(met, "node"))
    texts = placed.where("once").select("node", "text")
    found = cut(compared(placed))
    if not blocks.where("n > 1").isEmpty():
        # what is not in the largest group of its cluster yet meets all other members
        large = members.where("n > 1").select("node", "root", "n", "own")
        groups = components(found.join(large.select(F.col("node").alias("u")), "u", "left_semi")).withColumnRenamed("root", "label")
        named = cut(large.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")))
        size = named.groupBy("root", "label").agg(F.count("*").alias("k"))
        most = size.groupBy("root").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("of")).select("root", F.col("m.label").alias("main"), (F.col("of") - F.col("m.k")).alias("odd")).where("odd > 0")
        split = named.join(most, "root").withColumn("parts", F.ceil(F.col("odd") / BLOCK))
        # an odd member goes to its own part against each block of members, every member to its block against each part
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        odd = split.where("label <> main").select("node", "root", F.pmod(F.xxhash64("node", "root"), F.col("parts")).alias("lo"), each("n").alias("hi"))
        rest = split.select("node", "root", each("parts").alias("lo"), F.col("own").alias("hi"))
        again = odd.unionByName(rest).distinct().withColumn("place", F.col("root"))
        found = found.unionByName(compared(texts.join(again, "node")))
    final = components(found.unionByName(facts.where("kind = 2").select("u", "v")))
    sizes = facts.where("kind = 1").select(F.col("u").alias("node"), F.col("v").alias("n_shingles"))
    return sizes.join(final, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("root"))


#: Links of all pairs that share a shingle, then components: for small tables.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN n AS x ON u = x.doc_id JOIN n AS y ON v = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.other = l.u)
SELECT w.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) AS c ON w.doc_id = c.doc_id
"""
