"""Finding windows of units (bytes or words) that occur more than once, over whole tables.

The common first half of suffix-array dedup and substring dedup:
1. `bucketed`: rows go to document buckets of a bounded number of text bytes, a task for each bucket.
2. `anchor_hits`: the windows of a bucket's texts choose anchors (minimizers). A bucket tells each distinct anchor hash
   once, however many of its texts hold it, to the bucket of the hash; those that repeat anywhere are told back. So an
   anchor that a third of all texts hold is as many narrow rows as there are document buckets.
3. `with_hits`: a cogroup by document bucket puts the hashes told back beside the texts, whose anchors are found again.
The anchors only filter: a window that repeats always has a repeated anchor, and both dedups compare real contents.

A row's place in the order is (doc_id, tie); tie numbers the rows of one doc_id by their text, so repeated ids keep
apart. Rows without doc_id sort last, among themselves by a checksum of their text, by which they are also dealt to
buckets: they need no common task. Rows of one id that is not null meet in its bucket. Long texts are worked on in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import textops as T
from meshframe.llm.common import NULL_ID, pack, release, unpack

BLOB = "bucket int, blob binary"
#: Low bits of a tie number rows of one id and one text; above them stands the checksum of a text without id.
TIE_BITS = 31


class Piece:
    """Texts of some rows (or a part of one long text): their units, and the anchors of their windows."""

    def __init__(self, units: Units, buf: np.ndarray, off: np.ndarray, first_row: int, before: int):
        """before: units of the row in earlier pieces."""
        self.units, self.buf, self.first_row, self.before = units, buf, first_row, before
        if units.by_word:
            self.start, self.end, row = T.words(buf, off, T.SPACED)
            values = T.word_hashes(buf, self.start, self.end)
        else:
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            values = T.byte_values()[buf]
        self.base = np.searchsorted(row, np.arange(len(off)))  # first unit of each row
        self.pre = T.prefix(values)
        grams = T.grams_hash(self.pre, units.gram)
        # anchor, and first and last window that it stands for, in units of this piece
        self.at, self.first, self.last = T.anchors(grams, row, units.window, units.gram)
        self.row = row[self.at] if len(self.at) else self.at
        self.hash = grams[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def pick(self, some: np.ndarray) -> None:
        """Keeps some of the anchors."""
        self.at, self.first, self.last, self.row, self.hash = (x[some] for x in (self.at, self.first, self.last, self.row, self.hash))

    def place(self, unit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Place in its row of each unit of this piece."""
        return unit - self.base[row] + self.before


class Units:
    """What windows are made of: bytes, or words between white space."""

    def __init__(self, window: int, gram: int, by_word: bool):
        self.window, self.gram, self.by_word = window, gram, by_word

    def pieces(self, buf: np.ndarray, off: np.ndarray, limit: int | None = None) -> Iterator[Piece]:
        """Pieces of about `limit` bytes; each window of each row lies in exactly one of them."""
        limit = limit or T.SLICE
        for i, j in T.slices(off, limit):
            part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            if j > i + 1 or len(part) <= 2 * limit:
                yield Piece(self, part, o, i, 0)
                continue
            at, before = 0, 0
            while at < len(part):
                cut = min(at + limit, len(part))
                more = min(cut + self.window - 1, len(part))
                count = cut - at
                if self.by_word:
                    cut = next_gap(part, cut)
                    # the words that windows beginning before the cut reach into
                    more, reach = cut, 4096
                    while more < len(part):
                        more = next_gap(part, min(cut + reach, len(part)))
                        start, end, _ = T.words(part[cut:more], np.array([0, more - cut]), T.SPACED)
                        if len(start) >= self.window - 1:
                            more = cut + int(end[self.window - 2])
                            break
                        reach *= 4
                piece = Piece(self, part[at:more], np.array([0, more - at]), i, before)
                if self.by_word:
                    count = int(np.searchsorted(piece.start, cut - at))
                yield piece
                at, before = cut, before + count

    def spans_hash(self, piece: Piece) -> np.ndarray:
        """Hash of all that each anchor's windows cover, and of the anchor's place in it."""
        return T.mix(T.spans_hash(piece.pre, piece.first, piece.last + self.window) + (piece.at - piece.first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def next_gap(buf: np.ndarray, at: int) -> int:
    """The first place from `at` on that no word covers together with the place before it."""
    while at < len(buf):
        gap = np.flatnonzero(~T.SPACED[buf[at : at + 65536]])
        if len(gap):
            return at + int(gap[0])
        at += 65536
    return len(buf)


def doc_ids(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One packed blob for each bucket that has rows, rows in their order; an array of rows of numbers is flattened."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(bucket[part[0]]), pack(*(a[part].reshape(-1) for a in arrays))


def blobs(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["bucket", "blob"])


def dealt(df: DataFrame, buckets: int, column: str = "bucket"):
    """Groups by bucket, with as many tasks as buckets."""
    return df.repartition(buckets, column).groupBy(column)


def home(d: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    """Document bucket of a row's place in the order."""
    return (d % buckets + (tie >> TIE_BITS) % buckets) % buckets


def bucketed(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """Documents with their bucket, the same as home() gives."""
    key = f"coalesce(cast(`{doc_id}` as bigint), {NULL_ID}L)"
    own = f"if({key} = {NULL_ID}L, pmod(crc32(cast(coalesce(`{text}`, '') as binary)), {buckets}L), 0L)"
    return docs.withColumn("__mf_bucket", F.expr(f"cast(pmod(pmod({key}, {buckets}L) + {own}, {buckets}L) as int)"))


def _ordered(docs: pa.Table, doc_id: str, text: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's documents in order, with their ids and ties, and bytes and offsets of their texts."""
    ids = doc_ids(docs.column(doc_id))
    buf, off = T.buffer(docs.column(text))
    raw = lambda i: buf[off[i] : off[i + 1]].tobytes()
    sums = np.zeros(len(ids), np.int64)
    for i in np.flatnonzero(ids == NULL_ID).tolist():
        sums[i] = zlib.crc32(raw(i))
    order = np.lexsort((sums, ids))
    tie = sums[order] << TIE_BITS
    same = np.flatnonzero((ids[order][1:] == ids[order][:-1]) & (sums[order][1:] == sums[order][:-1]))
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
        a, b = int(run[0]), int(run[-1]) + 2
        order[a:b] = sorted(order[a:b].tolist(), key=raw)
        tie[a:b] += np.arange(b - a)
    docs = docs.take(pa.array(order, pa.int64()))
    return docs, ids[order], tie, *T.buffer(docs.column(text))


def anchor_hits(docs: DataFrame, doc_id: str, text: str, units: Units, buckets: int, across: bool) -> DataFrame:
    """Blobs (bucket of the hash, low half of the hash, route) by document bucket: anchor hashes that repeat.

    docs: as bucketed() gives them. across: only anchors in two documents or more count. route: a bucket shared by all
    holders of an anchor, by the first document that has it.
    """

    def send(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        ids = doc_ids(got.column(doc_id))
        buf, off = T.buffer(got.column(text))
        held = []
        for piece in units.pieces(buf, off):
            held.append(told(piece.hash, ids[piece.first_row + piece.row], np.zeros(len(piece.hash), bool), across))
        h, d, many = told(*(np.concatenate(x) for x in zip(*held, strict=True)), across) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
        own = np.full(len(h), key[0].as_py(), np.uint32)
        out = pa.Table.from_batches([blobs(by_bucket(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), d, many.astype(np.uint8), own))])
        release()
        return out

    def meet(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        h, d, many, source = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in got.column("blob")), strict=True))
        order = np.lexsort((d, h))
        h, d, many, source = h[order], d[order], many[order], source[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(h)])) - 1
        repeated = np.maximum.reduceat(many, first).astype(bool) | (d[first] != d[last] if across else last > first)
        route = (T.mix(d[first].astype(np.uint64)) % np.uint64(buckets)).astype(np.uint32)
        keep = repeated[group]
        name = np.full(int(keep.sum()), key[0].as_py(), np.uint32)
        out = pa.Table.from_batches([blobs(by_bucket(source[keep], name, h[keep], route[group][keep]))])
        release()
        return out

    sent = dealt(docs, buckets, "__mf_bucket").applyInArrow(send, BLOB)
    return dealt(sent, buckets).applyInArrow(meet, BLOB)


def told(h: np.ndarray, d: np.ndarray, many: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, with its smallest document and whether it is known to repeat."""
    if not len(h):
        return h, d, many
    order = np.lexsort((d, h))
    h, d, many = h[order], d[order], many[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.concatenate((first[1:], [len(h)])) - 1
    return h[first], d[first], np.logical_or.reduceat(many, first) | (d[first] != d[last] if across else last > first)


def with_hits(docs: DataFrame, hits: DataFrame, doc_id: str, text: str, units: Units, buckets: int, make: Callable) -> DataFrame:
    """make(pieces) for the texts of a document bucket with their repeated anchors.

    make is called as a generator over (piece, ids, ties, routes), ids and ties by row of the piece, in document order,
    and yields (bucket, blob).
    """

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([blobs([])])
        _, ids, tie, buf, off = _ordered(left, doc_id, text)
        name, low, route = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in right.column("blob")), strict=True))
        known = name.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(known)
        known, route = known[order], route[order]
        del name, low, order

        def found():
            for piece in units.pieces(buf, off):
                key = (piece.hash >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (piece.hash & np.uint64(0xFFFFFFFF))
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                some = np.flatnonzero(known[at] == key)
                if len(some):
                    piece.pick(some)
                    rows = slice(piece.first_row, piece.first_row + len(piece.base) - 1)
                    yield piece, ids[rows], tie[rows], route[at[some]]

        out = pa.Table.from_batches([blobs(make(found()))])
        release()
        return out

    return dealt(docs, buckets, "__mf_bucket").cogroup(dealt(hits, buckets)).applyInArrow(run, BLOB)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges [lo, hi) of sorted ranges; ranges that touch are one."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return lo[new], reach[np.concatenate((new[1:], [len(lo)])) - 1]


def word_lists(raw: np.ndarray) -> Iterator[list[bytes]]:
    """Words of a text, in lists of bounded size."""
    at = 0
    while at < len(raw):
        to = len(raw) if len(raw) - at <= 8 * T.SLICE else next_gap(raw, at + 4 * T.SLICE)
        yield raw[at:to].tobytes().split()  # splits at 0x20 and 0x09 to 0x0D
        at = to


def remove(docs: DataFrame, flags: DataFrame, doc_id: str, text: str, units: Units, buckets: int, extra: str, as_text: bool = False) -> DataFrame:
    """Documents without the units that flagged windows cover.

    flags: blobs (document, tie, first start, last start) of windows by document bucket. extra: the names of the added
    columns n_units, n_removed, n_spans and kept (bytes), separated by commas. Columns of the same names are replaced. as_text: kept as a string; characters cut in two go.
    """
    names = extra.split(",")
    keep = [c for c in docs.columns if c not in names and c != "__mf_bucket"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {k}" for n, k in zip(names, ("bigint", "bigint", "bigint", "string" if as_text else "binary"), strict=True))])

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        table, ids, tie, buf, off = _ordered(left, doc_id, text)
        d = t = lo = hi = np.zeros(0, np.int64)
        if right.num_rows:
            d, t, lo, hi = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in right.column("blob")), strict=True))
            order = np.lexsort((lo, t, d))
            d, t, lo, hi = d[order], t[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
        # rows and flags are both in the order of (id, tie): the flags of a row are one run
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(d) else np.zeros(0, bool)
        edge = np.append(np.flatnonzero(new), len(d)).tolist()
        where = {(a, b): k for k, (a, b) in enumerate(zip(d[new].tolist(), t[new].tolist(), strict=True))}
        total, gone, spans, kept = [], [], [], []
        for k, place in enumerate(zip(ids.tolist(), tie.tolist(), strict=True)):
            raw = buf[off[k] : off[k + 1]]
            g = where.get(place)
            x = slice(edge[g], edge[g + 1]) if g is not None else slice(0, 0)
            a, b = merged(lo[x], hi[x] + units.window)
            gone.append(int((b - a).sum()))
            spans.append(len(a))
            left_ = list(zip([0, *b.tolist()], [*a.tolist(), 1 << 62], strict=True))  # ranges that stay
            if units.by_word:
                n, parts = 0, []
                for some in word_lists(raw):
                    to = n + len(some)
                    parts += [w for s, e in left_ if s < to and e > n for w in some[max(s - n, 0) : e - n]] if g is not None else some
                    if len(parts) > 1 << 17:
                        parts = [b" ".join(parts)]
                    n = to
                total.append(n)
                kept.append(b" ".join(parts))
            else:
                total.append(len(raw))
                kept.append(b"".join(raw[s:e].tobytes() for s, e in left_) if g is not None else raw.tobytes())
        out = [table.column(c) for c in keep] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
        release()
        return pa.Table.from_arrays(out, names=[*keep, *names])

    return dealt(docs, buckets, "__mf_bucket").cogroup(dealt(flags, buckets)).applyInArrow(run, schema)
