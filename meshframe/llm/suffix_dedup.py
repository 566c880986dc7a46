"""Suffix-array dedup: a distributed merge sort of suffixes that knows their common prefixes.

Every byte that a 100-byte window covers which also starts earlier (smaller doc_id, or earlier in the document) goes.
Suffixes are sparse: they start at the anchors of windows (see repeats), and only at anchors that repeat anywhere. Each
document bucket drops those whose whole surrounding equals one it has seen (their windows are repeats already, so of a
run of one character or line one surrounding stays), sorts the rest, front-codes the sorted run (length shared with the
one before, rest) and sends one piece to each key range. A range merges its runs with a loser tree that carries the
prefix known to be shared with the last winner and starts comparing behind it. Suffixes that share their anchor come out
side by side; there the windows are compared.

Defined cases: null is an empty text and keeps its null in the input column; texts under 100 bytes lose nothing; of
repeated rows all but one lose everything that is long enough; a null doc_id sorts last, such rows by a checksum of
their text; an empty table gives no rows; columns named like results are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import repeats
from meshframe.llm import textops as T
from meshframe.llm.common import bucket_count, pack, release, unpack

WINDOW = 100
GRAM = 40
#: Bytes by which suffixes are dealt to ranges: all suffixes that share an anchor share them.
_KEY = 32
#: One document in so many lends suffixes to the sample that sets the ranges, and so many suffixes at most; only balance depends on it.
_SAMPLE_EVERY, _SAMPLE_MOST = 32, 200_000


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        to = min(n, at + step)
        if a[at:to] == b[at:to]:
            at, step = to, step * 2
        elif to - at == 1:
            return at
        else:
            step = max(1, (to - at) // 2)
    return n


def encode(run: list[tuple]) -> bytes:
    """A sorted run of (suffix, before, id, tie, start, count), front-coded."""
    shared, rest, last = [], [], b""
    for x in run:
        n = common(last, x[0], 0)
        shared.append(n)
        rest.append(x[0][n:])
        last = x[0]
    before = [x[1] for x in run]
    lens = lambda xs: np.fromiter(map(len, xs), np.uint16, len(xs))
    flat = lambda xs: np.frombuffer(b"".join(xs), np.uint8)
    return pack(np.array(shared, np.uint16), lens(rest), flat(rest), lens(before), flat(before), *(np.array([x[k] for x in run], np.int64) for k in (2, 3, 4, 5)))


def decode(blob: bytes) -> Iterator[tuple]:
    """(length shared with the one before, suffix, before, id, tie, start, count) in order."""
    shared, n_rest, rest, n_before, before, *cols = unpack(blob)
    rest, before, i, j, last = rest.tobytes(), before.tobytes(), 0, 0, b""
    for s, r, b, d, t, at, c in zip(shared.tolist(), n_rest.tolist(), n_before.tolist(), *(x.tolist() for x in cols), strict=True):
        last = last[:s] + rest[i : i + r]
        yield s, last, before[j : j + b], d, t, at, c
        i, j = i + r, j + b


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Sorted items with the length each shares with the one before it, by a loser tree.

    A loser keeps the length it shares with the item that beat it. That winner was put out, so both lengths on the path
    are relative to the same item: the longer one wins without a look at any byte, and only at equal lengths are bytes
    compared, from that length on.
    """
    if not runs:
        return
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    shared = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common(x[1], y[1], shared[a])
        win, lose = (a, b) if (x[1][n : n + 1], a) < (y[1][n : n + 1], b) else (b, a)
        shared[lose] = n
        return win, lose

    tree = [0] * k  # losers at 1 .. k - 1, the winner at 0
    top = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        top[i], tree[i] = play(top[2 * i], top[2 * i + 1])
    tree[0] = top[1] if k > 1 else 0
    while (item := heads[tree[0]]) is not None:
        w = tree[0]
        yield (shared[w], *item[1:])
        heads[w] = nxt = next(runs[w], None)
        shared[w] = nxt[0] if nxt else 0
        i = (w + k) // 2
        while i:
            w, tree[i] = play(w, tree[i])
            i //= 2
        tree[0] = w


def splitters(docs: DataFrame, doc_id: str, text: str, units: repeats.Units, buckets: int) -> list[bytes]:
    """Bounds of the key ranges, from a bounded sample of suffixes."""

    def some(batches):
        for batch in batches:
            buf, off = T.buffer(batch.column(0))
            for piece in units.pieces(buf, off):
                raw = piece.buf.tobytes()
                # what repeats within a text has one place in the order
                keys = {raw[x : x + _KEY]: None for x in piece.at[::8].tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary())], names=["k"])

    picked = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(_SAMPLE_EVERY)) == 0).select(text)
    keys = sorted(r[0] for r in picked.mapInArrow(some, "k binary").limit(_SAMPLE_MOST).toLocalIterator())
    return sorted({bytes(keys[len(keys) * i // buckets]) for i in range(1, buckets)}) if keys else []


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """Documents with n_bytes, n_removed, n_spans and kept (the remaining bytes; as_text: a string without characters cut in two)."""
    units = repeats.Units(window, gram, False)
    buckets = bucket_count(docs, text)
    bounds = splitters(docs, doc_id, text, units, buckets)
    docs = repeats.bucketed(docs, doc_id, text, buckets)
    hits = repeats.anchor_hits(docs, doc_id, text, units, buckets, False)

    def make(found):
        runs: dict[int, list] = {}
        seen: set[int] = set()
        for piece, ids, ties, _ in found:
            raw = piece.buf.tobytes()
            key, one, group = np.unique(units.spans_hash(piece), return_index=True, return_inverse=True)
            fresh = np.zeros(len(piece.at), bool)
            fresh[[i for k, i in zip(key.tolist(), one.tolist(), strict=True) if k not in seen]] = True
            seen.update(key.tolist())
            first = piece.place(piece.first, piece.row)
            for i in np.flatnonzero(fresh).tolist():
                at, a, b, r = int(piece.at[i]), int(piece.first[i]), int(piece.last[i]), int(piece.row[i])
                suffix = raw[at : b + window]
                runs.setdefault(bisect.bisect_right(bounds, suffix[:_KEY]), []).append((suffix, raw[a:at], int(ids[r]), int(ties[r]), int(first[i]), b - a + 1))
            # surroundings met before in this bucket: their windows are flagged, as ranges of neighbours
            x = np.flatnonzero(~fresh)
            x = x[np.lexsort((first[x], piece.row[x]))]
            r, lo, hi = piece.row[x], first[x], first[x] + (piece.last - piece.first)[x]
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (lo[1:] != hi[:-1] + 1)))) if len(x) else x
            end = np.append(new[1:], len(x)) - 1
            if len(new):
                yield from ((int(k), b"\1" + blob) for k, blob in repeats.by_bucket(repeats.home(ids[r[new]], ties[r[new]], buckets), ids[r[new]], ties[r[new]], lo[new], hi[end]))
        for bucket, run in runs.items():
            run.sort()
            yield bucket, b"\0" + encode(run)

    def meet(got: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in got.column("blob")]
        docs_, ties, lows, highs = [], [], [], []

        def flag(d, t, lo, hi):
            docs_.append(d)
            ties.append(t)
            lows.append(lo)
            highs.append(hi)

        def compare(group: list[tuple]) -> None:
            """Windows of suffixes that share an anchor: all but the earliest of equal ones are flagged."""
            seen: dict[bytes, tuple] = {}
            get = seen.get
            for suffix, before, d, t, start, count in sorted(group, key=lambda x: x[2:]):
                whole = before + suffix
                run = -1
                for o in range(count):
                    at = get(w := whole[o : o + window])
                    if at is None or at == (d, t, start + o):
                        if at is None:
                            seen[w] = (d, t, start + o)
                        if run >= 0:
                            flag(d, t, start + run, start + o - 1)
                            run = -1
                    elif run < 0:
                        run = o
                if run >= 0:
                    flag(d, t, start + run, start + count - 1)

        group: list[tuple] = []
        for item in merge([decode(x[1:]) for x in raw if x[0] == 0]):
            if item[0] < gram and group:
                if len(group) > 1:
                    compare(group)
                group = []
            group.append(item[1:])
        if len(group) > 1:
            compare(group)
        flagged = [np.array(x, np.int64) for x in (docs_, ties, lows, highs)]
        d, t, lo, hi = (np.concatenate(x) for x in zip(flagged, *(unpack(x[1:]) for x in raw if x[0] == 1), strict=True))
        release()
        return pa.Table.from_batches([repeats.blobs(repeats.by_bucket(repeats.home(d, t, buckets), d, t, lo.astype(np.uint32), hi.astype(np.uint32)))])

    sent = repeats.with_hits(docs, hits, doc_id, text, units, buckets, make)
    flags = repeats.dealt(sent, buckets).applyInArrow(meet, repeats.BLOB)
    return repeats.remove(docs, flags, doc_id, text, units, buckets, "n_bytes,n_removed,n_spans,kept", as_text)


#: All windows, as hexadecimal digits, sorted by content: for small tables. Texts are cut into blocks only to read windows fast.
OP3_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT doc_id, b, substr(h, 2000 * b + 1, 2198) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS b FROM t) AS x),
win AS (SELECT doc_id, 1000 * b + i AS i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, b, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM block WHERE len(h) >= 200) AS x),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) AS x WHERE k > 1),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hit) AS x),
span AS (SELECT doc_id, r, min(i) AS s, max(i) + 100 AS e FROM run GROUP BY doc_id, r),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n FROM span GROUP BY doc_id),
edge AS (SELECT doc_id, e AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS z FROM (SELECT doc_id, s, e FROM span UNION ALL SELECT doc_id, -1, 0 FROM t) AS x),
kept AS (SELECT t.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, len(h) // 2) - a)), '' ORDER BY a) AS k FROM t JOIN edge ON t.doc_id = edge.doc_id GROUP BY t.doc_id)
SELECT t.doc_id, cast(len(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
  sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
