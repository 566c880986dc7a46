"""Substring dedup with suffix automata over shards of reference text.

A word goes if a window of 13 words covers it whose word sequence also starts in a document with a smaller doc_id.
An automaton over all text, held against all documents, would cost the square of the corpus. So anchors (see repeats)
first find the stretches of text that can repeat across documents; a stretch goes to the shard of the first document
that holds its anchor, and there every holder meets. Equal stretches of a document bucket are one class, sent once. A
shard reads its classes in document order: the matching statistics of each against the automaton of the earlier ones
flag windows, and what is new extends the automaton. Each state keeps the first document that reached it, so a window's
first document is known without a second pass. Long stretches are cut into overlapping ones, so that what repeats
within a document is sent once; later places of the same document get the statistics of the first.

Defined cases: null is an empty text; under 13 words nothing goes; repeats inside one document stay; rows of one doc_id
don't remove each other's words, nor do rows without doc_id; a null doc_id sorts last; an empty table gives no rows;
columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshframe.llm import repeats
from meshframe.llm import textops as T
from meshframe.llm.common import bucket_count, pack, release, runs_of, unpack

WINDOW = 13
GRAM = 6
#: Windows of a stretch that is sent as one.
STRETCH = 4096


class Automaton:
    """A suffix automaton of several texts that knows, for each state, the first document that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(link)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = k
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k

    def add(self, text: list[int], doc: int) -> None:
        """Adds all substrings of a text; documents must come in order."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            k = len(link)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(doc)
            p = last
            while p >= 0 and (q := nxt[p].get(c)) is None:
                nxt[p][c] = k
                p = link[p]
            if p >= 0:
                link[k] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = k

    def firsts(self, text: list[int], window: int) -> list[int]:
        """For each window of the text the first document that holds it, -1 for none."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, v, n = [], 0, 0
        for c in text:
            while (q := nxt[v].get(c)) is None and v:
                v = link[v]
                n = length[v]
            if q is None:
                n = 0
            else:
                v = q
                n += 1
                if n >= window:
                    while length[link[v]] >= window:
                        v = link[v]
                    n = min(n, length[v])
            out.append(first[v] if n >= window else -1)
        return out[window - 1 :]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents with n_words, n_removed, n_spans and kept (the remaining words with single spaces, as bytes)."""
    units = repeats.Units(window, gram, True)
    buckets = bucket_count(docs, text)
    docs = repeats.bucketed(docs, doc_id, text, buckets)
    hits = repeats.anchor_hits(docs, doc_id, text, units, buckets, True)

    def make(found):
        """Stretches by shard: 0 with their words, 1 places of a class of an earlier document, 2 of one of the same document."""
        seen: dict[tuple, tuple] = {}
        out: dict[int, tuple] = {}
        for piece, ids, ties, route in found:
            order = np.lexsort((piece.first, route, piece.row))
            row, shard, lo, hi = piece.row[order], route[order], piece.first[order], piece.last[order] + window
            part = np.cumsum(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))))
            far = len(piece.start) + window  # sets the stretches of different rows and shards apart
            reach = np.maximum.accumulate(hi + part * far)
            # stretches that share a window are one
            at = np.flatnonzero(np.concatenate(([True], (lo + part * far)[1:] >= reach[:-1] - window + 2)))
            until = (reach - part * far)[np.append(at[1:], len(lo)) - 1]
            raw = piece.buf.tobytes()
            begin, stop = piece.start, piece.end
            for r, k, s, e in zip(row[at].tolist(), shard[at].tolist(), lo[at].tolist(), until.tolist(), strict=True):
                d, tie, shift = int(ids[r]), int(ties[r]), piece.before - int(piece.base[r])
                whole, twins, same = out.setdefault(k, ([], [], []))
                for i in range(s, e - window + 1, STRETCH):
                    j = min(i + STRETCH + window - 1, e)
                    words = raw[begin[i] : stop[j - 1]]
                    d0, t0, s0 = seen.setdefault((k, words), (d, tie, i + shift))
                    if d0 < d:
                        twins.append((d, tie, i + shift, j + shift))
                    elif (t0, s0) == (tie, i + shift):
                        whole.append((d, tie, i + shift, j + shift, words))
                    else:
                        same.append((d, tie, i + shift, t0, s0))
        for shard, (whole, twins, same) in out.items():
            cols = [np.array([x[k] for x in whole], np.int64) for k in range(4)]
            yield shard, b"\0" + pack(*cols, np.array([len(x[4]) for x in whole], np.int64), np.frombuffer(b"".join(x[4] for x in whole), np.uint8))
            if twins:
                yield shard, b"\1" + pack(*(np.array([x[k] for x in twins], np.int64) for k in range(4)))
            if same:
                yield shard, b"\2" + pack(*(np.array([x[k] for x in same], np.int64) for k in range(5)))

    def meet(got: pa.Table) -> pa.Table:
        pieces, flagged, same = [], [], []
        for blob in (x.as_py() for x in got.column("blob")):
            if blob[0] == 1:
                # all windows of the class stand in the automaton with its first document, which is an earlier one
                d, t, s, e = unpack(blob[1:])
                flagged.append(np.stack([d, t, s, e - window], 1))
            elif blob[0] == 2:
                same += zip(*(x.tolist() for x in unpack(blob[1:])), strict=True)
            else:
                d, t, s, e, n, flat = unpack(blob[1:])
                flat, at = flat.tobytes(), 0
                for row in zip(d.tolist(), t.tolist(), s.tolist(), n.tolist(), strict=True):
                    pieces.append((*row[:3], flat[at : at + row[3]]))
                    at += row[3]
        pieces.sort(key=lambda x: x[:3])
        auto, number, rows = Automaton(), {}, []
        asked = {(d, t0, s0) for d, _, _, t0, s0 in same}
        stays: dict[tuple, list] = {}
        for d, t, s, piece in pieces:
            w = [number.setdefault(x, len(number)) for x in piece.split()]
            found = np.array(auto.firsts(w, window), np.int64)
            earlier = list(zip(*(x.tolist() for x in runs_of((found >= 0) & (found < d))), strict=True))
            rows += [(d, t, s + i, s + j - 1) for i, j in earlier]
            if (d, t, s) in asked:
                stays[d, t, s] = earlier
            for i, j in zip(*(x.tolist() for x in runs_of(found < 0)), strict=True):
                auto.add(w[i : j + window - 1], d)
        rows += [(d, t, s + i, s + j - 1) for d, t, s, t0, s0 in same for i, j in stays[d, t0, s0]]
        if rows:
            flagged.append(np.array(rows, np.int64))
        d, t, lo, hi = np.concatenate(flagged).T if flagged else np.zeros((4, 0), np.int64)
        del auto
        release()
        return pa.Table.from_batches([repeats.blobs(repeats.by_bucket(repeats.home(d, t, buckets), d, t, lo.astype(np.uint32), hi.astype(np.uint32)))])

    sent = repeats.with_hits(docs, hits, doc_id, text, units, buckets, make)
    flags = repeats.dealt(sent, buckets).applyInArrow(meet, repeats.BLOB)
    return repeats.remove(docs, flags, doc_id, text, units, buckets, "n_words,n_removed,n_spans,kept")


#: First documents of all windows: for small tables.
OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13) AS x),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) AS x WHERE f < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT wd.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM wd ANTI JOIN cov ON wd.doc_id = cov.doc_id AND wd.p = cov.p GROUP BY wd.doc_id)
SELECT dw.doc_id, cast(len(w) AS bigint) AS n_words, cast(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM dw LEFT JOIN kept ON dw.doc_id = kept.doc_id
"""
