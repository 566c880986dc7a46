"""Copies among images by local descriptors: found when cropped, rescaled, turned or changed in brightness.

1. A media column (PGM, PPM or 8-bit PNG bytes) is decoded once; on a pyramid of scales, Harris corners are kept where they are the
   largest of their surroundings, and all of them describe it. A corner's direction is that of its
   patch's centre of mass; its descriptor is 128 comparisons of smoothed pixels at places turned by that direction.
2. Hamming-table join: a descriptor is cut into six pieces; each pair of pieces is the key of one of fifteen tables, so
   descriptors that differ in at most four bits share a key. Images of a key are tied to its smallest image (a star); up
   to FEW of them are paired with one another too. What two images share is summed over all keys and hubs: with TIED
   corners or more they are compared, or joined by other links already. Images so tied by keys of more than FEW images
   make clusters. Pairs that share fewer corners are no candidates; README has the recall against all pairs.
3. Consensus: descriptors of two images within MATCH_BITS of one another vote for a similarity transform; INLIERS corners
   that agree with one transform link the images, if many corners would not agree as often by chance. Each image is first
   compared with the hub that it shares most corners with. Pairs are listed only of images that are in different groups
   after that: near copies that their hub has joined make none. Where more than LISTED an image are left, each image is
   compared with one of another group again, as long as that halves them. Listed pairs are compared in both directions; an
   image goes once to each cell of the pairs' grid that has a pair of it. Where the images of a cluster are not one group,
   they meet in blocks of bounded size, and two images of different groups are compared once, in both directions.

Equal contents are one class with one representative; the result has each row's group. Defined cases: null, broken and flat images have no corner and no link (null and empty contents are no
copies of one another; other equal contents are one class, also without a corner); ties of strength go to the larger
scale, then to the smaller y, x; repeated ids are one image whose contents all count; a null id sorts last; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import repeats
from meshframe.llm.common import NULL_ID, cut, pack, prime_at_least, unpack
from meshframe.llm.graph import components, least_of
from meshframe.sources.files import decode_png

LEVELS, STEP = 3, 1.5
RADIUS = 9
PIECES = 6
MATCH_BITS = 16
INLIERS = 8
TOLERANCE = 2.5
#: Links expected of unrelated images, by the number of matches that agree by chance.
CHANCE = 1e-6
#: Corners that two images must share, over all keys, to be compared.
TIED = 2
#: Images of a key that are paired with one another; more of them are compared in blocks.
FEW = 32
BLOCK = 256
#: Pairs an image, on average, that are listed without comparing each image with one other first.
LISTED = 16
#: Corners that an image block of the grid of pairs should hold, and blocks of it at least.
CELL_CORNERS, LEAST_BLOCKS = 1 << 20, 4
#: Corners, and cells of a table of corners by corners, that a step of a comparison holds.
STEP_CORNERS, STEP_CELLS = 4096, 1 << 22
#: Cells of such a table that stay in a processor's cache.
CACHED_CELLS = 1 << 17
#: Keys that a map task gathers before it sends them out, and keys that a bucket should hold.
FLUSH_KEYS, BUCKET_KEYS = 1 << 20, 1 << 21
#: Descriptions that a task remembers to reuse them for equal contents.
REMEMBERED = 4096
_HEADER = re.compile(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s")


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a pixmap or an 8-bit PNG; None if it cannot be read."""
    if (raw or b"")[:4] == b"\x89PNG":
        try:
            rgb = decode_png(raw)
        except (ValueError, zlib.error, struct.error):
            return None
        return None if rgb is None else rgb.mean(2).astype(np.float32)
    head = _HEADER.match(raw or b"")
    if not head:
        return None
    w, h, n = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
    body = np.frombuffer(raw, np.uint8, offset=head.end())
    if not w * h or len(body) < w * h * n:
        return None
    return body[: w * h * n].reshape(h, w, n).mean(2).astype(np.float32)


def encode(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, a.shape[0]), (w, a.shape[1])))
    y0, x0 = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0).astype(np.float32)
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1)^2 windows, the border repeated."""
    p = np.pad(a, r, mode="edge")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1), np.float64)
    s[1:, 1:] = p.cumsum(0, dtype=np.float64).cumsum(1)
    k = 2 * r + 1
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def _pattern() -> np.ndarray:
    """Pairs of places inside a disc, from a fixed seed."""
    r = np.random.default_rng(20240613)
    pts = r.normal(0, RADIUS / 2.2, (4000, 2))
    return pts[(pts**2).sum(1) <= (RADIUS - 1) ** 2][:256].reshape(128, 2, 2)


PATTERN = _pattern()
DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 49])


def features(grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (n, 2) of uint64 and places (n, 4): x, y in the image, scale, direction."""
    none = np.zeros((0, 2), np.uint64), np.zeros((0, 4), np.float32)
    if grey is None:
        return none
    found = []
    for level in range(LEVELS):
        scale = STEP**level
        h, w = int(grey.shape[0] / scale), int(grey.shape[1] / scale)
        if min(h, w) < 2 * RADIUS + 4:
            break
        a = grey if not level else resize(grey, h, w)
        gy, gx = np.gradient(a.astype(np.float64))
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        strong = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strong[RADIUS + 1 : h - RADIUS - 1, RADIUS + 1 : w - RADIUS - 1]
        if inner.size == 0 or inner.max() <= 1e-3:
            continue
        peak = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = strong[RADIUS + 1 + dy : h - RADIUS - 1 + dy, RADIUS + 1 + dx : w - RADIUS - 1 + dx]
                    peak &= (inner > near) | ((inner == near) & (dy + dx * 0.5 > 0))
        y, x = np.nonzero(peak & (inner > 1e-3))
        found.append((-inner[y, x], np.full(len(y), level), y + RADIUS + 1, x + RADIUS + 1, *describe_corners(box(a, 1) / 9, y + RADIUS + 1, x + RADIUS + 1, scale)))
    if not found:
        return none
    strength, level, y, x, bits, places = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.lexsort((x, y, level, strength))
    return bits[order], places[order]


def describe_corners(smooth: np.ndarray, y: np.ndarray, x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors and places of the corners of one scale."""
    bits, places = np.zeros((len(y), 2), np.uint64), np.zeros((len(y), 4), np.float32)
    for at in range(0, len(y), STEP_CORNERS):
        part = slice(at, at + STEP_CORNERS)
        cy, cx = y[part, None], x[part, None]
        disc = smooth[cy + DISC[:, 0], cx + DISC[:, 1]]
        angle = np.arctan2((disc * DISC[:, 0]).sum(1), (disc * DISC[:, 1]).sum(1))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(PATTERN[..., 0] * c - PATTERN[..., 1] * s).astype(int) + cx[..., None]
        py = np.rint(PATTERN[..., 0] * s + PATTERN[..., 1] * c).astype(int) + cy[..., None]
        v = smooth[py, px]
        bits[part] = np.packbits(v[..., 0] < v[..., 1], 1).view(np.uint64)
        places[part] = np.stack([(x[part] + 0.5) * scale, (y[part] + 0.5) * scale, np.full(len(angle), scale), angle], 1)
    return bits, places


def table_keys(d: np.ndarray) -> np.ndarray:
    """(n, 15) keys: each pair of the six pieces, with the table's number mixed in."""
    from meshframe.llm.textops import mix

    bits = np.unpackbits(d.view(np.uint8).reshape(len(d), 16), axis=1)
    edge = np.linspace(0, 128, PIECES + 1).astype(int)
    power = (np.uint64(1) << np.arange(32, dtype=np.uint64))[::-1]
    pieces = [(bits[:, a:b].astype(np.uint64) * power[-(b - a) :]).sum(1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    pairs = [(i, j) for i in range(PIECES) for j in range(i + 1, PIECES)]
    return np.stack([mix((pieces[i] << np.uint64(32) | pieces[j]) + np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64))) for t, (i, j) in enumerate(pairs)], 1)


def agree(pa_: np.ndarray, pb: np.ndarray, enough: int | None = None) -> int:
    """The most matches that one similarity transform explains, counted by distinct corners on both sides; the search stops at enough."""
    ratio = pb[:, 2] / pa_[:, 2]
    turn = pb[:, 3] - pa_[:, 3]
    c, s = np.cos(turn) * ratio, np.sin(turn) * ratio
    x, y = pa_[:, 0], pa_[:, 1]
    tx, ty = pb[:, 0] - (c * x - s * y), pb[:, 1] - (s * x + c * y)
    best, step = 0, max(1, STEP_CELLS // max(1, len(x)))
    room = float(np.prod(np.ptp(pb[:, :2], axis=0).astype(np.float64) + 2 * TOLERANCE)) if len(x) else 1.0
    for at in range(0, len(x), step):
        k = slice(at, at + step)
        dx = c[k, None] * x - s[k, None] * y + tx[k, None] - pb[:, 0]
        dy = s[k, None] * x + c[k, None] * y + ty[k, None] - pb[:, 1]
        reach = (TOLERANCE * np.maximum(1, np.maximum(pb[:, 2], pa_[:, 2] * ratio[k, None]))) ** 2
        fit = dx * dx + dy * dy <= reach
        count, by_chance = fit.sum(1), np.pi * reach.sum(1, dtype=np.float64) / room
        for i in np.argsort(-count, kind="stable").tolist():
            if count[i] < max(INLIERS, best + 1):
                break
            sides = (np.unique(np.rint(p[fit[i], :2]), axis=0) for p in (pa_, pb))
            n, mean = min(len(u) for u in sides), by_chance[i]
            # Chernoff's bound of a Poisson tail, over all transforms tried
            if n > mean and np.log(len(x)) + n - mean + n * np.log(mean / n) <= np.log(CHANCE):
                best = max(best, n)
            if enough is not None and best >= enough:
                return best
    return best


def close(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of corners within MATCH_BITS of one another."""
    n, a, b = len(e), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step, wide = min(len(d), max(1, CACHED_CELLS // max(1, n))), -(-n // 8) * 8
    left, right = (np.ascontiguousarray(e[:, k]) for k in (0, 1))
    differ, bits, hit = np.empty((step, n), np.uint64), np.empty((step, n), np.uint8), np.zeros((step, wide), bool)
    for at in range(0, len(d) if n else 0, step or 1):
        part = d[at : at + step]
        m = len(part)
        # what is close in all bits is so in the first half
        np.less_equal(np.bitwise_count(np.bitwise_xor(part[:, :1], left, out=differ[:m]), out=bits[:m]), MATCH_BITS, out=hit[:m, :n])
        # eight cells at once: few have a hit
        some = np.flatnonzero(hit[:m].reshape(-1).view(np.uint64) != 0)
        eight, cell = np.nonzero(hit[:m].reshape(-1, 8)[some])
        i, j = np.divmod(some[eight] * 8 + cell, wide)
        near = np.bitwise_count(part[i, 0] ^ left[j]) + np.bitwise_count(part[i, 1] ^ right[j]) <= MATCH_BITS
        a.append(i[near] + at)
        b.append(j[near])
    return np.concatenate(a), np.concatenate(b)


def links(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], both: bool = False) -> list[int]:
    """Which of the other images link with one, or if both, one with them."""
    d, p = one
    if len(d) < INLIERS or not others:
        return []
    base = np.cumsum([0] + [len(x) for x, _ in others])
    out, at = [], 0
    while at < len(others):
        end = max(at + 1, int(np.searchsorted(base, base[at] + STEP_CORNERS, "right")) - 1)
        a, b = close(d, np.concatenate([x for x, _ in others[at:end]]))
        b += base[at]
        owner = np.searchsorted(base, b, "right") - 1
        count = np.bincount(np.searchsorted(base, np.unique(b), "right") - 1, minlength=end)
        for j in np.flatnonzero(count >= INLIERS).tolist():
            mine = owner == j
            x, y = p[a[mine]], others[j][1][b[mine] - base[j]]
            if agree(x, y, INLIERS) >= INLIERS or (both and agree(y, x, INLIERS) >= INLIERS):
                out.append(j)
        at = end
    return out


def distinct(rows: np.ndarray, columns: int) -> np.ndarray:
    """Rows in the order of the first columns, one of those that are equal there."""
    rows = rows[np.lexsort(rows[:, :columns].T[::-1])]
    return rows[begins(rows[:, :columns])]


def begins(rows: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    return np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)))


class Joined:
    """Labels that links have joined."""

    def __init__(self, labels) -> None:
        self.top = {int(x): int(x) for x in labels}

    def find(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.top[y] = x
        return x != y


def join_groups(parts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join images of different labels, and of different sides if these are given; images already joined are not compared again."""
    joined = Joined(label)
    names, number, size = np.unique(label, return_inverse=True, return_counts=True)
    most = number == np.argmax(size) if len(names) else np.zeros(0, bool)
    out = []
    # every pair of labels has a side that is not the largest; two such images are compared at the first of them
    for i in np.flatnonzero(~most).tolist():
        top = np.array([joined.find(int(x)) for x in names])
        apart = (top != top[number[i]])[number] & (most | (np.arange(len(parts)) > i))
        if side is not None:
            apart &= side != side[i]
        rest = np.flatnonzero(apart).tolist()
        out += [(i, rest[k]) for k in links(parts[i], [parts[j] for j in rest], True) if joined.join(int(label[i]), int(label[rest[k]]))]
    return out


def image_copies(media: DataFrame, media_id: str = "media_id", content: str = "content") -> DataFrame:
    """media_id, n_keypoints, group_id (smallest id reachable by links) for each row."""
    spark = media.sparkSession

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # copies that follow one another are described once
        for b in batches:
            out = []
            for name, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    d, p = features(decode(raw))
                    known[name] = len(d), pack(d.reshape(-1), p.reshape(-1))
                out.append(known[name])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["id", "digest", "n", "features"])

    key = F.coalesce(F.col(media_id).cast("bigint"), F.lit(NULL_ID))
    readable = F.col(content).cast("binary")
    # null and empty contents are no copies of one another
    digest = F.when(F.octet_length(readable) > 0, F.sha2(readable, 256)).otherwise(F.concat(F.lit("-"), key.cast("string")))
    named = media.select(key.alias("id"), digest.alias("digest"), readable.alias("content"))
    described = named.where("left(digest, 1) <> '-'").mapInArrow(describe, "id long, digest string, n long, features binary")
    # one description for each content; the rows' names are read again at the end
    classes = cut(described.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "features"), "id").alias("own")).select("digest", "rep", "own.n", "own.features"), tidy=True)
    corners = classes.agg(F.sum("n")).first()[0] or 0
    tables = PIECES * (PIECES - 1) // 2
    buckets = prime_at_least(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-corners * tables // BUCKET_KEYS)))
    own = classes.where("n > 0").select(F.col("rep").alias("id"), "features")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            k, ids, corners = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # within a bucket five bytes of a key tell keys apart; what is equal by chance is compared later
            low, more = (k & np.uint64(0xFFFFFFFF)).astype(np.uint32), (k >> np.uint64(56)).astype(np.uint8)
            return repeats.blobs(repeats.by_bucket(((k >> np.uint64(32) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64), low, more, ids, corners))

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = unpack(raw)[0].reshape(-1, 2)
                for at in range(0, len(d), STEP_CORNERS):
                    k = table_keys(d[at : at + STEP_CORNERS])
                    held.append((k.reshape(-1), np.full(k.size, i, np.int64), np.repeat(np.arange(at, at + len(k), dtype=np.uint32), k.shape[1])))
                    if sum(len(x[0]) for x in held) >= FLUSH_KEYS:
                        yield flush()
        if held:
            yield flush()

    def columns(got: pa.Table) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in got.column("blob")), strict=True)]

    def ordered(k: np.ndarray, d: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Corners by key and image, and before them the first corner of each key and the key's number of each corner."""
        order = np.lexsort((d, k))
        first = np.concatenate(([True], np.diff(k[order]) != 0))
        return np.flatnonzero(first), np.cumsum(first) - 1, *(x[order] for x in (k, d, *more))

    def meet(got: pa.Table) -> pa.Table:
        """Corners whose key another image has too, with the key's smallest image, by bucket of the image."""
        low, more, d, c = columns(got)
        k = np.uint64(got.column("bucket")[0].as_py()) << np.uint64(40) | more.astype(np.uint64) << np.uint64(32) | low
        first, at, k, d, c = ordered(k, d, c)
        hub = d[first]
        shared = (d[np.append(first[1:], len(d)) - 1] != hub)[at]
        rows = [x[shared] for x in (d, hub[at], c, k)]
        return pa.Table.from_batches([repeats.blobs(repeats.by_bucket(rows[0] % buckets, *rows))])

    def best(got: pa.Table) -> pa.Table:
        """For each image the hub that it shares most corners with, summed over all keys, if these are TIED."""
        d, hub, c, _ = columns(got)
        star = distinct(np.stack((d, hub, c.astype(np.int64)), 1)[d != hub], 3)
        at = np.flatnonzero(begins(star[:, :2]))
        n = np.diff(at, append=len(star))
        star, n = star[at][n >= TIED, :2], n[n >= TIED]
        star = star[np.lexsort((star[:, 1], -n, star[:, 0]))]
        return pairs(*star[np.flatnonzero(np.diff(star[:, 0], prepend=star[:1, 0] - 1))].T)

    def labelled(got: pa.Table, named: pa.Table) -> pa.Table:
        """Corners with their image's group, by bucket of the key."""
        d, _, c, k = columns(got)
        images, number = np.unique(d, return_inverse=True)
        _, i, j = np.intersect1d(images, named.column("node").to_numpy(), return_indices=True)
        label = images.copy()
        label[i] = named.column("root").to_numpy()[j]
        return pa.Table.from_batches([repeats.blobs(repeats.by_bucket((k >> np.uint64(40)).astype(np.int64), k, d, c, label[number]))])

    def apart(got: pa.Table) -> pa.Table:
        """Corners that images of different groups share with the smallest image of a key (from few, 0, or many images, 1) or with one another (2), by bucket of the image.

        Those of its own group are told for keys of many images only (3).
        """
        first, at, _, d, c, label = ordered(*columns(got))
        once = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(at) != 0))))  # images of each key
        images = np.bincount(at[once])
        few, hub = (images <= FEW)[at], first[at]
        same = label == label[hub]
        told = lambda u, v, kind: np.stack([d[u], d[v], c[u].astype(np.int64), kind, label[u], label[v]], 1)
        star = np.flatnonzero((d != d[hub]) & ~(few & same))
        rows = [told(star, hub[star], np.where(same, 3, ~few)[star])]
        start = np.cumsum(images) - images
        mixed = np.minimum.reduceat(label, first) < np.maximum.reduceat(label, first)
        for n in range(3, FEW + 1):
            place = once[start[mixed & (images == n)][:, None] + np.arange(n)]
            i, j = np.triu_indices(n - 1, 1)
            u, v = place[:, 1 + j], place[:, 1 + i]
            other = label[u] != label[v]
            rows.append(told(u[other], v[other], np.full(other.sum(), 2)))
        rows = distinct(np.concatenate(rows), 4)
        return pa.Table.from_batches([repeats.blobs(repeats.by_bucket(rows[:, 0] % buckets, *rows.T))])

    def count(got: pa.Table) -> pa.Table:
        """One star for each component of clusters (1), and for each image with pairs of different groups (2) the image that it shares most corners with, how many pairs it has and these.

        What an image shares with another is summed over all keys and hubs; TIED corners make a pair worth comparing.
        """
        rows = distinct(np.stack(columns(got), 1), 4)
        first, kind = begins(rows[:, :2]), rows[:, 3]
        number = np.cumsum(first) - 1  # pair of each row
        shared = np.bincount(number[begins(rows[:, :3])])[number]
        strong = (kind == 3) | (shared >= TIED)
        many = np.stack(least_of(*rows[strong & (kind % 2 == 1), :2].T), 1)
        open_ = first & strong & (kind < 3)
        (u, v, a, b), n = rows[open_][:, [0, 1, 4, 5]].T, shared[open_]
        at = np.flatnonzero(np.diff(u, prepend=u[:1] - 1))
        most = np.lexsort((v, -n, u))[at]
        packed = [pack(*x) for x in zip(np.split(v, at[1:]), np.split(b, at[1:]), strict=True)] if len(u) else []
        out = np.concatenate((many.T, many.T)), np.stack((u, v, a, b))[:, most], np.concatenate((np.zeros(len(many), np.int64), np.diff(at, append=len(u))))
        kinds = np.repeat([1, 2], [len(many), len(most)])
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (kinds, *np.concatenate(out[:2], 1), out[2])] + [pa.array([None] * len(many) + packed, pa.binary())], names=["kind", "u", "v", "a", "b", "n", "pairs"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            for u, a, raw in zip(g.column(0).to_pylist(), g.column(1).to_pylist(), g.column(2).to_pylist(), strict=True):
                v, b = unpack(raw)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(v), u), v, np.full(len(v), a), b)], names=["u", "v", "a", "b"])

    def pairs(u: list, v: list) -> pa.Table:
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    found = cut(own.select("id", "features").mapInArrow(send, repeats.BLOB).groupBy("bucket").applyInArrow(meet, repeats.BLOB), tidy=True)
    ties = cut(found.groupBy("bucket").applyInArrow(best, "u long, v long"), tidy=True)
    shapes = own.select(F.col("id").alias("node"), "features")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    # an image goes to the hub that it shares most with, and a hub to itself
    routed = ties.select(F.col("u").alias("node"), F.col("v").alias("hub")).unionByName(ties.select(F.col("v").alias("node"), F.col("v").alias("hub")).distinct())
    parted = lambda got: [tuple(x.reshape(-1, n) for x, n in zip(unpack(r.as_py()), (2, 4), strict=True)) for r in got.column("features")]

    def with_hub(got: pa.Table) -> pa.Table:
        hub, ids, parts = got.column("hub").to_numpy(), got.column("node").to_numpy(), parted(got)
        u, v = [], []
        order = np.lexsort((ids, hub))
        for g in np.split(order, np.flatnonzero(np.diff(hub[order])) + 1):
            rest = [i for i in g if ids[i] != hub[i]]
            for h in (i for i in g if ids[i] == hub[i]):
                for k in links(parts[h], [parts[i] for i in rest]):
                    u.append(ids[rest[k]])
                    v.append(hub[h])
        return pairs(u, v)

    starred = cut(shapes.join(routed, "node").withColumn("place", place("hub")).groupBy("place").applyInArrow(with_hub, "u long, v long"), tidy=True)
    groups = components(starred)

    def with_other(asked: pa.Table, images: pa.Table) -> pa.Table:
        part = dict(zip(images.column("node").to_pylist(), parted(images), strict=True))
        u, v, a, b = (asked.column(c).to_numpy() for c in ("u", "v", "a", "b"))
        joined, out = Joined(np.concatenate((a, b))), []
        order = np.lexsort((v, u))
        for g in np.split(order, np.flatnonzero(np.diff(u[order])) + 1) if len(order) else []:
            rest = [k for k in g.tolist() if joined.find(int(a[k])) != joined.find(int(b[k]))]
            out += [rest[k] for k in links(part[int(u[g[0]])], [part[int(v[k])] for k in rest], True) if joined.join(int(a[rest[k]]), int(b[rest[k]]))]
        return pairs(u[out], v[out])

    grid = max(LEAST_BLOCKS, -(-corners // CELL_CORNERS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))

    def linked(open_: DataFrame) -> DataFrame:
        """Links of pairs, dealt to the cells of a grid of image blocks by image blocks."""
        open_ = cut(open_.withColumns({"lo": F.least(block("u"), block("v")), "hi": F.greatest(block("u"), block("v"))}), tidy=True)
        asked = open_.select(F.explode(F.array("u", "v")).alias("node"), F.col("lo").alias("row"), F.col("hi").alias("column")).distinct()
        shipped = shapes.join(asked, "node").groupBy("row", "column")
        return open_.groupBy("lo", "hi").cogroup(shipped).applyInArrow(with_other, "u long, v long")

    # pairs that are not in one group yet; where they are many, each image is first compared with one, as long as that halves them
    before = None
    while True:
        roots = groups.select(F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"), "node", "root")
        told = found.groupBy("bucket").cogroup(roots.groupBy("bucket")).applyInArrow(labelled, repeats.BLOB).groupBy("bucket").applyInArrow(apart, repeats.BLOB)
        told = cut(told.groupBy("bucket").applyInArrow(count, "kind long, u long, v long, a long, b long, n long, pairs binary"), tidy=True)
        open_ = told.where("kind = 2")
        images, now = open_.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        whole = now <= LISTED * images or (before is not None and now > before / 2)
        open_ = open_.select("u", "a", "pairs").mapInArrow(listed, "u long, v long, a long, b long") if whole else open_.select("u", "v", "a", "b")
        starred = cut(starred.unionByName(linked(open_)), tidy=True)
        groups = components(starred)
        if whole:
            break
        before = now
    # clusters of tied images that are not one group yet
    tied = components(told.where("kind = 1").select("u", "v")).withColumnRenamed("root", "cluster").join(groups, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    blocks = tied.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("k"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("cluster", "k")
    members = tied.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select(
        "node", "cluster", "label", "own",
        F.when(F.col("k") == 1, place("cluster")).otherwise(F.col("cluster")).alias("place"),
        F.when(F.col("k") == 1, F.lit(-1)).otherwise(F.least("own", "other")).alias("lo"), F.greatest("own", "other").alias("hi"),
    )

    def compare(got: pa.Table) -> pa.Table:
        cluster, ids, label, own, parts = *(got.column(c).to_numpy() for c in ("cluster", "node", "label", "own")), parted(got)
        # two images of one block meet in that block's own cell
        crossed = 0 <= got.column("lo")[0].as_py() < got.column("hi")[0].as_py()
        u, v = [], []
        order = np.lexsort((ids, cluster))
        for g in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            for i, j in join_groups([parts[k] for k in g], label[g], own[g] if crossed else None):
                u.append(ids[g[i]])
                v.append(ids[g[j]])
        return pairs(u, v)

    more = cut(shapes.join(spread, "node").groupBy("place", "lo", "hi").applyInArrow(compare, "u long, v long"), tidy=True)
    final = components(starred.unionByName(more).where("u <> v"))
    rows = named.select("id", "digest").join(classes.select("digest", "rep", "n"), "digest", "left").withColumns({"rep": F.coalesce("rep", "id"), "n": F.coalesce("n", F.lit(0).cast("bigint"))})
    out = rows.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    given = lambda c: F.when(c != NULL_ID, c)
    return out.select(given(F.col("id")).alias("media_id"), F.col("n").alias("n_keypoints"), given(F.coalesce("root", "rep")).alias("group_id"))


def pictures(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """media_id and a picture of each vector: the products of its numbers, as grey levels. Null vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                if not v or any(x is None for x in v):
                    out.append(None)
                    continue
                e = np.array(v, np.float64)
                e /= np.sqrt((e * e).mean()) or 1.0
                out.append(encode(np.clip(np.rint(128 + 60 * np.nan_to_num(e[:, None] * e)), 0, 255)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["media_id", "content"])

    return vectors.select(vec_id, vector).mapInArrow(run, "media_id long, content binary")
