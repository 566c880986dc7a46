"""Lexical retrieval packing into sequences of a fixed number of tokens.

1. Texts become token ids once (checkpointed); document frequencies of all tokens are counted over all rows.
2. A document goes to the index shard of its rarest shared token. Shards hold a bounded number of tokens: ranges of
   tokens are cut by their sizes, counted over all rows, and a token too large for one shard is spread over several by a
   hash of the row's number.
3. A shard gives whole windows of long documents a sequence each. The tails stand in a BM25 inverted index; each seed
   asks it with all of its tokens for neighbours not yet used, which fill the window in order of score. The neighbour
   that does not fit is cut, and its rest is the next seed; where no neighbour is left, the next unused tail follows.
   So only the last sequence of a shard is padded.

Ids are those that the tokenizers library gives for the tokenizer file without special tokens added. They are made by a
faster BPE from the same file's vocabulary, after a check that it is byte-level with the usual split and that its merges
stand in id order; other files, and texts that hold one of the file's added tokens, go through the library itself.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import textops as T
from meshframe.llm.common import cut, release

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 4 << 20
K1, B = 1.2, 0.75
#: Pieces of text that byte-level BPE never merges across (a fixed value of this kind of tokenizer).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, found without going back: runs are not given up in part, and white space at the end is one piece.
PIECES_AT_ONCE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters whose classes stand in a table; texts with higher ones are split by the pattern.
CHARACTERS = 0x20000
#: Characters that are split at once.
BLOCK = 1 << 20
#: Distinct pieces whose ids a worker remembers from block to block; when there are more, it starts anew.
KNOWN = 1 << 17
LETTER, NUMBER, SPACE = 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE files write each byte: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each character, as the engine that runs the pattern sees it."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, CHARACTERS)]))
    out = np.zeros(CHARACTERS, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        # what a pattern does not match is left out
        found = bytes(tiktoken.Encoding(f"class{k}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = k
    return out


def piece_starts(u: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Characters at which pieces start, in texts end to end that begin at `begin`; none of them is empty.

    White space before a piece goes whole up to its last character; that one belongs to the piece if it is a blank, else
    stands alone. At the end of a text white space is one piece.
    """
    first = np.zeros(len(u) + 3, bool)
    first[begin] = first[len(u) :] = True
    kind = character_classes()[u]
    white, blank = kind == SPACE, u == 0x20
    start = np.ones(len(u), bool)
    follows = np.append(~white[1:], False) & ~first[1 : len(u) + 1]  # another piece comes behind this character
    start[1:] = np.where(white[1:], ~white[:-1] | follows[1:], np.where(white[:-1], ~blank[:-1], kind[1:] != kind[:-1]))
    start[begin] = True
    # contractions, where a piece starts with an apostrophe
    at = np.flatnonzero((u == 0x27) & start)
    at = at[~first[at + 1]]
    if len(at):
        one, two = u[at + 1], np.where(first[at + 2], 0, u[np.minimum(at + 2, len(u) - 1)])
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e")))
        at, size = at[short | long], np.where(short, 2, 3)[short | long]
        start[at + 1] = False
        start[(at + size)[at + size < len(u)]] = True
    return np.flatnonzero(start)


def blocks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts that are not empty with their numbers, in blocks of about BLOCK characters; long ones cut before white space."""
    now, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            to = at + BLOCK
            while (to := t.find(" ", to)) >= 0 and t[to - 1].isspace():
                to += 1
            part = t[at:to] if to >= 0 else t[at:] if at else t
            now.append((i, part))
            at, size = at + len(part), size + len(part)
            if size >= BLOCK:
                yield now
                now, size = [], 0
    if now:
        yield now


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to arrays of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab = model["vocab"]
    pre = spec.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False) and not spec.get("normalizer")

    @lru_cache(maxsize=1)
    def own():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    slow = lambda texts: [np.array(x.ids, np.uint32) for x in own().encode_batch(texts, add_special_tokens=False)]
    if not byte_level or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return slow
    import tiktoken

    added = [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    bpe = tiktoken.Encoding("file", pat_str=PIECES_AT_ONCE, mergeable_ranks=ranks, special_tokens={})
    del spec, model, merges, vocab, ranks
    single = bpe._core_bpe.encode_single_piece
    # pieces met before: their number, and the end of the ids of each in `flat`
    place: dict[bytes, int] = {}
    flat, ends = array("I"), array("q", [0])

    def block(texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are not empty: each distinct piece is merged once."""
        whole = "".join(texts)
        u = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if int(u.max()) >= CHARACTERS:
            return [np.array(bpe.encode_ordinary(t), np.uint32) for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start = piece_starts(u, begin[:-1])
        edge = np.append(start, len(u)).astype(np.int32)
        raw = whole.encode()
        if len(raw) > len(u):
            # bytes at which characters start
            lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            edge = np.append(lead[start], len(raw)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(raw)]).dictionary_encode()
        _, cuts, held = pieces.dictionary.buffers()
        cuts, held = np.frombuffer(cuts, np.int32, len(pieces.dictionary) + 1).tolist(), held.to_pybytes()
        if len(place) > KNOWN:
            place.clear()
            del flat[:], ends[1:]
        where = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            piece = held[i:j]
            k = place.get(piece)
            if k is None:
                k = place[piece] = len(place)
                flat.extend(single(piece))
                ends.append(len(flat))
            where.append(k)
        at = np.array(ends, np.int64)
        where = np.array(where, np.int64)[pieces.indices.to_numpy()]
        n = (at[1:] - at[:-1])[where]
        end = np.cumsum(n)
        out = np.array(flat, np.uint32)[np.repeat(at[where] - (end - n), n) + np.arange(int(end[-1]))]
        return np.split(out, (end - n)[np.searchsorted(start, begin[1:-1])])

    def encode(texts: list[str]) -> list[np.ndarray]:
        # added tokens inside a text are ids of their own: those few texts are for the library
        plain = ["" if any(x in t for x in added) else t for t in texts]
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for some in blocks(plain):
            for (i, _), x in zip(some, block([t for _, t in some]), strict=True):
                got[i].append(x)
        return [slow([t])[0] if t and not p else np.concatenate(x) if len(x) != 1 else x[0] for t, p, x in zip(texts, plain, [x or [np.zeros(0, np.uint32)] for x in got], strict=True)]

    return encode


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    """The narrowest array type that holds all ids of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    last = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", [])), END_ID])
    return "<u2" if last < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, doc_id: str, text: str) -> DataFrame:
    """doc_id, n and the ids (with the end id) as bytes of an array."""
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            ids = [np.append(x, np.uint32(END_ID)) for x in encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "ids"])
            release()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, "doc_id long, n long, ids binary")


def arrays(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """The id arrays of a column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from arrays(chunk, kind)
        return
    buf, off = T.buffer(column)
    flat, off = buf.view(kind), (off // np.dtype(kind).itemsize).tolist()
    for a, b in zip(off[:-1], off[1:], strict=True):
        yield flat[a:b]


#: Ids that are sorted faster than all flags of a vocabulary are looked through.
SHORT = 2048


class Present:
    """Distinct ids of one document after another; those of long ones without sorting."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < SHORT:
            return np.unique(ids)
        if len(ids) and int(ids.max()) >= len(self.seen):
            self.seen = np.zeros(int(ids.max()) * 2, bool)
        self.seen[ids] = True
        out = np.flatnonzero(self.seen)
        self.seen[ids] = False
        return out


def document_frequencies(tokens: DataFrame, kind: str) -> np.ndarray:
    """Documents that hold each id; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, total = Present(), np.zeros(1 << 16, np.int64)
        for b in batches:
            for ids in arrays(b.column(0), kind):
                some = present(ids)
                if int(some[-1]) >= len(total):
                    total = np.concatenate((total, np.zeros(int(some[-1]) * 2 - len(total), np.int64)))
                total[some] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in got), default=0) + 1, np.int64)
    for r in got:  # one row for each id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def topics(df: np.ndarray, kind: str):
    """A function from a column of ids to the topic of each: the rarest id that another document has too."""
    # ids from the rarest on, those of one document last; equal ones by number
    order = np.lexsort((np.arange(len(df)), np.where(df > 1, df, np.iinfo(np.int64).max)))
    place = np.empty(len(df), np.int32)
    place[order] = np.arange(len(df), dtype=np.int32)

    def of(column: pa.Array) -> np.ndarray:
        buf, off = T.buffer(column)
        # each document has its end id at least
        return order[np.minimum.reduceat(place[buf.view(kind)], off[:-1] // np.dtype(kind).itemsize)]

    return of


def topic_sizes(tokens: DataFrame, topic_of) -> dict[int, int]:
    """Tokens of each topic, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                topic, where = np.unique(topic_of(b.column("ids")), return_inverse=True)
                total = np.bincount(where, b.column("n").to_numpy()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(topic, pa.int64()), pa.array(total)], names=["topic", "n"])

    got = tokens.select("n", "ids").mapInArrow(run, "topic long, n long")
    return {r["topic"]: r["n"] for r in got.groupBy("topic").agg(F.sum("n").alias("n")).collect()}  # one row for each id of the vocabulary


def in_shards(tokens: DataFrame, topic_of, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """doc_id, ids and shard of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = topic_of(b.column("ids"))
                shard = first[t] + np.mod(b.column("salt").to_numpy(), parts[t])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(shard, pa.int32())], names=["doc_id", "ids", "shard"])

    salt = F.abs(F.xxhash64("row") % F.lit(1 << 30))  # repeated rows spread like all others
    return tokens.select("doc_id", "ids", salt.alias("salt")).mapInArrow(run, "doc_id long, ids binary, shard int")


def deal(sizes: dict[int, int], most: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each topic, from the topics' tokens; a topic without a size joins the one before."""
    first, parts = np.zeros(vocabulary, np.int64), np.ones(vocabulary, np.int64)
    at, held, last = 0, 0, -1
    for topic, n in sorted(sizes.items()):
        first[last + 1 : topic] = at
        own = -(-n // most)
        if own > 1:
            at += held > 0
            first[topic], parts[topic] = at, own
            at, held = at + own, 0
        else:
            if held + n > most:
                at, held = at + 1, 0
            first[topic] = at
            held += n
        last = topic
    first[last + 1 :] = at
    return first, parts


#: A token that one class in so many has gets a row of weights over all classes instead of postings, if there are not more classes.
COMMON, ROW_CLASSES = 4, 1 << 15
#: Neighbours that are put in order first.
FEW = 64


class Index:
    """A BM25 inverted index over classes of equal tails; used tails leave it, and it shrinks with them."""

    def __init__(self, tails: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float) -> None:
        classes: dict[bytes, int] = {}
        self.of = np.array([classes.setdefault(t.tobytes(), len(classes)) for t in tails], np.int32)
        # tails of each class in order, and the next of them that is not used
        self.members = np.argsort(self.of, kind="stable")
        self.end = np.cumsum(np.bincount(self.of, minlength=len(classes)))
        self.at = self.end - np.bincount(self.of, minlength=len(classes))
        self.used = np.zeros(len(tails), bool)
        one = [tails[i] for i in self.members[self.at].tolist()]
        lens = np.array([len(t) for t in one], np.int64)
        # the tokens of all classes and how often each has them, in one sort; the end id stands in all tails and finds nothing
        key = np.concatenate(one).astype(np.int64)
        key = (np.repeat(np.arange(len(one)), lens) << 32 | key)[key != END_ID]
        key, tf = np.unique(key, return_counts=True)
        tok, doc = (key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.int32)
        cuts = np.searchsorted(doc, np.arange(len(one) + 1)).tolist()
        self.terms = [tok[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        del key
        tf = tf.astype(np.float32)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * lens / mean)).astype(np.float32)
        weight = idf[tok] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        held = np.bincount(tok, minlength=len(df))
        common = np.flatnonzero((held * COMMON >= max(len(one), COMMON)) & (len(one) <= ROW_CLASSES))
        self.line = np.full(len(df), -1, np.int32)
        self.line[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(one)))
        at = np.flatnonzero(self.line[tok] >= 0)
        self.rows[self.line[tok[at]], doc[at]] = weight[at]
        few = np.flatnonzero(self.line[tok] < 0)
        tok, doc, weight = tok[few], doc[few], weight[few]
        order = np.argsort(tok, kind="stable").astype(np.int32)
        # in the types that sums are made in, so that no seed converts them again
        self.doc, self.weight = doc[order].astype(np.intp), weight[order].astype(np.float64)
        self.edge = np.searchsorted(tok[order], np.arange(len(df) + 1))
        self.room = np.empty_like(self.doc), np.empty_like(self.weight)  # for the postings of one seed
        self.df = df
        # the class of each column of rows; postings hold columns
        self.column = np.arange(len(one))
        self.shut = 0

    def left(self, k: int) -> bool:
        """Whether class k has an unused tail; its pointer then stands on it."""
        at, end = int(self.at[k]), int(self.end[k])
        while at < end and self.used[self.members[at]]:
            at += 1
        self.at[k] = at
        return at < end

    def take(self, i: int) -> None:
        self.used[i] = True
        if not self.left(int(self.of[i])):
            self.shut += 1
            if 4 * self.shut >= len(self.column):
                # columns of classes without unused tails go: over all, each weight moves a bounded number of times
                keep = self.at[self.column] < self.end[self.column]
                some = keep[self.doc]
                self.edge = np.concatenate(([0], np.cumsum(some)))[self.edge]
                self.doc, self.weight = (np.cumsum(keep) - 1)[self.doc[some]], self.weight[some]
                self.rows, self.column = np.take(self.rows, np.flatnonzero(keep), 1), self.column[keep]
                self.shut = 0

    def neighbours(self, i: int, most: int) -> Iterator[int]:
        """Unused tails that share tokens with tail i, best first; the first `most` of them at least."""
        k = int(self.of[i])
        u = self.terms[k]
        u = u[np.argsort(self.df[u], kind="stable")]
        lines = self.line[u]
        rows, u = lines[lines >= 0].tolist(), u[lines < 0]
        spans = [(a, b) for a, b in zip(self.edge[u].tolist(), self.edge[u + 1].tolist(), strict=True) if b > a]
        if not spans and not rows:
            return
        n = sum(b - a for a, b in spans)
        doc = np.concatenate([self.doc[:0], *(self.doc[a:b] for a, b in spans)], out=self.room[0][:n])
        weight = np.concatenate([self.weight[:0], *(self.weight[a:b] for a, b in spans)], out=self.room[1][:n])
        if not rows and 8 * len(doc) < len(self.column):
            found, where = np.unique(doc, return_inverse=True)
            score = np.bincount(where, weight)
        else:
            score = np.bincount(doc, weight, len(self.column)).astype(np.float64, copy=False)
            for k in rows:
                score += self.rows[k]
            found = np.flatnonzero(score)  # every weight is greater than 0
            score = score[found]
        found = self.column[found]
        alive = self.at[found] < self.end[found]
        found, score = found[alive], score[alive]
        # each class gives a tail at least, so the best `most` classes are enough, and the first few nearly always
        for size in (FEW, most):
            least = np.partition(score, len(score) - size)[len(score) - size] if len(score) > size else -np.inf
            above = score >= least
            best, by = found[above], score[above]
            for c in best[np.argsort(-by, kind="stable")].tolist():
                while self.left(c):
                    yield int(self.members[self.at[c]])
            found, score = found[~above], score[~above]


def fill(tails: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as (tail, start, length); all are full but the last."""
    index = Index(tails, df, n_docs, mean)
    nxt = 0
    now: list[tuple[int, int, int]] = []
    room = window
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while nxt < len(tails) and index.used[nxt]:
                nxt += 1
            if nxt == len(tails):
                break
            rest = (nxt, 0)
            index.take(nxt)
        seed, at = rest
        rest = None
        take = min(room, len(tails[seed]) - at)
        now.append((seed, at, take))
        room -= take
        if take < len(tails[seed]) - at:
            rest = (seed, at + take)
        elif room:
            for d in index.neighbours(seed, room):
                index.take(d)
                take = min(room, len(tails[d]))
                now.append((d, 0, take))
                room -= take
                if take < len(tails[d]):
                    rest = (d, take)
                if not room:
                    break
        if not room:
            yield now
            now, room = [], window
    if now:
        yield now


def pack_sequences(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids if asked for."""
    # the number of a row stands in the checkpoint, so that it is the same whenever it is read
    tokens = cut(tokenize(docs, path, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    kind = id_type(path)
    n_docs, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens, kind)
    topic_of = topics(df, kind)
    first, parts = deal(topic_sizes(tokens, topic_of), SHARD_TOKENS, len(df))
    mean = total / n_docs if n_docs else 1.0

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        ids = list(arrays(got.column("ids"), kind))
        name = got.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (name[i] is None, name[i] or 0, ids[i].tobytes()))
        ids, name = [ids[i] for i in order], [name[i] for i in order]
        rows, held, base, at = [], [], int(key[0].as_py()) << 32, 0

        def put(pieces: list[tuple[int, int, int]]) -> None:
            offset = 0
            for i, start, length in pieces:
                piece = ids[i][start : start + length].astype("<u4")
                rows.append((name[i], start, length, zlib.crc32(piece.tobytes()), len(ids[i]), base + at, offset))
                if with_ids:
                    held.append(piece)
                offset += length

        tails, cuts = [], []
        for i, x in enumerate(ids):
            whole = len(x) // window
            for k in range(whole):
                put([(i, k * window, window)])
                at += 1
            if len(x) % window:
                tails.append(x[whole * window :])
                cuts.append((i, whole * window))
        if tails:
            for pieces in fill(tails, df, n_docs, mean, window):
                put([(cuts[t][0], cuts[t][1] + s, n) for t, s, n in pieces])
                at += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if with_ids:
            edge = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(held).astype(np.int32))))
        release()
        return pa.Table.from_arrays(out, names=names + ["ids"] * with_ids)

    return in_shards(tokens, topic_of, first, parts).groupBy("shard").applyInArrow(run, schema)
