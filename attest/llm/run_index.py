"""Byte substring dedup with run-length indexes: run-compressed Burrows-Wheeler transforms with sampled run ends.

The corpus is dealt out so that equal strings meet without a global sort: every window of ``window`` bytes belongs to
the least of its hashed ``gram``-byte pieces, and neighbouring windows with the same least piece form one stretch. Only
stretches whose piece some other document has too are sent, each different one of a chunk once, to a bucket of their
piece. Each bucket indexes its different stretches: suffix order, its transform cut into runs, and for each run's
first suffix the sampled position and the length it matches with its neighbour. Inside a run the length is one less
than that of the position before, so the lengths of all positions stream along the text from the samples. Positions
that match ``window`` bytes or more stand together in the suffix order; one is marked if the smallest document among
them is smaller than its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from attest.llm.chunks import Chunks, answers_of, bits_of, bucket_of, by_bucket, mixed, packed, shared_by_chunks, split_bits
from attest.llm.words import joined
from attest.session import ship_with_plans

ship_with_plans(__name__)

WINDOW = 50
#: Shorter pieces make longer stretches, but more of them meet by chance in a large corpus.
GRAM = 28
#: Windows of a stretch, at most: a periodic text makes long ones.
STRETCH = 200
CHUNK_BYTES = 2_000_000
#: Bytes of stretches indexed at once.
INDEX_BYTES = 500_000
#: Bytes of text for each bucket: the stretches of a bucket are in one task's memory together.
BUCKET_BYTES = 1_000_000
#: How often the stretches of one piece are cut anew, at most.
SEEDS = 6
NAME_BYTES = 6
_SEPARATOR = 0xFF  # in no UTF-8 text
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def least_pieces(data: np.ndarray, window: int, gram: int, seed: int = 0) -> np.ndarray:
    """The least hash of the pieces in each window."""
    eight = np.ascontiguousarray(sliding_window_view(data, 8)).view("<u8")[:, 0]
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        value = np.full(n, seed * 0x2545F4914F6CDD1D % (1 << 64), np.uint64)
        for i, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
            value += eight[at : at + n] * _FACTORS[i % len(_FACTORS)]
        value = mixed(value)
    width, reach = window - gram + 1, 1
    while 2 * reach <= width:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    return np.minimum(value[: n - width + 1], value[width - reach :][: n - width + 1])


class _Chunk:
    """Documents in the order of their keys, their stretches, and the different pieces of those."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        texts, keys = rows.column("text").to_pylist(), rows.column("key").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (keys[i] is not None, keys[i] or 0))
        self.keys = [keys[i] for i in order]
        self.rank = np.array([-(2**63) if k is None else k for k in self.keys], np.int64)
        self.window = window
        self.data, self.starts = joined(pa.array([texts[i] for i in order], pa.large_binary()))
        counts = np.maximum(np.diff(self.starts) - window, 0)  # a text is followed by one space
        self.at = self.size = self.name = self.doc = np.zeros(0, np.int64)
        self.names, self.which, self.often = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        if not counts.any():
            return
        held = self.starts[:-1][counts > 0]
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[held], inside[held + counts[counts > 0]] = 1, -1
        place = np.flatnonzero(np.cumsum(inside, dtype=np.int8))
        least = least_pieces(self.data, window, gram)[place]
        new = np.ones(len(place), bool)
        new[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(place)))
        parts = -(-size // STRETCH)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head = np.repeat(head, parts) + part * STRETCH
        self.size = np.minimum(np.repeat(size, parts) - part * STRETCH, STRETCH)
        self.at = place[head]
        self.doc = np.searchsorted(self.starts, self.at, "right") - 1
        self.names, self.which = np.unique(least[head], return_inverse=True)
        # Pieces that two documents of the chunk have.
        by_name = np.lexsort((self.doc, self.which))
        w, d = self.which[by_name], self.doc[by_name]
        self.often = np.zeros(len(self.names), bool)
        self.often[w[1:][(w[1:] == w[:-1]) & (self.rank[d[1:]] != self.rank[d[:-1]])]] = True

    def stretches(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches to compare: indices of all; for each the number of its first equal one; indices of those firsts.

        Documents come in the order of their keys, so a first one has the smallest key. Firsts come by piece.
        """
        some = np.flatnonzero((self.often | shared)[self.which])
        some = some[np.lexsort((some, self.which[some]))]
        body, seen = self.data.tobytes(), {}
        number = np.empty(len(some), np.int64)
        for i, (a, n) in enumerate(zip(self.at[some].tolist(), self.size[some].tolist())):
            number[i] = seen.setdefault(body[a : a + n + self.window - 1], len(seen))
        first = some[np.unique(number, return_index=True)[1]]
        return some, number, first


def _stretch_messages(chunk: _Chunk, first: np.ndarray, buckets: int):
    of = bucket_of(chunk.names[chunk.which[first]], buckets)
    cuts = np.flatnonzero(np.diff(of)) + 1
    edges = [0, *cuts.tolist(), len(of)] if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        some = first[a:b]
        held, doc = np.unique(chunk.doc[some], return_inverse=True)
        size = chunk.size[some] + chunk.window - 1
        text = b"".join([chunk.data[i : i + n].tobytes() for i, n in zip(chunk.at[some].tolist(), size.tolist())])
        yield int(of[a]), b"".join([
            np.array([len(held), len(some)], "<i8").tobytes(), chunk.rank[held].astype("<i8").tobytes(),
            doc.astype("<i4").tobytes(), size.astype("<i4").tobytes(),
            packed(chunk.names[chunk.which[some]], 4), text])


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of strings that each end in a separator; separators differ and grow with their place."""
    n = len(text)
    wide = np.concatenate([text, np.full(8, _SEPARATOR, np.uint8)])
    key = np.ascontiguousarray(sliding_window_view(wide, 8)[:n]).view(">u8")[:, 0].astype(np.uint64)
    to_end = np.flatnonzero(text == _SEPARATOR)
    to_end = to_end[np.searchsorted(to_end, np.arange(n))] - np.arange(n)
    short = to_end < 8
    # What follows the own separator does not count; equal keys that hold it are told apart by their place.
    key[short] |= (np.uint64(1) << (np.uint64(56) - np.uint64(8) * to_end[short].astype(np.uint64))) - np.uint64(1)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    # Equal keys that hold a separator come by place.
    at = np.flatnonzero(short[order])
    order[at] = order[at][np.lexsort((order[at], np.cumsum(new)[at]))]
    new[at] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = order[_repeated(new)]
    reach = 8
    # A rank is the place of the first suffix that is equal so far; only suffixes with equals are sorted on.
    while len(open_):
        both = rank[open_] * n + rank[open_ + reach]
        by = np.argsort(both)
        both, open_ = both[by], open_[by]
        old, places, new, first = rank[open_], np.arange(len(by)), np.ones(len(by), bool), np.ones(len(by), bool)
        new[1:], first[1:] = both[1:] != both[:-1], old[1:] != old[:-1]
        rank[open_] = old + np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(first, places, 0))
        open_ = open_[_repeated(new)]
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _repeated(new: np.ndarray) -> np.ndarray:
    """Which elements of a sorted list equal a neighbour, from which differ from the one before."""
    return ~(new & np.append(new[1:], True))


class RunIndex:
    """Runs of the transform of some strings and, at each run's first suffix, a sampled position and match length."""

    def __init__(self, text: np.ndarray, most: int):
        self.text = text
        self.order = suffix_order(text)
        before = text[self.order - 1]  # the last character, a separator, comes before the first
        head = np.ones(len(text), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == _SEPARATOR)
        self.heads = np.flatnonzero(head)
        self.samples = self.order[self.heads]
        self.lengths = self._matches(self.samples, self.order[self.heads - 1], most)
        self.lengths[self.heads == 0] = 0

    def _matches(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Equal characters from two places on, up to ``most`` and to a separator."""
        wide = np.concatenate([self.text, np.full(most + 1, _SEPARATOR, np.uint8)])
        length, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(most):
            x = wide[a[live] + k]
            live = live[(x == wide[b[live] + k]) & (x != _SEPARATOR)]
            if not len(live):
                break
            length[live] = k + 1
        return length

    def stream(self) -> np.ndarray:
        """How far each position matches its neighbour in the suffix order, streamed along the text from the samples."""
        place = np.zeros(len(self.text), np.int64)
        place[self.samples] = np.arange(len(self.samples))
        sampled = np.zeros(len(self.text), bool)
        sampled[self.samples] = True
        last = np.maximum.accumulate(np.where(sampled, np.arange(len(self.text)), 0))
        return self.lengths[place[last]] - (np.arange(len(self.text)) - last)


def _marks(strings: list[bytes], ranks: np.ndarray, window: int) -> np.ndarray:
    """For different strings in the order of their ranks: which windows also stand in a string of a smaller rank."""
    text = np.frombuffer(b"".join([s + b"\xff" for s in strings]), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    owner = np.repeat(ranks, sizes)
    index = RunIndex(text, int(sizes.max()))
    together = (index.stream()[index.order] >= window).astype(np.int64)
    group = np.cumsum(1 - together) - 1
    own = owner[index.order]
    starts = np.flatnonzero(together == 0)
    least = np.minimum.reduceat(own, starts)
    marked = np.empty(len(text), bool)
    marked[index.order] = least[group] < own
    ends = np.cumsum(sizes)
    inside = np.arange(len(text)) + window < np.repeat(ends, sizes)
    return marked[inside]


class _Stretches:
    """Places in one text, with the ranks of their documents; windows are numbered through, stretch by stretch."""

    def __init__(self, body: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray, name: np.ndarray):
        self.body, self.start, self.size, self.rank, self.name = body, start, size, rank, name

    def text(self, i: int) -> bytes:
        return self.body[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def compared(self, window: int, gram: int, seed: int = 0) -> np.ndarray:
        """Which windows also stand in a stretch of a smaller rank; equal windows have equal names.

        Stretches are indexed some ``INDEX_BYTES`` at a time, cut between names; one whose name no other has needs no
        index. The stretches of one name that are too many are cut anew by the least pieces of another hash, under
        which what they share falls together and what they don't share falls apart.
        """
        n = self.size - window + 1
        begin = np.cumsum(n) - n
        flags = np.zeros(int(n.sum()), bool)
        order = np.argsort(self.name, kind="stable")
        named = self.name[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(len(named), 1), bool), named[1:] != named[:-1]]))
        total = np.concatenate([[0], np.cumsum(self.size[order])])
        held: list[np.ndarray] = []
        bytes_held = 0
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(order)]):
            if b - a == 1:
                continue
            own = int(total[b] - total[a])
            if held and bytes_held + own > INDEX_BYTES:
                self._index(np.concatenate(held), flags, begin, n, window, gram, seed)
                held, bytes_held = [], 0
            held.append(order[a:b])
            bytes_held += own
        if held:
            self._index(np.concatenate(held), flags, begin, n, window, gram, seed)
        return flags

    def _index(self, ids: np.ndarray, flags: np.ndarray, begin: np.ndarray, n: np.ndarray, window: int, gram: int, seed: int) -> None:
        ids = ids[np.argsort(self.rank[ids], kind="stable")]
        firsts: dict[bytes, int] = {}
        same = np.fromiter((firsts.setdefault(self.text(i), i) for i in ids.tolist()), np.int64, len(ids))
        del firsts
        first = ids[same == ids]
        if self.size[first].sum() > 2 * INDEX_BYTES and seed < SEEDS:
            marks = self._cut(first, window, gram, seed + 1).compared(window, gram, seed + 1)
        else:
            marks = _marks([self.text(i) for i in first.tolist()], self.rank[first], window)
        at = 0
        for i in first.tolist():
            flags[begin[i] : begin[i] + n[i]] = marks[at : at + n[i]]
            at += n[i]
        for i, j in zip(ids.tolist(), same.tolist()):
            if i != j:
                flags[begin[i] : begin[i] + n[i]] = True if self.rank[i] != self.rank[j] else flags[begin[j] : begin[j] + n[j]]

    def _cut(self, ids: np.ndarray, window: int, gram: int, seed: int) -> "_Stretches":
        """The same windows in the same order, in stretches of one least piece under another hash."""
        start, size, rank, name = [], [], [], []
        step = np.cumsum(self.size[ids]) // INDEX_BYTES
        for k in np.unique(step).tolist():
            some = ids[step == k]
            length = self.size[some]
            text = np.concatenate([self.body[a : a + m] for a, m in zip(self.start[some].tolist(), length.tolist())])
            count = length - window + 1
            owner = np.repeat(np.arange(len(some)), count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            least = least_pieces(text, window, gram, seed)[np.repeat(np.cumsum(length) - length, count) + inner]
            head = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
            start.append(self.start[some][owner[head]] + inner[head])
            size.append(np.diff(np.append(head, len(owner))) + window - 1)
            rank.append(self.rank[some][owner[head]])
            name.append(least[head])
        return _Stretches(self.body, *(np.concatenate(x) for x in (start, size, rank, name)))


def _compare(window: int, gram: int):
    """Answer: which windows of each stretch also stand in a smaller document of any chunk."""

    def answer(payloads: list[bytes]) -> list[bytes]:
        body, size, rank, name, windows = [], [], [], [], []
        for payload in payloads:
            docs, n = np.frombuffer(payload, "<i8", 2).tolist()
            rank.append(np.frombuffer(payload, "<i8", docs, 16)[np.frombuffer(payload, "<i4", n, 16 + 8 * docs)])
            size.append(np.frombuffer(payload, "<i4", n, 16 + 8 * docs + 4 * n).astype(np.int64))
            name.append(np.frombuffer(payload, "<u4", n, 16 + 8 * docs + 8 * n).astype(np.uint64))
            body.append(np.frombuffer(payload, np.uint8, offset=16 + 8 * docs + 12 * n))
            windows.append(int((size[-1] - window + 1).sum()))
        sizes = np.concatenate(size)
        found = _Stretches(np.concatenate(body), np.cumsum(sizes) - sizes, sizes, np.concatenate(rank), np.concatenate(name))
        return split_bits(found.compared(window, gram), windows)

    return answer


def remove_shared(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                  chunk_bytes: int = CHUNK_BYTES, with_text: bool = False, **options) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, bytes): texts without what smaller keys have.

    A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller key. Strings are
    judged on the input, whole texts as UTF-8, and never cross documents. Keys are whole numbers; a null key is smaller
    than any other; rows that share a key are separate documents, of which neither is smaller. A null text is empty;
    no rows give no rows. Other columns are not read.
    """
    chunks = Chunks(docs, key, text, chunk_bytes, **({"bucket_bytes": BUCKET_BYTES} | options))
    buckets = chunks.buckets

    def ask_names(rows: pa.Table, _):
        chunk = _Chunk(rows, window, gram)
        for bucket, a, b in by_bucket(chunk.names, buckets):
            yield bucket, packed(chunk.names[a:b], NAME_BYTES)

    def stretches(chunk: _Chunk, answers: pa.Table):
        sizes = [b - a for _, a, b in by_bucket(chunk.names, buckets)]
        return chunk.stretches(bits_of(answers_of(answers, 1), sizes))

    def ask_stretches(rows: pa.Table, answers: pa.Table):
        chunk = _Chunk(rows, window, gram)
        yield from _stretch_messages(chunk, stretches(chunk, answers)[2], buckets)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, window, gram)
        change = np.zeros(len(chunk.data) + 1, np.int64)
        if len(chunk.at):
            some, number, first = stretches(chunk, answers)
            of = bucket_of(chunk.names[chunk.which[first]], buckets)
            edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)) if len(of) else [0]
            n = chunk.size[first]
            bits = bits_of(answers_of(answers, 2), [int(n[a:b].sum()) for a, b in zip(edges[:-1], edges[1:])])
            begin = np.cumsum(n) - n
            later = chunk.rank[chunk.doc[some]] > chunk.rank[chunk.doc[first[number]]]
            size = chunk.size[some]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            marked = np.repeat(later, size) | bits[np.repeat(begin[number], size) + inner] if len(bits) else np.repeat(later, size)
            place = (np.repeat(chunk.at[some], size) + inner)[marked]
            change[: len(chunk.data)] += np.bincount(place, minlength=len(chunk.data))
            np.subtract.at(change, place + window, 1)
        gone = np.cumsum(change)[:-1] > 0
        out = []
        for i, k in enumerate(chunk.keys):
            a, b = int(chunk.starts[i]), int(chunk.starts[i + 1]) - 1
            cut = gone[a:b]
            kept = chunk.data[a:b][~cut].tobytes()
            spans = int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1))
            out.append((k, b - a, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # Every chunk holds different pieces once: two chunks with one have it in two documents, or in rows that share a key.
    names = chunks.ask(ask_names, shared_by_chunks(NAME_BYTES), 1)
    found = chunks.ask(ask_stretches, _compare(window, gram), 2, names)
    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = chunks.finish(finish, schema, names.unionByName(found)).withColumnRenamed("key", key)
    return out if with_text else out.drop("kept")
