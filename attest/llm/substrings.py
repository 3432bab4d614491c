"""Substring dedup by recompression: word runs and pairs get global names, shared symbols reveal long repeats.

Rounds rename a text's words: first each maximal run of one word, then, round after round, each pair of neighbours of
which the first falls in one half of the alphabet and the second in the other. A name is the hash of what it stands
for, so every task gives the same run or pair the same name without asking, and whether two neighbours join depends on
them alone. So equal stretches of words have equal symbols but for a bounded margin. Each window of ``window`` words is
held by the first symbol of the highest round that lies inside its margins whatever stands around the window: equal
windows have the same holder. Windows whose holder occurs elsewhere are compared by two independent hashes of their
words (96 bits); nothing else is. A window without an inner symbol (a run) is its own holder.

Names are asked about, and windows compared, in Spark rounds over buckets of the hash space, see ``chunks``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from attest.llm.chunks import Chunks, answers_of, bits_of, bucket_of, by_bucket, mixed, packed, shared_by_chunks, split_bits
from attest.llm.words import joined, words_of
from attest.session import ship_with_plans

ship_with_plans(__name__)

WINDOW = 20
ROUNDS = 5
NAME_BYTES = 6
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """A hash of each ``window`` consecutive word hashes."""
    with np.errstate(over="ignore"):
        powers = np.ones(len(words), np.uint64)
        powers[1:] = base
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.ones(len(words), np.uint64)
        inverse[1:] = np.uint64(pow(int(base), -1, 1 << 64))
        inverse = np.cumprod(inverse, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
        n = len(words) - window + 1
        return mixed((sums[window:] - sums[:-window]) * inverse[:n])


def holders(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Name and place of the symbol that holds each window; where there is none, place is -1 and the name 0."""
    n = len(words)
    name, place = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    with np.errstate(over="ignore"):
        # Runs.
        head = np.ones(n, bool)
        head[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
        bound = np.append(np.flatnonzero(head), n)
        length = np.diff(bound).astype(np.uint64)
        symbol = words[bound[:-1]]
        symbol = np.where(length > 1, mixed(symbol * np.uint64(3) + length), symbol)
        at = np.append(np.cumsum(head) - 1, len(symbol))
        left, right = bound[at[starts] + 1], bound[at[starts + window - 1]]
        for r in range(rounds + 1):
            if r:
                half = mixed(symbol ^ np.uint64(r * 0x51ED27)) & np.uint64(1)
                owner = doc[bound[:-1]]
                join = (half[:-1] == 0) & (half[1:] == 1) & (owner[1:] == owner[:-1])
                # A first symbol of the second half may belong to what stands before, a last one of the first half to what follows.
                first, last = at[np.minimum(left, n - 1)], at[np.maximum(right - 1, 0)]
                left = np.where((left < right) & (half[first] == 1), bound[first + 1], left)
                right = np.where((left < right) & (half[last] == 0), bound[last], right)
                joined_to = np.concatenate([[False], join])
                symbol = np.where(np.append(join, False), mixed(symbol * np.uint64(5) + mixed(np.append(symbol[1:], symbol[-1:]))), symbol)
                symbol = symbol[~joined_to]
                bound = np.append(bound[:-1][~joined_to], n)
                mark = np.zeros(n, np.int64)
                mark[bound[:-1]] = 1
                at = np.append(np.cumsum(mark) - 1, len(symbol))
            inside = left < right
            name[inside] = symbol[at[left[inside]]]
            place[inside] = left[inside]
    return name, place


class _Chunk:
    """What a task knows of a chunk: documents in the order of (key, text), their words, windows and holders."""

    def __init__(self, rows: pa.Table, window: int, rounds: int):
        texts = rows.column("text").to_pylist()
        keys = rows.column("key").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (keys[i] is not None, keys[i] or 0, texts[i] or b""))
        self.keys = [keys[i] for i in order]
        self.rank = np.array([-(2**63) if k is None else k for k in self.keys], np.int64)
        words, self.first = words_of(*joined(pa.array([texts[i] for i in order], pa.binary())))
        coded = words.dictionary_encode()
        self.known = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.known], np.uint64)
        self.words = hashes[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(order)), np.diff(self.first))
        n = len(self.words) - window + 1
        self.starts = np.flatnonzero(self.doc[: max(n, 0)] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.window = window
        if len(self.starts):
            name, place = holders(self.words, self.doc, self.starts, window, rounds)
            self.hash = [window_hashes(self.words, window, b)[self.starts] for b in _BASES]
            alone = place < 0
            name[alone], place[alone] = self.hash[0][alone], self.starts[alone]
            # A holder's occurrences, once each: several windows in a row share one.
            new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1])]))
            self.names, which = np.unique(name[new], return_inverse=True)
            self.often = np.bincount(which, minlength=len(self.names)) > 1
            self.which = np.repeat(which, np.diff(np.append(new, len(name))))
        else:
            self.names, self.which, self.often = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
            self.hash = [np.zeros(0, np.uint64)] * 2

    def candidates(self, shared: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that may repeat: (later copies inside the chunk, first copies, both as indices; documents of the latter).

        First copies come by (bucket, document, place).
        """
        some = np.flatnonzero((self.often | shared)[self.which])
        low, high = self.hash[0][some], self.hash[1][some]
        order = np.lexsort((self.starts[some], high, low))
        new = np.ones(len(some), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        first = some[np.sort(order[new])]
        of = bucket_of(self.hash[1][first], buckets)
        first = first[np.argsort(of, kind="stable")]
        return some[order[~new]], first, self.doc[self.starts[first]]


def _window_messages(chunk: _Chunk, first: np.ndarray, docs: np.ndarray, buckets: int):
    """(bucket, payload): the number of documents, (rank, windows) of each, and the 12 bytes of each window."""
    of = bucket_of(chunk.hash[1][first], buckets)
    cuts = np.flatnonzero(np.diff(of)) + 1
    edges = [0, *cuts.tolist(), len(of)] if len(of) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        held, n = np.unique(docs[a:b], return_counts=True)
        head = np.stack([chunk.rank[held], n.astype(np.int64)], axis=1)
        body = np.concatenate([
            np.frombuffer(packed(chunk.hash[0][first[a:b]], 8), np.uint8).reshape(-1, 8),
            np.frombuffer(packed(chunk.hash[1][first[a:b]], 4), np.uint8).reshape(-1, 4)], axis=1)
        yield int(of[a]), np.int64(len(held)).tobytes() + head.astype("<i8").tobytes() + body.tobytes()


def _first_wins(payloads: list[bytes]) -> list[bytes]:
    """Which windows another chunk has in an earlier document (of equal ranks, in an earlier chunk)."""
    low, high, rank, chunk, sizes = [], [], [], [], []
    for i, payload in enumerate(payloads):
        m = int(np.frombuffer(payload, "<i8", 1)[0])
        head = np.frombuffer(payload, "<i8", 2 * m, 8).reshape(m, 2)
        body = np.frombuffer(payload, np.uint8, offset=8 + 16 * m).reshape(-1, 12)
        low.append(np.ascontiguousarray(body[:, :8]).view("<u8")[:, 0])
        high.append(np.ascontiguousarray(body[:, 8:]).view("<u4")[:, 0])
        rank.append(np.repeat(head[:, 0], head[:, 1]))
        chunk.append(np.full(len(body), i, np.int32))
        sizes.append(len(body))
    low, high, rank, chunk = (np.concatenate(x) for x in (low, high, rank, chunk))
    order = np.lexsort((chunk, rank, high, low))
    later = np.zeros(len(order), bool)
    later[1:] = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
    flags = np.zeros(len(order), bool)
    flags[order] = later
    return split_bits(flags, sizes)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS,
                   with_text: bool = False, **options) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` (and ``kept``): each text without the words of repeated windows.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. A word goes if a window over it
    has a sequence of words that also starts earlier: in a document with a smaller key, or before in the same one.
    Windows are judged on the input. Keys are whole numbers; a null key comes first. Rows that share a key are
    documents of their own, ordered by their text inside a chunk and by chunk beyond it, so one copy stays. A null or
    empty text has no words; no rows give no rows. Other columns are not read.
    """
    chunks = Chunks(docs, key, text, **options)
    buckets = chunks.buckets

    def ask_names(rows: pa.Table, _):
        chunk = _Chunk(rows, window, rounds)
        for bucket, a, b in by_bucket(chunk.names, buckets):
            yield bucket, packed(chunk.names[a:b], NAME_BYTES)

    def shared(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
        return bits_of(answers_of(answers, 1), [b - a for _, a, b in by_bucket(chunk.names, buckets)])

    def ask_windows(rows: pa.Table, answers: pa.Table):
        chunk = _Chunk(rows, window, rounds)
        _, first, held = chunk.candidates(shared(chunk, answers), buckets)
        yield from _window_messages(chunk, first, held, buckets)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, window, rounds)
        later, first, _ = chunk.candidates(shared(chunk, answers), buckets)
        of = bucket_of(chunk.hash[1][first], buckets)
        sizes = np.diff(np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]])).tolist() if len(of) else []
        elsewhere = first[bits_of(answers_of(answers, 2), sizes)] if len(first) else first
        change = np.zeros(len(chunk.words) + 1, np.int64)
        for some in (chunk.starts[later], chunk.starts[elsewhere]):
            np.add.at(change, some, 1)
            np.add.at(change, some + window, -1)
        gone = np.cumsum(change)[:-1] > 0
        out = []
        for i, k in enumerate(chunk.keys):
            a, b = chunk.first[i], chunk.first[i + 1]
            kept = b" ".join([chunk.known[c] for c in chunk.codes[a:b][~gone[a:b]].tolist()])
            out.append((k, int(b - a), int(gone[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        names = ["key", "n_words", "n_removed", "kept_sha256", "kept"]
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = chunks.ask(ask_names, shared_by_chunks(NAME_BYTES), 1)
    windows = chunks.ask(ask_windows, _first_wins, 2, names)
    out = chunks.finish(finish, "key long, n_words long, n_removed long, kept_sha256 string, kept string", names.unionByName(windows))
    out = out.withColumnRenamed("key", key)
    return out if with_text else out.drop("kept")
