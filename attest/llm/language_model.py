"""Language-model scoring with a weighted backoff automaton over the whole corpus.

The model counts words, word pairs and triples of the training documents. Its states are the histories: the root, every
word h, and every pair (g, h) that was read at least ``LEAST_STATE`` times. A seen n-gram is an arc of its history with
weight (c(history, w) + m P(w)) / (c(history) + m), where P is the weight that the next shorter history gives w, and
every state has a failure arc to that history, with weight m / (c(history) + m): from (g, h) to h and from h to the
root, where any word has its smoothed weight (c(w) + a) / (N + a (V + 1)). The arcs of a state and its failure arc sum
to one over the vocabulary and one unknown word. A text is read once from left to right: each word takes an arc of the
state or fails to shorter ones until it finds one, adds the logarithm of what it took, and leads to the longest history
that is a state.

The automaton is never in one place. Each chunk asks the buckets of a hash space for the counts of the words and pairs
it has, each once, then for those of the triples whose first two words are a state, and so gets the part of the
automaton that its own texts can visit. Pairs and triples go by names of 80 bits: that any two of 10^10 share one is a
chance of one in 20,000.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.chunks import BUCKET, Chunks, answers_of, bucket_of, mixed, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from attest.llm.words import joined, words_of
from attest.session import ship_with_plans

ship_with_plans(__name__)

ADDED = 0.1
#: m: how many readings of a state its failure arc counts for, by the words of the history.
STRENGTHS = (20.0, 5.0)
#: Readings that make a pair a state.
LEAST_STATE = 2
CHUNK_BYTES = 8_000_000
#: Names that are made at a time.
_SLICE = 1 << 16
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_OTHER = np.uint64(0xA0761D6478BD642F)


def held_out(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def _named(history: np.ndarray, low: np.ndarray | None, word: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64 and 16 bits that name each history ``of`` followed by the word ``at``, a slice at a time."""
    high, rest = np.empty(len(of), np.uint64), np.empty(len(of), np.uint16)
    for i in range(0, len(of), _SLICE):
        some = slice(i, i + _SLICE)
        h, w = history[of[some]], word[at[some]]
        more = np.uint64(0) if low is None else low[of[some]].astype(np.uint64)
        with np.errstate(over="ignore"):
            high[some] = mixed(h * np.uint64(5) + mixed(w + more))
            rest[some] = mixed(h * np.uint64(7) + mixed(w ^ _OTHER) + more) >> np.uint64(48)
    return high, rest


class _Grams:
    """The different n-grams of a chunk in the order of their names, how often its training texts have each, and which each reading is."""

    def __init__(self, high: np.ndarray, low: np.ndarray, which: np.ndarray, counts: np.ndarray, buckets: int):
        self.high, self.low, self.which, self.counts = high, low, which, counts
        self.cuts = np.searchsorted(bucket_of(high, buckets), np.arange(buckets + 1))

    @staticmethod
    def read(high: np.ndarray, low: np.ndarray, train: np.ndarray, buckets: int) -> _Grams:
        """Of the names of all readings. One that shares its upper bits with another may come twice: its bucket adds both up."""
        order = np.argsort(high)
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        starts = np.flatnonzero(new)
        high, low = high[starts], low[starts]
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        counts = np.add.reduceat(train[order], starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
        return _Grams(high, low, which, counts, buckets)

    def payload(self, bucket: int) -> bytes:
        some = slice(*self.cuts[bucket : bucket + 2])
        return pack_counts(self.counts[some]) + pack_sorted(self.high[some]) + self.low[some].astype("<u2").tobytes()

    def totals(self, payloads: list[bytes], at: list[int], asked: list[int]) -> np.ndarray:
        """The counts that buckets answered; ``at`` moves on in each payload."""
        out = np.zeros(len(self.high), np.int64)
        for i, b in enumerate(asked):
            out[slice(*self.cuts[b : b + 2])], at[i] = unpack_counts(payloads[i], at[i])
        return out


def _asked(*grams: _Grams) -> list[int]:
    """The buckets that a chunk has anything for."""
    return np.flatnonzero(np.sum([np.diff(g.cuts) for g in grams], axis=0)).tolist()


class _Chunk:
    """Tokens of a chunk's texts (ends included), and its words and pairs."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.keys, self.buckets = rows.column("key").to_pylist(), buckets
        data, starts = joined(rows.column("text"))
        # Arrays are as long as the texts have bytes or words: each goes when it has been read, and none is wider than it must be.
        lower = data | (((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5))
        del data
        words, first = words_of(lower, starts)
        del lower
        coded = words.dictionary_encode()
        del words
        known = coded.dictionary.to_pylist()
        end, start = len(known), len(known) + 1
        self.hashes = np.fromiter(chain(map(xxhash.xxh64_intdigest, known), (_END, _START)), np.uint64, end + 2)
        del known
        self.codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), first[1:], end)
        del coded
        self.first = first + np.arange(len(first))
        before = np.empty(len(self.codes), np.int32)
        before[1:] = self.codes[:-1]
        before[self.first[:-1]] = start
        self.held = np.array([held_out(k) for k in self.keys], bool)
        self.train = ~np.repeat(self.held, np.diff(self.first))
        # The start is read as a history only, of which there are as many as ends.
        order = np.argsort(self.hashes[: end + 1])
        place = np.empty(end + 2, np.int32)
        place[order] = np.arange(end + 1, dtype=np.int32)
        place[start] = place[end]
        which = place[self.codes]
        counts = np.bincount(which[self.train], minlength=end + 1)
        self.words = _Grams(self.hashes[order], np.zeros(end + 1, np.uint16), which, counts, buckets)
        self.history = place[before]
        self.pairs = _Grams.read(*_named(self.hashes, None, self.hashes, before, self.codes), self.train, buckets)

    def counts(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        asked, payloads = _asked(self.words, self.pairs), answers_of(answers, 1)
        at = [0] * len(payloads)
        return self.words.totals(payloads, at, asked), self.pairs.totals(payloads, at, asked)

    def triples(self, pairs: np.ndarray, least: int) -> tuple[np.ndarray, _Grams]:
        """Which tokens are read in the state of a pair, and the triples they make."""
        within = np.ones(len(self.codes), bool)
        within[self.first[:-1]] = False
        within[1:] &= (pairs >= least)[self.pairs.which[:-1]]
        some = np.flatnonzero(within).astype(np.int32)
        names = _named(self.pairs.high, self.pairs.low, self.hashes, self.pairs.which[some - 1], self.codes[some])
        return some, _Grams.read(*names, self.train[some], self.buckets)


def _totals(kinds: int):
    """Answer: the total counts of every message's n-grams of each kind; with two kinds also the bucket's tokens and different words."""

    def answer(payloads: list[bytes]) -> list[bytes]:
        parts, out, own = [0] * len(payloads), [b""] * len(payloads), b""
        for kind in range(kinds):
            highs, lows, counts = [], [], []
            for i, payload in enumerate(payloads):
                n, at = unpack_counts(payload, parts[i])
                high, at = unpack_sorted(payload, at)
                lows.append(np.frombuffer(payload, "<u2", len(n), at))
                parts[i] = at + 2 * len(n)
                highs.append(high)
                counts.append(n)
            high, low, n = (np.concatenate(x) for x in (highs, lows, counts))
            order = np.lexsort((low, high))
            new = np.ones(len(order), bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            sums = np.bincount(group, n, int(new.sum())).astype(np.int64)
            total, at = sums[group], 0
            for i, c in enumerate(counts):
                out[i] += pack_counts(total[at : at + len(c)])
                at += len(c)
            if kind == 0:
                own = np.array([sums.sum(), (sums > 0).sum()], ">i8").tobytes()
        return [*out, own] if kinds > 1 else out

    return answer


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", added: float = ADDED, strengths: tuple[float, float] = STRENGTHS,
                least_state: int = LEAST_STATE, chunk_bytes: int = CHUNK_BYTES, **options) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row for each row of ``docs``.

    Keys are whole numbers. The model learns from the texts whose crc32 of the key, written out, is no multiple of
    ten (a null key counts as an empty string, so it is held out). Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    in lower case and one end, also of a null or empty text. ``base_score`` is the text's log10 probability under
    single words, ``score`` the automaton's; ``n_known`` counts tokens seen in training, ``train_tokens`` all of those.
    Rows that share a key are texts of their own, repeated rows count as often as they come; no rows give no rows.
    Other columns are not read.
    """
    chunks = Chunks(docs, key, text, chunk_bytes, **options)
    buckets = chunks.buckets

    def ask(rows: pa.Table, _):
        chunk = _Chunk(rows, buckets)
        for b in _asked(chunk.words, chunk.pairs):
            yield b, chunk.words.payload(b) + chunk.pairs.payload(b)

    def ask_triples(rows: pa.Table, answers: pa.Table):
        chunk = _Chunk(rows, buckets)
        _, triples = chunk.triples(chunk.counts(answers)[1], least_state)
        for b in _asked(triples):
            yield b, triples.payload(b)

    counts = chunks.ask(ask, _totals(2), 1)
    sums = counts.where(F.col("chunk") == BUCKET).select(
        *[F.conv(F.hex(F.substring("payload", i, 8)), 16, 10).cast("long").alias(n) for i, n in ((1, "n"), (9, "v"))]
    ).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, different = sums["n"] or 0, sums["v"] or 0
    counts = counts.where(F.col("chunk") != BUCKET)
    more = chunks.ask(ask_triples, _totals(1), 2, counts)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, buckets)
        word, pair = chunk.counts(answers)
        some, triples = chunk.triples(pair, least_state)
        payloads = answers_of(answers, 2)
        triple = triples.totals(payloads, [0] * len(payloads), _asked(triples))
        root = (word + added) / (tokens + added * (different + 1))
        seen, weight = word[chunk.words.which], root[chunk.words.which]
        # From the root up the failure arcs: what a state's arc weighs takes in what the shorter history gives.
        state = word[chunk.history]
        taken = (pair[chunk.pairs.which] + strengths[0] * weight) / (state + strengths[0])
        state = pair[chunk.pairs.which[some - 1]]
        taken[some] = (triple[triples.which] + strengths[1] * taken[some]) / (state + strengths[1])
        owner = np.repeat(np.arange(len(chunk.keys)), np.diff(chunk.first))
        sums = [np.bincount(owner, x, len(chunk.keys)) for x in (seen > 0, np.log10(weight), np.log10(taken))]
        return pa.table({
            "key": pa.array(chunk.keys, pa.int64()), "held_out": pa.array(chunk.held), "n_tokens": pa.array(np.diff(chunk.first)),
            "n_known": pa.array(sums[0].astype(np.int64)), "train_tokens": pa.array(np.full(len(chunk.keys), tokens, np.int64)),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    schema = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.finish(finish, schema, counts.unionByName(more)).withColumnRenamed("key", key)
