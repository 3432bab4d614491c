"""Quality classifier: a label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Labellers vote good, bad or nothing on every document: style (capitals, symbols, repeated words, table bars), a
lexicon of word beginnings learned from a bounded sample of annotated documents, and the annotations themselves where
there are any. Expectation-maximisation over the counts of vote patterns (at most 3^6 rows) estimates each labeller's
accuracy and every pattern's posterior. The posteriors of a bounded sample train a sparse logistic scorer on hashed
words and word beginnings, which then scores every whole text. Counts and votes cover all documents; the two bounded
samples are ``labelled`` and ``trained`` documents, picked by hash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.words import joined, pieces, process_cache, words_of
from attest.session import ship_with_plans, written

ship_with_plans(__name__)

#: Annotated documents the lexicon is learned from, at most.
LABELLED = 20_000
#: Texts the scorer is trained on, at most: half of them annotated and half not, where there are as many.
TRAINED = 8_000
#: Entries of the lexicon, at most.
LEXICON = 5_000
SURPRISE = 20.0
UNANNOTATED = 0.1
#: A document whose votes alone leave it less chance than this is rejected whatever its score.
SURELY_BAD = 0.02
#: Share of the bad documents an entry has to stand in, so that the words of one family of copies make none.
LEAST_SHARE = 0.02
BITS = 20
#: Words a worker remembers, at most.
CACHE_WORDS = 150_000
PIECE_BYTES = 2_000_000
BEGINNINGS = (4, 5, 6)
LABELLERS = ("capitals", "symbols", "repeats", "bars", "lexicon", "annotation")
GOOD, BAD, NONE = 1, 0, 2
_SYMBOLS = np.frombuffer(b"%#$&*^~<>{}[]=+\\@!", np.uint8)
_STYLE = len(LABELLERS) - 1


_LOW = (1 << BITS) - 1


def _hashed(word: bytes) -> bytes:
    plain = word.decode("utf-8", "replace").lower().strip(".,;:!?%#$&*|()\"'")
    names = [plain, *[f"{plain[:k]}\0" for k in BEGINNINGS if len(plain) >= k]]
    return array("i", [xxhash.xxh64_intdigest(n) & _LOW for n in names]).tobytes()


def _hashes(words: list[bytes]) -> list[bytes]:
    """The hashed features of words, as 32-bit integers; a worker remembers some words."""
    known = process_cache("hashed_words")
    if len(known) > CACHE_WORDS:
        known.clear()
    out = list(map(known.get, words))
    for i in [i for i, h in enumerate(out) if h is None]:
        out[i] = known[words[i]] = _hashed(words[i])
    return out


def _twice(features: np.ndarray) -> np.ndarray:
    """The feature "two or more different words of the text have this"."""
    return features & ~_LOW | (features * 0x9E3779B1 + 0x85EBCA6B) & _LOW


def relevant(features: np.ndarray) -> np.ndarray:
    """Which features have to be looked at to find the given ones."""
    wanted = np.zeros(1 << BITS, bool)
    wanted[features] = True
    return wanted | wanted[_twice(np.arange(1 << BITS))]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[new], np.diff(np.append(new, len(x)))


class Features:
    """Style votes of some texts and their hashed features, ``doc << BITS | feature``, sorted and distinct.

    With ``only``, just the features that it marks are looked at.
    """

    def __init__(self, texts: pa.Array, only: np.ndarray | None = None):
        data, starts = joined(texts)
        words, first = words_of(data, starts)
        self.n = len(texts)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded.dictionary.to_pylist()
        doc = np.repeat(np.arange(self.n), np.diff(first))
        n_words = np.diff(first)
        hashes = _hashes(known)
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes)) // 4
        flat = np.frombuffer(b"".join(hashes), np.int32).astype(np.int64)
        some = np.ones(len(codes), bool)
        if only is not None:
            owner = np.repeat(np.arange(len(sizes)), sizes)[only[flat]]
            flat = flat[only[flat]]
            sizes = np.bincount(owner, minlength=len(sizes))
            some = (sizes > 0)[codes] if len(codes) else some
        pairs, _ = _distinct(doc[some] * max(len(known), 1) + codes[some])
        at, code = pairs // max(len(known), 1), pairs % max(len(known), 1)
        n = sizes[code] if len(code) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        index = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n) + np.arange(n.sum()) if len(code) else n
        pairs, seen = _distinct(np.repeat(at, n) << BITS | flat[index])
        # A beginning of two or more different words of a text is one more feature.
        self.pairs, _ = _distinct(np.concatenate([pairs, _twice(pairs[seen > 1])]))
        self.votes = np.full((self.n, _STYLE), NONE, np.int64)
        capital = (data >= 65) & (data <= 90)
        letter = capital | ((data >= 97) & (data <= 122)) | (data >= 0xC0)
        symbol = np.isin(data, _SYMBOLS)
        same = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        bar = pc.equal(words, pa.scalar(b"|", pa.large_binary())).to_numpy(zero_copy_only=False)
        enough = n_words >= 5
        per_word = np.maximum(n_words, 1)
        shares = [
            (self._sums(capital, starts) / np.maximum(self._sums(letter, starts), 1), 0.3, 0.6),
            (self._sums(symbol, starts) / per_word, 0.2, 0.6),
            (np.bincount(doc[1:][same], minlength=self.n) / per_word, 0.1, 0.3),
            (np.bincount(doc[bar.astype(bool)], minlength=self.n) / per_word, 0.02, 0.1),
        ]
        for i, (share, low, high) in enumerate(shares):
            self.votes[enough & (share < low), i] = GOOD
            self.votes[enough & (share > high), i] = BAD

    @staticmethod
    def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[starts[1:]] - total[starts[:-1]]

    def look_up(self, lexicon: np.ndarray) -> None:
        hits = np.bincount(self.pairs[np.isin(self.pairs & _LOW, lexicon)] >> BITS, minlength=self.n)
        self.votes[:, 4] = np.where(hits >= 2, BAD, np.where(hits == 0, GOOD, NONE)) if len(lexicon) else NONE

    def all(self) -> np.ndarray:
        """The hashed features with one for each labeller's bad vote, above the hashed ones."""
        at, labeller = np.nonzero(self.votes == BAD)
        return _distinct(np.concatenate([self.pairs, at << BITS | labeller]))[0]


def _lexicon(docs: DataFrame, labels: DataFrame, labelled: int) -> np.ndarray:
    """Hashed words and beginnings that bad documents have and good ones hardly ever do."""
    some = labels.orderBy(F.xxhash64("key"), "key").limit(labelled)
    sample = docs.join(F.broadcast(some), "key").dropDuplicates(["print"]).select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                pairs = Features(part.column("text")).pairs
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)[pairs >> BITS]
                both = (pairs & _LOW) * 2 + good
                ids, n = np.unique(both, return_counts=True)
                columns = [ids // 2, np.where(ids % 2 == 0, n, 0), np.where(ids % 2 == 1, n, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["f", "bad", "good"])

    sums = sample.mapInArrow(count, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = sample.agg(F.count_if(~F.col("good")).alias("bad"), F.count("*").alias("n")).first()
    share = (counts["bad"] + 1) / (counts["n"] + 2)
    base = share / (1 - share)
    ratio = (F.col("bad") + 0.1) / (F.col("good") + 0.1)
    seen = F.col("bad") + F.col("good")
    # Twice the log-likelihood ratio against "bad as often as any document"; 20 is far beyond chance for a million words.
    part = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (seen * (1 - share)))).otherwise(0.0)
    surprise = 2 * (F.col("bad") * F.log(F.col("bad") / (seen * share)) + part)
    chosen = sums.where(F.col("bad") >= max(3.0, LEAST_SHARE * counts["bad"])).where((ratio >= 20 * base) & (surprise >= SURPRISE)).orderBy(F.desc("bad"), "f").limit(LEXICON)
    return np.array(sorted(r["f"] for r in chosen.collect()), np.int64)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of good for each vote pattern, and ``accuracy[labeller, class, vote]``, by EM.

    Starts from the annotation where there is one and else from whether any labeller votes bad. Documents without an
    annotation weigh ``UNANNOTATED`` in the estimates, so that many of them cannot pull the classes elsewhere.
    """
    counts = counts * np.where(patterns[:, -1] == NONE, UNANNOTATED, 1.0)
    start = np.where((patterns[:, :-1] == BAD).any(axis=1), 0.1, 0.9)
    start = np.where(patterns[:, -1] == NONE, start, np.where(patterns[:, -1] == GOOD, 0.99, 0.01))
    good, votes = start, np.stack([(patterns == v) for v in (BAD, GOOD, NONE)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        rates = np.einsum("cp,plv->lcv", weight, votes) + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        log = np.log(prior)[None, :] + np.einsum("plv,lcv->pc", votes, np.log(rates))
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return good, rates


def train(doc: np.ndarray, feature: np.ndarray, good: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse logistic weights ``(features, weights, bias)`` of good, by accelerated proximal steps; text ``doc[i]`` has ``feature[i]``.

    Both classes weigh the same while the weights are found, the bias then gets their true shares; a feature has to stand in about four documents of the rarer class to count.
    """
    n, seen = len(good), np.bincount(feature, minlength=1 << BITS)
    ids = np.flatnonzero(seen >= 2)
    place = np.zeros(1 << BITS, np.int32)
    place[ids] = np.arange(len(ids))
    some = seen[feature] >= 2
    doc, feature = doc[some], place[feature[some]]
    del some
    weight = np.where(good > 0.5, 0.5 / max((good > 0.5).sum(), 1), 0.5 / max((good <= 0.5).sum(), 1))
    penalty = max(5e-4, 2.0 * float(weight.max()))
    w = z = np.zeros(len(ids))
    bias = zb = 0.0
    step, t = 0.5, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, z[feature], n) + zb, -30, 30)))
        error = weight * (p - good)
        move = z - step * np.bincount(feature, error[doc], len(ids))
        new = np.sign(move) * np.maximum(np.abs(move) - step * penalty, 0)
        bias_new, t_new = zb - step * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_new * (new - w), bias_new + (t - 1) / t_new * (bias_new - bias)
        if np.dot(z - new, new - w) > 0:
            t_new, z, zb = 1.0, new, bias_new
        w, bias, t = new, bias_new, t_new
    some = w != 0
    shares = np.log(((good > 0.5).sum() + 1) / ((good <= 0.5).sum() + 1))
    return ids[some], w[some], float(bias + shares)


def drawn(judged: DataFrame, trained: int) -> DataFrame:
    """``print, posterior`` and least ``key`` of at most ``trained`` distinct texts of ``judged``, picked by hash.

    Annotated texts and the others get half each, so that the posteriors of both train the scorer; what one of them
    lacks the other gets.
    """
    texts = written(judged.groupBy("print").agg(F.min("posterior").alias("posterior"), F.max("known").alias("known"), F.min("key").alias("key")), "texts")
    there = {r["known"]: r["count"] for r in texts.groupBy("known").count().collect()}
    annotated = max(trained // 2, trained - there.get(False, 0))
    others = trained - min(annotated, there.get(True, 0))
    parts = [texts.where(which).orderBy(F.xxhash64("print"), "print").limit(n) for which, n in (("known", annotated), ("NOT known", others))]
    return parts[0].union(parts[1]).drop("known")


def one_each(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``print, posterior, text``: one row for each text of ``sample``, however many copies ``rows`` holds.

    Only copies with the least key are kept, of which each partition sends one.
    """
    held = F.broadcast(sample.select(F.col("print").alias("held"), F.col("key").alias("least"), "posterior"))
    same = (rows["print"] == F.col("held")) & rows["key"].eqNullSafe(F.col("least"))
    return rows.join(held, same).select("print", "posterior", "text").dropDuplicates(["print"])


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: int = LABELLED,
            trained: int = TRAINED) -> DataFrame:
    """``key, print, posterior, score, keep``, one row for each row of ``docs``; rejected documents have keep false.

    ``labels`` has the key, ``quality`` and ``toxic``; a document is good when quality is 1 and toxic 0, nulls count
    as not known, and of several annotations a bad one holds. ``posterior`` is the label model's, ``score`` the
    scorer's probability of good. A null or empty text, or one of fewer than five words, gets no style votes.
    ``print`` tells rows that share a key apart by their text; rows with a null key have no annotation; repeated rows
    stay; no rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).cast("binary").alias("text"))
    key_type = docs.schema[key].dataType.simpleString()
    marked = labels.select(F.col(key).alias("key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    marked = marked.where("key IS NOT NULL AND good IS NOT NULL").groupBy("key").agg(F.min("good").alias("good"))
    marked = written(marked, "marked")
    lexicon = _lexicon(rows, marked, labelled)

    in_lexicon = relevant(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = Features(part.column("text"), in_lexicon)
                found.look_up(lexicon)
                code = found.votes @ 3 ** np.arange(_STYLE)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("print"), pa.array(code)], ["key", "print", "votes"])

    votes = written(rows.mapInArrow(vote, f"key {key_type}, print long, votes long"), "votes")
    annotation = F.when(F.col("good"), GOOD).when(~F.col("good"), BAD).otherwise(NONE)
    votes = votes.join(marked, "key", "left").select("key", "print", (F.col("votes") + 3**_STYLE * annotation).alias("votes"))
    counted = votes.groupBy("votes").count().collect()
    codes = np.array([r["votes"] for r in counted], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posteriors, _ = label_model(patterns, np.array([r["count"] for r in counted], float))
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posteriors)], "votes long, posterior double")
    known = F.expr(f"votes DIV {3**_STYLE} <> {NONE}")
    judged = written(votes.join(F.broadcast(table), "votes").select("key", "print", "posterior", known.alias("known")), "judged")

    sample = drawn(judged, trained)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = Features(part.column("text"))
                found.look_up(lexicon)
                pairs = found.all()
                ends = np.searchsorted(pairs, np.arange(found.n + 1) << BITS)
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array((pairs & _LOW).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("print"), part.column("posterior"), lists], ["print", "posterior", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, good = [], [], []
        for batch in batches:
            lists = batch.column("f")
            rows.append(lists.flatten().to_numpy())
            sizes.append(lists.value_lengths().to_numpy())
            good.append(batch.column("posterior").to_numpy())
        if rows:
            n = np.concatenate(sizes)
            doc, feature = np.repeat(np.arange(len(n), dtype=np.int32), n), np.concatenate(rows)
            rows.clear()
            ids, weights, bias = train(doc, feature, np.concatenate(good))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(weights, bias))], ["f", "w"])

    listed = one_each(rows, sample).mapInArrow(features, "print long, posterior double, f array<int>")
    model = listed.repartition(1).sortWithinPartitions("print").mapInArrow(fit, "f long, w double").collect()
    dense = np.zeros(1 << BITS, np.float32)
    for r in model:
        if r["f"] >= 0:
            dense[r["f"]] = r["w"]
    weighted = in_lexicon | relevant(np.flatnonzero(dense))
    bias = next((r["w"] for r in model if r["f"] < 0), 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = Features(part.column("text"), weighted)
                found.look_up(lexicon)
                pairs = found.all()
                sums = np.bincount(pairs >> BITS, dense[pairs & _LOW], found.n) + bias
                chance = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("print"), pa.array(chance)], ["key", "print", "score"])

    scored = rows.mapInArrow(score, f"key {key_type}, print long, score double")
    judged = judged.groupBy("key", "print").agg(F.first("posterior").alias("posterior"))
    same = scored["key"].eqNullSafe(judged["key"]) & (scored["print"] == judged["print"])
    return scored.join(judged, same).select(
        scored["key"].alias(key), scored["print"], "posterior", "score", ((F.col("score") >= 0.5) & (F.col("posterior") >= SURELY_BAD)).alias("keep")
    )


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    found = quality(docs, labels, key, text, **options).where("NOT keep")
    bad = found.select(F.col(key).alias("__key"), F.col("print").alias("__print")).distinct()
    same = docs[key].eqNullSafe(bad["__key"]) & (F.xxhash64(docs[text]) == bad["__print"])
    return docs.join(bad, same, "left_anti")
