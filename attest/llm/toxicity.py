"""Toxicity: a weighted finite-state grammar of clauses, whose lexicon and weights are learned from labels.

Words become symbols (insult, threat, target, negation, report, other) with a lexical weight. Five small transducers
read the symbols of a clause side by side: insults and threats, a target shortly before, a target shortly after, a
negation, reported speech. They are composed into one machine, which emits for every insult or threat the pattern it
stands in; a match weighs its word's weight and its pattern's. The matched clauses of a text give its score.

The insult arcs are words and word beginnings that toxic texts hold far more often than others; the longest known
beginning of a word decides, as in a backoff automaton. Arcs, pattern weights and the final scale are fitted on
``TOXIC`` and ``CLEAN`` labelled texts at most, picked by hash; every whole text of the table is then scored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.words import joined, pieces, process_cache, words_of
from attest.session import ship_with_plans, written

ship_with_plans(__name__)

#: Distinct labelled texts that the grammar is fitted on, at most, by label.
TOXIC, CLEAN = 6_000, 12_000
#: Texts that hold an arc's word or beginning, at least, for it to decide over a shorter one.
SUPPORT = 8
SURPRISE = 20.0
LEAST_ODDS = 1.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Words of a clause, at most.
CLAUSE_WORDS = 40
#: Words that a pattern reaches over.
NEGATED, REPORTED, BEFORE, AFTER = 3, 12, 5, 3
#: Weight above which a clause hardly ever matches by chance.
SURE = 3.0
THRESHOLD = 0.7
CACHE_WORDS = 200_000
FACTS = 7
PIECE_BYTES = 2_000_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of the classes that are not learned. Fixed values.
LEXICON = {
    INSULT: "idiot moron scum trash loser dummkopf idiota imbécile abruti estúpido arschloch",
    THREAT: "kill hurt destroy stab shoot strangle töten umbringen erschießen tuer frapper égorger matar golpear destruir",
    TARGET: "you your u they them he she du dich dir ihr euch sie tu te toi vous ils tú ti usted ustedes ellos",
    NEGATION: "not no never neither nor nobody isn't aren't don't won't nicht kein keine keinen nie niemand pas jamais aucun nunca jamás ningún",
    REPORT: "said says called wrote writes quoted claimed sagte sagt schrieb nannte zitierte dit écrit appelé cité dijo dice escribió llamó citó",
}
SEED_WEIGHT = 2.0
#: Log odds that a pattern adds before anything is learned.
PRIOR = {"targeted": 0.5, "negated": -2.0, "reported": -2.0, "threat": -2.0, "aimed": 2.5}
PRIOR_MATCHES = 20.0


# The grammar.


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over (class, quoted): ``step`` gives the next state, ``marks`` what a match in it shows."""

    start: int
    step: Callable[[int, int, bool], int]
    marks: Callable[[int], frozenset] = lambda state: frozenset()


def _window(opens: Callable[[int, bool], bool], reach: int, mark: str) -> Transducer:
    """Marks matches up to ``reach`` words after what opens it."""
    return Transducer(0, lambda s, c, q: reach + 1 if opens(c, q) else max(s - 1, 0), lambda s: frozenset([mark] if s else []))


TRANSDUCERS = (
    _window(lambda c, q: c == NEGATION, NEGATED, "negated"),
    _window(lambda c, q: c == REPORT or q, REPORTED, "reported"),
    _window(lambda c, q: c == TARGET, BEFORE, "targeted"),
)
#: An insult or threat waits for a target that follows.
WAITING = Transducer(0, lambda s, c, q: AFTER + 1 if c in (INSULT, THREAT) else 0 if c == TARGET else max(s - 1, 0))


@dataclass
class Machine:
    """The composition: ``next[state, symbol]`` and ``emit[state, symbol]``, an index into ``patterns`` or -1."""

    next: np.ndarray
    emit: np.ndarray
    patterns: list[frozenset] = field(default_factory=list)


def compose(windows: tuple[Transducer, ...] = TRANSDUCERS, waiting: Transducer = WAITING) -> Machine:
    """One machine for all transducers, by breadth-first search of the states that are reached together.

    A symbol is ``2 * class + quoted``. A match emits its marks; a target that a match waits for emits ``late``.
    """
    parts = (*windows, waiting)
    start = tuple(p.start for p in parts)
    number, queue, patterns = {start: 0}, [start], {}
    nexts, emits = [], []
    for states in queue:
        row, out = [], []
        for symbol in range(2 * len(LEXICON) + 2):
            c, q = symbol >> 1, bool(symbol & 1)
            after = tuple(p.step(s, c, q) for p, s in zip(parts, states))
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
            pattern = None
            if c in (INSULT, THREAT):
                pattern = frozenset([c]).union(*[p.marks(s) for p, s in zip(windows, after)])
            elif c == TARGET and states[-1]:
                pattern = frozenset(["late"])
            row.append(number[after])
            out.append(-1 if pattern is None else patterns.setdefault(pattern, len(patterns)))
        nexts.append(row)
        emits.append(out)
    return Machine(np.array(nexts, np.int32), np.array(emits, np.int32), list(patterns))


def prior_weight(pattern: frozenset) -> float:
    weight = sum(PRIOR[m] for m in ("negated", "reported") if m in pattern)
    if THREAT in pattern:
        return weight + PRIOR["threat"] + (PRIOR["aimed"] if "targeted" in pattern else 0)
    return weight + (PRIOR["targeted"] if pattern & {"targeted", "late"} else 0)


def learned_weights(machine: Machine, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Each pattern's weight: log odds of its matches against those of plain insults, drawn to the prior where few.

    ``toxic`` and ``clean`` count the matches of each pattern in texts of either label, each text weighing one.
    """
    plain = machine.patterns.index(frozenset([INSULT]))
    base = np.log((toxic[plain] + 1) / (clean[plain] + 1))
    out = np.zeros(len(machine.patterns))
    for i, pattern in enumerate(machine.patterns):
        share = 1 / (1 + np.exp(-(base + prior_weight(pattern))))
        odds = np.log((toxic[i] + PRIOR_MATCHES * share) / (clean[i] + PRIOR_MATCHES * (1 - share)))
        out[i] = np.clip(odds - base, -4, 4)
    out[plain] = 0
    return out


# Words.

_EDGES = ".,;:!?%#$&*|()[]{}<>\"'«»„“”‚‘’…¡¿-_"
_ENDS = (".", "!", "?", ";", "…")
_QUOTES = ("\"", "«", "»", "„", "“", "”")


def arc_names(plain: str) -> list[str]:
    """The word and its beginnings, longest first; a word ends with a blank, which no beginning does."""
    return [plain + " ", *[plain[:k] for k in reversed(BEGINNINGS) if len(plain) >= k]]


def plain_word(word: bytes) -> tuple[str, bool, bool]:
    """The word in lower case without what surrounds it; whether a quotation mark does; whether a clause ends with it."""
    text = word.decode("utf-8", "replace").lower()
    plain = text.strip(_EDGES)
    return plain, any(q in text for q in _QUOTES), text.rstrip("\"'«»“”)").endswith(_ENDS)


@dataclass
class Grammar:
    """All that scoring needs."""

    arcs: dict[str, float]
    machine: Machine = field(default_factory=compose)
    weights: np.ndarray | None = None
    scale: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.classes = {w: c for c, words in LEXICON.items() for w in words.split()}
        if self.weights is None:
            self.weights = np.array([prior_weight(p) for p in self.machine.patterns])

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, lexical weight and clause end of each word; a worker remembers some words."""
        known = process_cache(f"toxicity-{self.name}")
        if len(known) > CACHE_WORDS:
            known.clear()
        out = list(map(known.get, words))
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = known[words[i]] = self._code(words[i])
        packed = np.fromiter(out, np.int64, len(out))
        return (packed & 31).astype(np.int8), (packed >> 8) / 1e4, (packed & 32) > 0

    def _code(self, word: bytes) -> int:
        plain, quoted, ends = plain_word(word)
        kind = self.classes.get(plain, OTHER)
        # The longest beginning that was seen often enough decides.
        weight = next((self.arcs[a] for a in arc_names(plain) if a in self.arcs), SEED_WEIGHT if kind == INSULT else 0.0) if plain else 0.0
        if weight > 0 and kind in (OTHER, INSULT):
            kind = INSULT
        elif kind == INSULT:
            kind = OTHER
        if kind == THREAT:
            weight = SEED_WEIGHT
        return int(round(max(weight, 0) * 1e4)) << 8 | ends << 5 | kind << 1 | quoted


@dataclass
class Matches:
    """The matches of some texts: text, pattern, word (as a number), lexical weight, clause (first word, number of words)."""

    n: int
    n_words: np.ndarray
    doc: np.ndarray
    pattern: np.ndarray
    word: np.ndarray
    lexical: np.ndarray
    clause: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    words: pa.Array


def matches(texts: pa.Array, grammar: Grammar) -> Matches:
    """Run the machine over the clauses that hold an insult or a threat."""
    data, starts = joined(texts)
    words, first = words_of(data, starts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(first))
    coded = words.dictionary_encode()
    symbols, lexical, ends = grammar.coded(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        none = np.zeros(0, np.int64)
        return Matches(n, np.diff(first), none, none, none, none.astype(float), none, none, none, words)
    symbol, lexical, ends = symbols[codes], lexical[codes], ends[codes]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    line = np.cumsum(data == 10)[at]
    new = np.ones(len(codes), bool)
    new[1:] = ends[:-1] | (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begun = np.flatnonzero(new)
    place = np.arange(len(codes)) - np.repeat(begun, np.diff(np.append(begun, len(codes))))
    begun = np.flatnonzero(place % CLAUSE_WORDS == 0)
    sizes = np.diff(np.append(begun, len(codes)))
    clause = np.repeat(np.arange(len(begun)), sizes)
    wanted = np.unique(clause[(symbol >> 1 == INSULT) | (symbol >> 1 == THREAT)])
    wanted = wanted[np.argsort(-sizes[wanted], kind="stable")]
    state, found = np.zeros(len(wanted), np.int32), []
    most = int(sizes[wanted[0]]) if len(wanted) else 0
    machine = grammar.machine
    for step in range(most):
        # Longer clauses come first, so those that go on are the first ones.
        going = int(np.searchsorted(-sizes[wanted], -step, "left"))
        word = begun[wanted[:going]] + step
        emitted = machine.emit[state[:going], symbol[word]]
        state[:going] = machine.next[state[:going], symbol[word]]
        hit = np.flatnonzero(emitted >= 0)
        found.append(np.stack([word[hit], emitted[hit]]))
    word, pattern = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    order = np.argsort(word, kind="stable")
    word, pattern = word[order], pattern[order]
    return Matches(n, np.diff(first), doc[word], pattern, codes[word], lexical[word], clause[word], begun, sizes, words)


def facts(found: Matches, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """What a text is scored by, a row for each text, and its best clause or -1.

    The best clause's weight and what of it lies above ``SURE``, the logs of the sum of all and of what single clauses
    have above ``SURE``, that sum against the words, and the log of the words.
    """
    weight = found.lexical + grammar.weights[found.pattern]
    late = found.lexical == 0
    weight[late] = grammar.weights[found.pattern[late]]
    # A word that a clause repeats counts once there, where it weighs most.
    order = np.lexsort((weight, found.word, found.clause))
    last = np.ones(len(order), bool)
    last[:-1] = (np.diff(found.word[order]) != 0) | (np.diff(found.clause[order]) != 0)
    weight[order[~last]] = 0
    clauses, inverse = np.unique(found.clause, return_inverse=True)
    sums = np.bincount(inverse, weight, len(clauses)) if len(clauses) else np.zeros(0)
    owner = np.zeros(len(clauses), np.int64)
    owner[inverse] = found.doc
    good = sums > 0
    total = np.bincount(owner[good], sums[good], found.n)
    best, which = np.zeros(found.n), np.full(found.n, -1)
    # The last of a text's clauses in ascending order of weight is its best; of equal ones the first in the text.
    order = np.lexsort((-clauses, sums))
    order = order[good[order]]
    best[owner[order]], which[owner[order]] = sums[order], clauses[order]
    words = np.maximum(found.n_words, 1)
    sure = np.bincount(owner, np.maximum(sums - SURE, 0), found.n)
    columns = [np.ones(found.n), best, np.maximum(best - SURE, 0), np.log1p(total), np.log1p(sure), np.log1p(100 * total / words), np.log1p(words)]
    return np.stack(columns, axis=1), which


def chance(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ scale, -50, 50)))


def fitted(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic scale by Newton steps; the parts of a match never speak against toxicity."""
    free, scale = np.ones(x.shape[1], bool), np.zeros(x.shape[1])
    while True:
        scale[:] = 0
        for _ in range(30):
            p = chance(x[:, free], scale[free])
            slope = x[:, free].T @ (weight * (toxic - p)) - ridge * scale[free]
            bend = (x[:, free] * (weight * p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(free.sum())
            scale[free] += np.clip(np.linalg.solve(bend, slope), -5, 5)
        wrong = free & (scale < 0)
        wrong[[0, -1]] = False
        if not wrong.any():
            return scale
        free &= ~wrong


# Fitting and scoring.


def labelled(docs: DataFrame, labels: DataFrame, held: Column, toxic: int, clean: int) -> tuple[DataFrame, dict[int, int]]:
    """``print, label, part, text``: at most ``toxic`` and ``clean`` distinct labelled texts; how many keys have each label.

    Rows of ``docs`` that ``held`` marks are left out. Part 3 of four is for the patterns and the scale.
    """
    known = labels.where("key IS NOT NULL AND label IS NOT NULL").where(~held).groupBy("key").agg(F.max("label").alias("label"))
    known = written(known.select("key", (F.col("label") > 0).cast("int").alias("label")), "known")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(n) for v, n in ((1, toxic), (0, clean))]
    some = F.broadcast(parts[0].union(parts[1]))
    # Copies give one text, toxic if one of them is; which of the equal texts is taken makes no difference.
    rows = docs.join(some, "key").groupBy("print").agg(F.max("label").alias("label"), F.first("text").alias("text"))
    return written(rows.withColumn("part", F.pmod(F.xxhash64(F.col("print"), F.lit(5)), F.lit(4))), "labelled"), counts


def learned_arcs(sample: DataFrame, support: int = SUPPORT) -> dict[str, float]:
    """Weights of words and beginnings: those that toxic texts hold far more often, and the longer ones that go on from them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for i in range(len(batch)):
                words, _ = words_of(*joined(batch.column("text").slice(i, 1)))
                names = {a for w in words.unique().to_pylist() if (p := plain_word(w)[0]) for a in arc_names(p)}
                total[batch.column("label")[i].as_py()].update(names)
            for label, c in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c.keys()), pa.string()), pa.array([n * (1 - label) for n in c.values()], pa.int64()),
                     pa.array([n * label for n in c.values()], pa.int64())], ["arc", "clean", "toxic"])

    sums = sample.select("label", "text").mapInArrow(count, "arc string, clean long, toxic long").groupBy("arc")
    sums = written(sums.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "arcs")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    seen = F.col("toxic") + F.col("clean")
    share = (t + 1) / (t + c + 2)
    rate = (F.col("toxic") + 0.5) / (t + 1.0) / ((F.col("clean") + 0.5) / (c + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    part = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * (1 - share)))).otherwise(0.0)
    surprise = 2 * (F.col("toxic") * F.log(F.greatest(F.col("toxic"), F.lit(1)) / (seen * share)) + part)
    judged = sums.withColumn("weight", F.log(rate) - spread).where(seen >= support)
    good = (F.col("weight") >= LEAST_ODDS) & (surprise >= SURPRISE) & (F.col("toxic") >= 3)
    arcs = {r["arc"]: r["weight"] for r in judged.where(good).collect()}
    roots = sorted({a for a in arcs if not a.endswith(" ")})
    if roots:
        under = F.lit(False)
        for k in BEGINNINGS:
            own = [a for a in roots if len(a) == k]
            under = under | F.substring("arc", 1, k).isin(own) if own else under
        for r in judged.where(under & ~good).collect():
            arcs[r["arc"]] = max(r["weight"], 0.0) if r["weight"] >= LEAST_ODDS else 0.0
    return arcs


def fit(sample: DataFrame, counts: dict[int, int], support: int = SUPPORT) -> Grammar:
    """Arcs from three quarters of the sample, patterns and scale from the last, which holds a bounded number of rows."""
    grammar = Grammar(learned_arcs(sample.where("part < 3"), support))
    kinds = len(grammar.machine.patterns)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = matches(part.column("text"), grammar)
                total = np.zeros((len(part), kinds))
                np.add.at(total, (found.doc, found.pattern), 1)
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1)
                label = part.column("label").to_numpy()
                sums = [total[label == v].sum(axis=0).tolist() for v in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(sums, pa.list_(pa.float64()))], ["label", "n"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                x, _ = facts(matches(part.column("text"), grammar), grammar)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    rows = sample.where("part = 3").select("label", "text")
    sums = rows.mapInArrow(match, "label long, n array<double>").collect()
    total = {v: np.sum([r["n"] for r in sums if r["label"] == v] or [np.zeros(kinds)], axis=0) for v in (0, 1)}
    grammar.weights = learned_weights(grammar.machine, total[1], total[0])
    known = rows.mapInArrow(weigh, "label int, x array<double>").collect()
    x, y = np.array([r["x"] for r in known] or np.zeros((0, FACTS))), np.array([r["label"] for r in known], float)
    # The sample's labels weigh as they occur among all labelled rows.
    share = {v: counts.get(v, 0) / max((y == v).sum(), 1) for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) * len(y) / max(sum(counts.values()), 1)
    # With few labels a plain insult alone decides.
    grammar.scale = fitted(x, y, weight) if min((y == 0).sum(), (y == 1).sum()) >= 5 else np.array([-3.0, 2.0] + [0.0] * (FACTS - 2))
    return grammar


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: int = TOXIC, clean: int = CLEAN,
             threshold: float = THRESHOLD) -> DataFrame:
    """``key, held_out, score, predicted, n_clauses, clause``, one row for each row of ``docs``.

    ``labels`` has the key and ``toxic``; nulls count as not known, and of several labels a toxic one holds. Rows whose
    key has a crc32 that leaves 1 when divided by 3 are held out of all fitting; a null key is neither held out nor
    labelled. ``clause`` is the words of the clause that weighs most, null where none matches. A null or empty text
    has no clause and gets the score of a text without a match; repeated rows stay; without labels the fixed lexicon
    and prior weights score; no rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).cast("binary").alias("text"))
    known = labels.select(F.col(key).alias("key"), F.col("toxic").alias("label"))
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % 3 == 1, F.lit(False))
    sample, counts = labelled(rows, known, held, toxic, clean)
    grammar = fit(sample, counts)
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = matches(part.column("text"), grammar)
                x, which = facts(found, grammar)
                many = np.bincount(found.doc[np.flatnonzero(np.diff(found.clause, prepend=-1))], minlength=found.n)
                best = [None if c < 0 else b" ".join(found.words.slice(found.starts[c], found.sizes[c]).to_pylist()).decode("utf-8", "replace") for c in which]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(chance(x, grammar.scale)), pa.array(many), pa.array(best, pa.string())],
                    ["key", "score", "n_clauses", "clause"])

    scored = rows.select("key", "text").mapInArrow(score, f"key {kind}, score double, n_clauses long, clause string")
    return scored.select(
        F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses", "clause")
