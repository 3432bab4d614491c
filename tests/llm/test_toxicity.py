"""The clause grammar: its machine against plain loops, what it learns, and held-out labels."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from attest.llm import toxicity as tox
from attest.llm.toxicity import Grammar, compose, facts, matches, prior_weight, toxicity

SCHEMA = "doc_id long, text string"


def walk(symbols):
    """The patterns of a clause, by looking around each match."""
    out = []
    for i, s in enumerate(symbols):
        c = s >> 1

        def seen(reach, want, i=i):
            return any(want(t) for t in symbols[max(0, i - reach) : i + 1])

        if c in (tox.INSULT, tox.THREAT):
            marks = {c}
            if seen(tox.NEGATED, lambda t: t >> 1 == tox.NEGATION):
                marks.add("negated")
            if seen(tox.REPORTED, lambda t: t >> 1 == tox.REPORT or t & 1):
                marks.add("reported")
            if seen(tox.BEFORE, lambda t: t >> 1 == tox.TARGET):
                marks.add("targeted")
            out.append((i, frozenset(marks)))
        elif c == tox.TARGET:
            back = [t >> 1 for t in symbols[max(0, i - tox.AFTER - 1) : i]]
            waiting = False
            for t in back:
                waiting = t in (tox.INSULT, tox.THREAT) or (waiting and t != tox.TARGET)
            if waiting:
                out.append((i, frozenset(["late"])))
    return out


def test_composed_machine_equals_a_walk():
    machine, rng = compose(), random.Random(1)
    for _ in range(400):
        symbols = [rng.choice([0, 0, 0, 0, 1, 2, 4, 6, 6, 8, 10, 3]) for _ in range(rng.randrange(30))]
        state, out = 0, []
        for i, s in enumerate(symbols):
            if machine.emit[state, s] >= 0:
                out.append((i, machine.patterns[machine.emit[state, s]]))
            state = machine.next[state, s]
        assert out == walk(symbols)


def weights(*texts):
    grammar = Grammar({})
    x, which = facts(matches(pa.array([t.encode() for t in texts], pa.binary()), grammar), grammar)
    return x[:, 1]


def test_patterns_not_words_decide():
    plain, negated, reported, quoted, targeted = weights(
        "such an idiot", "he is not an idiot", "The man said an idiot came", 'the word "idiot" is old', "You are an idiot")
    assert targeted > plain > max(negated, reported, quoted)
    threat, aimed, later = weights("the storm may kill", "I will find you and kill you", "kill them")
    assert aimed > threat and later > threat
    across, within = weights("You came. An idiot", "You, an idiot")
    assert within > across


def test_pieces_do_not_matter():
    rng = random.Random(2)
    words = ["idiot", "you", "not", "said", "kill", "a", "b.", "c\n", "\"scum\"", "du", "long" * 50]
    texts = [None, "", " \n ", *[" ".join(rng.choices(words, k=rng.choice([1, 5, 200]))) for _ in range(60)]]
    grammar = Grammar({"long": 1.5, "scum ": 2.0})
    raw = [None if t is None else t.encode() for t in texts]
    whole, _ = facts(matches(pa.array(raw, pa.binary()), grammar), grammar)
    single = [facts(matches(pa.array([t], pa.binary()), grammar), grammar)[0][0] for t in raw]
    assert np.allclose(whole, single)


def test_longest_beginning_decides():
    grammar = Grammar({"lowe": 3.0, "lowering ": 0.0, "lowest": 1.0})
    assert [grammar.coded([w])[1][0] for w in (b"lowe", b"Loweing!", b"lowering", b"lowests", b"low")] == [3.0, 3.0, 0.0, 1.0, 0.0]


def test_learned_weights_follow_labels_and_else_the_prior():
    machine = compose()
    none = np.zeros(len(machine.patterns))
    negated, plain = machine.patterns.index(frozenset([tox.INSULT, "negated"])), machine.patterns.index(frozenset([tox.INSULT]))
    toxic, clean = none.copy(), none.copy()
    toxic[plain], clean[plain] = 100, 10
    out = tox.learned_weights(machine, toxic, clean)
    assert abs(out[negated] - prior_weight(frozenset([tox.INSULT, "negated"]))) < 0.1
    toxic[negated] = 500
    assert tox.learned_weights(machine, toxic, clean)[negated] > 0


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.01 * len(clean)


def table(n):
    rng = random.Random(3)
    bad = ["grumpf", "vexoli", "idiot"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["tree", "house", "river", "walks", "sings"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[10] = rng.choice(bad) + rng.choice(["", "s", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("bounds", [{}, {"toxic": 60, "clean": 100}])
def test_bad_rows(spark, bounds):
    rows, labels = table(600)
    rows += [(None, "you grumpf"), (5000, None), (5001, ""), (5002, "grumpf " * 200_000), (5003, "the river"), (5003, "the river")]
    labels += [(None, 1, 1), (5003, 1, None), (1, 1, None), (4, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS label", "2 AS score", "3 AS part").repartition(3)
    out = toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **bounds).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[None]["held_out"] is False and by[5000]["score"] == by[5001]["score"] and by[5000]["predicted"] == 0
    assert by[5002]["predicted"] == 1 and by[5002]["clause"].startswith("grumpf grumpf") and by[5000]["clause"] is None
    wrong = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and r["predicted"] != (r["doc_id"] % 4 == 0)]
    assert len(wrong) <= 6


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "You are an idiot"), (2, "a tree")], SCHEMA)
    first, second = toxicity(docs, none).orderBy("doc_id").collect()
    assert first["predicted"] == 1 and second["predicted"] == 0
    assert toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0
