import random
import re

from attest.llm.decontaminate import decontaminate, hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = tokens(text)
    hit, found = set(), set()
    for name, item in items:
        t = tokens(item)
        for k in range(max(len(t) - 12, 1) if t else 0):
            win = t[k : k + 13]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(name)
    return len(w), len(hit), sorted(map(str, found - {None}))


def made():
    rng = random.Random(3)
    vocabulary = ["a", "B", "é", "É", "x1", "the", "Of"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(12)]
    items[0] = (0, "only-one9")
    items += [(None, "hidden item"), (50, None), (51, " ... "), (3, "same id, other text")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            parts[len(parts) // 2 : len(parts) // 2] = rng.choice(items[:12])[1].upper().split(" ")
        docs.append((i, rng.choice([" ", "-", ", "]).join(parts)))
    docs += [(60, None), (61, ""), (61, "!!"), (62, "Hidden ITEM"), (5, "x1 other text"), (None, "nothing here"), (7, docs[7][1])]
    return docs, items


def test_against_brute_force_both_ways(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS w", "2 AS p")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS size")
    expected = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for most in (1, 100_000):
        got = hits(d, b, broadcast_windows=most).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == expected
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_removal(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS items")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate(d, b)
    assert whole.columns == d.columns
    kept = [(i, t) for i, t in docs if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute(t, items))]
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=str) == sorted(kept, key=str)
    spans = decontaminate(spark.createDataFrame([(1, "Keep, hidden  Item; this")], "doc_id long, text string"), b, remove="spans")
    assert spans.first().text == "Keep,   ; this"
    assert decontaminate(d.limit(0), b).count() == 0 and hits(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = " ".join(f"v{i % 977}" for i in range(60_000)) + " " + item
    row = hits(spark.createDataFrame([(1, text)], "doc_id long, text string"),
               spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (60_040, 40, ["9"], False)
