import hashlib
import random

from attest.llm.substrings import remove_repeats


def brute(rows, window=20):
    """For rows with different keys."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            win = tuple(words[i : i + window])
            if win in seen:
                gone[i : i + window] = [True] * window
            seen.add(win)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[key] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS kept").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, **options).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, chunk_bytes=40_000).collect()}
    assert got == brute(rows)


def test_runs_periods_and_shared_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["a"] * 10
    passage = [" ".join(rng.choice(words) for _ in range(n)) for n in (19, 20, 21, 50)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(rng.choice([rng.choice(passage), "a " * rng.randrange(60), "x y " * rng.randrange(40), "p q r\n" * rng.randrange(20),
                                     " ".join(rng.choice(words) for _ in range(rng.randrange(40)))]))
        rows.append((i * 7 - 100, "\t".join(parts)))
    rows += [(None, passage[3]), (900, None), (901, ""), (902, " \n "), (903, passage[3] + " tail")]
    for size in (300, 4_000_000):
        check(spark, rows, chunk_bytes=size, buckets=3)


def test_repeated_keys_long_and_empty(spark):
    text = " ".join(f"v{i}" for i in range(25))
    long = " ".join(f"u{i % 30_011}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [(1, 0), (1, 25), (2, 60_000 - 30_011)]
    assert remove_repeats(docs.limit(0)).count() == 0
    kept = remove_repeats(docs, with_text=True).where("n_removed = 0").first().kept
    assert kept == text
