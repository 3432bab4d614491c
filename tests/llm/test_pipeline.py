"""Each stage against a brute-force version over its own input."""

from collections import Counter

import corpus_pipeline
from attest.llm.mixing import WORD
from attest.session import written
from test_decontaminate import brute
from test_mixing import brute_targets
from test_near_dedup import brute_components, brute_simhash
from test_token_files import expected
import re


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        after = docs.collect()
        assert name == "token_files" or docs.columns == columns
        if name == "quality":
            assert set(after) <= set(before) and 0.5 * len(before) < len(after) < len(before)
        elif name == "near_dedup":
            prints = {r.doc_id: brute_simhash(r.text) for r in before}
            roots = brute_components(prints.values())
            first = {}
            for d, p in sorted(prints.items()):
                first.setdefault(roots[p], d)
            assert sorted(r.doc_id for r in after) == sorted(first.values()) and set(after) <= set(before)
        elif name == "decontamination":
            clean = [r for r in before if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute(r.text, items))]
            assert sorted(after) == sorted(clean)
        elif name == "mixing":
            count = lambda t: len(re.findall(WORD, t or ""))
            sizes, took = Counter(), Counter()
            for r in before:
                sizes[r.source] += count(r.text)
            whole = {r.doc_id: Counter(re.findall(WORD, r.text)) for r in before}
            for r in after:
                took[r.source] += count(r.text)
                assert not Counter(re.findall(WORD, r.text)) - whole[r.doc_id] and r.n_chars == len(r.text)
            for source, target in brute_targets(sizes).items():
                assert abs(took[source] - target) <= 256
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            rows = [(r.doc_id, r.text) for r in before]
            got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after)
            assert got == sorted((d, n, c) for d, _, n, c in expected(rows))
            starts = sorted((r.start, r.n_tokens) for r in after)
            assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
        before = after


def test_empty_and_null_documents(spark, sf_dir):
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", None, 3), (1, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= 4


def test_clashing_columns(spark, sf_dir):
    """Columns that stages use inside stay what they are."""
    names = ["__key", "__hash", "__print", "__row", "__words", "__spans", "__pieces", "print", "copy", "tag", "size", "sid"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        assert rows and all(r[n] == r.doc_id for r in rows for n in names), name
