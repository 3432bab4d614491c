"""A stored index gives the rows of the plain search and reads only what it needs."""

import random
import re

import pytest

from attest.operators import catalog
from attest.operators.catalog import reaching_cells, read_blocks, search_pages, search_stored, write_index


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(900)]
    # A few pages are full of a word, several of them equally.
    texts[100:104] = ["w1 " * 60] * 4
    texts[700] = "w1 " * 30 + "w2 " * 30
    return spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "page_id long, text string")


@pytest.fixture(scope="module")
def stored(pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "blocks")
    write_index(pages, "page_id", "text", path, block_pages=16)
    return path


@pytest.mark.parametrize("query", ["w1", "w1 w2", "W3, w1; w3", "w39 nowhere", "nowhere", "", "w0 w1 w2 w3 w4 w5"])
@pytest.mark.parametrize("limit", [1, 3, 25, 5000])
def test_rows_of_the_plain_search(spark, pages, stored, query, limit):
    expected = [tuple(r) for r in search_pages(pages, "page_id", "text", query, limit).collect()] if query else []
    assert [tuple(r) for r in search_stored(spark, stored, "page_id", query, limit).collect()] == expected


def test_blocks_that_cannot_win_are_skipped(spark, stored):
    blocks = read_blocks(spark, stored, "w1 w2")
    cells = blocks.select("cell").distinct().count()
    assert cells > 40 and reaching_cells(blocks, 5).count() <= 8
    # Everything is read where fewer pages have a word than are wanted.
    assert reaching_cells(blocks, 5000).count() == cells


def test_only_the_words_folders_are_listed(spark, stored):
    plan = read_blocks(spark, stored, "w1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "EqualTo(term,w1)" in plan
    files = read_blocks(spark, stored, "w1").inputFiles()
    assert {re.search(r"folder=(\d+)", f).group(1) for f in files} and len(files) >= 1
    read = read_blocks(spark, stored, "w1").select("cell", "most")._jdf.queryExecution().executedPlan().toString()
    assert "pages" not in re.search(r"ReadSchema: (\S+)", read).group(1)


def test_parts_of_a_cell_and_repeated_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "HELD_WORDS", 50)
    monkeypatch.setattr(catalog, "FILE_CELLS", 3)
    rows = [(f"p{i % 150}" if i % 40 else None, "w1 w2 W1 " * (i % 7) + "été") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id string, text string").repartition(3)
    write_index(pages, "page_id", "text", str(tmp_path / "blocks"), block_pages=16)
    counts = {}
    for page, text in rows:
        counts[page] = counts.get(page, 0) + len(re.findall("w1|été", text.lower()))
    best = sorted(counts.items(), key=lambda r: (-r[1], r[0] is not None, r[0] or ""))[:20]
    got = search_stored(spark, str(tmp_path / "blocks"), "page_id", "w1 été", 20).collect()
    assert [tuple(r) for r in got] == best
