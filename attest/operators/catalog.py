"""Search over catalogues and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.functions.content import byte_length, digest
from attest.session import ship_with_plans

ship_with_plans(__name__)

WORD_BREAK = r"[^\p{L}\p{N}]+"
#: Pages of a block of a stored index, and folders that its terms are dealt to.
BLOCK_PAGES = 64
INDEX_FOLDERS = 64
#: Cells whose blocks of a folder lie in one file.
FILE_CELLS = 16_384
#: Words of a cell that are counted at once.
HELD_WORDS = 5_000_000


def search_catalog(df: DataFrame, name: ColumnLike, term: str) -> DataFrame:
    """Entries whose name contains the term, in any case; no hit returns nothing."""
    return df.where(F.contains(F.lower(as_column(name)), F.lit(term.lower())))


def list_children(df: DataFrame, path: str, parent: str) -> DataFrame:
    """Direct children of a folder: ``name``, ``is_folder`` and how many entries lie at or below it."""
    base = parent.rstrip("/") + "/"
    rest = F.substring(F.col(path), F.lit(len(base) + 1), F.length(path))
    inside = df.where(F.startswith(F.col(path), F.lit(base)) & (F.col(path) != base))
    parts = F.split(rest, "/", 2)
    children = inside.select(F.element_at(parts, 1).alias("name"), (F.size(parts) > 1).alias("deeper"))
    return (
        children.where(F.col("name") != "")
        .groupBy("name")
        .agg(F.bool_or("deeper").alias("is_folder"), F.count(F.lit(1)).alias("n_entries"))
    )


def fetch_receipt(df: DataFrame, content: ColumnLike, limit: int) -> DataFrame:
    """Add size, digest and whether the item is over the delivery limit."""
    return df.withColumns({
        "size": byte_length(content),
        "sha256": digest(content),
        "over_limit": byte_length(content) > limit,
    })


def search_pages(df: DataFrame, page_id: str, text: ColumnLike, query: str, limit: int | None = None) -> DataFrame:
    """Pages that hold a query word, by number of occurrences, ties by id.

    The words of one query are few and sit in the plan: each page is scored in place, without a shuffle.
    ``limit`` gives the usual top-k report.
    """
    terms = query_terms(query)
    words = F.split(F.lower(as_column(text)), WORD_BREAK)
    hits = F.size(F.filter(words, lambda w: w.isin(*terms))).cast("bigint")
    scored = df.select(page_id, hits.alias("score")).where(F.col("score") > 0)
    if limit is None:
        return scored
    return scored.orderBy(F.col("score").desc(), F.col(page_id)).limit(limit)


def build_index(df: DataFrame, page_id: str, text: ColumnLike) -> DataFrame:
    """Inverted index ``term``, page, ``frequency`` for a catalogue that is searched often.

    ``write_index`` stores it so that a search reads only what it needs.
    """
    words = F.explode(F.split(F.lower(as_column(text)), WORD_BREAK))
    return (
        df.select(page_id, words.alias("term"))
        .where(F.col("term") != "")
        .groupBy("term", page_id)
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def search_index(index: DataFrame, page_id: str, query: str, limit: int | None = None) -> DataFrame:
    scored = (
        index.where(F.col("term").isin(*query_terms(query)))
        .groupBy(page_id)
        .agg(F.sum("frequency").alias("score"))
    )
    if limit is None:
        return scored
    return scored.orderBy(F.col("score").desc(), F.col(page_id)).limit(limit)


def write_index(df: DataFrame, page_id: str, text: ColumnLike, path: str, block_pages: int = BLOCK_PAGES,
                folders: int = INDEX_FOLDERS) -> None:
    """Store an inverted index for ``search_stored``.

    Pages are dealt by hash to cells of about ``block_pages`` pages. A row is a block: one term in one cell, with its
    pages, their frequencies and the greatest of these. Blocks lie in ``folders`` by the term's hash,
    sorted by term and cell; a term of many blocks is spread over several files. Texts are shuffled once, to their cells,
    whose words are counted as they stream by; blocks are shuffled once, to their files. A cell of very long pages has
    several blocks of a term.
    """
    cells = max(1, -(-df.select(page_id).distinct().count() // block_pages))
    cell = F.pmod(F.xxhash64(page_id), F.lit(cells)).alias("cell")
    dealt = df.select(cell, F.col(page_id).alias("page"), as_column(text).alias("text")).repartition("cell").sortWithinPartitions("cell")
    words = dealt.select("cell", "page", F.split(F.lower("text"), WORD_BREAK).alias("words"))
    kind = words.schema["page"].dataType.simpleString()
    blocks = words.mapInArrow(_blocks, f"cell bigint, term string, most int, pages array<{kind}>, frequencies array<int>")
    blocks = blocks.withColumn("folder", _folder(F.col("term"), folders))
    # Cells of one file: a folder of more cells has several files.
    spread = F.pmod("cell", F.lit(-(-cells // FILE_CELLS)))
    blocks.repartition("folder", spread).sortWithinPartitions("folder", "term", "cell").write.partitionBy("folder").parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages that come cell by cell with their words; one cell is held at a time, or a part of it."""
    held, size, cell = [], 0, None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for at, end in zip([0, *cuts], [*cuts, len(cells)]):
            if end == at:
                continue
            if held and (cells[at] != cell or size > HELD_WORDS):
                yield _block(cell, held)
                held, size = [], 0
            cell = cells[at]
            held.append(batch.slice(at, end - at))
            size += pc.sum(pc.list_value_length(held[-1].column("words"))).as_py() or 0
    if held:
        yield _block(cell, held)


def _block(cell: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each term of some pages of a cell."""
    lists = pa.concat_arrays([b.column("words") for b in held])
    pages = pa.concat_arrays([b.column("page") for b in held]).dictionary_encode(null_encoding="encode")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(lists)
    some = pc.not_equal(words, "")
    owner = np.repeat(pages.indices.to_numpy(zero_copy_only=False), lengths)[some.to_numpy(zero_copy_only=False)]
    terms, n = words.filter(some).dictionary_encode(), len(pages.dictionary)
    found, frequency = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + owner, return_counts=True)
    term, page = found // max(n, 1), found % max(n, 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
    frequency = frequency.astype(np.int32)
    columns = [
        np.full(len(starts), cell, np.int64), terms.dictionary,
        np.maximum.reduceat(frequency, starts) if len(starts) else frequency,
        pa.ListArray.from_arrays(offsets, pages.dictionary.take(pa.array(page))), pa.ListArray.from_arrays(offsets, pa.array(frequency)),
    ]
    columns = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, ["cell", "term", "most", "pages", "frequencies"])


def read_blocks(spark: SparkSession, path: str, query: str, folders: int = INDEX_FOLDERS) -> DataFrame:
    """The stored blocks of the query's words; other folders are not listed and other terms not read."""
    terms = query_terms(query)
    within = F.col("folder").isin(*[_folder(F.lit(t), folders) for t in terms]) if terms else F.lit(False)
    return spark.read.parquet(path).where(within & F.col("term").isin(*terms))


def search_stored(spark: SparkSession, path: str, page_id: str, query: str, limit: int,
                  folders: int = INDEX_FOLDERS) -> DataFrame:
    """The rows of ``search_pages`` with a limit, from a stored index.

    No page of a cell scores more than the sum of its blocks' greatest frequencies. The ``limit`` cells of the highest
    bounds are scored first; the score of the last page that they would return is a threshold, and only cells whose
    bound reaches it are scored then. Pages of equal score are never skipped, so ties are exact.
    """
    blocks = read_blocks(spark, path, query, folders)
    chosen = reaching_cells(blocks, limit)
    return _best(_scored(blocks, chosen), limit).select(F.col("page").alias(page_id), "score")


def reaching_cells(blocks: DataFrame, limit: int) -> DataFrame:
    """Cells that may hold one of the ``limit`` best pages, with their bound."""
    bounds = blocks.groupBy("cell").agg(F.sum("most").alias("bound"))
    first = bounds.orderBy(F.col("bound").desc(), "cell").limit(limit)
    # One row: a full report's last score, nothing if there are fewer pages.
    last = _best(_scored(blocks, first), limit).agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).first()
    return bounds.where(F.col("bound") >= last["score"]) if last["n"] == limit else bounds


def _scored(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    hits = blocks.join(cells.select("cell"), "cell", "left_semi").select(F.explode(F.arrays_zip("pages", "frequencies")).alias("p"))
    return hits.groupBy(F.col("p.pages").alias("page")).agg(F.sum("p.frequencies").alias("score"))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "page").limit(limit)


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def query_terms(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})
