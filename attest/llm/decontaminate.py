"""Benchmark decontamination: broadcast the test set's word windows, scan documents, verify hits, remove.

Built-in functions only. A document's window is looked at closely only where the hashes of its first, third and last
word pair all occur at those places of some benchmark window; those few candidates are joined with the windows by
their text, which verifies them. A benchmark of more than ``BROADCAST_WINDOWS`` windows is not broadcast: then every
document window joins by a shuffle. Either way gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.names import unused

WINDOW = 13
#: Windows of at most about 150 bytes each: 15 MB in every executor at most.
BROADCAST_WINDOWS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same two before lower-casing.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of the word pairs that a full window is screened by.
PAIRS = (0, 2, WINDOW - 2)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does just that for a text of one-byte characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Normalised words; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``size, win, items``: each different window with the sorted ids (as strings) of the items that hold it."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    wins = items.select("item", F.least(F.size("w"), F.lit(window)).alias("size"), "w", F.explode(starts).alias("at"))
    wins = wins.select("item", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("win"))
    return wins.groupBy("size", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _pair(at: str) -> str:
    return f"xxhash64(get(w, {at}), get(w, {at} + 1))"


def _screens(windows: DataFrame, window: int) -> dict[int, list[str]]:
    """For each window size, the conditions on the pairs ``p`` at position i that its windows meet."""
    pairs = PAIRS if window == WINDOW else (0,)
    split = windows.select("size", F.split("win", " ").alias("w"))
    hashes = split.select("size", *[F.expr(_pair(str(k))).alias(f"p{k}") for k in pairs], F.expr("xxhash64(w[0])").alias("one")).collect()
    screens: dict[int, list[str]] = {}
    for size in sorted({r["size"] for r in hashes}):
        rows = [r for r in hashes if r["size"] == size]
        if size == 1:
            screens[size] = [f"get(h, i) IN ({_longs(r['one'] for r in rows)})"]
            continue
        places = pairs if size == window else (0,)
        screens[size] = [f"get(p, i + {k}) IN ({_longs(r[f'p{k}'] for r in rows)})" for k in places]
    return screens


def _longs(values) -> str:
    # A long's smallest value cannot be written as a literal; its hash would have to be exactly that.
    return ", ".join(f"CAST('{v}' AS BIGINT)" if v == -(2**63) else f"{v}L" for v in sorted(set(values)))


def _candidates(docs: DataFrame, sizes: list[int], screens: dict[int, list[str]] | None) -> Column:
    found = []
    for size in sizes:
        places = f"sequence(0, size(w) - {size})"
        if screens:
            # The pairs stand in a column of their own and are read more than once, so they are computed once.
            tests = " AND ".join([*screens[size], "(h IS NOT NULL AND p IS NOT NULL)"])
            places = f"filter({places}, i -> {tests})"
        some = f"transform({places}, i -> struct(i AS at, {size} AS size, array_join(slice(w, i + 1, {size}), ' ') AS win))"
        found.append(f"CASE WHEN size(w) >= {size} THEN {some} ELSE array() END")
    return F.expr(f"concat({', '.join(found)})")


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``key, text_hash, n_words, n_hit, items, spans, contaminated``: one row for each row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A document word inside any
    occurrence is hit; ``spans`` holds the occurrences as (at, size) in words. A document is contaminated when at
    least one in twenty of its words is hit. Null and empty texts have no words and no hits. Items without words have
    no window; items with a null id hit words but are not listed; items that share an id are one item. Rows that
    share a key are separate documents, exact repeats give repeated rows. Other columns are not read.
    """
    windows = benchmark_windows(benchmark, item, item_text, window)
    few = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    screens = _screens(windows, window) if few else None
    sizes = sorted(screens) if few else [r["size"] for r in windows.select("size").distinct().collect()]
    base = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    base = base.withColumns({
        "p": F.expr(f"transform(w, (x, i) -> {_pair('i')})"),
        "h": F.expr("transform(w, x -> xxhash64(x))") if 1 in sizes else F.array().cast("array<bigint>"),
    })
    mark = F.array(F.expr("struct(CAST(NULL AS INT) AS at, 0 AS size, CAST(NULL AS STRING) AS win)"))
    places = F.concat(mark, _candidates(base, sizes, screens)) if sizes else mark
    rows = base.select("__key", "text_hash", F.size("w").alias("n_words"), F.explode(places).alias("c"))
    rows = rows.select("__key", "text_hash", "n_words", "c.at", "c.size", "c.win")
    known = windows.select(F.col("size").alias("wsize"), F.col("win").alias("wwin"), F.col("items"))
    known = F.broadcast(known) if few else known
    joined = rows.join(known, (rows["win"] == known["wwin"]) & (rows["size"] == known["wsize"]), "left")
    kept = joined.where("at IS NULL OR wwin IS NOT NULL")
    grouped = kept.groupBy("__key", "text_hash", "n_words").agg(
        F.count_if(F.col("at").isNull()).alias("__copies"),
        F.collect_set(F.expr("CASE WHEN at IS NOT NULL THEN struct(at, size) END")).alias("spans"),
        F.collect_set("items").alias("__items"),
    )
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'end', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(s.at + s.size - greatest(s.at, a.end), 0), 'end', greatest(a.end, s.at + s.size))).n"
    )
    out = grouped.withColumns({"n_hit": covered, "items": F.array_sort(F.array_distinct(F.flatten("__items")))})
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(
        F.col("__key").alias(key), "text_hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  remove: str = "documents", **options) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, or (``remove="spans"``) without the hit words."""
    found = hits(docs, benchmark, key, text, **options)
    some = found.where("contaminated" if remove == "documents" else "n_hit > 0")
    of, print_, spans, parts = unused(docs, "__key", "__hash", "__spans", "__pieces")
    some = some.select(F.col(key).alias(of), F.col("text_hash").alias(print_), F.col("spans").alias(spans))
    same = docs[key].eqNullSafe(some[of]) & (F.xxhash64(docs[text]) == some[print_])
    if remove == "documents":
        return docs.join(some, same, "left_anti")
    some = some.dropDuplicates([of, print_])
    same = docs[key].eqNullSafe(some[of]) & (F.xxhash64(docs[text]) == some[print_])
    pieces = f"regexp_extract_all(`{text}`, r'{RAW_WORDS}|{RAW_SEPARATORS}', 0)"
    joined = docs.join(some, same, "left").withColumn(parts, F.expr(pieces))
    lead = f"CAST(get({parts}, 0) RLIKE r'^{RAW_SEPARATORS}' AS INT)"
    hit = f"(j + {lead}) % 2 = 0 AND exists({spans}, s -> (j - {lead}) DIV 2 >= s.at AND (j - {lead}) DIV 2 < s.at + s.size)"
    cut = F.when(F.col(spans).isNull(), F.col(text)).otherwise(
        F.expr(f"array_join(filter({parts}, (x, j) -> NOT ({hit})), '')")
    )
    return joined.withColumn(text, cut).select(*docs.columns)



_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"
HITS_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), {WINDOW}) AS size,
         unnest(list_transform(range(0, greatest(len(w) - {WINDOW}, 0) + 1), lambda i: array_to_string(w[i + 1 : i + {WINDOW}], ' '))) AS win
  FROM b WHERE len(w) > 0),
starts AS (
  SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS pos
  FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
found AS (
  SELECT doc_id, pos, s.size, item_id
  FROM starts s JOIN bw ON bw.size = s.size AND bw.win = array_to_string(s.w[s.pos + 1 : s.pos + s.size], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
