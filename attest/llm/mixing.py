"""Mixing sources to target weights: fixed-length blocks, drawn slots, pseudorandom index permutations.

Built-in functions only. The words of each source are laid out in lanes of about ``LANE_WORDS`` (a lane is a hash
class of documents, so a source of any size spreads over many tasks) and cut into blocks of ``BLOCK_WORDS``. A source
gets as many slots as its target needs. One pseudorandom permutation of all slots deals them over the output shards:
a shard's source counts are then the multinomial draw under the condition that the totals come out exactly, so no
source drifts from its target. A source's k-th slot takes block pi(k mod n), with a new permutation pi of its n blocks
for each pass; slots and blocks join by (source, index). A target of at most twice the source takes no block more than
twice. The permutations are swap-or-not networks over exactly n indices, keyed by ``seed``: the same rows give the same
mix on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.names import unused
from attest.operators.skew import numbered
from attest.session import written

BLOCK_WORDS = 32
LANE_WORDS = 1_000_000
SLOTS_PER_SHARD = 1024
ROUNDS = 16
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def permuted(index: str, size: str, key: str, rounds: int = ROUNDS) -> Column:
    """Where a keyed permutation of [0, size) sends ``index``: in each round i and K - i may swap."""
    other = f"pmod(pmod(xxhash64({key}, r), {size}) - a, {size})"
    swap = f"(xxhash64({key}, r, greatest(a, {other})) & 1) = 0"
    return F.expr(f"aggregate(sequence(1, {rounds}), {index}, (a, r) -> CASE WHEN {swap} THEN a ELSE {other} END)")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sid, source, source_size, target`` from ``source, source_size``; one row per source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all words. A target stops at
    ``most`` times its source and what is above is shared again by weight: filled in order of (bound / weight), the
    level that the open sources reach is found in one pass.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    # One row per source.
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("sid", F.row_number().over(order).cast("long") - 1)
    rows = rows.withColumn("weight", F.get(listed, (F.col("sid") % len(weights)).cast("int")))
    rows = rows.withColumn("bound", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "filled": F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "wanted": share * F.sum("source_size").over(everything),
    })
    first = F.when((F.col("wanted") - F.col("filled")) * F.col("weight") / F.col("open") <= F.col("bound"),
                   F.struct(F.col("bound") / F.col("weight"), "sid", (F.col("wanted") - F.col("filled")).alias("left"), "open"))
    rows = rows.withColumn("at", F.min(first).over(everything))
    level = F.col("at.left") * F.col("weight") / F.col("at.open")
    return rows.select("sid", "source", "source_size", F.coalesce(F.least("bound", level), "bound").alias("target"))


def _copies(rows: DataFrame, by: list[str], order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``copy``, counting from 0 the rows that share ``by`` in the given order, however many there are.

    Rows that are equal in all of these are alike, so their order, that of ``tag``, is of no account.
    """
    narrow = rows.select(*by, *order, tag)
    again = narrow.groupBy(*by).count().where("count > 1").select(*[F.col(b).alias(f"__{b}") for b in by])
    same = [narrow[b].eqNullSafe(again[f"__{b}"]) for b in by]
    tied = numbered(narrow.join(again, same, "left_semi"), [*by, *order, tag], "__at")
    first = tied.groupBy(*by).agg(F.min("__at").alias("__first")).select(*[F.col(b).alias(f"__{b}") for b in by], "__first")
    same = [tied[b].eqNullSafe(first[f"__{b}"]) for b in by]
    tied = tied.join(first, same).select(F.col(tag).alias("__tag"), (F.col("__at") - F.col("__first")).alias("copy"))
    out = rows.join(tied, rows[tag] == tied["__tag"], "left").drop("__tag")
    return out.withColumn("copy", F.coalesce("copy", F.lit(0)).cast("long"))


class Mix:
    """A mix of ``docs``.

    ``placed``: every row with its source's size and target and its place (``sid, lane, start``); ``slots``: the
    output, one row per slot with its shard, block and ``pieces`` (which words ``at .. at + n`` of which place, and
    with ``with_text`` those words). A null text has no words and no slot; a null source is a source; sources
    without words get no slot; repeated rows are documents of their own, told apart by a count of copies, so that the
    mix is that of the rows and not of their files; no rows give no slots. ``tag`` is a column that numbers the rows;
    ``tie`` orders rows that share key and text.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                 weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                 block_words: int = BLOCK_WORDS, lane_words: int = LANE_WORDS, seed: int = 42, with_text: bool = False,
                 tag: str | None = None, tie: Column | None = None):
        self.block, self.seed, self.with_text = block_words, seed, with_text
        carried = [F.col(text).alias("text")] if with_text else []
        rows = docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("print"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (F.col(tag) if tag else F.monotonically_increasing_id()).alias("tag"), (F.lit(0) if tie is None else tie).alias("tie"), *carried,
        )
        rows = written(rows, "sized")
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.sources = written(targets(sizes, weights, share, most), "sources")
        rows = _copies(rows, ["key", "print"], ["source", "tie"], "tag").drop("tie")
        lanes = F.greatest(F.ceil(F.col("source_size") / lane_words), F.lit(1))
        known = self.sources.withColumnRenamed("source", "__source")
        rows = rows.join(known, rows["source"].eqNullSafe(known["__source"])).drop("__source")
        rows = rows.withColumn("lane", F.pmod(F.xxhash64("key", "print", "copy"), lanes))
        lane = Window.partitionBy("sid", "lane").orderBy("key", "print", "copy")
        start = F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        self.placed = written(rows.withColumn("start", start), "placed")
        self.lanes = written(self._lanes(), "lanes")

    def _lanes(self) -> DataFrame:
        """``sid, lane, first, blocks, n, slots, slots_before``: one row per lane with words."""
        lanes = self.placed.where("size > 0").groupBy("sid", "lane").agg(F.sum("size").alias("words"))
        lanes = lanes.withColumn("blocks", F.ceil(F.col("words") / self.block))
        within = Window.partitionBy("sid")
        before = within.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        lanes = lanes.withColumns({
            "first": F.coalesce(F.sum("blocks").over(before), F.lit(0)),
            "n": F.sum("blocks").over(within),
        })
        blocks = lanes.groupBy("sid").agg(F.max("n").alias("n_blocks"))
        slots = blocks.join(self.sources, "sid").select(
            "sid", F.round(F.col("n_blocks") * F.col("target") / F.col("source_size")).cast("long").alias("slots"))
        # One row per source.
        counted = slots.select(
            "sid", "slots", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias("slots_before"),
            F.sum("slots").over(Window.partitionBy()).alias("all_slots"))
        return lanes.join(counted, "sid")

    def blocks(self) -> DataFrame:
        """``sid, block, pieces``: at most ``block_words`` pieces each."""
        places = self.placed.where("size > 0").join(self.lanes.select("sid", "lane", "first"), ["sid", "lane"])
        if self.with_text:
            places = places.withColumn("words", F.expr(f"regexp_extract_all(text, r'{WORD}', 0)"))
        span = F.sequence(F.expr(f"start DIV {self.block}"), F.expr(f"(start + size - 1) DIV {self.block}"))
        rest = ["words"] if self.with_text else []
        parts = places.select("sid", "lane", "start", "size", "first", *rest, F.explode(span).alias("b"))
        at = F.greatest(F.col("b") * self.block - F.col("start"), F.lit(0))
        end = F.least((F.col("b") + 1) * self.block - F.col("start"), F.col("size"))
        parts = parts.select("sid", "lane", "start", (F.col("first") + F.col("b")).alias("block"), at.alias("at"),
                             (end - at).alias("n"), *rest)
        fields = ["start", "lane", "at", "n"]
        if self.with_text:
            cut = F.slice("words", (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("words")
            parts, fields = parts.select("sid", "block", "start", "lane", "at", "n", cut), [*fields, "words"]
        return parts.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))

    def drawn(self) -> DataFrame:
        """``shard, slot, sid, block, pass``: which block each slot of each output shard takes."""
        low = F.expr("CAST(floor(CAST(first AS DECIMAL(38, 0)) * slots / n) AS BIGINT)")
        high = F.expr("CAST(floor(CAST(first + blocks AS DECIMAL(38, 0)) * slots / n) AS BIGINT)")
        # A lane is one small row here and some ten thousands of slots below, so its size says nothing of theirs.
        some = self.lanes.withColumns({"low": low, "high": high}).where("high > low")
        some = some.repartition(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "lane")
        slots = some.select("sid", "n", "slots_before", "all_slots", F.explode(F.expr("sequence(low, high - 1)")).alias("k"))
        slots = slots.withColumns({
            "q": F.col("slots_before") + F.col("k"), "i": F.pmod("k", "n"), "pass": F.expr("k DIV n"),
        })
        place = permuted("q", "all_slots", f"{self.seed}, -1L, 0L")
        block = permuted("i", "n", f"{self.seed}, sid, pass")
        slots = slots.select("sid", "pass", block.alias("block"), place.alias("place"))
        return slots.select(F.expr(f"place DIV {SLOTS_PER_SHARD}").alias("shard"), F.pmod("place", F.lit(SLOTS_PER_SHARD)).alias("slot"),
                            "sid", "block", "pass")

    def slots(self) -> DataFrame:
        return self.drawn().hint("merge").join(self.blocks(), ["sid", "block"])

    def taken(self) -> DataFrame:
        """``key, source, size, source_size, target, taken`` for every row of ``docs``."""
        pieces = self.slots().select("sid", F.explode("pieces").alias("p"))
        sums = pieces.groupBy("sid", F.col("p.lane").alias("lane"), F.col("p.start").alias("start")).agg(F.sum("p.n").alias("taken"))
        # Rows without words share their place with another and take nothing.
        rows = self.placed.withColumn("held", F.when(F.col("size") > 0, F.col("start")))
        same = [rows[c] == sums[c] for c in ("sid", "lane")] + [rows["held"] == sums["start"]]
        return rows.join(sums, same, "left").select(
            "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: each row of ``docs`` once for each pass that takes some of its words, with those words.

    A text taken whole stays as it is; of others the taken words are joined by one space. The other columns stay.
    The same rows give the same mix, however they lie in files; a row that comes twice is two documents.
    """
    tag, spans, split = unused(docs, "__row", "__spans", "__words")
    rows = written(docs.withColumn(tag, F.monotonically_increasing_id()), "rows")
    mix = Mix(rows, key, text, source, tag=tag, tie=F.xxhash64(*docs.columns), **options)
    parts = mix.slots().select("sid", "pass", F.explode("pieces").alias("p"))
    parts = parts.select("sid", F.col("p.lane").alias("lane"), F.col("p.start").alias("start"), "pass", F.struct("p.at", "p.n").alias("span"))
    found = parts.groupBy("sid", "lane", "start", "pass").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.sum("span.n").alias("n"))
    held = mix.placed.where("size > 0").select("sid", "lane", "start", F.col("tag").alias(tag), "size")
    taken = found.join(held, ["sid", "lane", "start"]).select(tag, F.when(F.col("n") < F.col("size"), F.col("spans")).alias(spans))
    joined = rows.join(taken, tag).withColumn(split, F.expr(f"regexp_extract_all(`{text}`, r'{WORD}', 0)"))
    some = F.expr(f"array_join(flatten(transform(`{spans}`, s -> slice(`{split}`, CAST(s.at AS INT) + 1, CAST(s.n AS INT)))), ' ')")
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(some)).select(*docs.columns)
