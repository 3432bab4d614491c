"""Masking of a table of known secrets, however many there are.

``redact`` holds a handful of secrets in the plan and looks for each in every text. Here a text is cut once into the
pieces a secret of the table could be, and the hashes of the pieces are looked up by equality:

* a secret without white space lies inside one word, so words give their substrings of the lengths in use;
* any other secret is a run of words, of which the first may be the end of a word and the last the beginning of one. A
  run is looked up by its second word first, and then as a whole in the shapes that secrets with this second word have
  (number of words, length of the first, length of the last), so secrets that begin alike make no more rows than sizes.
  Before a run is cut out at all, a table of bits tells whether a secret may have its second word, and that after such
  an end of its first: common words alone cost a look each. The table has one size; what it lets pass is looked up.

Words shorter than the shortest secret give nothing, so prose costs little. A hit is a candidate only: the masking itself
replaces whole secrets in the text, so an equal hash of another piece masks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.text import MASK, TOKEN_PATTERNS, Secret, redact
from attest.operators.skew import SLICE_ROWS, lookup_join
from attest.session import written

# Fixed value: shorter secrets would mask ordinary text.
SHORTEST = 4
# White space that ends a word.
BREAK = r"[\x09-\x0D\x20]"
# A longer word is cut into overlapping parts, because a substring is found by counting from the word's beginning.
WORD_PART = 512
# So many characters of a second word that need not be whole are looked up.
SECOND = 4
# So many characters of the first word's end are looked up with the second word.
END = 3
# Longs of the table of bits (32 KB): more secrets than bits let more runs pass, and change no result.
SLOTS = 4096


def known_secrets(secrets: DataFrame, secret: str = "secret") -> DataFrame:
    """Different secrets of at least four characters: ``secret``, ``length``, and the ``shape`` of those with white space."""
    words = F.split("secret", BREAK)
    shape = F.struct(
        F.size(words).alias("words"),
        F.char_length(F.element_at(words, 1)).alias("first"),
        F.char_length(F.element_at(words, -1)).alias("last"),
    )
    known = secrets.select(F.col(secret).cast("string").alias("secret")).where(F.char_length("secret") >= SHORTEST).distinct()
    return known.select(
        "secret", F.char_length("secret").alias("length"), F.when(F.size(words) > 1, shape).alias("shape"),
        F.xxhash64(F.array_join(words, " ")).alias("piece"))


def _in_words(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``id, piece``: the substrings of words that have a length in use."""
    # One row that holds each length once: at most as many numbers as the longest secret has characters.
    lengths = known.where(F.col("shape").isNull()).agg(
        F.array_sort(F.collect_set("length")).alias("lengths"), F.min("length").alias("least"), F.max("length").alias("most")
    ).where(F.col("least").isNotNull())
    split = texts.select("id", F.split("text", BREAK).alias("words"))
    split = split.join(F.broadcast(lengths), F.least(F.size("words"), F.lit(0)) == F.least("least", F.lit(0)))
    # Texts without a word of the least length end here.
    long = F.array_distinct(F.filter("words", lambda w: F.char_length(w) >= F.col("least")))
    words = split.select("id", "lengths", "most", F.explode(long).alias("word"))
    parts = words.select("id", "lengths", "word", "most", F.explode(F.sequence(F.lit(1), F.char_length("word"), F.lit(WORD_PART))).alias("at"))
    # A part reaches as far beyond its end as a piece that starts in it.
    parts = parts.select("id", "lengths", F.substring("word", F.col("at"), F.col("most") + (WORD_PART - 1)).alias("part"))
    sized = parts.select("id", "part", F.explode(F.filter("lengths", lambda n: n <= F.char_length("part"))).alias("n"))
    last = F.least(F.char_length("part") - F.col("n") + 1, F.lit(WORD_PART))
    placed = sized.select("id", "part", "n", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return placed.select("id", F.xxhash64(F.substring("part", F.col("at"), F.col("n"))).alias("piece"))


def _second(n: Column, second: Column, last: Column) -> tuple[Column, Column]:
    """How the second word of a run is looked up: as a whole (-1), or if it is the last by at most four characters."""
    kind = F.when(n > 2, F.lit(-1)).otherwise(F.least(last, F.lit(SECOND)))
    return kind, F.when(n > 2, second).otherwise(F.left(second, kind))


def _place(key: Column) -> tuple[Column, Column]:
    """The long and the bit in it that stand for a hash."""
    return key.bitwiseAND(F.lit(SLOTS - 1)).cast("int"), F.shiftright(key, 32).bitwiseAND(F.lit(63)).cast("int")


def _bits(keys: DataFrame) -> DataFrame:
    """One row ``bits``: an array of ``SLOTS`` longs with one bit set for each ``key``."""
    slot, bit = _place(F.col("key"))
    marks = keys.select(slot.cast("long").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mark"))
    marks = marks.unionByName(keys.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("mark")))
    slots = marks.groupBy("slot").agg(F.bit_or("mark").alias("mark"))
    return slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "mark"))), lambda x: x["mark"]).alias("bits"))


def _marked(key: Column) -> Column:
    slot, bit = _place(key)
    return F.getbit(F.element_at("bits", slot + 1), bit) == 1


def _in_runs(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``id, piece``: the runs of words that have a shape in use with their second word."""
    spaced = known.where(F.col("shape").isNotNull())
    kind, start = _second(F.col("shape.words"), F.element_at(F.split("secret", BREAK), 2), F.col("shape.last"))
    end = F.least(F.col("shape.first"), F.lit(END))
    ended = F.xxhash64(kind, start, end, F.right(F.element_at(F.split("secret", BREAK), 1), end))
    spaced = spaced.select("shape", "length", kind.alias("kind"), end.alias("end"), F.xxhash64(kind, start).alias("key"), ended.alias("ended"))
    # One row: at most six kinds and four ends, the sizes of the longest secret, and the table of bits.
    uses = spaced.agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("end")).alias("ends"),
        F.max("shape.words").alias("most"), F.max("length").alias("longest"))
    bits = _bits(spaced.select(F.explode(F.array("key", "ended")).alias("key")))
    uses = uses.where(F.col("most").isNotNull()).crossJoin(bits)
    # A row for each second word: its shapes are no more than the sizes of secrets.
    shapes = spaced.groupBy("key").agg(F.collect_set("shape").alias("shapes"))
    cut = texts.select("id", F.split("text", BREAK).alias("words")).join(F.broadcast(uses), F.least(F.size("words"), F.lit(0)) == F.least("longest", F.lit(0))).where(F.size("words") > 1)

    def likely(at: Column) -> Column:
        second = F.element_at("words", at + 1)
        start = lambda k: F.when(k < 0, second).otherwise(F.left(second, k))
        ended = lambda k, e: F.xxhash64(k, start(k), e, F.right(F.element_at("words", at), e))
        return F.exists("kinds", lambda k: _marked(F.xxhash64(k, start(k))) & F.exists("ends", lambda e: _marked(ended(k, e))))

    def opened(at: Column) -> Column:
        second = F.element_at("words", at + 1)
        fitting = F.filter("kinds", lambda k: (k < 0) | (F.char_length(second) >= k))
        # Longer than the longest secret is as good as longer by one character.
        later = F.transform(F.slice("words", at + 1, F.col("most") - 1), lambda w: F.left(w, F.col("longest") + 1))
        run = F.array_join(F.concat(F.array(F.right(F.element_at("words", at), F.col("longest"))), later), " ")
        return F.transform(fitting, lambda k: F.struct(
            run.alias("run"), F.xxhash64(k, F.when(k < 0, second).otherwise(F.left(second, k))).alias("key")))

    placed = F.filter(F.sequence(F.lit(1), F.size("words") - 1), likely)
    rows = cut.select("id", F.explode(F.flatten(F.transform(placed, opened))).alias("r"))
    found = rows.select("id", "r.run", "r.key").join(shapes, "key").select("id", F.split("run", " ").alias("w"), F.explode("shapes").alias("s"))
    n, first, last = F.col("s.words"), F.element_at("w", 1), F.col("s.last")
    found = found.where((F.size("w") >= n) & (F.char_length(first) >= F.col("s.first")))
    inner = F.slice("w", 2, n - 2)
    pieces = F.concat(F.array(F.right(first, F.col("s.first"))), inner, F.array(F.left(F.element_at("w", n), last)))
    return found.select("id", F.xxhash64(F.array_join(pieces, " ")).alias("piece"))


def found_secrets(df: DataFrame, text: str, secrets: DataFrame, secret: str = "secret") -> DataFrame:
    """``id, secrets``: for each different text (by its SHA-256) the secrets it may hold, longest first, ties by text."""
    # Different secrets, written once: they are read for their lengths, their shapes, their second words and themselves.
    known = written(known_secrets(secrets, secret), "secrets")
    texts = df.select(F.sha2(F.col(text), 256).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    entries = known.select("piece", "secret", "length")
    pieces = _in_words(texts, known).unionByName(_in_runs(texts, known))
    ordered = F.array_sort(F.collect_set(F.struct((-F.col("length")).alias("rank"), F.col("secret"))))
    return pieces.join(entries, "piece").groupBy("id").agg(F.transform(ordered, lambda x: x["secret"]).alias("secrets"))


def redact_table(
    df: DataFrame,
    text: str,
    secrets: DataFrame,
    secret: str = "secret",
    into: str = "redacted",
    patterns: Sequence[str | Secret] = TOKEN_PATTERNS,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Add ``into``: the text with every secret of the table masked, longest first, then anything shaped like a token.

    Secrets of one length are masked in the order of their texts. Secrets that are null or shorter than four characters
    are ignored, repeated ones count once. A null text stays null. A secret counts if the text holds it before masking.
    The result is that of ``redact`` with those secrets as literals, longest first.
    """
    found = found_secrets(df, text, secrets, secret).select(F.col("id").alias("__text"), F.col("secrets").alias("__secrets"))
    rows = df.withColumn("__text", F.sha2(F.col(text), 256))
    joined = lookup_join(rows, found, ["__text"], slice_rows=slice_rows)
    listed = F.coalesce("__secrets", F.array().cast("array<string>"))
    masked = F.aggregate(listed, F.col(text), lambda t, s: F.replace(t, s, F.lit(MASK)))
    return joined.withColumn(into, redact(masked, patterns=patterns)).drop("__text", "__secrets")
