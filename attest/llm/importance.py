"""Importance resampling: draw the documents whose hashed n-grams look most like those of target texts.

Texts are cut by Arrow kernels (``split_pattern_regex``, ``list_flatten``, ``ascii_lower``, ``dictionary_encode``);
n-grams are shifted dictionary indices, and only distinct ones are hashed: the CRC of an n-gram goes on from that of
its first words. The buckets of every document are written once as a list column. Bucket counts of documents and
target give each bucket a gain; a second, narrow pass takes the gains of each list and sums them by segments. Gumbel
noise made from the key turns the weights into scores, so that the highest scores are a draw without replacement.
Ranks are given range by range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.words import pieces
from attest.operators.skew import numbered
from attest.session import ship_with_plans, written

ship_with_plans(__name__)

BUCKETS = 10_000
ORDERS = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
PIECE_BYTES = 4_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, and the text each stands in; a null text has none."""
    parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), _SEPARATORS)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    # Words are lowered, not texts: the kernel reads a slice of a cast array from the wrong place.
    return pc.ascii_lower(flat.filter(some)), owner.filter(some).to_numpy(zero_copy_only=False)


def features(texts: pa.Array, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams of 1 to ``orders`` words, sorted by text; how many each text has, and its words."""
    n = len(texts)
    flat, owner = words(texts)
    coded = flat.dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    sums = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    gram, at, found, owners = codes, np.arange(len(codes)), [], []
    for order in range(1, orders + 1):
        if order > 1:
            # The n-grams one word longer that do not leave their text, as (n-gram, next word).
            inside = at + order - 1 < len(codes)
            inside[inside] = owner[at[inside]] == owner[at[inside] + order - 1]
            pairs, gram = np.unique(gram[inside] * max(len(known), 1) + codes[at[inside] + order - 1], return_inverse=True)
            at = at[inside]
            first, last = pairs // max(len(known), 1), pairs % max(len(known), 1)
            sums = np.fromiter((zlib.crc32(b" " + known[b], int(sums[a])) for a, b in zip(first, last)), np.uint32, len(pairs))
        found.append((sums % buckets)[gram].astype(np.int32) if len(gram) else np.zeros(0, np.int32))
        owners.append(owner[at])
    every, whose = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(whose, kind="stable") if orders > 1 else slice(None)
    return every[order], np.bincount(whose, minlength=n), np.bincount(owner, minlength=n)


def listed(texts: DataFrame, keys: list[str], orders: int, buckets: int) -> DataFrame:
    """``keys``, ``n_words`` and the list ``buckets`` of every row's ``text``, written once."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text", PIECE_BYTES):
                found, sizes, n_words = features(some.column("text"), orders, buckets)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(found))
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in keys], pa.array(n_words), lists], [*keys, "n_words", "buckets"])

    return written(texts.select(*keys, "text").mapInArrow(run, ", ".join([*kinds, "n_words long, buckets array<int>"])), "buckets")


def counted(lists: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs; one row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(pc.list_flatten(batch.column("buckets")).to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = [0] * buckets
    for r in lists.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share of the target to that of the source, one added to each count."""
    n, s, t = len(source), float(sum(source) + len(source)), float(sum(target) + len(target))
    out = [math.floor(1000 * math.log((target[i] + 1.0) * s / ((source[i] + 1.0) * t))) for i in range(n)]
    return np.array(out, np.int64)


def noise(key: Column, seed: str) -> Column:
    """Thousandths of a Gumbel draw that the key decides; a null key draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
              orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``key, print, n_words, n_features, weight, score, rank``, one row for each row of ``docs``; undrawn rows have no rank.

    Of the rows with at least ``least_words`` words ``percent`` in a hundred (rounded down) are drawn: the highest
    scores, ties to the smaller key, a null key first, then to the fewer features; repeated rows follow one another.
    A null or empty text has no features and weighs 0; with no target texts every bucket weighs against the commonest;
    no rows give no rows. ``print`` is a hash of the text. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("tag"), F.col(text).alias("text"))
    lists = listed(rows, ["key", "print", "tag"], orders, buckets)
    aims = listed(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), ["key"], orders, buckets)
    gain = gains(counted(lists, buckets), counted(aims, buckets))
    kind = rows.schema["key"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gain.take(pc.list_flatten(found).to_numpy(zero_copy_only=False)))])
            sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            columns = [batch.column(c) for c in ("key", "print", "tag", "n_words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])],
                                             ["key", "print", "tag", "n_words", "n_features", "weight"])

    weighed = lists.mapInArrow(weigh, f"key {kind}, print long, tag long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "scored")
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    # The tag splits rows that are equal in all else between ranges.
    ordered = numbered(scored.where(F.col("n_words") >= least_words).withColumn("down", -F.col("score")), ["down", "key", "n_features", "print", "tag"], "rank")
    ordered = ordered.drop("down").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ordered.unionByName(others).select(F.col("key").alias(key), "print", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``; rows that are equal in key and text come if one of them is drawn."""
    found = resampled(docs, target, key, text, **options).where("rank IS NOT NULL")
    found = found.select(F.struct(F.col(key).alias("k"), F.col("print").alias("p")).alias("__drawn")).distinct()
    same = docs[key].eqNullSafe(found["__drawn.k"]) & (F.xxhash64(docs[text]) == found["__drawn.p"])
    return docs.join(found, same, "left_semi")


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), CAST(2 * i + 1 AS INT), 2))::BIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: {byte}), 4294967295)"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
RESAMPLED_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
k AS (SELECT word, {_crc32("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM d UNION SELECT word FROM b)),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE
             / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM d JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM y LEFT JOIN r USING (doc_id)
"""
