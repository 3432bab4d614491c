"""Token ids in Parquet: one list per document in ascending key order, indexed by where its ids start.

Documents are dealt out by ranges of the key, each range is sorted, encoded and written as one file. The ids are a
dictionary-encoded, bit-packed list column beside narrow columns (key, place in the shard, number of ids), in bounded
row groups and pages with a page index, so that a reader of places alone, or of some documents, leaves the rest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.llm.words import joined, pieces, process_cache, words_of
from attest.session import shared_dir, ship_with_plans

ship_with_plans(__name__)

END_ID = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PIECE_BYTES = 6_000_000
#: Encoded words a worker remembers, at most: the words of late, and those of before until they are forgotten.
CACHE_WORDS = 1_000_000
#: The tokenizer's own way to cut a lower-case word of printable ASCII before its merges (fixed by its file).
_ASCII_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
_ENDS = (b".", b",", b";", b":", b"!", b"?")
_PLAIN = rb"[\x21-\x7e]+"
#: Letters of Latin script whose lower case does not depend on what surrounds them.
_LATIN = "[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts word by word. The tokenizer's rules never cross white space, so the ids are those of the whole."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.parts = re.compile(_ASCII_PARTS).findall
        self.plain = re.compile(_PLAIN).fullmatch
        self.latin = re.compile(_LATIN).fullmatch
        self.letters = byte_letters()

    def _part(self, name: bytes) -> bytes:
        """The ids of what the tokenizer merges as one, remembered."""
        ids = self.known.get(name)
        if ids is None:
            ids = self.before.get(name)
            if ids is None:
                merged = name.decode("latin-1")
                if not name.isascii():
                    merged = merged.translate(self.letters)
                ids = array("i", [t.id for t in self.tokenize(merged)]).tobytes()
            self.known[name] = ids
        return ids

    def _word(self, word: bytes) -> bytes | None:
        """The ids of a word that is not all letters of ASCII, or None if only the whole tokenizer can tell."""
        low = word.lower()
        if self.plain(low):
            return None if b"<|" in low else b"".join([self._part(p.encode()) for p in self.parts(low.decode())])
        text = word.decode("utf-8", "replace").lower()
        end = text[-1] if text[-1] in ".,;:" else ""
        core = text[: len(text) - len(end)]
        if self.latin(core) and is_normalized("NFC", text):
            return self._part(core.encode()) + (self._part(end.encode()) if end else b"")
        return None

    def words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as 32-bit integers."""
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.before = {}, self.known
        known, before, part, hard = self.known, self.before, self._part, []
        out = list(map(known.get, words))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            ids = before.get(word)
            if ids is None:
                low = word.lower()
                if low.isalpha():
                    ids = part(low)
                elif low[-1:] in _ENDS and low[:-1].isalpha():
                    ids = part(low[:-1]) + part(low[-1:])
                else:
                    ids = self._word(word)
            if ids is None:
                hard.append(i)
            else:
                out[i] = known[word] = ids
        if hard:
            texts = [words[i].decode("utf-8", "replace") for i in hard]
            for i, e in zip(hard, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                out[i] = known[words[i]] = array("i", e.ids).tobytes()
        return out

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end_id`` after each text, and the number of ids of each text with it."""
        words, first = words_of(*joined(texts))
        coded = words.dictionary_encode()
        ids = self.words(coded.dictionary.to_pylist())
        ids.append(array("i", [end_id]).tobytes())
        # The end id is one more word after the words of each text.
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), first[1:], len(ids) - 1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        n = sizes[codes]
        ends = np.cumsum(n)
        kind = np.int32 if max(len(flat), int(n.sum())) < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(sizes) - sizes)[codes] - ends + n).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        return flat.take(place), np.diff(np.concatenate([[0], ends])[first + np.arange(len(first))])


def word_encoder(spec: str) -> WordEncoder:
    cache = process_cache("word_encoders")
    if spec not in cache:
        cache.clear()
        cache[spec] = WordEncoder(spec)
    return cache[spec]


def write_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 path: str | None = None, shards: int | None = None) -> str:
    """Write the ids of every text in ascending key order, and say where.

    ``tokenizer`` is the path of a tokenizer file, read on the driver. A null or empty text has the end id alone. Null
    keys come first; rows that share a key are ordered by their text; repeated rows stay. No rows give no ids.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = word_encoder(spec), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in pieces(batch, "__text", PIECE_BYTES):
                ids, sizes = encoder.texts(some.column("__text"), end_id)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids)
                columns = [some.column("__key"), np.full(len(sizes), shard, np.int32), start + ends - sizes, sizes, lists]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                                                 ["key", "shard", "place", "n_tokens", "ids"])
                start += int(ends[-1])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    tie = F.xxhash64("__text")
    dealt = rows.repartitionByRange(shards, "__key", tie).sortWithinPartitions("__key", tie)
    tokens = dealt.mapInArrow(encode, f"key {key_type}, shard int, place long, n_tokens long, ids array<int>")
    writer = tokens.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    writer = writer.option("parquet.enable.dictionary", "true").option("compression", "zstd")
    writer.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_tokens, ids``: ``start`` counts the ids of all documents before."""
    files = spark.read.parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "shard").select("key", (F.col("place") + F.col("offset")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Add the unsigned crc32 of each list as little-endian 32-bit integers and leave the list."""
    rest = [f for f in tokens.schema.fields if f.name != ids]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], [*[f.name for f in rest], name])

    return tokens.select(*[f.name for f in rest], ids).mapInArrow(run, schema)
