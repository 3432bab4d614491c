import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from attest.llm.token_files import WordEncoder, read_tokens, with_crc32, write_tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(open(PATH, encoding="utf-8").read())


def whole(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def check(texts):
    ids, sizes = ENCODER.texts(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 1)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == whole(text), text


def test_word_by_word_equals_whole_texts():
    check(["It's we'll I'D 12 3a-b_c", "", None, "<|endoftext|> x<|startoftext|>y <|STARTOFTEXT|>", "H̱ ẖ Á b c \x1c d\x85e",
           "tab\tnl\n\x0b\x0c\r end ", " lead", "''s's 't're!!'ve$$%% ß ẞ İ İ ſ K Å", "日本語 текст 1²³ x\x7fy\x01z \x00"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_texts(texts):
    check([t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBstrevmld'019 .,!<|>_\t", max_size=40))
def test_ascii_texts(text):
    check([text])


def expected(rows):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_in_key_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = write_tokens(docs, PATH, path=str(tmp_path / "t"), shards=5)
    got = [tuple(r) for r in with_crc32(read_tokens(spark, path)).orderBy("start").collect()]
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_long_and_empty(spark, tmp_path):
    rows = [(3, "b"), (3, "b"), (None, "null id"), (1, None), (2, ""), (9, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS shard")
    tokens = read_tokens(spark, write_tokens(docs, PATH, path=str(tmp_path / "t"), shards=3))
    assert [tuple(r) for r in with_crc32(tokens).orderBy("start").collect()] == expected(rows)
    assert read_tokens(spark, write_tokens(docs.limit(0), PATH, path=str(tmp_path / "e"))).count() == 0
