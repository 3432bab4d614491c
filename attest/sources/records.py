"""JSON documents with a size limit, content files, and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.content import byte_length, digest
from attest.functions.predicates import MAX_FILE_BYTES

# How large a metadata document may be.
MAX_DOCUMENT_BYTES = 1 << 20
MAX_BUILD_MANIFEST_BYTES = 64 << 10


def parse_records(
    df: DataFrame, text: ColumnLike, schema: T.StructType, max_bytes: int = MAX_DOCUMENT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Records of JSON documents, one object or a batch array each, and the documents refused.

    Refused documents carry ``problem``: ``too_large`` or ``bad_json`` (also a blank or null one); their content is
    never parsed into records. Fields are those of ``schema``, never inferred.
    """
    body = as_column(text)
    # JSON's own white space.
    trimmed = F.btrim(body, F.lit(" \t\n\r"))
    corrupt = "__corrupt"
    record = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    # The parser stops after the first value. Wrapped as a field, what follows must start with a brace or a further
    # field; wrapped as an item, with a bracket or a further item: a document that passes both is one value.
    field = F.from_json(
        F.concat(F.lit('{"r":'), trimmed, F.lit("}")),
        T.StructType([T.StructField("r", T.StringType()), T.StructField(corrupt, T.StringType())]), options)
    strings = T.ArrayType(T.StringType())
    whole = field[corrupt].isNull() & field["r"].isNotNull() & (
        F.size(F.from_json(F.concat(F.lit("["), trimmed, F.lit("]")), strings)) == 1)
    items = F.when(whole & trimmed.startswith("["), F.from_json(trimmed, strings)).when(
        whole & trimmed.startswith("{"), F.array(trimmed))
    batch = F.transform(items, lambda item: F.from_json(item, record, options))
    small = df.withColumn("__bytes", byte_length(body))
    parsed = small.withColumn("__batch", F.when(F.col("__bytes") <= max_bytes, batch)).withColumn(
        "problem",
        first_of(
            (F.col("__bytes") > max_bytes, "too_large"),
            (F.col("__batch").isNull() | F.exists("__batch", lambda r: r.isNull() | r[corrupt].isNotNull()), "bad_json"),
        ),
    )
    refused = parsed.where(F.col("problem").isNotNull()).drop("__batch").withColumnRenamed("__bytes", "size")
    accepted = (
        parsed.where(F.col("problem").isNull())
        .drop("__bytes", "problem")
        .withColumn("__r", F.explode("__batch"))
        .select(*df.columns, *[F.col("__r")[f.name].alias(f.name) for f in schema.fields])
    )
    return accepted, refused


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = MAX_DOCUMENT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Read one JSON document per file below ``path``; see ``parse_records``.

    Files over the limit are refused on the length the file listing gives, before their bytes are read.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    oversized = listed.where(F.col("length") > max_bytes).select(
        "path", F.col("length").alias("size"), F.lit("too_large").alias("problem")
    )
    body = F.make_valid_utf8(F.col("content").cast("string"))
    within = listed.where(F.col("length") <= max_bytes).select("path", body.alias("body"))
    accepted, refused = parse_records(within, "body", schema, max_bytes)
    return accepted.drop("body"), oversized.unionByName(refused.select("path", "size", "problem"))


def content_table(
    df: DataFrame, content: ColumnLike, max_bytes: int = MAX_FILE_BYTES, length: ColumnLike | None = None
) -> DataFrame:
    """Add ``length`` and ``sha256`` of a content column and leave it; over the limit the digest is null.

    ``length`` may name a column that already has the number of bytes.
    """
    body = as_column(content).cast("binary")
    size = (byte_length(body) if length is None else as_column(length)).cast("bigint")
    sha256 = F.when(size <= max_bytes, digest(body))
    rest = [c for c in df.columns if c not in ("length", "sha256") and c != content]
    return df.select(*rest, size.alias("length"), sha256.alias("sha256"))


def read_content(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below ``path`` with length and digest. Those over the limit keep a null digest and are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    within = content_table(files.where(F.col("length") <= max_bytes).select("path", "length", "content"), "content", max_bytes, "length")
    skipped = files.where(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("sha256")
    )
    return within.unionByName(skipped)


def write_json(df: DataFrame, path: str) -> None:
    """Publish as JSON lines; the committer makes the output visible only when it is complete."""
    df.write.mode("overwrite").json(path)


def write_listing(df: DataFrame, path: str, order: Sequence[str] = ("block",), text: str = "text") -> None:
    """Publish listing blocks as plain text, in order over the numbered part files."""
    lines = df.orderBy(*order).select(F.regexp_replace(text, r"\n\z", "").alias("value"))
    lines.write.mode("overwrite").text(path)
