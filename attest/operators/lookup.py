"""Longest matches against tables: address ranges, path prefixes, allow-lists of any size.

A value is cut into its beginnings of the lengths that the table uses, and each beginning is looked up by equality: no
range join and no chain of conditions, whatever the table holds. Only different values are cut, so a value that a third
of the rows have is looked up once, and the answer is joined back by ``lookup_join``, which spreads hot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.network import ipv4_number, ipv6_hex
from attest.functions.predicates import FIELD_SHAPES
from attest.operators.skew import SLICE_ROWS, lookup_join


def _longest(values: DataFrame, beginning: Column, table: DataFrame, slice_rows: int | None) -> DataFrame:
    """``value, best``: the entry of ``table(kind, length, start, entry)`` with the longest beginning of each ``value, kind``.

    ``beginning`` gives a value's first ``length`` units. Entries that share one are the least of them.
    """
    entries = table.groupBy("kind", "length", "start").agg(F.min("entry").alias("entry"))
    # At most one row for each kind and length.
    lengths = table.groupBy("kind").agg(F.collect_set("length").alias("lengths")).select(F.col("kind").alias("of"), "lengths")
    cut = values.join(lengths, values["kind"] == lengths["of"]).select("value", "kind", F.explode("lengths").alias("length"))
    cut = cut.withColumn("start", beginning).where(F.col("start").isNotNull())
    found = lookup_join(cut, entries, ["kind", "length", "start"], how="inner", slice_rows=slice_rows, distinct_by=["value"])
    return found.groupBy("value").agg(F.max_by(F.struct("length", "entry"), "length").alias("best"))


def _answer(df: DataFrame, value: Column, kind: Column, beginning: Column, table: DataFrame, names: dict[str, str], slice_rows: int | None) -> DataFrame:
    rows = df.withColumn("__value", _once(value))
    values = rows.where(F.col("__value").isNotNull()).select(F.col("__value").alias("value")).distinct().withColumn("kind", kind)
    best = _longest(values, beginning, table, slice_rows).select(
        F.col("value").alias("__value"), *[F.expr(f"best.entry.{field}").alias(name) for name, field in names.items()])
    return lookup_join(rows, best, ["__value"], slice_rows=slice_rows).drop("__value")


def _once(value: Column) -> Column:
    """The value, computed in a step of its own: a long expression is not repeated wherever it is used."""
    return F.explode(F.array(value))


# Addresses.


def address_hex(address: ColumnLike) -> Column:
    """8 hexadecimal digits of an IPv4 address, 32 of an IPv6 address, null for anything else."""
    number = ipv4_number(address)
    return F.when(number.isNotNull(), F.lower(F.lpad(F.hex(number), 8, "0"))).otherwise(ipv6_hex(address))


def first_bits(digits: ColumnLike, bits: ColumnLike) -> Column:
    """The first bits of hexadecimal digits, as digits of which the last may be cut."""
    d, n = as_column(digits), as_column(bits).cast("int")
    whole, rest = F.floor(n / 4).cast("int"), n % 4
    last = F.conv(F.substring(d, whole + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.lower(F.hex((last - last % F.pow(F.lit(2), 4 - rest).cast("int")).cast("bigint")))
    return F.when(rest == 0, F.left(d, whole)).otherwise(F.concat(F.left(d, whole), cut))


def parsed_ranges(ranges: DataFrame, cidr: str) -> DataFrame:
    """``ranges`` with ``__digits`` and ``__bits``, null where the text is no range, or one of every address."""
    text = F.trim(cidr)
    digits = address_hex(F.substring_index(text, "/", 1))
    bits = F.when(text.rlike(r"\A[^/]+/[0-9]{1,3}\z"), F.substring_index(text, "/", -1).cast("int"))
    good = digits.isNotNull() & bits.between(1, 4 * F.char_length(digits)) & text.rlike(rf"\A(?:{FIELD_SHAPES['cidr']})\z|:")
    found = F.when(good, F.struct(digits.alias("digits"), bits.alias("bits")))
    parsed = ranges.withColumn("__range", _once(found))
    return parsed.withColumns({"__digits": F.col("__range.digits"), "__bits": F.col("__range.bits")}).drop("__range")


def refused_ranges(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Rows whose text is no range, or a range of every address: ``lookup_range`` leaves them out."""
    return parsed_ranges(ranges, cidr).where(F.col("__digits").isNull()).drop("__digits", "__bits")


def lookup_range(df: DataFrame, address: ColumnLike, ranges: DataFrame, cidr: str = "cidr", value: str = "name",
                 slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Add ``range`` and ``value``: the narrowest range of the table that holds the address, IPv4 or IPv6, else null.

    Ranges may nest and repeat; of equal ranges the one with the least ``value`` counts, then the least text.
    """
    known = parsed_ranges(ranges, cidr).where(F.col("__digits").isNotNull())
    table = known.select(
        F.char_length("__digits").alias("kind"), F.col("__bits").alias("length"), first_bits("__digits", "__bits").alias("start"),
        F.struct(F.col(value).alias("value"), F.trim(cidr).alias("range")).alias("entry"))
    names = {"range": "range", value: "value"}
    return _answer(df, address_hex(address), F.char_length("value"), first_bits("value", "length"), table, names, slice_rows)


def range_blocks(low: ColumnLike, high: ColumnLike) -> Column:
    """The fewest IPv4 blocks ``a.b.c.d/n`` that make up the addresses from ``low`` to ``high``; none if they are in the wrong order.

    Both ends move up the tree of blocks: an odd left end and an odd right end each leave a block behind.
    """
    kind = "array<struct<at:bigint,size:int>>"
    none = F.array().cast(kind)
    start = F.struct(ipv4_number(low).alias("lo"), (ipv4_number(high) + 1).alias("hi"), none.alias("found"))

    def step(s: Column, size: Column) -> Column:
        left, right = (s["lo"] < s["hi"]) & (s["lo"] % 2 == 1), (s["lo"] < s["hi"]) & (s["hi"] % 2 == 1)
        lo, hi = s["lo"] + left.cast("int"), s["hi"] - right.cast("int")

        def block(at: Column) -> Column:
            return F.array(F.struct((at * F.pow(F.lit(2), size).cast("bigint")).alias("at"), size.alias("size"))).cast(kind)

        found = F.concat(s["found"], F.when(left, block(s["lo"])).otherwise(none), F.when(right & (hi >= lo), block(hi)).otherwise(none))
        return F.struct(F.floor(lo / 2).cast("bigint").alias("lo"), F.floor(hi / 2).cast("bigint").alias("hi"), found.alias("found"))

    def text(block: Column) -> Column:
        parts = [F.shiftright(block["at"], shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
        return F.concat(F.concat_ws(".", *parts), F.lit("/"), (32 - block["size"]).cast("string"))

    return F.transform(F.array_sort(F.aggregate(F.sequence(F.lit(0), F.lit(32)), start, step, lambda s: s["found"])), text)


# Paths.


def longest_prefix(df: DataFrame, path: ColumnLike, table: DataFrame, prefix: str = "prefix", value: str = "name",
                   slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Add ``prefix`` and ``value``: the longest prefix of the table that the path starts with, else null.

    Of rows that share a prefix the least ``value`` counts. An empty prefix matches every path, a null one none.
    """
    known = table.where(F.col(prefix).isNotNull())
    # One kind, spelled so that the plan does not take it for a constant and the join for one without keys.
    one = lambda c: F.least(F.char_length(c), F.lit(0))
    entries = known.select(one(prefix).alias("kind"), F.char_length(prefix).alias("length"), F.col(prefix).alias("start"),
                           F.struct(F.col(value).alias("value"), F.col(prefix).alias("prefix")).alias("entry"))
    beginning = F.when(F.char_length("value") >= F.col("length"), F.left(F.col("value"), F.col("length")))
    return _answer(df, as_column(path), one("value"), beginning, entries, {prefix: "prefix", value: "value"}, slice_rows)


def match_route_table(df: DataFrame, path: str, routes: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Add ``backend``: that of the exact route of a path, else of its longest prefix. ``routes``: ``route, exact, backend``.

    Of exact rows that share a route the least backend counts.
    """
    exact = routes.where("exact AND route IS NOT NULL").groupBy(F.col("route").alias("__route")).agg(F.min("backend").alias("__exact"))
    prefixes = routes.where("NOT exact").select(F.col("route").alias("__prefix"), F.col("backend").alias("__below"))
    found = longest_prefix(df.withColumn("__route", F.col(path)), path, prefixes, "__prefix", "__below", slice_rows)
    found = lookup_join(found, exact, ["__route"], slice_rows=slice_rows)
    return found.withColumn("backend", F.coalesce("__exact", "__below")).drop("__route", "__prefix", "__below", "__exact")


def outside_table(items: DataFrame, item: str, allowed: DataFrame, forbidden: str | None = None, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Items that no row of ``allowed(route, exact)`` lists or covers (``unexpected``), or that match a forbidden pattern."""
    known = match_route_table(items, item, allowed.select("route", "exact", F.lit("allowed").alias("backend")), slice_rows)
    reason = first_of(
        (F.col(item).rlike(forbidden) if forbidden else F.lit(False), "forbidden"), (F.col("backend").isNull(), "unexpected"))
    return known.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("backend")
