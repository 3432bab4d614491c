"""Merkle manifest of a dataset: leaf coordinates from compressed bitmaps of ids, levels reduced in slot arrays.

Built-in functions only. The ids of each group form one bitmap, merged from partial bitmaps of the scan's tasks: rows
``(group, word, bits)`` of 64 ids each, of which only words with a bit exist. A popcount directory counts the ids before
each word; it is summed by prefixes of the word number, 2^16 to a prefix, so that however the ids are spread no task
adds up more than 65,536 counts. The rank of an id, which is its leaf's place, is the directory's count plus the
popcount of the bits below it: no leaf is sorted. Leaves then go to the slot arrays of their block, ``fanout ** 5`` to
one, and five levels at once are hashed inside a block; blocks are leaves of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attest.operators.skew import numbered
from attest.session import written

FANOUT = 3
#: Levels that are reduced at once.
BLOCK_LEVELS = 5
#: Bits of a word number that one level of the directory covers.
DIRECTORY_BITS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(fields: Sequence[Column]) -> Column:
    """The fields one after another: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(encoded(fields), 256)


def ranked(rows: DataFrame, by: Sequence[str], key: str, name: str) -> tuple[DataFrame, DataFrame, bool]:
    """``rows`` with how many rows of the group have a smaller ``key`` (a long); the words' counts; whether a key repeats.

    Rows that share group and key share the rank, and count each. ``rows`` is read more than once.
    """
    words = rows.groupBy(*by, F.shiftright(key, 6).alias("__w")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST({key} & 63L AS INT)))").alias("__bits"), F.count("*").alias("__n"))
    words = written(words, "bitmaps")
    facts = words.agg(F.min("__w").alias("low"), F.max("__w").alias("high"), F.bool_or(F.col("__n") > F.bit_count("__bits")).alias("repeats")).first()
    repeats, directory = bool(facts["repeats"]), _counted(words, by, facts["low"] or 0, facts["high"] or 0)
    if repeats:
        more = rows.groupBy(*by, key).agg((F.count("*") - 1).alias("more")).where("more > 0")
        more = more.groupBy(*by, F.shiftright(key, 6).alias("__w")).agg(
            F.collect_list(F.struct(F.expr(f"{key} & 63L").alias("b"), "more")).alias("__more"))
        directory = directory.join(more, [*by, "__w"], "left")
    directory = directory.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__w").alias("__word"), "__bits", "__before", *["__more"] * repeats)
    same = [rows[b] == directory[f"__by{i}"] for i, b in enumerate(by)] + [F.shiftright(rows[key], 6) == F.col("__word")]
    below = f"bit_count(__bits & ~shiftleft(-1L, CAST({key} & 63L AS INT)))"
    extra = f" + coalesce(aggregate(__more, 0L, (a, x) -> a + if(x.b < {key} & 63L, x.more, 0L)), 0L)" if repeats else ""
    out = rows.join(directory, same).withColumn(name, F.expr(f"__before + {below}{extra}"))
    return out.select(*[c for c in rows.columns if c != name], name), words, repeats


def _counted(words: DataFrame, by: Sequence[str], low: int, high: int) -> DataFrame:
    """``words`` with ``__before``, the rows of the group in words before: one level per prefix that tells words apart."""
    level, levels, shift = words, [], 0
    while True:
        # A word number has 58 bits: the last level has 2^10 prefixes of either sign.
        parent = F.shiftright("__w", shift + DIRECTORY_BITS) if shift + DIRECTORY_BITS < 58 else F.lit(0)
        level = level.withColumn("__up", parent)
        before = Window.partitionBy(*by, "__up").orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
        if shift + DIRECTORY_BITS >= 58 or low >> (shift + DIRECTORY_BITS) == high >> (shift + DIRECTORY_BITS):
            break
        # A prefix is held as its first word number, so that all levels shift alike.
        shift += DIRECTORY_BITS
        level = words.groupBy(*by, F.shiftleft(F.shiftright("__w", shift), shift).alias("__w")).agg(F.sum("__n").alias("__n"))
    above = levels.pop()
    while levels:
        shift -= DIRECTORY_BITS
        known = above.select(*by, F.shiftright("__w", shift + DIRECTORY_BITS).alias("__up"), F.col("__before").alias("__base"))
        above = levels.pop().join(known, [*by, "__up"]).withColumn("__before", F.col("__before") + F.col("__base"))
    return above


def placed(leaves: DataFrame, group: str = "group", key: str = "place_key", tie: str = "leaf", tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``pos``, from 0 in each group by key; and ``group, n``.

    Rows that share a key come in the order of ``tie`` (hexadecimal), equal ones of those in the order of ``tag``.
    """
    rows, words, repeats = ranked(leaves, [group], key, "pos")
    sizes = words.groupBy(group).agg(F.sum("__n").alias("n"))
    if not repeats:
        return rows, sizes
    again = leaves.groupBy(group, key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(group).alias("g"), F.col(key).alias("k"))
    tied = leaves.join(again, (leaves[group] == again["g"]) & (leaves[key] == again["k"]), "left_semi")
    tied = tied.select(group, key, F.conv(F.substring(tie, 1, 15), 16, 10).cast("long").alias("t"), tag)
    second = written(ranked(written(tied, "tied"), [group, key], "t", "second")[0], "second")
    third = ranked(second, [group, key, "t"], tag, "third")[0].select(F.col(tag).alias("__tag"), (F.col("second") + F.col("third")).alias("__after"))
    rows = rows.join(third, rows[tag] == third["__tag"], "left")
    return rows.withColumn("pos", F.col("pos") + F.coalesce("__after", F.lit(0))).select(*leaves.columns, "pos"), sizes


def _levels(n: str, fanout: int) -> str:
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(f"{p}L")
        p *= fanout
    return f"size(filter(array({', '.join(powers)}), p -> p < {n}))"


def _up(level: str, fanout: int) -> str:
    """The next level of an array of digests."""
    runs = f"sequence(0, (size({level}) - 1) DIV {fanout})"
    return f"transform({runs}, i -> sha2(array_join(slice({level}, CAST({fanout} * i + 1 AS INT), {fanout}), ''), 256))"


def blocks(nodes: DataFrame, sizes: DataFrame, done: int, fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """``group, block, slots, tree, node``: the levels ``tree`` over the digests of each block, and the node they end in.

    ``done`` levels lie below the nodes. A slot holds a digest and the ``carried`` columns.
    """
    width = fanout**BLOCK_LEVELS
    slot = F.struct(F.expr(f"CAST(pos % {width} AS INT)").alias("at"), "digest", *carried)
    rows = nodes.groupBy("group", F.expr(f"pos DIV {width}").alias("block")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    left = F.expr(f"CAST(least({BLOCK_LEVELS}, greatest({_levels('n', fanout)} - {done}, 0)) AS INT)")
    rows = rows.join(sizes, "group").withColumn("left", left)
    steps = ", ".join(map(str, range(BLOCK_LEVELS)))
    tree = f"aggregate(slice(array({steps}), 1, left), array(slots.digest), (a, x) -> concat(a, array({_up('element_at(a, -1)', fanout)})))"
    rows = rows.withColumn("tree", F.expr(tree)).withColumn("node", F.expr("element_at(tree, -1)[0]"))
    return rows.select("group", "block", "slots", "tree", "node")


def _path(fanout: int) -> str:
    """Of slot ``s``, level by level: the digests of its run that stand before it and after it."""
    width = "CAST(power({f}, l) AS INT)".replace("{f}", str(fanout))
    at, run = f"(s.at DIV {width})", f"(s.at DIV ({width} * {fanout}) * {fanout})"
    before = f"slice(tree[l], CAST({run} + 1 AS INT), CAST({at} - {run} AS INT))"
    after = f"slice(tree[l], CAST({at} + 2 AS INT), CAST({run} + {fanout} - 1 - {at} AS INT))"
    levels = "if(size(tree) > 1, sequence(0, size(tree) - 2), CAST(array() AS ARRAY<INT>))"
    return f"transform({levels}, l -> struct(array_join({before}, '') AS before, array_join({after}, '') AS after))"


def reduced(nodes: DataFrame, sizes: DataFrame, most: int, fanout: int = FANOUT, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``group, pos, digest, <carried>, path`` for every node, with the siblings up to its group's root; and ``group, node``.

    ``most`` is the largest number of nodes of a group.
    """
    rounds, width, count, done = [], fanout**BLOCK_LEVELS, most, 0
    while True:
        level = written(blocks(nodes, sizes, done, fanout, carried if not rounds else ()), "blocks")
        rounds.append(level)
        nodes = level.select("group", F.col("block").alias("pos"), F.col("node").alias("digest"))
        if count <= width:
            break
        count, done = -(-count // width), done + BLOCK_LEVELS
    roots = nodes.select("group", F.col("digest").alias("node"))
    above = None
    for k, level in reversed(list(enumerate(rounds))):
        if above is not None:
            known = above.select(F.col("group").alias("__g"), F.col("pos").alias("__p"), F.col("path").alias("rest"))
            level = level.join(known, (level["group"] == known["__g"]) & (level["block"] == known["__p"])).drop("__g", "__p")
        rest = "rest" if above is not None else "CAST(array() AS ARRAY<STRUCT<before: STRING, after: STRING>>)"
        path = f"transform(slots, s -> struct(s AS slot, concat({_path(fanout)}, {rest}) AS path))"
        above = level.select("group", "block", F.explode(F.expr(path)).alias("x")).select(
            "group", (F.col("block") * width + F.col("x.slot.at")).alias("pos"), F.col("x.slot.digest").alias("digest"),
            *[F.col(f"x.slot.{c}").alias(c) for c in (carried if k == 0 else ())], F.col("x.path").alias("path"))
    return above, roots


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, fanout: int = FANOUT,
             also: dict[str, Column] | None = None) -> DataFrame:
    """``key, source, pos, leaf, path, subroot, root`` and the columns ``also``, one row for each row of ``docs``.

    A source's leaves ascend by key, which is cast to long. A null key stands where the smallest long does; rows that
    share a key come in the order of their leaves, and equal leaves one after another. Every ``fanout`` nodes that
    follow one another become their digest, the last run of a level too, however short, while there is more than one;
    a lone leaf is its source's subroot. Subroots ascend by source, null first, and form the tree above. ``path`` holds
    for each level the siblings ``before`` and ``after``. Null and empty values differ; other columns are not read;
    no rows give no rows and no root.
    """
    also = also or {}
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("group"),
        place.alias("place_key"), leaf([F.col(f) for f in fields]).alias("leaf"), F.monotonically_increasing_id().alias("tag"),
        *[c.alias(f"also{i}") for i, c in enumerate(also.values())])
    leaves = written(rows, "leaves")
    extra = [f"also{i}" for i in range(len(also))]
    nodes, sizes = placed(leaves)
    sizes = written(sizes, "sizes")
    nodes = nodes.select("group", "pos", F.col("leaf").alias("digest"), "key", *extra)
    facts = sizes.agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    below, subroots = reduced(nodes, sizes, facts["most"] or 0, fanout, ["key", *extra])
    order = numbered(subroots, ["group"], "pos").select(F.left("group", F.lit(0)).alias("group"), (F.col("pos") - 1).alias("pos"), F.col("node").alias("digest"), F.col("group").alias("of"))
    # The tree above has one group, the empty text, spelled so that joins keep their key.
    whole = sizes.groupBy(F.left("group", F.lit(0)).alias("group")).agg(F.count("*").alias("n"))
    tops, root = reduced(order, whole, facts["groups"], fanout, ["of"])
    known = tops.join(root, "group").select(F.col("of").alias("__of"), F.col("digest").alias("subroot"), F.col("path").alias("above"), F.col("node").alias("root"))
    out = below.join(known, below["group"] == known["__of"])
    return out.select(
        F.col("key").alias(key), F.when(F.col("group").startswith("s"), F.expr("substring(group, 2)")).alias(source), "pos",
        F.col("digest").alias("leaf"), F.concat("path", "above").alias("path"), "subroot", "root",
        *[F.col(f"also{i}").alias(name) for i, name in enumerate(also)])


def tampered(key: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf after every second row's text, by the crc32 of its key, lost its line ends; null where nothing changes."""
    lost = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    hit = (F.crc32(F.col(key).cast("string")) % 2 == 0) & F.contains(F.col(text), F.lit("\n"))
    return F.when(hit, leaf([lost if f == text else F.col(f) for f in fields]))


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), CAST(2 * i + 1 AS INT), 2))::BIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: {byte}), 4294967295)"


def _encoded_sql(fields: Sequence[str]) -> str:
    return " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f}), '-')" for f in fields)


def _siblings(level: str) -> str:
    """What stands before and after each node in its run."""
    return f"""SELECT a.source, a.l, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
    FROM {level} a JOIN {level} b ON a.source IS NOT DISTINCT FROM b.source AND a.l = b.l AND a.pos // 3 = b.pos // 3
    WHERE a.n > 1 GROUP BY ALL"""


_LOST = "CASE WHEN {} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END".format(_crc32("doc_id::VARCHAR"))
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, sha256({_encoded_sql(FIELDS)}) AS leaf, sha256({_encoded_sql([*FIELDS[:-1], _LOST])}) AS tampered,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
lv AS (SELECT source, 0 AS l, pos, leaf AS digest, n FROM d
       UNION ALL SELECT source, l + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, l, pos // 3, n),
subs AS (SELECT source AS of, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tops AS (SELECT NULL::VARCHAR AS source, 0 AS l, pos, subroot AS digest, n FROM subs
         UNION ALL SELECT source, l + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY source, l, pos // 3, n),
near AS ({_siblings("lv")}), far AS ({_siblings("tops")}),
up AS (SELECT doc_id, source, 0 AS l, pos, tampered AS h, '' AS proof FROM d
       UNION ALL SELECT doc_id, up.source, up.l + 1, up.pos // 3, sha256(pre || h || post), proof || pre || post
       FROM up JOIN near USING (l, pos) WHERE up.source IS NOT DISTINCT FROM near.source),
mid AS (SELECT doc_id, source, arg_max(h, l) AS h, arg_max(proof, l) AS proof FROM up GROUP BY ALL),
top AS (SELECT doc_id, 0 AS l, pos, h, proof FROM mid JOIN subs ON mid.source IS NOT DISTINCT FROM subs.of
        UNION ALL SELECT doc_id, top.l + 1, top.pos // 3, sha256(pre || h || post), proof || pre || post FROM top JOIN far USING (l, pos)),
done AS (SELECT doc_id, arg_max(h, l) AS folded_root, sha256(arg_max(proof, l)) AS proof_sha256 FROM top GROUP BY ALL)
SELECT doc_id, leaf, subroot, digest AS root, proof_sha256, folded_root, folded_root = digest AS verified
FROM d JOIN done USING (doc_id) JOIN subs ON d.source IS NOT DISTINCT FROM subs.of JOIN tops ON tops.n = 1
"""
