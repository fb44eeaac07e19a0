"""A trie of conversation prefixes, by prefix-doubling naming.

Turns get dense names. In round k two neighbouring blocks of 2^(k-1) turns become one of 2^k, and equal
pairs of names get one dense name: after log2(longest) rounds every aligned power-of-two block of turns
has a name that stands for its whole content. A prefix of d turns is then composed along the binary
digits of d, from the largest block down: its name is made of the name of the prefix without its last
block and the name of that block. Among prefixes of one depth the smallest member names a node, so
grouping by that pair of names gives a node's members, and its sums need no walk over the tree: a
subtree's leaves and tokens are sums over the members' own paths.

Every group is summed before it is shuffled and joined back by equality, which Spark splits where a
key is hot; turns of one long conversation are ranked and summed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.session import materialize, ship

#: Turns of a conversation whose sums are taken in one task.
BLOCK = 4_096
#: Ids of a node that one row of text holds.
IDS = 8_192


def ranked(rows: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their number (from 0) in ``order`` within ``group``; a group may span many tasks.

    Rows are dealt by range, numbered in each part, and moved up by the rows of their group in earlier
    parts. Rows equal in ``group`` and ``order`` follow one another in any order.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, group, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = dealt.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__p")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(before, [group, "__p"]).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__p", "__own", "__before")


def named(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """``rows`` with a dense name (0, 1, ...) for each distinct combination of ``keys``."""
    distinct = rows.groupBy(*keys).agg(F.count("*").alias("__n")).drop("__n")
    # Written before it is used: names must stay what they are if a task runs again.
    parts = materialize(distinct.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "names")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__low"))  # a row for each task
    offset = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n") - F.col("__low")
    offsets = F.broadcast(sizes.select("__p", offset.alias("__offset")))
    table = parts.join(offsets, "__p").select(*keys, (F.col("__i") + F.col("__offset")).alias(name))
    return rows.join(table, keys)


def rebuild(turns: DataFrame, shared: int = 9, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations (c) and their rebuilt turns (c, pos, key, bytes).

    From turns (conv_id, turn, role, text), texts by SHA-256. Conversation c starts with the first
    h = crc32(c) % ``shared`` turns of conversation c - c % ``every`` and goes on with its own behind its first h.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    # The length of the role keeps (role, text) apart from other splits of the same characters.
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    short = turns.filter("conv_id is not null").select("conv_id", "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    original = materialize(ranked(short, "conv_id", ["turn", "key"]), "turns")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % shared
    head = F.col("c") - F.col("c") % every
    every_c = materialize(original.select(F.col("conv_id").alias("c")).distinct().select("c", h.alias("h"), head.alias("head")), "conversations")
    first = original.filter(F.col("pos") < shared - 1).select(F.col("conv_id").alias("head"), "pos", "key", "bytes")
    heads = materialize(every_c.join(first, "head").filter("pos < h").select("c", "pos", "key", "bytes"), "heads")
    begun = heads.groupBy("c").agg(F.count("*").alias("n"))
    own = original.withColumnRenamed("conv_id", "c").join(every_c.select("c", "h").join(begun, "c", "left"), "c").filter("pos >= h")
    moved = own.select("c", (F.col("pos") - F.col("h") + F.coalesce("n", F.lit(0))).alias("pos"), "key", "bytes")
    return every_c.select("c"), moved.unionByName(heads)


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, ...: (c, block, name), the dense name of turns [block * 2^k, (block + 1) * 2^k) of c."""
    found = [materialize(turns.select("c", F.col("pos").alias("block"), "name"), "blocks-0")]
    while 2 ** len(found) <= longest:
        half = F.col("block") % 2
        pairs = found[-1].groupBy("c", F.expr("block div 2").alias("block")).agg(*[F.max(F.when(half == i, F.col("name"))).alias(s) for i, s in enumerate("ab")])
        pairs = materialize(pairs.filter("a is not null and b is not null"), f"pairs-{len(found)}")
        found.append(materialize(named(pairs, ["a", "b"]).select("c", "block", "name"), f"blocks-{len(found)}"))
    return found


def _prefixes(blocks: list[DataFrame], everyone: DataFrame) -> DataFrame:
    """(c, depth, node, n): the smallest member and the number of members of the node of each prefix, the empty one too."""
    size = everyone.agg(F.min("c").alias("node"), F.count("*").alias("n"))
    done = everyone.select("c", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(size))  # one row
    for k in range(len(blocks) - 1, -1, -1):
        # Prefixes of a multiple of 2^(k+1) turns have a name; those that end in a block of 2^k turns follow from them.
        last = blocks[k].filter("block % 2 = 0").select("c", (F.col("block") * 2**k).alias("depth"), "name")
        longer = materialize(done.select("c", "depth", "node").join(last, ["c", "depth"]).withColumn("depth", F.col("depth") + 2**k), f"longer-{k}")
        # Written, so that both sides of the join are dealt anew and Spark can split a node of many members.
        nodes = materialize(longer.groupBy("depth", "node", "name").agg(F.min("c").alias("least"), F.count("*").alias("n")), f"nodes-{k}")
        grown = longer.join(nodes, ["depth", "node", "name"]).select("c", "depth", F.col("least").alias("node"), "n")
        done = done.unionByName(materialize(grown, f"prefixes-{k}"))
    return done


def _from_here(rows: DataFrame, group: str, at: str, value: Column) -> DataFrame:
    """``rows`` with ``tail``, the sum of ``value`` over the rows of ``group`` from this one on, in the order of ``at``."""
    rows = rows.withColumn("__v", value).withColumn("__b", F.expr(f"{at} div {BLOCK}"))
    sums = rows.groupBy(group, "__b").agg(F.sum("__v").alias("__s"))
    rest = sums.withColumn("__rest", F.sum("__s").over(Window.partitionBy(group).orderBy(F.desc("__b"))) - F.col("__s")).drop("__s")
    inside = F.sum("__v").over(Window.partitionBy(group, "__b").orderBy(F.desc(at)))
    return rows.withColumn("__t", inside).join(rest, [group, "__b"]).withColumn("tail", F.col("__t") + F.col("__rest")).drop("__v", "__b", "__t", "__rest")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, c) to (depth, node, first, ids): up to ``IDS`` ids of a node, joined by commas."""
    held: list[list] = []
    depth = node = None
    ids: list[int] = []

    def close() -> None:
        if ids:
            held.append([depth, node, ids[0], ",".join(map(str, ids))])
            ids.clear()

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(columns[3], pa.string())], ["depth", "node", "first", "ids"])

    for batch in batches:
        for d, v, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (d, v) != (depth, node) or len(ids) >= IDS:
                close()
                depth, node = d, v
            ids.append(c)
        if len(held) >= 4_096:
            yield out()
    close()
    if held:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, first, ids) to (depth, node, ends_sha256): one running hash a node, whatever its size."""
    held: list[tuple] = []
    now, state = None, None

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:2]] + [pa.array(columns[2], pa.string())], ["depth", "node", "ends_sha256"])

    for batch in batches:
        for d, v, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "node", "ids")), strict=True):
            if (d, v) != now:
                if now:
                    held.append((*now, state.hexdigest()))
                now, state = (d, v), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(held) >= 4_096:
            yield out()
    if now:
        held.append((*now, state.hexdigest()))
        yield out()


def _ends(last: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, c): ids are joined in many tasks, and the joined texts hashed in order.

    SHA-256 has to see a node's ids one after another, so its texts pass one task, as a stream.
    """
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["depth", "node", "c"]
    parts = last.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, node long, first long, ids string")
    dealt = parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return dealt.mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shared: int = 9, every: int = 5) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations (see ``rebuild``), from turns (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256; a subtree includes its top.

    Turns are ordered by turn, nulls first, equal ones by a hash of role and text; null role and text
    are empty; rows without a conv_id take no part; repeated rows are turns of their own. c % 5 has the sign of c, as in
    SQL. An empty table gives no node, not even a root. Other columns take no part.
    """
    ship(turns.sparkSession)
    everyone, rebuilt = rebuild(turns.select("conv_id", "turn", "role", "text"), shared, every)
    rows = materialize(named(rebuilt, ["key"]).select("c", "pos", "bytes", "name"), "rebuilt")
    longest = rows.agg(F.max("pos")).first()[0]
    done = _prefixes(_blocks(rows, longest + 1) if longest is not None else [], everyone)
    sized = done.join(rows.select("c", (F.col("pos") + 1).alias("depth"), "bytes"), ["c", "depth"], "left")
    length = rows.groupBy("c").agg(F.count("*").alias("length"))
    full = everyone.join(length, "c", "left").select("c", F.coalesce("length", F.lit(0)).alias("length"))
    paths = sized.join(full, "c")
    # A node's bytes are saved once for each member but its smallest.
    saved = F.when(F.col("c") != F.col("node"), F.coalesce("bytes", F.lit(0))).otherwise(0).cast("long")
    paths = materialize(_from_here(paths, "c", "depth", saved), "paths")
    top = paths.filter("c = node")
    above = paths.select("c", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    tops = materialize(top.select("c", "depth", "n").join(above, ["c", "depth"], "left"), "tops")
    children = tops.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    # A leaf's members all end there, so its smallest member's path is the leaf's.
    ends = paths.filter("depth = length")
    leaf = tops.select("depth", F.col("c").alias("node")).join(children, ["depth", "node"], "left_anti").select(F.col("node").alias("c")).withColumn("leaf", F.lit(1))
    sums = paths.join(leaf, "c", "left").groupBy("depth", "node").agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("tail").alias("saved_tokens"))
    nodes = tops.withColumnRenamed("c", "node").join(sums, ["depth", "node"]).join(children, ["depth", "node"], "left").join(_ends(ends), ["depth", "node"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
