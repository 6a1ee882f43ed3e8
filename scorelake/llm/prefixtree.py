"""The tree of conversation prefixes, by SQL ROLLUP over positional turn columns.

A node is a distinct sequence of first turns (role, text); conversations that begin with it are its members. How it is built:

1. A turn becomes a 128-bit digest of its role and text, and the number of its words; texts go no further than the scan.
   Turns are numbered by a range sort, so a conversation that holds a third of all rows is spread over many tasks.
2. A conversation is laid out as rows of ``width`` turn columns, its column blocks. A block's ``prior`` names the node that
   the blocks before it lead to: a digest of everything before, found by doubling (blocks 1, 2, 4, ... back are joined in), so
   that rounds grow with the logarithm of the longest conversation. One GROUP BY block, prior, ROLLUP(t1, ..., tw) then
   aggregates all prefixes of all blocks together, and grouping_id gives the depth. Groups whose last turn column is null are
   no nodes.
3. The least member of a node owns it, and (owner, depth) names it. What a conversation owns is one stretch of its path, so a
   sum over a subtree is the sum of what its members own, less what the owner itself owns above the node. A second ROLLUP sums
   that, over owners of shared nodes only: a node of one member has one leaf and saves nothing.
4. Ids that end at a node are joined in pieces of ``PIECE`` after a range sort, and the pieces are hashed in order as a stream.

Defined results: null roles and texts are empty. Turns of one conversation go by their number, nulls first, then by digest; repeated
rows are turns each. Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import materialize

WIDTH = 8
PIECE = 512
#: Turns, or blocks, of one conversation that are joined under one key.
STRETCH = 4096
#: Parents of more than this share of all nodes are broadcast, so there are at most as many of them.
HOT_PARENTS = 10_000


def nothing() -> Column:
    return F.lit(b"")


def digest(*parts: Column) -> Column:
    """16 bytes."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), d (digest of role and text) and n (words of the text) of every turn."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        digest(F.length(who).cast("string"), F.lit(":"), who, said).alias("d"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"),
    )
    order = ["conv_id", "turn", "d"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "d", "n", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            at = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(at)] += seen
            last, seen = ids[-1], int(at[-1])
            yield batch.append_column("at", pa.array(at, pa.int64()))

    local = materialize(sorted_.mapInArrow(run, "conv_id long, d binary, n long, part int, at long"))
    runs = local.groupBy("conv_id", "part").agg(F.max("at").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation goes on from another part at most once a part: as many rows as there are parts
    offsets = runs.withColumn("before", F.sum("rows").over(earlier)).where("before > 0").select("conv_id", "part", "before")
    pos = (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos")
    return local.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", pos, "d", "n")


def spread(rows: DataFrame, last: Column) -> DataFrame:
    """Each row under every stretch number up to that of ``last``, so that what it is joined to needn't meet in one task."""
    return rows.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(last, F.lit(0)) / STRETCH))))


def paths(numbered: DataFrame) -> DataFrame:
    """conv_id, pos, d, n and length of what ``turns`` gives: input of ``tree``."""
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("length"))
    keyed = numbered.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    return keyed.join(spread(sizes, F.col("length")), ["conv_id", "stretch"]).select("conv_id", "pos", "d", "n", "length")


def forked(numbered: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Paths of conversations that begin with the first h turns of the first conversation of their ``group`` ids.

    h is the CRC-32 of the decimal id modulo ``most``; a conversation's own turns follow from its turn h + 1 on. One that is left
    without turns has a row of length 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    leads = numbered.where((F.col("conv_id") == first) & (F.col("pos") < most)).groupBy("conv_id")
    leads = leads.agg(F.sort_array(F.collect_list(F.struct("pos", "d", "n"))).alias("lead")).withColumnRenamed("conv_id", "first")
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"first": first, "h": h})
    taken = F.least(F.col("h"), F.coalesce(F.size("lead"), F.lit(0))).cast("long")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    known = sizes.join(leads, "first", "left").withColumn("taken", taken).withColumn("length", length)
    head = known.select("conv_id", "length", F.explode(F.slice("lead", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    keyed = numbered.where(F.col("pos") > h).withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    rest = keyed.join(spread(known.select("conv_id", "own", "h", "taken", "length"), F.col("own")), ["conv_id", "stretch"])
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d", "n", "length")
    none = known.where("length = 0").select("conv_id", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("long"), "length")
    return head.select("conv_id", "t.pos", "t.d", "t.n", "length").union(rest).union(none)


def column_blocks(rows: DataFrame, width: int) -> DataFrame:
    """conv_id, block, length, prior, own (the node that a full block leads to) and turn columns t1 to t<width> (d, n)."""
    place = F.coalesce(F.col("pos") - 1, F.lit(0))
    cells = rows.select("conv_id", "length", F.floor(place / width).alias("block"), F.when(F.col("pos").isNotNull(), F.struct("pos", "d", "n")).alias("t"))
    wide = cells.groupBy("conv_id", "block").agg(F.max("length").alias("length"), F.sort_array(F.collect_list("t")).alias("t"))
    each = [F.get("t", F.lit(i)) for i in range(width)]
    columns = [F.when(t.isNotNull(), F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias(f"t{i + 1}") for i, t in enumerate(each)]
    blocks = materialize(wide.select("conv_id", "block", "length", *columns))
    deepest = blocks.agg(F.max("block")).first()[0] or 0
    chain = blocks.where(F.col(f"t{width}").isNotNull())
    chain = chain.select("conv_id", "block", digest(*[F.col(f"t{i + 1}.d") for i in range(width)]).alias("own"))
    step = 1
    while step <= deepest:
        back = chain.select("conv_id", (F.col("block") + step).alias("block"), F.col("own").alias("before"))
        joined = F.when(F.col("before").isNull(), F.col("own")).otherwise(digest(F.col("before"), F.col("own")))
        chain = materialize(chain.join(back, ["conv_id", "block"], "left").select("conv_id", "block", joined.alias("own")))
        step *= 2
    if not deepest:
        own = F.when(F.col(f"t{width}").isNotNull(), digest(*[F.coalesce(f"t{i + 1}.d", nothing()) for i in range(width)]))
        return blocks.withColumns({"prior": nothing(), "own": own})
    prior = chain.select("conv_id", (F.col("block") + 1).alias("block"), F.col("own").alias("prior"))
    found = blocks.join(chain, ["conv_id", "block"], "left").join(prior, ["conv_id", "block"], "left")
    return materialize(found.withColumn("prior", F.coalesce("prior", nothing())))


def node_key(width: int, depth: Column) -> Column:
    """Name of the node at ``depth`` turns of a block; that of a full block is ``own``."""
    turns_ = [F.when(depth > i, F.coalesce(F.col(f"t{i + 1}.d"), nothing())).otherwise(nothing()) for i in range(width)]
    inside = digest(F.col("block").cast("string").cast("binary"), F.lit(b":"), F.col("prior"), *turns_)
    return F.when(depth == width, F.col("own")).otherwise(inside)


def rolled_up(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """Every node of the blocks: block, prior, turn columns, own, inside (its depth in the block) and the aggregates ``sums``."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    found = blocks.sparkSession.sql(
        f"""select block, prior, {names}, cast({width} - bit_count(grouping_id()) as int) inside, min(own) own, {sums}
            from {{blocks}} group by block, prior, rollup({names})""",
        blocks=blocks,
    )
    held = sum((F.col(f"t{i + 1}").isNotNull().cast("int") for i in range(width)), F.lit(0))
    return found.where((held == F.col("inside")) & ((F.col("inside") > 0) | (F.col("block") == 0)))


def named(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("key", node_key(width, F.col("inside")))


def stretch_sums(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds to each row of (conv_id, depth) the sums of ``values`` over smaller depths of the conversation, in two levels."""
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    inside = above(Window.partitionBy("conv_id", "stretch").orderBy("depth"))
    across = above(Window.partitionBy("conv_id").orderBy("stretch"))
    whole = rows.groupBy("conv_id", "stretch").agg(*[F.sum(v).alias(name) for name, v in values.items()])
    whole = whole.select("conv_id", "stretch", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"{n}_far") for n in values])
    rows = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(whole, ["conv_id", "stretch"])
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_far") for n in values}).drop("stretch", *[f"{n}_far" for n in values])


def ends(blocks: DataFrame, width: int) -> DataFrame:
    """key and ends_sha256 of every node at which a conversation ends."""
    left = F.col("length") - F.col("block") * width
    last = blocks.where(((left > 0) | (F.col("block") == 0)) & (left <= width))
    rows = last.select(node_key(width, left).alias("key"), "conv_id")
    rows = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            out, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or keys[i] != keys[start] or i - start == PIECE:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = (pa.binary(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    joined = rows.mapInArrow(pieces, "key binary, first long, ids string").repartition("key").sortWithinPartitions("key", "first")
    return joined.mapInArrow(hashed, "key binary, ends_sha256 string")


def tree(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every node of the paths ``rows`` (conv_id, pos, d, n, length): conv_id (its least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, words of a node's last turn for every member but one) and ends_sha256."""
    blocks = column_blocks(rows, width)
    found = rolled_up(blocks, width, "min(conv_id) conv_id, count(*) n_convs")
    root, inside = F.col("inside") == 0, F.col("inside")
    top = node_key(width, F.lit(0))  # of the first block: the root
    parent = F.when(root, None).when((inside == 1) & (F.col("block") > 0), F.col("prior"))
    parent = parent.when(inside == 1, top).otherwise(node_key(width, inside - 1))
    words = F.coalesce(*[F.col(f"t{i}.n") for i in range(width, 0, -1)], F.lit(0))
    nodes = named(found, width).select(
        "key", parent.alias("parent"), "conv_id", (F.col("block") * width + inside).alias("depth"), "n_convs", words.alias("words")
    )
    nodes = materialize(nodes)
    below = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key"))
    below = below.agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = nodes.join(below, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "single")})

    # sums over subtrees, of shared nodes only
    leaf = F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = nodes.where("n_convs > 1").select("key", "conv_id", "depth", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    shared = materialize(shared)
    owners = shared.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.max("depth").alias("reach"))
    owners = spread(owners, F.floor(F.col("reach") / width))
    kept = blocks.withColumn("stretch", F.floor(F.col("block") / STRETCH)).join(owners, ["conv_id", "stretch"])
    kept = kept.where((F.col("block") == 0) | (F.col("block") * width < F.col("reach")))
    cut = {f"t{i + 1}": F.when(F.col("block") * width + i < F.col("reach"), F.col(f"t{i + 1}")) for i in range(width)}
    sums = named(rolled_up(kept.withColumns(cut), width, "sum(leaf) all_leaves, sum(saved) all_saved"), width)
    above = stretch_sums(shared, {"leaves_above": "leaf", "saved_above": "saved"})
    totals = above.join(sums.select("key", "all_leaves", "all_saved"), "key").select(
        "key", (F.col("all_leaves") - F.col("leaves_above")).alias("n_leaves"), (F.col("all_saved") - F.col("saved_above")).alias("saved_tokens")
    )

    # the owner of the parent: parents of many nodes come by broadcast, at most HOT_PARENTS of them
    many = nodes.count() // HOT_PARENTS
    owner = nodes.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("owner"), "n_children")
    hot = owner.where(F.col("n_children") > many).select(F.col("up").alias("parent"), F.col("owner").alias("hot_owner"))
    whole = nodes.join(totals, "key", "left").join(ends(blocks, width), "key", "left").join(F.broadcast(hot), "parent", "left")
    cold = owner.where(F.col("n_children") <= many).drop("n_children")
    whole = whole.withColumn("up", F.when(F.col("hot_owner").isNull(), F.col("parent")).otherwise(F.col("key"))).join(cold, "up", "left")
    return whole.select(
        "conv_id",
        "depth",
        F.when(F.col("parent").isNotNull(), F.coalesce("hot_owner", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
