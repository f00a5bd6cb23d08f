"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Every conversation is a path from the root; a node stands for the distinct
sequence of its first turns.  Its key is a running XOR of two 64-bit hashes of
(depth, SHA-256 of the turn), so texts are read once and never shuffled.

Subtree totals come from contraction rounds over the edge table.  A round
*rakes* all leaves (their totals are final and are added to their parents in
one aggregate) and *compresses* unary chains (a node with one child left is
taken out where its bit is set and its child's is not, so no two neighbours
go at once; the child is linked to the grandparent and carries what the node
had gathered).  The bits are those of the depth first, which halve a chain,
then of a hash.  When the root alone is left, the rounds are expanded again in
reverse: the total of a node that was taken out is that of its child, plus
what stood between them.  Every round is stored before the next one reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

#: Conversation ids in a piece of an end list.
PIECE = 1 << 16
#: Rounds that compress by the bits of the depth; later ones take hash bits.
DEPTH_ROUNDS = 20


# --------------------------------------------------------------------- turns

def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, digest, words): turns in order, null turn numbers first, equal ones by SHA-256 of role and text."""
    said, by = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (text, role))
    content = F.unhex(F.sha2(F.concat_ws(":", F.length(by).cast("string"), by, said), 256))
    rows = conversations.select(F.col(quoted(conv)).cast("long").alias("conv"), F.col(quoted(turn)).alias("turn"),
                                content.alias("digest"), F.regexp_count(said, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return (rows.filter("conv IS NOT NULL")
            .select("conv", (F.row_number().over(order) - 1).alias("place"), "digest", "words"))


def rebuilt_turns(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, digest, words) of the rebuilt conversations, and (conv, n), the turns of each.

    Conversation c takes the first h turns of c - c % ``family`` (all if
    fewer, none if absent), h = crc32(decimal c) % ``most``, then its own
    turns after its first h.
    """
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    heads = sizes.select("conv", "own", taken.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = stored(heads.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
                   .withColumn("k", F.least("h", F.coalesce("there", F.lit(0))).cast("int")), "trie-heads")
    first = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    copied = (heads.filter("k > 0").select("conv", "base", "k").join(first, "base").filter("place < k")
              .select("conv", (F.col("place") + 1).alias("depth"), "digest", "words"))
    own = (turns.join(heads.select("conv", "h", "k"), "conv").filter("place >= h")
           .select("conv", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "words"))
    lengths = heads.select("conv", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return copied.union(own), lengths


# --------------------------------------------------------------------- nodes

def _key(x: Column, y: Column) -> Column:
    """Sixteen bytes from two longs."""
    return F.unhex(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))


def path_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words, ends): one row for each conversation and node on its path, the root included."""
    order = Window.partitionBy("conv").orderBy("depth")
    marked = turns.withColumn("x", F.xxhash64("depth", "digest")).withColumn("y", F.xxhash64("digest", "depth"))
    x, y = F.bit_xor("x").over(order), F.bit_xor("y").over(order)
    last = F.lead("depth").over(order).isNull()
    below = (marked.select("conv", "depth", "words", "x", "y", x.alias("to_x"), y.alias("to_y"), last.alias("ends"))
             .select("conv", "depth", _key(F.col("to_x"), F.col("to_y")).alias("node"),
                     _key(F.col("to_x").bitwiseXOR(F.col("x")), F.col("to_y").bitwiseXOR(F.col("y"))).alias("parent"), "words", "ends"))
    # The key of the root is the XOR of no turns.
    root = lengths.select("conv", F.lit(0).alias("depth"), F.lit(bytes(16)).alias("node"), F.lit(None).cast("binary").alias("parent"),
                          F.lit(0).alias("words"), (F.col("n") == 0).alias("ends"))
    return below.union(root)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """(node, parent, depth, conv, n_convs, words, n_children): one row a node, by aggregates that combine before the shuffle."""
    nodes = stored(paths.groupBy("node", "depth").agg(F.first("parent").alias("parent"), F.min("conv").alias("conv"),
                                                      F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words")), "trie-members")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n_children"))
    return (nodes.join(children, F.col("node") == F.col("p"), "left").drop("p")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): lower-case SHA-256 of the ids (node, conv) of each node, ascending and comma-joined.

    A digest needs its bytes in order, so the ids of a node are joined to
    pieces in parallel (range-partitioned by node and id, which splits a hot
    node), and one task streams the pieces of a node through the hash.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([held[0]], pa.int64()),
                                               pa.array([",".join(map(str, held))], pa.string())], names=["node", "conv", "piece"])

        for batch in batches:
            for key, conv in zip(batch["node"].to_pylist(), batch["conv"].to_pylist()):
                if held and (key != node or len(held) == PIECE):
                    yield out()
                    held = []
                node = key
                held.append(conv)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                              names=["node", "ends_sha256"])

        for batch in batches:
            for key, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist()):
                if state is not None and key == node:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    yield out()
                node, state = key, hashlib.sha256(piece.encode())
        if state is not None:
            yield out()

    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    joined = ranged.mapInArrow(pieces, "node binary, conv long, piece string")
    return (joined.repartition("node").sortWithinPartitions("node", "conv")
            .mapInArrow(digests, "node binary, ends_sha256 string"))


# --------------------------------------------------------------- contraction

def subtree_totals(nodes: DataFrame, values: list[str], max_rounds: int = 400) -> DataFrame:
    """(node, *values): each value summed over the subtree of every node, itself included.

    ``nodes``: node, parent (null for the one root), depth, n_children and the
    long ``values``; the edges form one tree.
    """
    up = [f"up_{v}" for v in values]
    active = stored(nodes.select("node", "parent", "depth", F.col("n_children").alias("left"), *values,
                                 *[F.lit(0).cast("long").alias(u) for u in up]), "trie-active")
    raked, taken = [], []
    size = active.count()
    while size > 1:
        at = len(raked)
        if at == max_rounds:
            raise RuntimeError(f"contraction did not end in {max_rounds} rounds")
        bit = (F.shiftright("depth", at) if at < DEPTH_ROUNDS else F.xxhash64("node", F.lit(at))).bitwiseAND(F.lit(1))
        leaf = (F.col("left") == 0) & F.col("parent").isNotNull()
        # Rake: what leaves hand to their parents, and the children that stay.
        stays = F.when(~leaf, F.struct("node", bit.alias("bit")))
        handed = active.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(
            F.count(stays).alias("rest"), F.min(stays).alias("child"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(u))).alias(f"got_{v}") for v, u in zip(values, up)])
        alone = (F.col("rest") == 1) & F.col("parent").isNotNull()
        rest = stored(active.filter(~leaf).join(handed, F.col("node") == F.col("p"), "left").select(
            "node", "parent", "depth", F.coalesce("rest", F.lit(0)).cast("long").alias("left"),
            *[(F.col(v) + F.coalesce(f"got_{v}", F.lit(0))).alias(v) for v in values], *up,
            F.when(alone & (bit == 1) & (F.col("child.bit") == 0), F.col("child.node")).alias("child")), "trie-raked")
        # Compress: chosen nodes go, their children move up to the grandparent.
        gone = rest.filter("child IS NOT NULL")
        moved = gone.select("child", F.col("parent").alias("to"), *[(F.col(v) + F.col(u)).alias(f"add_{v}") for v, u in zip(values, up)])
        after = stored(rest.filter("child IS NULL").drop("child").join(moved, F.col("node") == F.col("child"), "left").select(
            "node", F.coalesce("to", "parent").alias("parent"), "depth", "left", *values,
            *[(F.col(u) + F.coalesce(f"add_{v}", F.lit(0))).alias(u) for v, u in zip(values, up)]), "trie-active")
        raked.append(active.filter(leaf).select("node", *values))
        # A chosen node's total: its child's, what the child carries from between them, and its own.
        carried = rest.select(F.col("node").alias("child"), *up)
        taken.append(gone.select("node", "child", *values).join(carried, "child").select(
            "node", "child", *[(F.col(v) + F.col(u)).alias(v) for v, u in zip(values, up)]))
        active, size = after, after.count()
    totals = active.select("node", *values)
    for leaves, chosen in zip(reversed(raked), reversed(taken)):
        below = totals.select(F.col("node").alias("child"), *[F.col(v).alias(f"below_{v}") for v in values])
        grown = chosen.join(below, "child").select("node", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values])
        totals = stored(totals.union(leaves).union(grown), "trie-totals")
    return totals


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                family: int = 20, most: int = 4) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn, null turns first and equal ones by a
    digest of role and text; null roles and texts count as empty, rows with a
    null conversation id take no part, and repeated rows are turns like
    others.  Each conversation is rebuilt with the head of another
    (``rebuilt_turns``), and one that is left without turns is a member of the
    root alone.  n_leaves and saved_tokens are sums over the subtree: of
    childless nodes, and of (n_convs - 1) times the words of a node's last
    text.  An empty table gives no node.  Further columns are ignored.
    """
    turns = stored(turn_rows(conversations, conv, turn, role, text), "trie-turns")
    paths = stored(path_rows(*rebuilt_turns(turns, family, most)), "trie-paths")
    nodes = stored(trie_nodes(paths).select(
        "*", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens")), "trie-nodes")
    totals = subtree_totals(nodes, ["n_leaves", "saved_tokens"])
    ends = end_digests(paths.filter("ends"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return (nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, "node", "left").join(above, "parent", "left")
            .select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
