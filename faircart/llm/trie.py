"""A prefix trie over conversations, built as a burst trie.

Distinct sequences of turn ids start out in one container under the root. A container of more than ``capacity`` sequences
bursts: its head becomes a node of the upper trie, and its sequences move to one container for each next turn id. What is left are
containers of bounded size; shards of them are sorted by turn ids and swept once, where each sequence closes the nodes
that it doesn't share with its neighbour before. The upper trie is summed up from the deepest heads to the root.

Equal conversations are one sequence with a count, so copies never fill a container; the ids of a sequence's copies are
hashed from sorted pieces, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

CAPACITY = 2048
#: Conversation ids in one piece of a hashed list.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv long, depth int, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, above binary"


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)), 1, 16)


def turn_lists(turns: DataFrame) -> DataFrame:
    """``(conv, ids, sizes)``: of each conversation, in order of turn (null first), turn ids and UTF-8 bytes of their texts.

    Null roles and texts are empty. Turns of one number are ordered by their ids. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct(
        F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"), turn_id(role, text).alias("id"), F.octet_length(text).alias("size")
    )
    found = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), one.alias("t"))
    found = found.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return found.select("conv", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def list_digests(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, ends)``: SHA-256 of each key's numbers in ascending order, comma-joined; in pieces, as one key may hold most rows."""
    cut = rows.select(key, number).repartitionByRange(key, number).sortWithinPartitions(key, number)
    kind = rows.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = None, []

        def out():
            columns = [pa.array([held], batch.schema[0].type), pa.array(numbers[:1], pa.int64()), pa.array([",".join(map(str, numbers))])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "first", "text"])

        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if numbers and (k != held or len(numbers) == PIECE):
                    yield out()
                    numbers = []
                held = k
                numbers.append(n)
        if numbers:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None

        def out(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(next(columns), batch.schema[0].type), pa.array(next(columns), pa.string())], names=["key", "ends"])

        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == held:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((held, sha.hexdigest()))
                    held, sha = k, hashlib.sha256()
                sha.update(text.encode())
            if done:
                yield out(done)
        if sha:
            yield out([(held, sha.hexdigest())])

    parts = cut.mapInArrow(pieces, f"key {kind}, first long, text string")
    parts = parts.repartition("key").sortWithinPartitions("key", "first")
    return parts.mapInArrow(joined, f"key {kind}, ends string").withColumnRenamed("key", key)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted sequences ``(head, above, depth, ids, sizes, conv, n, ends)``, head by head.

    Open nodes are a stack; a closed node waits with its parent until that one's smallest conversation is known. The
    top node of a head is left with ``above``, the key of the head over it.
    """
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [c.split()[0] for c in NODE.split(", ")]
    held, top, stack, out = None, None, [], []

    def opened(size):
        return {"conv": None, "n": 0, "size": size, "children": [], "leaves": 0, "saved": 0, "ends": EMPTY}

    def close():
        node, depth = stack.pop(), held[2] + len(stack)
        node["saved"] += (node["n"] - 1) * node["size"]
        node["leaves"] = node["leaves"] or 1
        for c, d in node["children"]:
            out.append((c["conv"], d, node["conv"], c["n"], len(c["children"]), c["leaves"], c["saved"], c["ends"], None))
        if stack:
            up = stack[-1]
            up["children"].append((node, depth))
            up["conv"] = node["conv"] if up["conv"] is None else min(up["conv"], node["conv"])
            for k in ("n", "leaves", "saved"):
                up[k] += node[k]
        else:
            out.append((node["conv"], depth, None, node["n"], len(node["children"]), node["leaves"], node["saved"], node["ends"], held[1]))
        node["children"] = [None] * len(node["children"])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        for head, above, depth, ids, sizes, conv, n, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is None or head != held[0]:
                while stack:
                    close()
                held, top = (head, above, depth), []
                stack.append(opened(sizes[depth - 1] if depth else 0))
                shared = depth
            else:
                shared = depth
                while shared < len(ids) and shared < len(top) and ids[shared] == top[shared]:
                    shared += 1
                while len(stack) > shared - depth + 1:
                    close()
            for d in range(shared, len(ids)):
                stack.append(opened(sizes[d]))
            last = stack[-1]
            last["conv"] = conv if last["conv"] is None else min(conv, last["conv"])
            last["n"] += n
            last["ends"] = ends
            top = ids
        if len(out) >= 4096:
            yield batch(out)
            out = []
    while stack:
        close()
    if out:
        yield batch(out)


def prefix_nodes(lists: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Nodes of the trie over ``lists(conv, ids, sizes)``, one row per conversation, ``conv`` distinct and not null.

    Returns ``(conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends)``: a node is named by its smallest conversation
    and its depth; ``ends`` hashes the ascending ids of the conversations that end there. Empty lists end at the root. Without
    conversations there is no node, not even a root. One sequence's ids and sizes are in memory at once, never the
    conversations of a node.
    """
    lists = lists.withColumn("seq", F.unhex(F.sha2(F.array_join(F.transform("ids", lambda x: F.hex(x)), ""), 256)))
    lists = materialise(lists, "trie-lists")
    seqs = lists.groupBy("seq").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    seqs = seqs.join(list_digests(lists, "seq", "conv"), "seq").join(lists.select("conv", "ids", "sizes"), "conv")
    root = F.unhex(F.lit("00"))
    state = seqs.select(root.alias("head"), F.lit(None).cast("binary").alias("above"), F.lit(0).alias("depth"), "ids", "sizes", "conv", "n", "ends")
    state = materialise(state, "trie-0")
    small, burst, depth = [], [], 0
    while True:
        # One row a head tells which containers burst; only heads above capacity are kept.
        full = state.groupBy("head").agg(F.count("*").alias("held"), F.max(F.size("ids")).alias("longest"))
        full = materialise(full.where((F.col("held") > capacity) & (F.col("longest") > depth)).select("head"), "trie-full")
        if full.isEmpty():
            small.append(state)
            break
        small.append(state.join(full, "head", "left_anti"))
        big = state.join(full, "head", "left_semi")
        here = F.size("ids") == depth
        size = F.first("sizes")[depth - 1].cast("long") if depth else F.lit(0).cast("long")
        heads = big.groupBy("head").agg(
            F.min("conv").alias("conv"), F.first("above").alias("above"), F.sum("n").alias("n_convs"), size.alias("size"), F.max(F.when(here, F.col("ends"))).alias("ends")
        )
        burst.append(materialise(heads, "trie-heads"))
        following = F.unhex(F.sha2(F.concat("head", F.col("ids")[depth]), 256))
        state = big.where(~here).select(following.alias("head"), F.col("head").alias("above"), F.lit(depth + 1).alias("depth"), "ids", "sizes", "conv", "n", "ends")
        depth += 1
        state = materialise(state, f"trie-{depth}")
    shards = reduce(DataFrame.unionByName, small).repartition("head").sortWithinPartitions("head", "ids")
    nodes = materialise(shards.mapInArrow(sweep, NODE), "trie-swept")
    tops = nodes.where("above is not null")
    out = [nodes.where("above is null").drop("above")]
    for depth in range(len(burst) - 1, -1, -1):
        # Tops of containers and burst heads of the next depth are the children; each gets its parent's conversation.
        children = tops.where(F.col("depth") == depth + 1) if depth == len(burst) - 1 else tops.where(F.col("depth") == depth + 1).unionByName(last)
        named = burst[depth].select(F.col("head").alias("above"), F.col("conv").alias("up"))
        out.append(children.join(named, "above").withColumn("parent_conv", F.col("up")).drop("above", "up"))
        sums = children.groupBy("above").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        last = burst[depth].join(sums.withColumnRenamed("above", "head"), "head").select(
            "conv",
            F.lit(depth).alias("depth"),
            F.lit(None).cast("long").alias("parent_conv"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
            F.coalesce("ends", F.lit(EMPTY)).alias("ends"),
            "above",
        )
        last = materialise(last, "trie-upper")
    if burst:
        out.append(last.drop("above"))
    return reduce(DataFrame.unionByName, out)


def rebuilt(lists: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """``lists`` with the first turns of each conversation replaced by those of the next smaller multiple of ``every``.

    How many is crc32 of the decimal id modulo ``modulus``; a base that is absent gives none, a shorter one all it has.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % modulus).cast("int")
    base = lists.where(F.col("conv") % every == 0).select(
        F.col("conv").alias("base"), F.slice("ids", 1, modulus - 1).alias("base_ids"), F.slice("sizes", 1, modulus - 1).alias("base_sizes")
    )
    met = lists.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", h).join(base, "base", "left")

    def both(first: str, own: str) -> Column:
        head = F.slice(F.coalesce(first, F.slice(own, 1, 0)), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))).alias(own)

    return met.select("conv", both("base_ids", "ids"), both("base_sizes", "sizes"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    nodes = prefix_nodes(rebuilt(turn_lists(table(spark, sf_dir, "conversations"))))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
