"""Prefix tries of conversations in double arrays.

A node stands for a distinct sequence of first turns; a conversation is a member of the nodes
of all its prefixes. The nodes tell what a prefix cache would save, where conversations
branch, and which are copies.

    turns, convs = number(conversations)       # places of turns, lengths of conversations
    nodes = build(turns, convs)

    nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
           saved_tokens, ends_sha256

1. Conversations are cut into blocks of ``BLOCK`` turns; a block knows the hash of all turns
   before it, so it is a path of the trie below that prefix, and no row holds more than a block.
2. Blocks are sorted by prefix, path and conversation, and dealt in ranges: the prefix shards.
   A prefix or a group of copies of any size is split between shards; two shards share no
   nodes but those on the path at their common edge, and the root of a block's trie.
3. Each shard gives its turns dense ids, packs its tries into BASE and CHECK arrays (the child
   of node s by turn id t is BASE[s] + t, if CHECK of it is s), walks its conversations through
   them, and sums up the subtrees. Nodes that it shares with nobody are done.
4. Shared upper nodes leave the shards as partial sums and are added up by their hash; what a
   later block's trie holds is added to the nodes of the path that leads to it.

Turns are compared by a 128-bit digest of role and text, prefixes by 128 bits. Defined results:
a null role or text is empty; turns are ordered by turn (null first), equal ones by digest, and
each repeated row is a turn of its own; rows without a conv_id belong to no conversation and
are left out; a conversation without turns is a member of the root; an empty table has no nodes;
other columns are not looked at. Ids are longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.ranking import global_row_number
from plumbline.llm.common import keep

#: Turns of a block, the most that one row holds.
BLOCK = 64
#: Turns of a shard; shards are at least as many as shuffle partitions.
SHARD_TURNS = 1_000_000
#: Ids that one row of a shared node's ends holds.
CHUNK = 20_000


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def number(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: conv_id, place (from 1), turn_id (digest), n_chars; convs: conv_id, n.

    Places come from one global numbering in ranges, so a conversation may hold any share
    of the rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest(role, text).alias("turn_id"), F.char_length(text).cast("long").alias("n_chars"))
    rows = global_row_number(keep(rows, "trie-turns"), ["conv_id", "turn", "turn_id"])
    convs = rows.groupBy("conv_id").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    turns = rows.join(convs.select("conv_id", "first"), "conv_id").select("conv_id", (F.col("row_no") - F.col("first") + 1).alias("place"), "turn_id", "n_chars")
    return turns, convs.select("conv_id", "n")


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block, more (a later block follows), x1, x2, path: array of at most BLOCK turns."""
    each = turns.select(
        "conv_id", F.expr(f"(place - 1) div {BLOCK}").alias("block"),
        F.struct("place", "turn_id", "n_chars", F.xxhash64(F.lit(1), "place", "turn_id").alias("x1"), F.xxhash64(F.lit(2), "place", "turn_id").alias("x2")).alias("t"), F.lit(None).cast("long").alias("n"))
    # Each conversation's own row tells its length, and makes a block where it has no turns.
    heads = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(n - 1) div {BLOCK}"), F.lit(0)))).alias("block"), F.lit(None).cast(each.schema["t"].dataType).alias("t"), "n")
    return each.unionByName(heads).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("t")).alias("path"), F.coalesce(F.bit_xor("t.x1"), F.lit(0)).cast("long").alias("x1"), F.coalesce(F.bit_xor("t.x2"), F.lit(0)).cast("long").alias("x2"),
        (F.max("n") > (F.col("block") + 1) * BLOCK).alias("more"))


_NODE = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("n_chars", pa.int64()), ("more", pa.bool_()), ("above", pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
    ("ends", pa.binary()), ("shard", pa.int64()), ("chunk", pa.int64())])
_NODE_DDL = (
    "kind string, block long, k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, n_chars long, more boolean, above array<struct<k1: long, k2: long>>, ends binary, shard long, chunk long")
#: Kinds of rows that shards give: nodes that are done; parts of shared nodes; chunks of the ids that end
#: at a shared node; nodes at the end of a block that go on in the next.
DONE, SHARED, ENDS, FRONTIER = "done", "shared", "ends", "frontier"


class DoubleArray:
    """BASE and CHECK over dense ids: child of s by id t at BASE[s] + t. Slot 1 is the root."""

    def __init__(self) -> None:
        self.base, self.check = [0, 0], [-1, 0]
        self.free = [2, 2]  # the first free slot from here on, found by path halving
        self.low = 2

    def _grow(self, size: int) -> None:
        while len(self.check) <= size:
            self.check.append(-1)
            self.base.append(0)
            self.free.append(len(self.free))

    def _next(self, i: int) -> int:
        self._grow(i)
        free = self.free
        while free[i] != i:
            self._grow(free[i])
            free[i] = free[free[i]]
            i = free[i]
        return i

    def place(self, node: int, ids: list[int]) -> None:
        """Pack the children of ``node``, by ascending ids, at the first base where all slots are free."""
        slot = self._next(max(2, ids[0] + 1))
        while True:
            b = slot - ids[0]
            self._grow(b + ids[-1])
            if all(self.check[b + t] < 0 for t in ids[1:]):
                break
            slot = self._next(slot + 1)
        self.base[node] = b
        for t in ids:
            self.check[b + t], self.free[b + t] = node, b + t + 1
        self._grow(b + ids[-1] + 1)


class _Trie:
    """The paths of one shard below one prefix, in sorted order."""

    def __init__(self, block: int, start: tuple[int, int], shard: int):
        self.block, self.start, self.shard = block, start, shard
        self.ids: dict[bytes, int] = {}
        self.chars: list[int] = []
        self.paths: list[tuple[list[int], list[tuple[int, int]], list[int], int, int, bool]] = []  # ids, hashes, conversations that end, all, the first, goes on
        self.last: list[bytes] | None = None

    def add(self, path: list[dict], conv: int, more: bool) -> None:
        mine = [t["turn_id"] for t in path]
        if mine == self.last:
            ids, keys, ends, n, first, on = self.paths[-1]
            self.paths[-1] = (ids, keys, ends, n + 1, first, on or more)  # sorted: the first is the smallest
        else:
            for t in path:
                if t["turn_id"] not in self.ids:
                    self.ids[t["turn_id"]] = len(self.chars)
                    self.chars.append(t["n_chars"])
            ends = []
            self.paths.append(([self.ids[t] for t in mine], [(t["x1"], t["x2"]) for t in path], ends, 1, conv, more))
            self.last = mine
        if not more:
            ends.append(conv)

    def nodes(self, first_open: bool, last_open: bool) -> Iterator[dict]:
        """The rows of this trie; paths at a shard's edge are shared."""
        # Children of each node, from neighbours in sorted order; nodes are in preorder.
        below: list[list[int]] = [[]]
        stack, before = [0], []
        for ids, *_ in self.paths:
            same = 0
            while same < min(len(ids), len(before)) and ids[same] == before[same]:
                same += 1
            del stack[same + 1:]
            for t in ids[same:]:
                below[stack[-1]].append(t)
                below.append([])
                stack.append(len(below) - 1)
            before = ids
        trie = DoubleArray()
        slots, todo, at = [], [1], 0
        while todo:  # preorder again, now by slots: ids were given in order, so children are ascending at first sight
            s = todo.pop()
            slots.append(s)
            ids = below[at]
            at += 1
            if ids:
                order = sorted(ids)
                trie.place(s, order)
                todo += [trie.base[s] + t for t in reversed(ids)]
        base, check = trie.base, trie.check
        n, first, depth, turn, more, key, ends = {}, {}, {1: 0}, {}, {}, {1: self.start}, {}
        for ids, hashes, over, count, conv, on in self.paths:
            s = 1
            n[s], first[s] = n.get(s, 0) + count, min(first.get(s, conv), conv)
            for t, (x1, x2) in zip(ids, hashes):
                child = base[s] + t
                if check[child] != s:
                    raise ValueError("a path that was packed is not in the arrays")
                if child in n:
                    n[child] += count
                    first[child] = min(first[child], conv)
                else:
                    n[child], first[child], depth[child], turn[child] = count, conv, depth[s] + 1, t
                    key[child] = (key[s][0] ^ x1, key[s][1] ^ x2)
                s = child
            more[s], ends[s] = on and len(ids) == BLOCK, over
        open_: set[int] = {1}
        for wanted, (ids, *_) in ((first_open, self.paths[0]), (last_open, self.paths[-1])):
            s = 1
            for t in ids if wanted else ():
                s = base[s] + t
                open_.add(s)
        children, leaves, saved = dict.fromkeys(slots, 0), dict.fromkeys(slots, 0), dict.fromkeys(slots, 0)
        for s in reversed(slots):  # children before their parents
            if s in open_:
                continue
            leaves[s] += children[s] == 0 and not more.get(s, False)
            saved[s] += (n[s] - 1) * self.chars[turn[s]]
            up = check[s]
            children[up] += 1
            leaves[up] += leaves[s]
            saved[up] += saved[s]
        above: dict[int, list[tuple[int, int]]] = {}
        for s in slots:
            up, own = check[s], ends.get(s, [])
            row = {
                "block": self.block, "k1": key[s][0], "k2": key[s][1], "depth": self.block * BLOCK + depth[s], "conv_id": first[s], "n_convs": n[s],
                "n_children": children[s], "n_leaves": leaves[s], "saved_tokens": saved[s]}
            if s != 1 and up in open_:
                row |= {"p1": key[up][0], "p2": key[up][1]}
            if s not in open_:
                if up not in open_:
                    row["parent_conv_id"] = first[up]
                yield row | {"kind": DONE, "ends": hashlib.sha256(",".join(map(str, own)).encode()).hexdigest().encode()}
                if more.get(s, False):
                    yield {"kind": FRONTIER, "k1": key[s][0], "k2": key[s][1], "conv_id": first[s]}
                continue
            above[s] = [*above.get(up, []), key[s]]
            yield row | {
                "kind": SHARED, "n_chars": self.chars[turn[s]] if s != 1 else 0, "more": more.get(s, False), "above": [{"k1": a, "k2": b} for a, b in above[s]]}
            for i in range(0, len(own), CHUNK):
                yield {
                    "kind": ENDS, "block": self.block, "k1": key[s][0], "k2": key[s][1], "ends": ",".join(map(str, own[i:i + CHUNK])).encode(), "shard": self.shard, "chunk": i}


def _shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tries():
        now, part = None, TaskContext.get().partitionId()
        for b in batches:
            for r in b.to_pylist():
                at = (r["block"], r["s1"], r["s2"])
                if now is None or at != (now.block, *now.start):
                    if now is not None:
                        yield now
                    now = _Trie(r["block"], (r["s1"], r["s2"]), part)
                now.add(r["path"], r["conv_id"], r["more"])
        if now is not None:
            yield now

    rows, is_first, waiting = [], True, None
    for trie in tries():
        if waiting is not None:
            for row in waiting.nodes(is_first, False):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, _NODE)
                    rows = []
            is_first = False
        waiting = trie
    if waiting is not None:
        for row in waiting.nodes(is_first, True):
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, _NODE)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _NODE)


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's chunks as they come, sorted; one hash state at a time."""
    now, state, out = None, None, []
    for b in batches:
        for r in b.to_pylist():
            at = (r["block"], r["k1"], r["k2"])
            if at != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = at, hashlib.sha256(r["ends"])
            else:
                state.update(b"," + r["ends"])
    if now is not None:
        out.append((*now, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["block", "k1", "k2", "ends_sha256"])


def _totals(shared: DataFrame) -> DataFrame:
    """Shared nodes (block, k1, k2) with the sums of all shards, subtrees within the block included."""
    key = ["block", "k1", "k2"]
    whole = shared.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("more").alias("more"), *[F.first(c).alias(c) for c in ("p1", "p2", "depth", "n_chars", "above")])
    branches = whole.where("p1 IS NOT NULL").groupBy("block", F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("shared_children"))
    whole = whole.join(branches, key, "left").withColumn("n_children", F.col("inner") + F.coalesce("shared_children", F.lit(0)))
    given = whole.select(
        "block", F.explode("above").alias("a"), (F.col("n_leaves") + F.when((F.col("n_children") == 0) & ~F.col("more"), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    sums = given.groupBy("block", F.col("a.k1").alias("k1"), F.col("a.k2").alias("k2")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return whole.select(*key, "conv_id", "n_convs", "n_children", "p1", "p2", "depth").join(sums, key)


def _from_later_blocks(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """k1, k2, and what the tries of later blocks add to the node.

    The root of a later block's trie is reached by its smallest conversation; that one
    brings the trie's sums to all nodes of its path in earlier blocks."""
    later = totals.where("block > 0 AND p1 IS NULL").select("block", "k1", "k2", "conv_id", "n_children", "n_leaves", "saved_tokens")
    w = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    brought = blocks.where("more OR block > 0").join(later.select("block", "conv_id", "n_leaves", "saved_tokens"), ["block", "conv_id"], "left")
    brought = brought.select("block", "conv_id", "s1", "s2", "path", F.sum("n_leaves").over(w).alias("add_leaves"), F.sum("saved_tokens").over(w).alias("add_saved")).where("add_leaves IS NOT NULL")
    hashes = F.expr(
        "transform(sequence(if(block = 0, 0, 1), size(path)), i -> aggregate(slice(path, 1, i), named_struct('k1', s1, 'k2', s2), "
        "(a, t) -> named_struct('k1', a.k1 ^ t.x1, 'k2', a.k2 ^ t.x2)))")
    on_path = brought.select(F.explode(hashes).alias("k"), F.lit(0).cast("long").alias("add_children"), "add_leaves", "add_saved").select("k.k1", "k.k2", "add_children", "add_leaves", "add_saved")
    branches = later.select("k1", "k2", F.col("n_children").alias("add_children"), F.lit(0).cast("long").alias("add_leaves"), F.lit(0).cast("long").alias("add_saved"))
    return on_path.unionByName(branches).groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("add_children", "add_leaves", "add_saved")])


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all prefixes. turns: conv_id, place (1, 2, ...), turn_id, n_chars; convs: conv_id, n."""
    spark = turns.sparkSession
    blocks = keep(_blocks(turns, convs), "trie-blocks")
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.where("block = 0").withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    long_ones = blocks.where("more OR block > 0").select("conv_id", "block", F.expr("bit_xor(x1)").over(w).alias("s1"), F.expr("bit_xor(x2)").over(w).alias("s2"))
    rest = blocks.where("block > 0").join(long_ones, ["conv_id", "block"])
    ranged = first.unionByName(rest, allowMissingColumns=True).select("block", "s1", "s2", "path", "conv_id", "more")
    n_turns = blocks.agg(F.sum(F.size("path"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_turns // SHARD_TURNS + 1)
    order = ["block", "s1", "s2", F.transform("path", lambda t: t["turn_id"]), "conv_id"]
    parts = keep(ranged.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_shard, _NODE_DDL), "trie-nodes")
    key = ["block", "k1", "k2"]
    totals = keep(_totals(parts.where(F.col("kind") == SHARED)), "trie-shared")
    chunks = parts.where(F.col("kind") == ENDS).select(*key, "shard", "chunk", "ends")
    ends = chunks.repartition(*key).sortWithinPartitions(*key, "shard", "chunk").mapInArrow(_hash_ends, "block long, k1 long, k2 long, ends_sha256 string")
    own = totals.where("block = 0 OR depth > block * " + str(BLOCK))  # the root of a later block is a node of the block before
    of_shared = own.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).withColumn("parent_conv_id", F.lit(None).cast("long"))
    done = parts.where(F.col("kind") == DONE).withColumn("ends_sha256", F.col("ends").cast("string"))
    cols = ["k1", "k2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = done.select(*cols).unionByName(of_shared.select(*cols))
    names = own.select("k1", "k2", "conv_id").unionByName(parts.where(F.col("kind") == FRONTIER).select("k1", "k2", "conv_id"))
    names = names.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    more = _from_later_blocks(ranged, totals)
    plus = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
    # Nodes that know their parent look for none; own keys keep them from meeting in one task.
    nodes = nodes.withColumns({"p1": F.coalesce("p1", "k1"), "p2": F.when(F.col("p1").isNull(), F.bitwise_not("k2")).otherwise(F.col("p2"))})
    return nodes.join(names, ["p1", "p2"], "left").join(more, ["k1", "k2"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", plus("n_children", "add_children"), plus("n_leaves", "add_leaves"),
        plus("saved_tokens", "add_saved"), "ends_sha256")
