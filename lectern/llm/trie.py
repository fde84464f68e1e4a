"""Prefix trie of conversations by range minima over sorted prefix lengths.

Conversations are strings of turn digests.  They are sorted over the whole cluster and
cut into blocks of neighbours.  In a block, the lengths of the prefixes that neighbours
share are put into a sparse table of range minima.  Each candidate prefix (what a
conversation shares with the one before it, and the whole conversation) finds the first
and the last conversation that share it by binary search over the table, by itself and
without a stack, and these intervals are the members of the nodes.  Nodes stand in
pre-order, so sums over subtrees are differences of a running sum.

Only nodes on the first or last path of a block can go on in another block.  These few
are added up by the digest of their prefix; what neighbouring blocks both counted is taken
back along the path they share.  All other nodes are whole in their block and are never
shuffled, however many conversations begin alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

# Bytes of a digest.
WIDE = 16
# Bounds of a block, beyond which only a single longer conversation goes.
BLOCK_ROWS, BLOCK_TURNS = 1 << 15, 1 << 19
# Blocks are numbered by partition, then by place in it.
_PLACES = 33
HEAD_TURNS, HEAD_STEP = 6, 100
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODES = (
    "block long, edge boolean, on_first boolean, on_last boolean, depth long, digest binary, parent binary,"
    " conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string, ids binary, size long, tail long"
)
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class RangeMinimum:
    """Sparse table: row k holds the minima of ``2 ** k`` neighbouring values."""

    def __init__(self, values: np.ndarray) -> None:
        rows = [values.astype(np.int64)]
        while 2 ** len(rows) <= len(values):
            half, last = 2 ** (len(rows) - 1), rows[-1]
            row = last.copy()
            row[: len(last) - half] = np.minimum(last[:-half], last[half:])
            rows.append(row)
        self.rows = np.stack(rows)
        self.size = len(values)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value at places ``low`` to ``high``, both included."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.rows[k, low], self.rows[k, high + 1 - (1 << k)])

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from which all values after it up to ``at`` reach ``bound``."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            start = at - (1 << k)
            ok = start >= 0
            ok[ok] = self.rows[k, start[ok] + 1] >= bound[ok]
            at[ok] = start[ok]
        return at

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``at`` reach ``bound``."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            end = at + (1 << k)
            ok = end < self.size
            ok[ok] = self.rows[k, at[ok] + 1] >= bound[ok]
            at[ok] = end[ok]
        return at


def shared_lengths(turns: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many turns each row shares with the row before it; -1 for the first row."""
    shared = np.zeros(len(count), np.int64)
    alive, depth = np.arange(1, len(count)), 0
    while len(alive):
        alive = alive[(count[alive - 1] > depth) & (count[alive] > depth)]
        alive = alive[(turns[start[alive - 1] + depth] == turns[start[alive] + depth]).all(1)]
        shared[alive] += 1
        depth += 1
    shared[:1] = -1
    return shared


def _chain(turns: np.ndarray) -> list[bytes]:
    """Digest of each prefix of a path, the empty one first."""
    state, out = hashlib.blake2b(digest_size=WIDE), []
    out.append(state.digest())
    for turn in turns:
        state.update(turn.tobytes())
        out.append(state.copy().digest())
    return out


def block_nodes(ids: np.ndarray, turns: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> dict[str, list | np.ndarray]:
    """The nodes of sorted conversations: ``ids``, turns per row, and all turns' digests and sizes."""
    rows = len(ids)
    start = np.cumsum(count) - count
    shared = shared_lengths(turns, start, count)
    table = RangeMinimum(shared)
    # Candidates: what a row shares with the row before it, and the whole row.
    at = np.concatenate([np.arange(1, rows), np.arange(rows)])
    depth = np.concatenate([shared[1:], count])
    left, right = table.left(at, depth), table.right(at, depth)
    deep = int(count.max()) + 1
    key, one = np.unique(left * deep + depth, return_index=True)
    right = right[one]
    # A node is named by its first row: row l begins those deeper than what it shares.
    begun = np.maximum(count - shared, 0)
    first = np.repeat(np.arange(rows), begun)
    depth = np.arange(len(first)) - np.repeat(np.cumsum(begun) - begun, begun) + np.repeat(shared + 1, begun)
    # Prefixes between two candidates have the members of the longer one.
    last = right[np.searchsorted(key, first * deep + depth)]
    own = first * deep + depth
    above = np.concatenate([[0], left[: rows - 1]])  # first row of the node that each row shares
    up = np.where(depth - 1 > shared[first], first, above[first])
    parent = np.searchsorted(own, up * deep + depth - 1)
    parent[0] = 0
    members = last - first + 1
    size = np.zeros(len(first), np.int64)
    size[depth > 0] = sizes[(start[first] + depth - 1)[depth > 0]]
    # Rows that equal the first of a node end in it.
    equal = np.zeros(rows, bool)
    equal[1:] = (shared[1:] == count[1:]) & (shared[1:] == count[:-1])
    run_end = np.concatenate([np.flatnonzero(~equal)[1:], [rows]])[np.cumsum(~equal) - 1] - 1
    ending = depth == count[first]
    leaf = ending & (run_end[first] == last)
    behind = np.searchsorted(first, last, "right")
    subtree = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[behind] - c[:-1]
    least = RangeMinimum(ids).least(first, last)
    on_first, on_last = first == 0, last == rows - 1
    edge = on_first | on_last
    chains = _chain(turns[: count[0]]), _chain(turns[start[-1] :])
    named = lambda j: chains[0 if on_first[j] else 1][depth[j]]
    whole_parent = ~edge[parent]
    joined = [b",".join(b"%d" % i for i in ids[a : run_end[a] + 1].tolist()) if e else None for a, e in zip(first.tolist(), ending)]
    sha = [None if e else hashlib.sha256(text or b"").hexdigest() for e, text in zip(edge.tolist(), joined)]
    return {
        "edge": edge, "on_first": on_first, "on_last": on_last, "depth": depth,
        "digest": [named(j) if edge[j] else None for j in range(len(first))],
        "parent": [named(p) if j and not w else None for j, (p, w) in enumerate(zip(parent.tolist(), whole_parent.tolist()))],
        "conv_id": least,
        "parent_conv_id": [i if w and j else None for j, (i, w) in enumerate(zip(least[parent].tolist(), whole_parent.tolist()))],
        "n_convs": members, "n_children": np.bincount(parent[1:], minlength=len(first)),
        "n_leaves": subtree(leaf.astype(np.int64)), "saved_tokens": subtree((members - 1) * size),
        "ends_sha256": sha, "ids": [text if e else None for e, text in zip(edge.tolist(), joined)],
        "size": size, "tail": np.full(len(first), count[-1]),
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring rows up to the bounds of a block."""
    held, rows, turns = [], 0, 0
    for batch in batches:
        counts = batch.column("path").cast(pa.large_binary())
        counts = np.diff(np.frombuffer(counts.buffers()[1], np.int64, len(counts) + 1, 8 * counts.offset)) // WIDE
        low = 0
        for at, n in enumerate(counts.tolist()):
            if rows and (rows >= BLOCK_ROWS or turns + n > BLOCK_TURNS):
                yield pa.Table.from_batches([*held, batch.slice(low, at - low)])
                held, rows, turns, low = [], 0, 0, at
            rows, turns = rows + 1, turns + n
        held.append(batch.slice(low))
    if rows:
        yield pa.Table.from_batches(held)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in _NODES.split(", "))])
    partition = TaskContext.get().partitionId()
    for place, block in enumerate(_blocks(batches)):
        paths = block.column("path").to_pylist()
        count = np.array([len(p) // WIDE for p in paths], np.int64)
        turns = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
        sizes = pa.concat_arrays([c.flatten() for c in block.column("sizes").chunks]).to_numpy()
        found = block_nodes(block.column("conv_id").to_numpy(), turns, sizes, count)
        found["block"] = np.full(len(found["depth"]), (partition << _PLACES) + place, np.int64)
        whole = pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            yield whole.slice(at, BLOCK_ROWS)


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def paths_of(messages: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: digests of the turns of each conversation in a row, and code points of their texts.

    Turns of one number are ordered by digest.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDE)
    turns = messages.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("one")
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return grouped.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def with_heads(paths: DataFrame, most: int = HEAD_TURNS, step: int = HEAD_STEP) -> DataFrame:
    """Give each conversation the first turns of the one whose id is rounded down to ``step``.

    ``crc32(id) % most`` turns are replaced; an absent conversation gives none.
    """
    nothing = F.lit(bytearray())
    turns = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = paths.filter(F.col("conv_id") % step == 0).select(
        F.col("conv_id").alias("head"), F.substring("path", 1, WIDE * most).alias("head_path"),
        F.slice("sizes", 1, most).alias("head_sizes"),
    )
    joined = paths.withColumn("head", F.col("conv_id") - F.col("conv_id") % step).withColumn("h", turns).join(heads, "head", "left")
    path = F.concat(
        F.substring(F.coalesce("head_path", nothing), F.lit(1), F.col("h") * WIDE),
        F.substring("path", F.col("h") * WIDE + 1, F.octet_length("path")),
    )
    none = F.slice("sizes", 1, 0)
    sizes = F.concat(F.slice(F.coalesce("head_sizes", none), F.lit(1), F.col("h")), F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return joined.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _following(edges: DataFrame) -> DataFrame:
    """``block, next``: the block after each; the driver sees the partitions that hold rows."""
    blocks = edges.filter("depth = 0").select("block", F.shiftright("block", _PLACES).alias("part"))
    parts = [r.part for r in blocks.select("part").distinct().orderBy("part").collect()]
    after = [F.lit(x).cast("long") for a, b in zip(parts, parts[1:]) for x in (a, b << _PLACES)]
    onward = F.create_map(*after)[F.col("part")] if after else F.lit(None).cast("long")
    inside = F.lead("block").over(Window.partitionBy("part").orderBy("block"))
    return blocks.select("block", F.coalesce(inside, onward).alias("next"))


def _counted_twice(edges: DataFrame) -> DataFrame:
    """What to take back along the path that a block shares with the one before it.

    Both count the shared nodes as new, so each step of the path was a child twice and its
    text paid for twice; and a conversation that goes on in the next block ended no leaf.
    """
    tails = edges.filter("on_last").join(_following(edges), "block").select(
        F.col("next").alias("block"), "depth", "digest", "size", "tail"
    )
    path = tails.join(edges.filter("on_first").select("block", "depth", "digest"), ["block", "depth", "digest"])
    deeper, whole = Window.partitionBy("block").orderBy(F.desc("depth")), Window.partitionBy("block")
    deepest = F.max("depth").over(whole)
    return path.select(
        "depth", "digest", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("n_convs"), F.when(F.col("depth") < deepest, -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("tail") == deepest, -1).otherwise(0).cast("long").alias("n_leaves"), F.sum("size").over(deeper).alias("saved_tokens"),
    )


def _ends(edges: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: pieces of id lists in block order, hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends"])
        for batch in batches:
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids")):
                if digest == last:
                    state.update(b",")
                else:
                    if last is not None:
                        yield row()
                    last, state = digest, hashlib.sha256()
                state.update(ids.as_buffer())
        if last is not None:
            yield row()

    pieces = edges.filter("ids is not null").select("digest", "block", "ids")
    return pieces.repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(run, "digest binary, ends string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of conversations ``conv_id, path, sizes``; see ``build``."""
    order = ["path", "conv_id"]
    found = written(paths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_nodes, _NODES), "nodes")
    edges = found.filter("edge")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = edges.select("depth", "digest", "parent", "conv_id", *sums).unionByName(_counted_twice(edges))
    merged = written(
        parts.groupBy("depth", "digest").agg(
            F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums)
        ),
        "edges",
    )
    named = merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    across = (
        merged.join(named, "parent", "left").join(_ends(edges), "digest", "left")
        .withColumn("parent_conv_id", F.col("above")).withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA)))
    )
    # Children of a node on an edge find it by block, so a node with very many is many keys.
    near = edges.select("block", F.col("digest").alias("parent")).join(named, "parent")
    inside = found.filter("not edge")
    below = inside.filter("parent is not null").join(near, ["block", "parent"]).withColumn("parent_conv_id", F.col("above"))
    return (
        inside.filter("parent is null").select(*_RESULT)
        .unionByName(below.select(*_RESULT)).unionByName(across.select(*_RESULT))
    )


def build(messages: DataFrame, heads: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The prefix trie of ``messages(conv_id, turn, role, text)``: one row per node.

    A node is a distinct sequence of first turns, compared by role and whole text; null
    role or text is empty.  ``conv_id`` is the smallest member, ``parent_conv_id`` that of
    the parent (null for the root), ``n_convs`` the members, ``n_children`` the nodes one turn
    longer, ``n_leaves`` the childless nodes in the subtree, ``saved_tokens`` the code points
    that members after the first need not repeat, over the subtree, and ``ends_sha256``
    the digest of the ids of members that end here.  ``heads`` may rebuild the
    conversations before.

    Turns stand in their order, null first; those of one number by digest, and repeated rows are
    turns like others.  Rows with a null id take no part.  An empty table gives no
    node, other columns are left out.  A conversation is one row of 24 bytes a turn.
    """
    paths = written(paths_of(messages), "paths")
    return trie(heads(paths) if heads else paths)


# The same for DuckDB, with the rebuilt conversations of the registered query.
SQL = f"""
with recursive
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as i,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
numbered as (select conv_id, i, dense_rank() over (order by role, text) as word, length(text) as size from turns),
ids as (select conv_id, cast(conv_id as varchar) as name, count(*) as n from turns group by conv_id),
crc as (select conv_id, name, 0 as k, 4294967295 as c from ids
    union all select conv_id, name, k + 1, xor(mixed >> 1, (mixed & 1) * 3988292384) from (
        select *, case when k % 8 = 0 then xor(c, ascii(name[k // 8 + 1])) else c end as mixed from crc
        where k < 8 * length(name))),
cut as (select conv_id, cast(xor(c, 4294967295) % {HEAD_TURNS} as int) as h from crc where k = 8 * length(name)),
rebuilt as (select c.conv_id, 0 as part, t.i, t.word, t.size from cut c
        join numbered t on t.conv_id = c.conv_id - c.conv_id % {HEAD_STEP} and t.i < c.h
    union all select c.conv_id, 1, t.i, t.word, t.size from cut c join numbered t on t.conv_id = c.conv_id and t.i >= c.h),
paths as (select conv_id, row_number() over w as depth, size, string_agg(cast(word as varchar), ',') over w as path
    from rebuilt window w as (partition by conv_id order by part, i)),
members as (select conv_id, 0 as depth, 0 as size, '' as path from ids union all select conv_id, depth, size, path from paths),
linked as (select *, lag(path) over (partition by conv_id order by depth) as up,
    lead(path) over (partition by conv_id order by depth) is null as ends from members),
nodes as (select depth, path, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from linked group by depth, path),
children as (select up as path, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
own as (select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c using (depth, path)),
sums as (select m.depth, m.path, count(*) filter (where o.n_children = 0) as n_leaves,
    sum((o.n_convs - 1) * o.size) as saved_tokens
    from own o join members m on m.conv_id = o.conv_id and m.depth <= o.depth group by m.depth, m.path)
select o.conv_id, cast(o.depth as bigint) as depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, s.n_leaves,
    cast(s.saved_tokens as bigint) as saved_tokens, o.ends_sha256
from own o join sums s using (depth, path) left join nodes p on p.path = o.up and p.depth = o.depth - 1
"""
