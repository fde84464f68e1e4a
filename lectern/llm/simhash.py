"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in few bits agree on some of their blocks, so every
fingerprint goes to one bucket per choice of blocks that must agree.  In a
bucket, pairs are first held against a pivot table: by the triangle inequality
two fingerprints within ``d`` bits have distances to any reference fingerprint
that differ by at most ``d``, so a pair whose largest coordinate difference is
above ``d`` is discarded.  Survivors are verified on the bits.

Equal fingerprints are one class, and only classes are compared.  Buckets of any
size are cut into chunks.  A first round links inside chunks; a second one
compares, across chunks, only classes that are not yet in the component that
holds most of their bucket.  So a dense group of near copies costs about its
size, and no pair of it is ever emitted: only forests are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices, texts_of, without_gc, written
from lectern.llm.components import components
from lectern.operators.joins import join_per_key

SEED = 42
BITS = 64
DISTANCE = 3
# Rows that meet in one comparison.
CHUNK = 1024
# Rows of these that are compared at once, which bounds the working memory.
STRIP = 128
# Reference fingerprints of the pivot table: fixed bit patterns.
PIVOTS = 16


def pivots(width: int = 1, count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints of ``width`` words, by hashing their number."""
    found = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(count * width)]
    return np.array(found, np.uint64).reshape(count, width)


def shingles(text: str, words: int) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, repeats included."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter(
        [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())],
        np.uint64,
        len(tokens) - size + 1,
    )


def majority(hashes: np.ndarray, width: int) -> list[int]:
    """The bits that most hashes have, in words of 64 bits.

    The first word takes the hashes, further ones take mixes of them.
    """
    if not len(hashes):
        return [0] * width
    out = []
    for number in range(width):
        set_bits = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            raw = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            set_bits += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0]))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * number)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprint(text: str, words: int = 3, width: int = 1) -> list[int]:
    """SimHash of the word shingles of a whole text, in words of 64 bits."""
    return majority(shingles(text, words), width)


def fingerprints(
    docs: DataFrame, text: str = "text", words: int = 3, width: int = 1, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The long columns ``keep`` and the fingerprint as signed longs ``w0, w1, ...``; map-only.

    A null text or one without words has fingerprint zero.
    """
    names = [f"w{i}" for i in range(width)]

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(t, words, width) for t in texts_of(batch, text)], np.uint64)
            columns = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(width)]
            kept = [batch.column(k).cast(pa.int64()) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *names])

    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"{n} long" for n in [*keep, *names]))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of the blocks that must agree, one per choice of ``distance`` others.

    Two fingerprints within ``distance`` bits agree on the blocks of some mask.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(fp: Column, masks: list[int]) -> Column:
    """Bucket keys of a fingerprint: the number of the mask and the bits it keeps."""
    return F.array(
        *(F.struct(F.lit(i).alias("m"), fp.bitwiseAND(F.lit(_signed(mask))).alias("k")) for i, mask in enumerate(masks))
    )


def links_among(left: np.ndarray, right: np.ndarray, references: np.ndarray, distance: int) -> np.ndarray:
    """Boolean matrix of the pairs within ``distance`` bits, pruned by pivots.

    Fingerprints are rows of words.
    """
    apart = lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)
    table = [apart(side[:, None], references[None, :]) for side in (left, right)]
    out = np.zeros((len(left), len(right)), bool)
    for low in range(0, len(left), STRIP):
        strip = slice(low, low + STRIP)
        i, j = np.nonzero(np.abs(table[0][strip, None, 0] - table[1][None, :, 0]) <= distance)
        i += low
        for p in range(1, len(references)):
            if len(i) < 64:
                break
            kept = np.abs(table[0][i, p] - table[1][j, p]) <= distance
            i, j = i[kept], j[kept]
        kept = apart(left[i], right[j]) <= distance
        out[i[kept], j[kept]] = True
    return out


def _trees(linked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, other members) of each component of a symmetric matrix."""
    open_rows = np.ones(len(linked), bool)
    for seed in range(len(linked)):
        if not open_rows[seed]:
            continue
        members = np.zeros(len(linked), bool)
        frontier = np.array([seed])
        members[seed] = True
        while len(frontier):
            reached = linked[frontier].any(0) & ~members
            members |= reached
            frontier = np.flatnonzero(reached)
        open_rows &= ~members
        others = np.flatnonzero(members)
        if len(others) > 1:
            yield seed, others[others != seed]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys in rows sorted by them, across batches."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if held:
            rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
        size = len(rows[keys[0]])
        new = np.zeros(max(size - 1, 0), bool)
        for key in keys:
            new |= rows[key][1:] != rows[key][:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                yield {n: v[a:b] for n, v in rows.items()}
        held = {n: v[starts[-1] :] for n, v in rows.items()}
    if held and len(held[keys[0]]) > 1:
        yield held


def _words_of(group: dict[str, np.ndarray]) -> np.ndarray:
    names = sorted(n for n in group if n[0] == "w" and n[1:].isdigit())
    return np.stack([group[n].view(np.uint64) for n in names], 1)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    a = np.concatenate([none, *(f[0] for f in found)])
    b = np.concatenate([none, *(f[1] for f in found)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _inside_chunks(rows: DataFrame, distance: int) -> DataFrame:
    """Forest links inside each chunk of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for group in _groups(batches, ["m", "k", "chunk"]):
            values, node = _words_of(group), group["node"]
            for seed, others in _trees(links_among(values, values, pivots(values.shape[1]), distance)):
                found.append((node[others], np.full(len(others), node[seed])))
        yield _edges(found)

    dealt = rows.repartition("m", "k", "chunk").sortWithinPartitions("m", "k", "chunk")
    return dealt.mapInArrow(run, "a long, b long")


def _across_chunks(rows: DataFrame, distance: int) -> DataFrame:
    """Links between components, in blocks of all rows against the minor ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for group in _groups(batches, ["m", "k", "chunk", "other"]):
            minor = group["side"] == 1
            if not minor.any() or minor.all():
                continue
            values = _words_of(group)
            i, j = np.nonzero(links_among(values[~minor], values[minor], pivots(values.shape[1]), distance))
            a, b = group["label"][~minor][i], group["label"][minor][j]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
            found.append((pairs[:, 0], pairs[:, 1]))
        yield _edges(found)

    keys = ["m", "k", "chunk", "other"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def linked_classes(rows: DataFrame, distance: int) -> DataFrame:
    """(node, component) for fingerprints that share buckets and have links.

    ``rows`` has a row per bucket of each class: table ``m``, key ``k``, the long
    ``node`` that names the class, and the words ``w0, w1, ...``.  ``component``
    is the smallest node reachable over links of at most ``distance`` bits; the
    smallest node of a component has no row.
    """
    words = sorted(c for c in rows.columns if c[0] == "w")
    sizes = rows.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = written(sizes, "buckets")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunked = rows.join(sizes, ["m", "k"]).select(
        "m", "k", "node", *words, F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk")
    )
    first = written(components(_inside_chunks(chunked, distance)), "first-round")

    # Second round: buckets of several chunks whose members are not all together.
    wide = written(
        rows.join(sizes.filter(F.col("n") > CHUNK), ["m", "k"])
        .join(first, "node", "left")
        .select("m", "k", "node", *words, F.coalesce("component", "node").alias("label")),
        "wide-buckets",
    )
    held = wide.groupBy("m", "k", "label").agg(F.count(F.lit(1)).alias("held"))
    top = held.groupBy("m", "k").agg(
        F.sum("held").alias("n"), F.max_by("label", F.struct("held", "label")).alias("major"),
        F.max("held").alias("most"),
    )
    top = written(top.filter("most < n"), "open-buckets")
    of_all = F.ceil(F.col("n") / CHUNK).cast("int")
    of_minor = F.ceil((F.col("n") - F.col("most")) / CHUNK).cast("int")
    open_rows = wide.join(top, ["m", "k"])
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = open_rows.select("m", "k", "node", *words, "label", part(of_all).alias("chunk"), every(of_minor).alias("other"))
    right = open_rows.filter("label <> major").select(
        "m", "k", "node", *words, "label", every(of_all).alias("chunk"), part(of_minor).alias("other")
    )
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    second = components(_across_chunks(both, distance))

    onward = second.select(F.col("node").alias("component"), F.col("component").alias("further"))
    moved = first.join(onward, "component", "left").select(
        "node", F.coalesce("further", "component").alias("component")
    )
    return moved.unionByName(second)


def groups(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, label`` for each fingerprint of ``found(fp)``: the smallest one that links lead to."""
    classes = written(found.select("fp").distinct(), "classes")
    key = F.explode(_keys(F.col("fp"), block_masks(distance, distance + 2))).alias("key")
    rows = classes.select("fp", key).select("key.m", "key.k", F.col("fp").alias("node"), F.col("fp").alias("w0"))
    labels = linked_classes(rows, distance)
    joined = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return written(joined.select("fp", F.coalesce("component", "fp").alias("label")), "labels")


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    ``component_id`` is the smallest id reachable over links of fingerprints with
    at most ``distance`` differing bits; all such links are found.  Whole texts are
    read, however long.  Null and wordless texts share the fingerprint zero and link
    like any other.  Rows with a null id keep their fingerprint and carry links; the
    component of nothing but null ids is null.  Repeated ids and rows give a row each.
    An empty table gives no rows; other columns are left out.
    """
    found = written(fingerprints(docs, text, words).withColumnRenamed("w0", "fp"), "fingerprints")
    labels = groups(found, distance)
    of_class = found.groupBy("fp").agg(F.min("doc_id").alias("first")).join(labels, "fp")
    of_class = written(of_class, "of-class")
    smallest = of_class.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(of_class.select("fp", "label").join(smallest, "label").select("fp", "component_id"), "components")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def repeated_rows(docs: DataFrame, order: str, keys: tuple[str, ...], text: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The ``keys`` of all rows but the first of each group of near copies.

    Rows are told apart by their long columns ``keys``; equal keys are one row.  The
    first row of a group has the smallest ``order``, null last, then the smallest keys.
    Links are those of ``near_duplicates``.
    """
    found = written(fingerprints(docs, text, words, keep=(order, *keys)).withColumnRenamed("w0", "fp"), "fingerprints")
    grouped = written(found.join(groups(found, distance), "fp").select("label", order, *keys), "groups")
    place = F.struct(F.col(order).isNull().alias("last"), order, *keys)
    first = grouped.groupBy("label").agg(F.min(place).alias("first")).select("label", *(F.col(f"first.{k}").alias(f"first_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"first_{k}"))
    # One group may hold a third of all rows.
    joined = join_per_key(grouped, first, "label", F.xxhash64(*keys), "inner")
    return joined.filter(~same).select(*keys).distinct()
