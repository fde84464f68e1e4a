"""Embedding near-duplicates by iterative quantisation and multi-index tables.

A rotation is learnt that makes the signs of the principal components balanced
binary codes.  The code is cut into substrings, one hash table each; vectors of
a label that agree on a substring meet in a bucket and are compared by cosine on
the original vectors.  A pair that meets in several tables is counted in the
first one only, so links are counted without ever writing pairs; components
need no more than a forest per bucket.

Equal vectors are one class and only classes are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sample_of, written
from lectern.llm.components import components, forest

COSINE = 0.93
# Bound on the vectors the rotations are learnt from: those of smallest hash.
SAMPLE_ROWS = 20_000
ITERATIONS = 30
# Chance that a pair right at the threshold is met in some table.
RECALL = 0.99
# Sampled vectors from which on a label is planned for by itself.
LABEL_SAMPLE = 50
# Rows to compare that carrying a row to one more table is worth.
ROW_COST = 32
# Rows that meet in one comparison.
CHUNK = 512


def usable(vector: Column) -> Column:
    """Whether a vector is not null, finite throughout and not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def learn_rotation(x: np.ndarray, seed: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are balanced codes of the rows of ``x``.

    Principal components, then a random rotation that is alternated with the
    codes it gives: each step is the orthogonal Procrustes solution.
    """
    width = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(width)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
    if len(x) < 2:
        return mean, rotation
    basis = np.linalg.eigh(np.cov((x - mean).T).reshape(width, width))[1]
    reduced = (x - mean) @ basis
    for _ in range(iterations):
        codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ codes)
        rotation = left @ right
    return mean, basis @ rotation


def agreements(sample: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], cosine: float) -> np.ndarray:
    """Share of equal bits of each sampled vector and a partner right at the threshold.

    Codes are signs after centring, so the share depends on how far the vectors lie from
    their mean, not on ``cosine`` alone.  Partners are turned away in a random direction, and
    in the direction of another sampled vector; the lower share counts.
    """
    rng = np.random.default_rng(len(sample))
    shares = np.ones(len(sample))
    for towards in (rng.normal(size=sample.shape), sample[rng.permutation(len(sample))]):
        away = towards - (towards * sample).sum(1, keepdims=True) * sample
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, norm, out=np.zeros_like(away), where=norm > 1e-9)
        partner = cosine * sample + math.sqrt(1 - cosine**2) * away
        equal = [((sample - m) @ p >= 0) == ((partner - m) @ p >= 0) for m, p in rotations]
        shares = np.minimum(shares, np.mean(equal, axis=(0, 2)))
    return shares


def table_plan(largest: int, width: int, shares: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> tuple[int, int]:
    """(bits per substring, tables) for labels of up to ``largest`` vectors.

    A pair meets in a table if all bits of a substring agree; tables are added until
    pairs at the threshold meet with chance ``recall`` on average over the sample, and
    over each label that has enough of it.  Of the lengths the one with the fewest rows
    to compare is taken.
    """
    names, place, size = np.unique(labels, return_inverse=True, return_counts=True)
    groups = [shares, *(shares[place == k] for k in np.flatnonzero(size >= LABEL_SAMPLE))]

    def needed(bits: int) -> int:
        apart = [1 - np.clip(g, 0.5, 1 - 1e-9) ** bits for g in groups]
        low, high = 0, 1
        while any((a**high).mean() > 1 - recall for a in apart):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if any((a**middle).mean() > 1 - recall for a in apart) else (low, middle)
        return high

    if not len(shares):
        return min(4, width), 1
    plans = [(needed(b) * (largest / 2**b + ROW_COST), b) for b in range(1, min(30, width) + 1)]
    bits = min(plans)[1]
    return bits, needed(bits)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _coded(classes: DataFrame, rotations: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> DataFrame:
    """Add ``keys``: the substring of every table."""
    shared = classes.sparkSession.sparkContext.broadcast(rotations)  # a few square matrices
    width = len(rotations[0][0])
    per = max(width // bits, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            x = _unit(flat.astype(float).reshape(-1, width))
            found = []
            for mean, projection in shared.value:
                signs = (x - mean) @ projection >= 0
                found += [signs[:, t * bits : (t + 1) * bits] @ power for t in range(per)]
            keys = np.stack(found[:tables], 1)
            column = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "keys"])

    return classes.mapInArrow(run, "label int, vector array<double>, first long, copies long, keys array<long>")


def _links(rows: DataFrame, width: int, tables: int, cosine: float) -> DataFrame:
    """(a, b, n): forest links, and with b null how many vectors a links to."""

    def compare(group: dict[str, np.ndarray], i: int, j: int) -> Iterator[tuple[np.ndarray, ...]]:
        at = int(group["t"][0])
        x = _unit(group["vector"].reshape(-1, width))
        left, right = group["chunk"] == i, group["chunk"] == j
        rows_left, rows_right = np.flatnonzero(left), np.flatnonzero(right)
        near = x[rows_left] @ x[rows_right].T >= cosine
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = rows_left[a], rows_right[b]
        if at and len(a):  # a pair belongs to the first table in which it meets
            keys = group["keys"].reshape(-1, tables)[:, :at]
            own = np.ones(len(a), bool)
            for low in range(0, len(a), 1 << 16):
                piece = slice(low, low + (1 << 16))
                own[piece] = ~(keys[a[piece]] == keys[b[piece]]).any(1)
            a, b = a[own], b[own]
        if not len(a):
            return
        size, copies = len(x), group["copies"]
        count = np.bincount(a, copies[b], size) + np.bincount(b, copies[a], size)
        some = np.flatnonzero(count)
        yield group["first"][some], np.full(len(some), -1), count[some].astype(np.int64)
        # One link per row and side is enough for a forest to start from.
        tree = forest(list(zip(group["first"][a].tolist(), group["first"][b].tolist(), strict=True)))
        ends = np.array(tree, np.int64).reshape(-1, 2)
        yield ends[:, 0], ends[:, 1], np.zeros(len(ends), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "t", "key", "i", "j"]
        held: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            group = {n: whole.column(n).to_numpy() for n in ("t", "chunk", "first", "copies")}
            group |= {
                n: whole.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                for n in ("vector", "keys")
            }
            for a, b, n in compare(group, last[3], last[4]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b, mask=b < 0) if len(b) and (b < 0).all() else pa.array(b.astype(np.int64)),
                     pa.array(n)], ["a", "b", "n"]
                )

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            starts = [0, *np.asarray(cuts, int).tolist(), len(keys)]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                key = tuple(keys[low].tolist())
                if last is not None and key != last:
                    yield from finish()
                    held = []
                last = key
                held.append(batch.slice(low, high - low))
        if held:
            yield from finish()

    keys = ["label", "t", "key", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors of one label link at a cosine of at least ``cosine`` in double
    precision.  Rows whose label is null or whose vector is null, zero or not
    finite link with nothing and are their own component, as are rows without an
    id.  Vectors of another length than the most common one (ties: the longest)
    take no part.  Pairs are found with a chance of about 0.99 at the threshold, more above;
    the plan is made on the sample's codes, so a mean that vectors have in common costs
    tables, not links.  Rows that share an id are one vector for components; each row counts
    in ``n_links``.  An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    able = rows.filter(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    sizes = able.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    alone = rows.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if common is None:
        return alone
    width = common.width
    able = able.filter(F.size("vector") == width)
    classes = written(
        able.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest, total = labels.agg(F.max("n"), F.sum("n")).first()
    sampled = sample_of(classes, "first", sample_rows, total).select("vector", "label").toPandas()
    sample = _unit(np.array(sampled["vector"].tolist(), float).reshape(-1, width))
    rotations = [learn_rotation(sample, seed) for seed in range(2)]
    bits, tables = table_plan(largest, width, agreements(sample, rotations, cosine), sampled["label"].to_numpy())
    per = max(width // bits, 1)
    rotations += [learn_rotation(sample, seed) for seed in range(2, -(-tables // per))]
    coded = written(_coded(classes, rotations, bits, tables), "codes")

    spread = coded.select("*", F.posexplode("keys").alias("t", "key"))
    counts = spread.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(counts, "buckets")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunked = spread.join(buckets, ["label", "t", "key"]).select(
        *spread.columns, F.pmod(F.xxhash64("first"), chunks).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("with"),
    )
    blocks = chunked.select(
        "label", "t", "key", "first", "copies", "vector", "keys", "chunk",
        F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"),
    )
    found = written(_links(blocks, width, tables, cosine), "found")
    trees = components(found.filter("b is not null").select("a", "b"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "first")
    result = written(
        classes.join(linked, "first", "left")
        .join(trees.withColumnRenamed("node", "first"), "first", "left")
        .select(
            "label", "vector",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "first").alias("component_id"),
        ),
        "classes",
    )
    joined = able.join(result, ["label", "vector"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    takes_part = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") == width)
    rest = rows.filter(~F.coalesce(takes_part, F.lit(False)))
    return joined.unionByName(
        rest.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    )


# The same for DuckDB, pair by pair.
SQL = f"""
with recursive
vectors as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
    where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b
    on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.e, b.e)
    / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {COSINE}),
reach as (select vec_id as a, vec_id as b from vectors
    union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component_id, e.vec_id) as component_id,
    e.vec_id = coalesce(component_id, e.vec_id) as kept
from embeddings e left join lowest r on e.vec_id = r.a left join counts c on e.vec_id = c.a
"""
