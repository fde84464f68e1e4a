"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled into the unit ball and lifted onto the sphere by one more
coordinate, so the largest inner product becomes the smallest distance.  A table
hashes by several functions floor((a.v + b) / w) with Gaussian a; the slots
together name a bucket.  A query visits its own bucket and perturbed ones in the
order of the estimated chance that a neighbour lies there, until the chances add
up to the wanted recall.  Candidates of all tables are ranked by the exact inner
product on the original vectors and merged.

How far neighbours are differs from query to query.  All begin with a common distance;
the last of the neighbours found then says how far its own query must look, and the
query probes on with that distance.  One that found too few visits all buckets.

Buckets are dealt to shards of bounded size; a bucket that is too large, as of
one very common vector, is split over several.  A shard holds its vectors and
streams its queries past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import sample_of, written
from lectern.llm.itq import usable

NEIGHBOURS = 20
TABLES = 2
WIDTH = 1.0
# Wanted share of true neighbours; probing stops when the estimate reaches it.
RECALL = 0.97
# Vectors of a shard; a shard holds less than twice as many.
SHARD = 2048
# Bound on the vectors from which the distance of neighbours is estimated.
SAMPLE_ROWS = 4096


@dataclass(frozen=True)
class Hashes:
    """The functions of all tables, and how far neighbours are expected to be."""

    directions: np.ndarray  # tables x functions x (dimensions + 1)
    shifts: np.ndarray  # tables x functions
    scale: float  # largest norm of a vector
    reach: float  # distance of the last wanted neighbour, to begin with
    recall: float

    def places(self, lifted: np.ndarray) -> np.ndarray:
        """Position on each function in units of slots: rows x tables x functions."""
        return np.einsum("nd,tkd->ntk", lifted, self.directions) / WIDTH + self.shifts

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def lift_query(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])

    def probes(self, place: np.ndarray, slots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of one table for a query, most promising first, and their chances.

        A neighbour at distance ``reach`` is displaced on each function by a Gaussian
        of that spread, which gives each slot its chance, and a bucket the product of
        its slots.  ``slots`` are the buckets that hold vectors; one of them holds the
        neighbour, so the visit ends when the wanted share of their chances is covered.
        """
        spread = max(reach, 1e-6) / WIDTH * math.sqrt(2)
        low, size = slots.min(0), np.ptp(slots, 0) + 1
        chance = np.ones(len(slots))
        for k, at in enumerate(place.tolist()):
            edges = (np.arange(low[k], low[k] + size[k] + 1) - at) / spread
            upto = np.array([math.erf(e) for e in edges])
            chance *= (np.diff(upto) / 2)[slots[:, k] - low[k]]
        order = np.argsort(-chance, kind="stable")
        covered, wanted = np.cumsum(chance[order]), 1 - (1 - self.recall) ** (1 / len(self.directions))
        if not covered[-1] > 0:  # nothing is near; all are as good
            return order, chance[order]
        stop = np.searchsorted(covered, wanted * covered[-1]) + 1
        return order[:stop], chance[order[:stop]]


def fit(sample: np.ndarray, rows: int, scale: float, k: int, recall: float = RECALL, seed: int = 7) -> Hashes:
    """Draw the functions and estimate from a sample how far neighbours are.

    About a quarter of log2 of the rows as many functions give about as many
    buckets as a bucket has vectors.  The n-th of all rows corresponds to a
    nearer rank in a sample; the median over sample queries is where they all begin.
    """
    functions = max(1, round(math.log2(max(rows, 2)) / 4))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(TABLES, functions, sample.shape[1] + 1))
    hashes = Hashes(directions, rng.uniform(size=(TABLES, functions)), scale, 1.0, recall)
    queries = hashes.lift_query(sample[:512])
    near = np.sort(2 - 2 * queries @ hashes.lift(sample).T, 1)
    rank = min(max(1, round(k * len(sample) / rows)), near.shape[1] - 1)
    reach = float(np.sqrt(max(0.0, np.quantile(near[:, rank], 0.5)))) if len(near) else 1.0
    return Hashes(directions, hashes.shifts, scale, reach, recall)


def deal(counts: list[tuple[int, tuple[int, ...], int]], size: int = SHARD) -> dict[tuple, tuple[int, int]]:
    """(first shard, number of shards) for each (table, bucket).

    Buckets are dealt in order, so near ones share a shard.
    """
    out: dict[tuple, tuple[int, int]] = {}
    shard, held, table = 0, 0, None
    for at, bucket, n in sorted(counts):
        if held and (at != table or held + n > size):
            shard, held = shard + 1, 0
        parts = max(1, -(-n // size))
        out[at, bucket] = (shard, parts)
        held, table = (size if parts > 1 else held + n), at
        shard += parts - 1
    return out


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(float)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> pa.Array:
    """Per query a list of (minus score, id) of its ``k`` best, ties to the smaller id.

    The matrix product only preselects, with a margin for its rounding; scores
    are summed anew in an order that depends on the two vectors alone.
    """
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    least = np.full(len(q), np.finfo(float).min)
    if rough.shape[1] > k:
        margin = 1e-9 * np.abs(x).max() * np.abs(q).sum(1)
        least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k] - margin)
    row, near = np.nonzero(rough >= least[:, None])
    low = -(x[near] * q[row]).sum(1)
    order = np.lexsort((ids[near], low, row))
    row, near, low = row[order], near[order], low[order]
    starts = np.searchsorted(row, np.arange(len(q) + 1))
    kept = np.arange(len(row)) - starts[row] < k
    pairs = pa.StructArray.from_arrays([pa.array(low[kept]), pa.array(ids[near[kept]])], ["low", "vec_id"])
    sizes = np.minimum(np.diff(starts), k)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pairs)


def search(
    vectors: DataFrame, every: int, k: int = NEIGHBOURS, vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates
    are all rows but those with the query's id.  Rows without an id and vectors
    that are null, zero or not finite, or of another length than the most common
    one (ties: the longest), take no part.  Rows that repeat an id and a vector
    count once.  Equal scores go to the smaller id.  With fewer than ``k`` candidates
    all are returned; an empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    able = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y))
    sizes = able.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    common = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    able = able.filter(F.size("v") == common.width)
    # Of equal vectors only the smallest ids can be among the nearest of any query.
    same = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = able.withColumn("place", same).filter(F.col("place") <= k + 1).drop("place").dropDuplicates(["v", "vec_id"])
    sample = sample_of(able, "vec_id", SAMPLE_ROWS, common.n).toPandas()
    sample = np.array(sample["v"].tolist(), float).reshape(-1, common.width)
    hashes = fit(sample, common.n, common.norm, k, recall)
    functions = hashes.shifts.shape[1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.floor(hashes.places(hashes.lift(_vectors(batch, "v")))).astype(np.int64)
            for table in range(TABLES):
                column = pa.FixedSizeListArray.from_arrays(pa.array(slots[:, table].ravel()), functions)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(batch.num_rows, table, np.int32)), column.cast(pa.list_(pa.int64()))],
                    ["vec_id", "v", "t", "bucket"],
                )

    kind = able.schema["v"].dataType.simpleString()
    coded = written(candidates.mapInArrow(code, f"vec_id long, v {kind}, t int, bucket array<long>"), "hashed")
    # About the root of the number of rows as many buckets.
    counts = coded.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    shards = spark.sparkContext.broadcast(deal([(r.t, tuple(r.bucket), r.n) for r in counts]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for table, bucket, vec_id in zip(*(batch.column(c).to_pylist() for c in ("t", "bucket", "vec_id"))):
                first, parts = shards.value[table, tuple(bucket)]
                found.append(first + vec_id * 0x9E3779B97F4A7C15 % (1 << 64) * parts // (1 << 64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array([0] * batch.num_rows, pa.int32()), batch.column("vec_id"), batch.column("v")],
                ["shard", "side", "vec_id", "v"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = [[b for b in shards.value if b[0] == table] for table in range(TABLES)]
        slots = [np.array([b[1] for b in some], np.int64) for some in buckets]
        dealt = [[shards.value[b] for b in some] for some in buckets]
        every_shard = {s for some in dealt for first, parts in some for s in range(first, first + parts)}

        def visited(of_tables: np.ndarray, reach: float | None) -> set[int]:
            if reach is None:
                return every_shard
            found: set[int] = set()
            for table, place in enumerate(of_tables):
                for at in hashes.probes(place, slots[table], reach)[0].tolist():
                    first, parts = dealt[table][at]
                    found.update(range(first, first + parts))
            return found

        for batch in batches:
            if not batch.num_rows or not every_shard:
                continue
            places = hashes.places(hashes.lift_query(_vectors(batch, "v")))
            rows, wanted = [], []
            for row, (of_tables, reach, before) in enumerate(
                zip(places, batch.column("reach").to_pylist(), batch.column("before").to_pylist(), strict=True)
            ):
                new = visited(of_tables, reach)
                if before is not None:
                    new = new - visited(of_tables, before)
                rows += [row] * len(new)
                wanted += sorted(new)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted, pa.int64()), pa.array([1] * len(rows), pa.int32()), taken.column("vec_id"), taken.column("v")],
                ["shard", "side", "vec_id", "v"],
            )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, x, ids = None, [], None, None
        for batch in batches:
            of, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "side"))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (side[1:] != side[:-1])) + 1
            starts = [0, *cuts.tolist(), batch.num_rows]
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                piece = batch.slice(low, high - low)
                if side[low] == 0:
                    if of[low] != shard:
                        shard, parts = of[low], []
                    parts.append((_vectors(piece, "v"), piece.column("vec_id").to_numpy()))
                    x = None
                    continue
                if of[low] != shard:
                    continue
                if x is None:
                    x, ids = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
                for start in range(0, piece.num_rows, 1024):
                    asked = piece.slice(start, 1024)
                    own = asked.column("vec_id").to_numpy()
                    found = best(x, ids, _vectors(asked, "v"), own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own), found], ["query_id", "found"])

    held = coded.mapInArrow(place, f"shard long, side int, vec_id long, v {kind}")

    def answers(queries: DataFrame) -> DataFrame:
        """Lists of what ``queries(vec_id, v, reach, before)`` find in the shards they visit."""
        asked = queries.select("vec_id", "v", "reach", "before").mapInArrow(ask, f"shard long, side int, vec_id long, v {kind}")
        dealt = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "side", "vec_id")
        return dealt.mapInArrow(rank, "query_id long, found array<struct<low:double,vec_id:long>>")

    def merged(lists: DataFrame) -> DataFrame:
        ordered = lists.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        # A candidate of several tables comes with the same score, so next to itself.
        new = F.filter("found", lambda pair, i: (i == 0) | (pair != F.get("found", F.greatest(i - 1, F.lit(0)))))
        return ordered.select("query_id", F.slice(new, 1, k).alias("found"))

    queries = able.filter(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("double")
    first = written(merged(answers(queries.withColumns({"reach": F.lit(hashes.reach), "before": none}))), "first-answers")
    # The last one found is at least as far as the last true neighbour.
    cosine = -F.get("found", F.lit(k - 1))["low"] / (norm * hashes.scale)
    own = F.when(F.size("found") >= k, F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0))))
    further = (
        queries.join(first.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        .select("vec_id", "v", own.alias("reach"), F.lit(hashes.reach).alias("before"))
        .filter(F.col("reach").isNull() | (F.col("reach") > F.col("before")))
    )
    found = merged(first.unionByName(answers(further)))
    return found.select("query_id", F.posexplode("found").alias("at", "near")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "near.vec_id", (-F.col("near.low")).alias("score")
    )
