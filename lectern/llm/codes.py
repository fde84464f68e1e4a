"""Vector code compression: product codes by slice-and-intersect bitmasks.

Vectors become integers and are cut into equal parts; each part is replaced by the
number of the nearest entry of its codebook.  To find it, the entries are sorted by
each coordinate, with a mask of the entries up to each place.  A radius around a point
selects a range of places per dimension; the masks at its two ends give the entries in
the slice, and the masks of all dimensions ANDed are the entries in a box that holds
the ball of that radius.  Only these are measured.  A point whose best distance exceeds
its radius, or whose box is empty, is tried again with a larger one, so the result is
exact whatever the first radius was.

Codebooks are trained by rounds of assignment and averaging over all vectors: each
task sums its points per entry, and the driver gets one row per entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.operators.joins import join_per_key

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
WORD = 64
# Points that are searched at once, which bounds the working memory.
STRIP = 8192
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


class SlicedCodebook:
    """The entries of one part, for exact nearest-entry search by sliced masks."""

    def __init__(self, entries: np.ndarray, radius: int | None = None) -> None:
        self.entries = entries.astype(np.int64)
        count, width = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.entries, order, 0).T)
        own = np.zeros((count, -(-count // WORD)), np.uint64)
        places = np.arange(count)
        own[places, places // WORD] = np.uint64(1) << (places % WORD).astype(np.uint64)
        # masks[d, i]: the i entries of smallest coordinate d
        self.masks = np.zeros((width, count + 1, own.shape[1]), np.uint64)
        for d in range(width):
            self.masks[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]], axis=0)
        self.radius = self._spacing() if radius is None else radius

    def _spacing(self) -> int:
        """About the distance from an entry to the next one, where nothing better is known."""
        apart = ((self.entries[:, None] - self.entries[None, :]) ** 2).sum(-1)
        others = apart[apart > 0]
        return int(np.sqrt(others.min())) + 1 if len(others) else 1

    def in_box(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, entry) of all entries within ``radius`` of a point in every coordinate, in order."""
        mask = np.full((len(points), self.masks.shape[2]), ~np.uint64(0))
        for d, coordinates in enumerate(self.sorted):
            low = np.searchsorted(coordinates, points[:, d] - radius, "left")
            high = np.searchsorted(coordinates, points[:, d] + radius, "right")
            mask &= self.masks[d][high] & ~self.masks[d][low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(self.entries))
        return np.nonzero(bits)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each point's nearest entry; ties to the lower number."""
        entry, apart = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        radius = np.full(len(points), self.radius, np.int64)
        left = np.arange(len(points))
        while len(left):
            row, candidate = self.in_box(points[left], radius[left])
            squares = ((points[left[row]] - self.entries[candidate]) ** 2).sum(1)
            # Pairs stand in order of (point, entry): the first of the smallest wins.
            best = np.lexsort((candidate, squares, row))
            first = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
            found = left[row[first]]
            entry[found], apart[found] = candidate[first], squares[first]
            sure = squares[first] <= radius[found] ** 2
            again = found[~sure]
            radius[again] = np.sqrt(apart[again]).astype(np.int64) + 1
            empty = np.setdiff1d(left, found, assume_unique=True)
            radius[empty] *= 2
            left = np.concatenate([again, empty])
        return entry, apart


def _units(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts x positions, from a list column of vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), parts, -1) if len(values) else np.zeros((len(column), parts, 0), np.int64)


def _assigned(books: list[SlicedCodebook], units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of each vector."""
    found = [book.nearest(np.ascontiguousarray(units[:, p])) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STRIP):
            yield batch.slice(at, STRIP)


def _sums(units: DataFrame, books: list[SlicedCodebook]) -> DataFrame:
    """``part, entry, position, total, n, apart``: one row per task, entry and position."""
    parts = len(books)
    count, width = books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * count, width), np.int64)
        n, apart = np.zeros(parts * count, np.int64), np.zeros(parts * count, np.int64)
        for batch in _strips(batches):
            values = _units(batch.column("units"), parts)
            entry, squares = _assigned(books, values)
            place = (entry + np.arange(parts) * count).ravel()
            np.add.at(total, place, values.reshape(-1, width))
            n += np.bincount(place, minlength=parts * count)
            np.add.at(apart, place, squares.ravel())
        part, number, position = np.indices((parts, count, width)).reshape(3, -1)
        wide = lambda x: np.repeat(x, width)
        columns = [part, number, position, total.ravel(), wide(n), wide(apart)]
        names = ["part", "entry", "position", "total", "n", "apart"]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return units.select("units").mapInArrow(
        run, "part long, entry long, position long, total long, n long, apart long"
    )


def _next_books(units: DataFrame, books: list[SlicedCodebook]) -> list[SlicedCodebook]:
    """Each entry at the floor of its points' mean; the next radius is their mean distance."""
    summed = _sums(units, books).groupBy("part", "entry", "position").agg(
        *(F.sum(c).alias(c) for c in ("total", "n", "apart"))
    )
    found = summed.filter("n > 0").toPandas()
    out = []
    for p, book in enumerate(books):
        own, entries = found[found["part"] == p], book.entries.copy()
        entry, position = own["entry"].to_numpy(int), own["position"].to_numpy(int)
        entries[entry, position] = own["total"].to_numpy(np.int64) // own["n"].to_numpy(np.int64)
        once = own[own["position"] == 0]
        mean = once["apart"].sum() / max(once["n"].sum(), 1)
        out.append(SlicedCodebook(entries, int(np.sqrt(mean)) + 1))
    return out


def _first_books(units: DataFrame, parts: int, entries: int) -> list[SlicedCodebook]:
    """Codebooks of the parts of the vectors of smallest id; one vector per id, null is the last id."""
    last = (1 << 63) - 1

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, batch.column("id").to_numpy()]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["id"])

    keyed = units.withColumn("id", F.coalesce("vec_id", F.lit(last)))
    few = keyed.select("id").mapInArrow(smallest, "id long").distinct().orderBy("id").limit(entries)
    ids = [r.id for r in few.collect()]
    chosen = keyed.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("units").alias("units")).orderBy("id").collect()
    if not chosen:
        return []
    width = len(chosen[0].units)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = np.array([r.units for r in chosen if len(r.units) == width], np.int64).reshape(-1, parts, width // parts)
    return [SlicedCodebook(rows[:, p]) for p in range(parts)]


def digest(books: list[SlicedCodebook]) -> str:
    """SHA-256 of all entries' components in decimal, joined by commas."""
    flat = np.concatenate([book.entries.ravel() for book in books])
    return hashlib.sha256(",".join(map(str, flat.tolist())).encode()).hexdigest()


def _coded(units: DataFrame, books: list[SlicedCodebook]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = max(2, len(f"{len(books[0].entries) - 1:x}"))
        names = np.array([f"{i:0{digits}x}" for i in range(len(books[0].entries))], object)
        for batch in _strips(batches):
            entry, squares = _assigned(books, _units(batch.column("units"), len(books)))
            code = pa.array(names[entry].sum(1), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), code, pa.array(squares.sum(1))],
                ["vec_id", "label", "code", "error"],
            )

    return units.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped.
    Components become ``floor(scale * x)``, held within 2^27 of zero so that no sum of
    squares overflows.  Null ids are coded too and come after all others where the first
    codebooks are chosen; a repeated id gives a row each, and its smallest vector may be
    a first entry; equal rows get equal codes.  Equal distances go to the lower entry.
    Null labels are one label.  Vectors longer or shorter than that of the smallest id
    have a null code and no error and train nothing.  Fewer ids than ``entries`` make a
    smaller codebook, an empty table gives no rows.  Other columns are left out.
    """
    bound = 1 << 27
    number = lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(float(-bound))), F.lit(float(bound))))
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf")))
    usable = vectors.filter(F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False)))
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = usable.select(
        F.col(key).cast("long").alias("vec_id"), name.alias("label"), F.transform(F.col(vector), number).alias("units")
    )
    rows = written(rows, "units")
    books = _first_books(rows, parts, entries)
    if not books:
        return rows.sparkSession.createDataFrame([], _RESULT)
    width = parts * books[0].entries.shape[1]
    whole = rows.filter(F.size("units") == width)
    for _ in range(rounds):
        books = _next_books(whole, books)
    coded = written(_coded(whole, books), "codes")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = join_per_key(coded, of_label, "label", F.xxhash64("vec_id", "code"))
    none = F.lit(None)
    other = rows.filter(F.size("units") != width).select(
        "vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error")
    )
    found = joined.select("vec_id", "code", "error", "label_error").unionByName(other)
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The same for DuckDB, entry by entry, with a common table for each round."""
    square = "list_sum(list_transform(list_zip(r.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    # Ties go to the lower entry: distances and numbers are compared as one.
    nearest = lambda k: f"""near{k} as materialized (select id, p, any_value(v) as v, min({{'d': d, 'e': e}}) as m
    from (select r.id, r.p, r.v, b.e, cast(coalesce({square}, 0) as bigint) as d from cut r join book{k} b on r.p = b.p)
    group by id, p)"""  # noqa: E731
    updated = lambda k: f"""book{k + 1} as materialized (select b.p, b.e, coalesce(n.v, b.v) as v from book{k} b left join (
    select p, e, list(x order by i) as v from (select p, e, i, cast(floor(sum(x) / count(*)) as bigint) as x
    from (select p, m.e as e, unnest(v) as x, generate_subscripts(v, 1) as i from near{k}) group by p, e, i)
    group by p, e) n on b.p = n.p and b.e = n.e)"""  # noqa: E731
    rounds = ",\n".join(f"{nearest(k)},\n{updated(k)}" for k in range(ROUNDS))
    return f"""
with units as (select row_number() over (order by vec_id) - 1 as id, vec_id, label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as u from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (select id, p, u[p * len(u) // {PARTS} + 1 : (p + 1) * len(u) // {PARTS}] as v
    from units, range({PARTS}) t(p)),
book0 as (select p, id as e, v from cut where id < {ENTRIES}),
{rounds},
{nearest(ROUNDS)},
coded as (select id, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error
    from near{ROUNDS} group by id),
total as (select sha256(string_agg(cast(x as varchar), ',' order by p, e, i)) as digest
    from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from book{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    digest as codebooks_sha256
from units join coded using (id), total
"""


SQL = _sql()
