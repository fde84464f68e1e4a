"""Product codes against brute force on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import codes


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, label, vector), in plain integers."""
    kept = [
        (i, label, [math.floor(4096 * x) for x in v]) for i, label, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = len(kept[0][2]) // parts
    cut = [[u[p * width : (p + 1) * width] for p in range(parts)] for _, _, u in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))
    chosen = []
    for k in first:
        if not chosen or kept[k][0] != kept[chosen[-1]][0]:
            chosen.append(k)
    books = [[cut[k][p] for k in chosen[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            taken = [near(c[p], book)[1] for c in cut]
            for k in range(len(book)):
                own = [c[p] for c, t in zip(cut, taken) if t == k]
                if own:
                    book[k] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    return sorted(
        str((i, "".join(f"{k:02x}" for _, k in f), e, sum(x for x, row in zip(errors, kept) if row[1] == label), sha))
        for (i, label, _), f, e in zip(kept, found, errors)
    )


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return made.withColumns({c: F.lit("extra") for c in ("units", "code", "error", "id", "part", "__salt")})


def found(spark, rows, **more):
    return sorted(str(tuple(r)) for r in codes.compress(frame(spark, rows), **more).collect())


def test_all_embeddings_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    assert sorted(str(tuple(r)) for r in codes.compress(table).collect()) == brute(rows)


def test_nulls_ties_repeats_and_signs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 2, None]), [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5]) for _ in range(16)]) for i in range(150)]
    rows += rows[:20] + [(7, 1, rows[90][2]), (None, None, rows[3][2]), (None, 2, rows[4][2])]
    rows += [(500, 1, None), (501, 1, [None, *rows[0][2][1:]]), (502, 1, [math.nan, *rows[0][2][1:]]),
             (503, 1, [math.inf, *rows[0][2][1:]]), (504, 1, [-math.inf, *rows[0][2][1:]])]
    assert found(spark, rows) == brute(rows)


def test_few_vectors_empty_tables_and_other_lengths(spark):
    rows = [(i, 1, [float(i)] * 8) for i in range(5)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == [] and found(spark, [(1, 1, None)]) == []
    mixed = found(spark, [*rows, (9, 1, [1.0, 2.0]), (10, None, [])])
    assert [r for r in mixed if "None" not in r] == brute(rows) and len(mixed) == 7
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, 1, [1.0] * 9)])
    huge = found(spark, [(1, 1, [1e30] * 8), (2, 1, [-1e300] * 8)])
    assert len(huge) == 2


@pytest.mark.parametrize("radius", [1, 40, 100_000])
@pytest.mark.parametrize("entries", [1, 16, 64, 200])
def test_sliced_search_is_exact_for_any_radius(entries, radius):
    rng = np.random.default_rng(entries)
    book = rng.integers(-300, 300, (entries, 5))
    book[entries // 2 :] = book[: entries - entries // 2]  # equal entries: the lower number wins
    points = rng.integers(-900, 900, (700, 5))
    number, apart = codes.SlicedCodebook(book, radius).nearest(points)
    squares = ((points[:, None] - book[None]) ** 2).sum(-1)
    assert (number == squares.argmin(1)).all() and (apart == squares.min(1)).all()


def test_a_box_holds_what_lies_within_its_radius():
    rng = np.random.default_rng(1)
    book, points = rng.integers(0, 50, (40, 3)), rng.integers(0, 50, (60, 3))
    row, entry = codes.SlicedCodebook(book).in_box(points, np.full(60, 9))
    wanted = np.nonzero((np.abs(points[:, None] - book[None]) <= 9).all(-1))
    assert (row == wanted[0]).all() and (entry == wanted[1]).all()
