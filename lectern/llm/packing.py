"""Packing of tokenised documents into sequences, by bin completion.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of piece lengths: at most one row per length up to the capacity,
whatever the size of the corpus.  The plan is a list of patterns (how many
pieces of which lengths share a sequence) with multiplicities.  Pieces are then
numbered within their length and each number is looked up in the plan, so the
rows themselves never meet in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import parse_ranks
from lectern.llm.common import slices, texts_of, written

CAPACITY = 2048
END_ID = 0
# The one special token of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}
# Cut of ordinary text into pre-tokens, as the tokenizer file prescribes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A length is numbered in parts of at most this share of all pieces.
PARTS = 512
# Nodes the branch and bound may open; the best packing found so far is kept.
NODES = 4_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``size`` tokens; only the first may be short."""
    first = size % capacity or capacity
    starts = [0, *range(first, size, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], size], strict=True)]


def pieces(docs: DataFrame, ranks_path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts and cut them into pieces of at most ``capacity`` ids.

    Map-only.  Every document ends with ``END_ID``, so a null or empty text is
    one piece of length 1.
    """
    with open(ranks_path, "rb") as file:  # a vocabulary file, about one megabyte
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        codec = tiktoken.Encoding(
            "pieces", pat_str=PATTERN, mergeable_ranks=parse_ranks(raw.value), special_tokens=SPECIAL
        )
        for batch in slices(batches, text):
            rows: list[list[int]] = [[] for _ in range(5)]
            for doc_id, value in zip(
                batch.column("doc_id").to_pylist(), texts_of(batch, text), strict=True
            ):
                ids = np.array([*codec.encode(value, allowed_special="all"), END_ID], "<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, item in zip(rows, (doc_id, number, start, length, crc), strict=True):
                        column.append(item)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", text).mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Step:
    """``times`` sequences that each hold these lengths, longest first."""

    times: int
    lengths: tuple[int, ...]


def _largest(counts: np.ndarray) -> np.ndarray:
    """For every length, the largest length up to it that is left, else 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _times(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    kinds, uses = np.unique(lengths, return_counts=True)
    return int((counts[kinds] // uses).min())


def best_fit(counts: np.ndarray, capacity: int) -> list[Step]:
    """Best fit decreasing: the largest piece left, then the largest that fit."""
    counts, steps = counts.copy(), []
    while counts.any():
        fits, room, taken = _largest(counts), capacity, []
        left = counts.copy()
        while room and (size := int(fits[room])):
            taken.append(size)
            left[size] -= 1
            room -= size
            if not left[size]:
                fits = _largest(left)
        step = Step(_times(counts, tuple(taken)), tuple(taken))
        np.subtract.at(counts, list(taken), step.times)
        steps.append(step)
    return steps


def completions(counts: np.ndarray, capacity: int, most: int = 8) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest piece, least waste first.

    A filling of one, two or three pieces, each the largest that still fits; the
    last rooms are filled further as best fit would.  A filling is dominated if
    its pieces fit into the pieces of another one: a smaller single piece, a pair
    whose sum fits into the best single piece, and so on.
    """
    largest = int(np.flatnonzero(counts)[-1])
    left = counts.copy()
    left[largest] -= 1
    room = capacity - largest
    fits = _largest(left)
    single = int(fits[room])
    if not single:
        return [(largest,)]
    found = [(single,)]
    if single < room:
        # For each first piece the largest second one, no larger than the first.
        a = np.flatnonzero(left[: single + 1])
        b = fits[np.minimum(room - a, a)]
        b = np.where((b == a) & (left[a] < 2), fits[np.maximum(b - 1, 0)], b)
        pair = (b > 0) & (a + b > single)
        a, b = a[pair], b[pair]
        order = np.lexsort((-a, -(a + b)))[:most]
        found += [(int(a[i]), int(b[i])) for i in order]
        if not any(sum(f) == room for f in found):
            for first, second in found[1:]:
                rest = left.copy()
                rest[[first]] -= 1
                rest[[second]] -= 1
                third = int(_largest(rest)[room - first - second]) if (rest >= 0).all() else 0
                if third:
                    found.append((first, second, third))
            base = np.flatnonzero(left[: room + 1])
            for first in base[::-1][:most].tolist():
                rest = left.copy()
                rest[first] -= 1
                pairs = np.flatnonzero(rest[: room - first + 1])
                if not len(pairs):
                    continue
                fit = _largest(rest)[np.minimum(room - first - pairs, pairs)]
                fit = np.where((fit == pairs) & (rest[pairs] < 2), 0, fit)
                best = int((pairs + fit).argmax())
                if fit[best]:
                    found.append((first, int(pairs[best]), int(fit[best])))
    whole = []
    for filling in dict.fromkeys(tuple(sorted(f, reverse=True)) for f in found):
        rest = left.copy()
        np.subtract.at(rest, list(filling), 1)
        if (rest < 0).any():
            continue
        space, more = room - sum(filling), list(filling)
        while space and (size := int(_largest(rest)[space])):
            more.append(size)
            rest[size] -= 1
            space -= size
        whole.append((largest, *sorted(more, reverse=True)))
    whole = list(dict.fromkeys(whole))
    # Least waste first; among equals the one with the larger, harder pieces.
    return sorted(whole, key=lambda f: (-sum(f), tuple(-x for x in f)))[:most]


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: all tokens over the capacity, with pieces over half apart."""
    sizes = np.arange(len(counts))
    bound = -(-int((sizes * counts).sum()) // capacity)
    for small in range(1, capacity // 2 + 1, 16):
        big, middle = counts[capacity - small + 1 :].sum(), counts[capacity // 2 + 1 : capacity - small + 1].sum()
        free = middle * capacity - int((sizes * counts)[capacity // 2 + 1 : capacity - small + 1].sum())
        low = int((sizes * counts)[small : capacity // 2 + 1].sum())
        bound = max(bound, int(big + middle + max(0, -(-(low - int(free)) // capacity))))
    return bound


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Step]:
    """Steps that pack ``counts[length]`` pieces of each length.

    Depth first over the completions of the largest piece left.  A branch is cut
    when its waste leaves no way to beat the incumbent, which starts as best fit;
    the search ends at the lower bound or after ``nodes`` nodes.
    """
    counts = counts.astype(np.int64)
    incumbent = best_fit(counts, capacity)
    best = sum(s.times for s in incumbent)
    bound, total = least_bins(counts, capacity), int((np.arange(len(counts)) * counts).sum())
    stack: list[tuple[np.ndarray, list[Step], int, int]] = [(counts, [], 0, 0)]
    path: list[Step] = []
    while stack and best > bound and nodes > 0:
        nodes -= 1
        left, last, depth, used = stack.pop()
        del path[depth:]
        path += last
        depth = len(path)
        if not left.any():
            if used < best:
                best, incumbent = used, list(path)
            continue
        # Every sequence to come holds at most its capacity.
        rest = total - int(sum(s.times * sum(s.lengths) for s in path))
        if used + -(-rest // capacity) >= best:
            continue
        for filling in reversed(completions(left, capacity)):
            times = _times(left, filling)
            after = left.copy()
            np.subtract.at(after, list(filling), times)
            stack.append((after, [Step(times, filling)], depth, used + times))
    return incumbent


def slots(steps: list[Step]) -> dict[str, np.ndarray]:
    """For each run of equal places: length, first rank, ranks per sequence, place.

    Ranks ``first, first + 1, ...`` of a length go to sequence ``sequence +
    (rank - first) // per`` at ``offset + (rank - first) % per * length``.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for step in steps:
        offset = 0
        for length in dict.fromkeys(step.lengths):
            per = step.lengths.count(length)
            rows.append((length, used.get(length, 0), per, sequence, offset))
            used[length] = used.get(length, 0) + per * step.times
            offset += per * length
        sequence += step.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "sequence", "offset"), table.T, strict=True))


def pack(
    docs: DataFrame, ranks_path: str, text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece with the sequence and the offset where it lies.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    An empty table gives no rows.  Repeated or null ids are packed like any
    other; columns but ``doc_id`` and the text are not read.  Whole texts are packed,
    however long; null and empty ones are a piece of one token.  Pieces of one length
    are interchangeable, so which of them shares a sequence with which is open.

    Texts are read once; the narrow piece table is written to the shared folder.
    The driver sees only the histogram of lengths, at most ``capacity`` rows.
    """
    found = written(pieces(docs, ranks_path, text, capacity), "pieces")
    histogram = found.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram.collect():  # at most one row per length up to the capacity
        counts[row.length] = row.n
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    ranked = _ranked(found, histogram, int(counts.sum()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table["length"] << 48) | table["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            number, per = rank - table["first"][at], table["per"][at]
            sequence = table["sequence"][at] + number // per
            offset = table["offset"][at] + number % per * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def _ranked(found: DataFrame, histogram: DataFrame, total: int) -> DataFrame:
    """Add ``rank``, from 0, within each length.

    A length is numbered in parts by hash, as many as its share of all rows asks
    for, and each part is moved up by the sizes of those before it.
    """
    share = F.ceil(F.col("n") * PARTS / F.lit(max(total, 1))).cast("int")
    parts = found.join(F.broadcast(histogram.select("length", share.alias("parts"))), "length")
    parted = parts.withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int")
    ).drop("parts")
    sizes = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        parted.withColumn("row", F.row_number().over(inside))
        .join(base, ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("row") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )
