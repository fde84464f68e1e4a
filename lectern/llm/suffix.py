"""Suffix-array deduplication with a run-length index.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier in the corpus.  All occurrences of such a string are found as follows.

1. *Anchors.*  Of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes
   the one of smallest hash is the window's anchor.  Equal windows have equal
   anchors, and about one position in 35 is one.  Consecutive windows with one
   anchor are a segment.
2. *Classes.*  Segments meet by anchor.  Of segments with the same bytes all but
   the first are repeats.  An anchor with several different segments is open.
3. *Run-length index.*  The bytes of open segments are gathered by anchor and
   indexed: suffix order, run-compressed Burrows-Wheeler transform, text
   positions sampled at the ends of its runs.  Matching statistics are streamed
   by stepping backwards from every sample at once, and a window that matches
   ``LENGTH`` bytes of an earlier position is a repeat.  Anchors with very many
   different segments are compared by a digest of each window instead, so that
   no task has to hold them.
4. *Removal.*  Repeats meet the texts by document.

The number of rows is bound by the number of anchors, no pairs are made, and
equal segments or windows are reduced to one per task before they are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import slices, texts_of, written

LENGTH = 100
GRAM = 32
# Segments of one anchor up to which they are compared in one index.
HOT = 1024
# Text that goes into one index.
INDEX_BYTES = 1 << 18
# Anchors a task gathers before it reduces equal segments.
GATHERED = 1 << 18
# Text a task turns into arrays at once.
SLICE_BYTES = 1 << 20
NO_ID = (1 << 63) - 1

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_DIGITS = bytes.maketrans(b"0123456789", bytes(range(0xF5, 0xFF)))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, most significant first."""
    word = raw.astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        word = (word[:-step] << np.uint64(bits)) | word[step:]
    return word


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def segments(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The segments of joined documents that end at ``ends``.

    ``doc`` is the place of the document, ``start`` the first window in ``raw``,
    ``n`` the number of windows, ``anchor`` the hash of the anchor and ``seg`` a
    hash of the bytes, the number of windows and the place of the anchor.
    """
    empty = {n: np.zeros(0, np.int64) for n in ("doc", "start", "n")}
    empty |= {n: np.zeros(0, np.uint64) for n in ("anchor", "seg")}
    grams, width = len(raw) - gram + 1, length - gram + 1
    if len(raw) < length:
        return empty
    word, hashed = _words(raw), np.zeros(grams, np.uint64)
    for at, odd in zip(range(0, gram, 8), _ODD):
        hashed = (hashed ^ word[at : at + grams]) * odd
        hashed ^= hashed >> np.uint64(29)
    hashed = _mixed(hashed)
    # Sliding minimum: within blocks from both sides; ties go to the left.
    place = np.arange(grams, dtype=np.uint64)
    valued = (hashed & np.uint64(0xFFFFFFFF00000000)) | place
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:grams] = valued
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(raw) - length + 1
    least = np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that lie in one document.
    sizes = np.diff(ends, prepend=0)
    whole = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(ends)), whole)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(ends - sizes, whole)
    if not len(start):
        return empty
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(start))
    low, at = start[first], anchor[first]
    # Polynomial hash of the bytes by differences of a running sum.
    running = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)))])
    seg = (running[low + n + length - 1] - running[low]) * _powers(_BASE_INVERSE, len(raw))[low]
    seg = _mixed(seg ^ (n.astype(np.uint64) << np.uint64(48)) ^ ((at - low).astype(np.uint64) << np.uint64(56)))
    return {"doc": doc[first], "start": low, "n": n, "anchor": hashed[at], "seg": seg}


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text with sampled run ends.

    A run is kept as its byte, the shift of its rows under the backward step and
    the text position at its last row; ``run_of`` is the rank of run heads, and
    ``groups`` the rows at which a new prefix of ``length`` bytes begins.
    """

    def __init__(self, text: np.ndarray, length: int = LENGTH) -> None:
        size = len(text)
        order, groups = self._suffix_order(text, length)
        before = text[order - 1]  # the row of position 0 wraps to the last byte
        new = np.ones(size, bool)
        new[1:] = before[1:] != before[:-1]
        # The row of position 0 is a run of its own, so the wrap never mixes in.
        zero = int(np.flatnonzero(order == 0)[0])
        new[zero] = True
        if zero + 1 < size:
            new[zero + 1] = True
        start = np.flatnonzero(new)
        self.byte = before[start]
        self.size, self.groups = size, groups
        self.run_of = (np.cumsum(new) - 1).astype(np.int32)
        run_length = np.diff(start, append=size)
        # Backward step: rows in order of (byte before, row).
        by_byte = np.argsort(self.byte, kind="stable")
        target = np.empty(len(start), np.int64)
        target[by_byte] = np.cumsum(run_length[by_byte]) - run_length[by_byte]
        self.shift = (target - start).astype(np.int32)
        self.end_row = start + run_length - 1
        self.end_text = order[self.end_row]

    @staticmethod
    def _suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and the rows where the prefix changes.

        Prefix doubling from eight bytes on.  The text is cyclic and its longest
        run of the largest byte is at its end, so all ranks become distinct.
        """
        size = len(text)
        rank = _words(np.concatenate([text, text[: 7] if size > 7 else np.resize(text, 7)]))
        order = np.argsort(rank)
        depth, groups = 8, None

        def ranked(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ordered = key[order]
            changed = np.concatenate([[False], ordered[1:] != ordered[:-1]])
            out = np.empty(size, np.int64)
            out[order] = np.cumsum(changed)
            return out, changed

        rank, _ = ranked(rank, order)
        while True:
            if groups is None and 2 * depth >= length:
                key = rank * size + np.roll(rank, -(length - depth))
                changed = ranked(key, np.argsort(key))[1]
                changed[0] = True
                groups = np.flatnonzero(changed)
            if int(rank.max()) == size - 1 or depth >= 2 * size:
                break
            key = rank * size + np.roll(rank, -depth)
            rank, _ = ranked(key, np.argsort(key))
            depth *= 2
        if groups is None:
            groups = np.arange(size)
        order = np.empty(size, np.int64)
        order[rank] = np.arange(size)
        return order, groups

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text positions, rows) for the whole text, from all samples at once.

        From the text position of each run end the text is walked to the left
        until the next sampled position, one backward step for all at a time.
        """
        by_text = np.argsort(self.end_text)
        position, row = self.end_text[by_text].astype(np.int32), self.end_row[by_text].astype(np.int32)
        stop = np.concatenate([[np.int32(-1)], position[:-1]])
        while len(position):
            yield position, row
            going = np.flatnonzero(position - 1 > stop)
            position, stop, row = position[going] - 1, stop[going], row[going]
            row = row + self.shift[self.run_of[row]]

    def matches_earlier(self) -> np.ndarray:
        """For each text position, whether its next ``length`` bytes start earlier.

        The matching statistic of a position is the group of rows that share its
        prefix; all but the smallest text position of a group match earlier text.
        """
        group, of_row = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64)
        of_row[self.groups[1:]] = 1
        of_row = np.cumsum(of_row)
        for position, row in self.stream():
            group[position] = of_row[row]
        seen = np.flatnonzero(group >= 0)[::-1]
        earliest = np.full(len(self.groups), self.size, np.int64)
        earliest[group[seen]] = seen  # descending, so the smallest is written last
        out = np.zeros(self.size, bool)
        out[seen] = earliest[group[seen]] < seen
        return out


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per text, whether each of its windows also starts earlier in the list.

    Texts are joined by their number in bytes that occur in no UTF-8 text, so no
    suffixes are alike beyond the end of a text, and no window equals a string
    that touches a number.
    """
    joined = b"".join(text + b"\xff" + (b"%07d" % i).translate(_DIGITS) for i, text in enumerate(texts)) + b"\xff" * 9
    found = RunIndex(np.frombuffer(joined, np.uint8), length).matches_earlier()
    out, at = [], 0
    for text in texts:
        out.append(found[at : at + len(text) - length + 1])
        at += len(text) + 8
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(start, size) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [(a, b - a) for a, b in edges.reshape(-1, 2).tolist()]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``row, d, sub, text``: the order of documents, total on different rows.

    ``row`` holds all columns but the text.
    Null ids come last.  Different texts under one id, which only a damaged
    table has, are ordered by hash; equal rows are one document.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(others.alias("row"), order.alias("d"), F.col(text).alias("text"))
    again = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return rows.withColumn("sub", F.lit(0)).select("row", "d", "sub", "text")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    ranks = rows.join(again, "d", "left_semi").select("d", hashed.alias("hash")).distinct()
    ranks = ranks.withColumn("sub", F.dense_rank().over(Window.partitionBy("d").orderBy("hash")))
    return (
        rows.withColumn("hash", hashed).join(ranks, ["d", "hash"], "left")
        .select("row", "d", F.coalesce("sub", F.lit(0)).alias("sub"), "text")
    )


ANCHORS = "key long, seg long, d long, sub int, start long, n int, known int"


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row per segment; those a task knows to be repeats get a key of their own."""

    def reduced(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        order = np.lexsort((rows["start"], rows["sub"], rows["d"], rows["seg"], rows["anchor"]))
        rows = {n: v[order] for n, v in rows.items()}
        same = np.zeros(len(order), bool)
        same[1:] = (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["seg"][1:] == rows["seg"][:-1])
        itself = same.copy()
        for name in ("d", "sub", "start"):
            itself[1:] &= rows[name][1:] == rows[name][:-1]
        key = np.where(same, _mixed(rows["d"].astype(np.uint64) ^ (rows["start"].astype(np.uint64) << np.uint64(32))), rows["anchor"])
        kept = ~itself
        columns = [key.view(np.int64), rows["seg"].view(np.int64), rows["d"], rows["sub"], rows["start"], rows["n"], same]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        names = [c.split(" ")[0] for c in ANCHORS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c[kept].astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            raws = [t.encode() for t in texts_of(batch, "text")]
            ends = np.cumsum([len(r) for r in raws])
            found = segments(np.frombuffer(b"".join(raws), np.uint8), ends, length)
            if not len(found["n"]):
                continue
            doc = found.pop("doc")
            found["start"] = found["start"] - (ends[doc] - np.array([len(r) for r in raws])[doc])
            for name in ("d", "sub"):
                found[name] = batch.column(name).to_numpy()[doc]
            parts.append(found)
            held += len(doc)
            if held >= GATHERED:
                yield reduced(parts)
                parts, held = [], 0
        if parts:
            yield reduced(parts)

    return docs.select("d", "sub", "text").mapInArrow(run, ANCHORS)


def _classified(anchors: DataFrame) -> DataFrame:
    """``key, d, sub, start, n, open``: repeats, and first segments of open anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seg", "d", "sub", "start", "n", "known"]
        held: dict[str, np.ndarray] | None = None  # from the last first segment on
        inside = False  # whether that one follows another segment of its anchor

        def emit(rows: dict[str, np.ndarray], mask: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(rows[n][mask]) for n in ("key", "d", "sub", "start", "n")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(is_open[mask])], ["key", "d", "sub", "start", "n", "open"])

        def decided(rows: dict[str, np.ndarray], inside: bool, final: bool):
            key, seg = rows["key"], rows["seg"]
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])
            itself = same.copy()
            for name in ("d", "sub", "start"):
                itself[1:] &= rows[name][1:] == rows[name][:-1]
            first = np.flatnonzero(~same)
            near = np.zeros(len(first) + 1, bool)
            near[1:-1] = key[first[1:]] == key[first[:-1]]
            near[0] = inside
            is_open = np.zeros(len(key), bool)
            is_open[first] = (near[:-1] | near[1:]) & (rows["known"][first] == 0)
            repeat = (same | (rows["known"] == 1)) & ~itself
            upto = len(key) if final else int(first[-1])
            mask = (repeat | is_open)
            mask[upto:] = False
            return emit(rows, mask, is_open), upto, bool(near[len(first) - 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                rows = {n: np.concatenate([held[n], rows[n]]) for n in names}
            out, upto, inside = decided(rows, inside, False)
            held = {n: v[upto:] for n, v in rows.items()}
            yield out
        if held is not None:
            yield decided(held, inside, True)[0]

    order = ["key", "seg", "d", "sub", "start"]
    dealt = anchors.repartition("key").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "key long, d long, sub int, start long, n int, open boolean")


def _by_document(docs: DataFrame, rows: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Texts and rows about them, each text before its rows."""
    carried = [c for c in docs.columns if c == "row"]
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in extra.items()]
    texts = docs.select(*carried, "d", "sub", F.lit(0).alias("side"), F.coalesce("text", F.lit("")).alias("text"), *nothing)
    about = rows.select(
        *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in carried), "d", "sub", F.lit(1).alias("side"),
        F.lit(None).cast("string").alias("text"), *extra,
    )
    return texts.unionByName(about).repartition("d", "sub").sortWithinPartitions("d", "sub", "side", "start")


def _rows_of(batches: Iterator[pa.RecordBatch], names: list[str], wide: str = "text") -> Iterator[tuple]:
    """Rows as tuples; ``wide`` is the column that holds most of the bytes."""
    for batch in slices(batches, wide, SLICE_BYTES):
        yield from zip(*(batch.column(n).to_pylist() for n in names))


SEGMENTS = "key long, hot boolean, bytes binary, d long, sub int, start long"


def _open_bytes(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The bytes of open segments; for hot anchors a digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, at, out, held = b"", None, [], 0
        seen: dict[bytes, None] = {}
        names = ["d", "sub", "side", "text", "key", "hot", "start", "n"]

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["key", "hot", "bytes", "d", "sub", "start"])

        for d, sub, side, text, key, hot, start, n in _rows_of(batches, names):
            if side == 0:
                if (d, sub) != at:
                    raw, at = text.encode(), (d, sub)
                continue
            if not hot:
                out.append((key, False, raw[start : start + n + length - 1], d, sub, start))
                held += n + length
            else:
                for window in range(start, start + n):
                    digest = hashlib.blake2b(raw[window : window + length], digest_size=16).digest()
                    if digest in seen:  # known to start earlier: documents come in order
                        out.append((window, True, None, d, sub, window))
                    else:
                        if len(seen) < GATHERED:
                            seen[digest] = None
                        out.append((int.from_bytes(digest[:8], "big", signed=True), True, digest[8:], d, sub, window))
                held += 40 * n
            if held > 1 << 22:
                yield flush()
                out, held = [], 0
        yield flush()

    wanted = {"key": "long", "hot": "boolean", "start": "long", "n": "int"}
    return _by_document(docs.drop("row"), rows, wanted).mapInArrow(run, SEGMENTS)


def _indexed(found: DataFrame, length: int) -> DataFrame:
    """``d, sub, start, n``: runs of windows that start earlier."""

    def index(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        rows = sorted(rows, key=lambda r: r[3:6])  # text order is corpus order
        marks = repeated_windows([r[2] for r in rows], length)
        return [
            (r[3], r[4], r[5] + a, n) for r, mark in zip(rows, marks, strict=True) for a, n in _runs(mark)
        ]

    def batch_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["d", "sub", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out, last = [], 0, [], None
        names = ["key", "hot", "bytes", "d", "sub", "start"]
        for row in _rows_of(batches, names, "bytes"):
            key, hot, raw, d, sub, start = row
            if hot:  # sorted by digest, then corpus order
                if raw is None or (key, raw) == last:
                    out.append((d, sub, start, 1))
                last = (key, raw)
            else:
                if size > INDEX_BYTES and key != held[-1][0]:
                    out += index(held)
                    held, size = [], 0
                held.append(row)
                size += len(raw)
            if len(out) > 1 << 16:
                yield batch_of(out)
                out = []
        if held:
            out += index(held)
        yield batch_of(out)

    order = ["hot", "key", F.when(F.col("hot"), F.col("bytes")), "d", "sub", "start"]
    return found.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "d long, sub int, start long, n int")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``d, sub, start, n``: runs of windows of keyed documents that start earlier."""
    rows = written(_classified(_anchors(docs, length)), "segments")
    open_rows = rows.filter("open")
    hot = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > HOT)
    hot = written(hot.select("key", F.lit(True).alias("hot")), "hot-anchors")
    flagged = open_rows.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    compared = _indexed(_open_bytes(docs, flagged, length), length)
    return rows.filter("not open").select("d", "sub", "start", "n").unionByName(compared)


def _removed(docs: DataFrame, text: str, length: int, decoded: bool = False) -> DataFrame:
    """``row, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``.

    ``kept`` is binary, or with ``decoded`` a string without cut characters.
    """
    keyed = _keyed(docs, text)
    found = repeats(keyed, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, raw, windows, out, size, kind = None, [], b"", None, [], 0, None

        def finish() -> None:
            covered = np.zeros(len(raw) + 1, np.int32)
            for start, n in _runs(windows) if windows is not None else ():
                covered[start] += 1
                covered[min(start + n + length - 1, len(raw))] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for row in rows:
                shown = kept.decode(errors="ignore") if decoded else kept
                out.append((row, len(raw), len(raw) - len(kept), len(_runs(gone)), shown))

        def flush() -> pa.RecordBatch:
            kinds = (kind, *[pa.int64()] * 3, pa.string() if decoded else pa.binary())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "n_removed", "n_spans", "kept"])

        for batch in batches:
            kind = batch.schema.field("row").type
            for row, d, sub, side, value, start, n in _rows_of(
                iter([batch]), ["row", "d", "sub", "side", "text", "start", "n"]
            ):
                if side == 0:
                    if (d, sub) == at:
                        rows.append(row)
                        continue
                    if at is not None:
                        finish()
                        size += len(raw)
                    at, rows, raw, windows = (d, sub), [row], value.encode(), None
                    if size > 1 << 22:
                        yield flush()
                        out, size = [], 0
                    continue
                if windows is None:
                    windows = np.zeros(len(raw), bool)
                windows[start : start + n] = True
        if at is not None:
            finish()
            yield flush()

    wanted = {"start": "long", "n": "int"}
    row = keyed.schema["row"].dataType.simpleString()
    return _by_document(keyed, found, wanted).mapInArrow(
        run, f"row {row}, n_bytes long, n_removed long, n_spans long, kept {'string' if decoded else 'binary'}"
    )


def deduplicate(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` with ``kept`` the bytes that stay.

    One row per row of ``docs``.  Null and empty texts have no bytes.  Null ids
    come after all others, rows with one id and different texts are ordered by
    hash of the text, and equal rows count as one document, so neither repeats
    the other.  Whole texts are read, however long; an empty table gives no rows and
    other columns are not read.
    """
    narrow = docs.select("doc_id", text)
    return _removed(narrow, text, length).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def rewrite(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes cut from the text.

    What is left of a character that is cut in two goes as well; a null text
    becomes empty and a column ``n_chars`` is set to the new length.
    """
    found = _removed(docs, text, length, decoded=True)
    size = F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    value = {text: F.col("kept"), "n_chars": size}
    return found.select(
        *((value[c] if c in value else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )


# The same for DuckDB, window by window; bytes are pairs of hexadecimal digits.
SQL = f"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
windows as (select doc_id, s, md5(substr(x, 2 * s + 1, {2 * LENGTH})) as g
    from (select doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) as s from texts) w),
repeated as (select doc_id, s from
    (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from windows) o where r > 1),
flagged as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + {LENGTH} then 0 else 1 end as new
    from repeated),
runs as (select doc_id, s, sum(new) over (partition by doc_id order by s) as run from flagged),
spans as (select doc_id, min(s) as low, max(s) + {LENGTH} as high from runs group by doc_id, run),
cuts as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as after from spans),
pieces as (select c.doc_id, count(*) as n_spans, sum(high - low) as n_removed, max(high) as last,
    string_agg(substr(x, 2 * after + 1, 2 * (low - after)), '' order by low) as kept
    from cuts c join texts t on c.doc_id = t.doc_id group by c.doc_id)
select t.doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
    cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(case when p.doc_id is null then x else kept || substr(x, 2 * last + 1) end)) as kept_sha256
from texts t left join pieces p on t.doc_id = p.doc_id
"""
