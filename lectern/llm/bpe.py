"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Texts are cut into pre-tokens without a regular expression.  Every code point
gets a class from an array indexed by code point (letter, number, space, ...);
with one or two characters of look-ahead the classes become the input symbols
of a small automaton.  Each symbol is a function from state to state and
composition is associative, so the states of a whole batch of documents are
found by a parallel prefix scan in numpy: blocks are composed side by side,
their products are scanned by doubling, and a last sweep reads off where tokens
begin.  The slices then go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import slices, texts_of, without_gc

# Character classes.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE = range(6)
# Automaton input: classes after look-ahead.  SHORT and LONG are apostrophes that
# start a contraction of two or three characters; LEADING is a space right
# before a word; LAST any other blank right before a word; MID the blanks before.
(L, N, O, SHORT, LONG, LEADING, LAST, MID, END) = range(9)
# Automaton states: what the token being read consists of.
(FRESH, IN_L, IN_N, IN_O, IN_LEADING, IN_BLANKS, ONE_LEFT, TWO_LEFT) = range(8)
STATES = 8
BLOCK = 64
# Pieces kept in the cache of a task; beyond it the cache starts anew.
# Ids that are decoded at once, which bounds the working memory.
DECODED_IDS = 1 << 16
CACHED_PIECES = 1 << 19
# Longer pieces are merged one by one.
LONG_PIECE = 48


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token begins, both by (symbol, state)."""
    fresh = {L: IN_L, N: IN_N, O: IN_O, SHORT: ONE_LEFT, LONG: TWO_LEFT, LEADING: IN_LEADING,
             LAST: FRESH, MID: IN_BLANKS, END: FRESH}
    going_on = {
        **{(s, ONE_LEFT): FRESH for s in range(9)},
        **{(s, TWO_LEFT): ONE_LEFT for s in range(9)},
        **{(s, IN_O): IN_O for s in (O, SHORT, LONG)},
        **{(s, IN_LEADING): IN_O for s in (O, SHORT, LONG)},
        (L, IN_L): IN_L, (L, IN_LEADING): IN_L,
        (N, IN_N): IN_N, (N, IN_LEADING): IN_N,
        (MID, IN_BLANKS): IN_BLANKS,
    }
    step = np.zeros((9, STATES), np.uint8)
    begins = np.zeros((9, STATES), bool)
    for symbol in range(9):
        for state in range(STATES):
            step[symbol, state] = going_on.get((symbol, state), fresh[symbol])
            begins[symbol, state] = (symbol, state) not in going_on and symbol != END
    step[END] = FRESH
    return step, begins


STEP, BEGINS = _automaton()


@cache
def class_table(library: str) -> np.ndarray:
    """Class of every code point, by the Unicode data of ``library``.

    ``tiktoken`` and ``tokenizers`` carry their own versions of Unicode; each is
    asked which of all code points are letters, numbers and blanks.
    """
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        if library == "tiktoken":
            import tiktoken

            every = tiktoken.Encoding(
                "bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)},
                special_tokens={},
            )
            members = bytes(every.encode_ordinary(text)).decode()
        else:
            import tokenizers

            cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
            members = "".join(part for part, _ in cut.pre_tokenize_str(text))
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return table


def _symbols(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Automaton input for joined documents, with END at the positions ``ends``."""
    kind = table[points]
    kind[ends] = END
    after = np.append(kind[1:], np.uint8(END))
    symbol = np.select([kind == LETTER, kind == NUMBER, kind == END], [L, N, END], O).astype(np.uint8)
    blank = (kind == BLANK) | (kind == SPACE)
    before_word = (after != BLANK) & (after != SPACE) & (after != END)
    symbol[blank] = MID
    symbol[blank & before_word] = LAST
    symbol[(kind == SPACE) & before_word] = LEADING
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        real = np.where(kind == END, 0, points)
        first = np.append(real[1:], [0, 0])[quotes]
        second = np.append(real[2:], [0, 0, 0])[quotes]
        symbol[quotes[np.isin(first, [ord(c) for c in "stmd"])]] = SHORT
        for a, b in ("re", "ve", "ll"):
            symbol[quotes[(first == ord(a)) & (second == ord(b))]] = LONG
    return symbol


def _token_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a token begins, by a blocked prefix scan over functions."""
    rows = max(1, -(-len(symbol) // BLOCK))
    padded = np.full(rows * BLOCK, END, np.uint8)
    padded[: len(symbol)] = symbol
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat = STEP.ravel()
    # The function of each block: image of every state.
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in columns:
        function = flat[(column[:, None].astype(np.uint16) << 3) | function]
    # Inclusive scan by doubling: later function after earlier function.
    reach = 1
    while reach < rows:
        composed = np.take_along_axis(function[reach:], function[:-reach].astype(np.intp), 1)
        function = np.concatenate([function[:reach], composed])
        reach *= 2
    state = np.concatenate([[np.uint8(FRESH)], function[:-1, FRESH]])
    begins, marks = BEGINS.ravel(), np.empty((BLOCK, rows), bool)
    for place, column in enumerate(columns):
        index = (column.astype(np.uint16) << 3) | state
        marks[place] = begins[index]
        state = flat[index]
    return np.flatnonzero(marks.T.ravel()[: len(symbol)])


def pre_tokens(texts: list[str], table: np.ndarray) -> list[list[int]]:
    """Per text, the code point offsets at which its pre-tokens begin."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(text) + 1 for text in texts]) - 1
    starts = _token_starts(_symbols(points, ends, table))
    cuts = np.searchsorted(starts, ends).tolist()
    out, low, base = [], 0, 0
    for high, end in zip(cuts, ends.tolist(), strict=True):
        out.append((starts[low:high] - base).tolist())
        low, base = high, end + 1
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of any length, by a heap over a linked list in n log n."""
    size = len(piece)
    end = list(range(1, size + 1))  # of the part that begins here; 0 where none does
    before = list(range(-1, size - 1))
    heap = [
        (rank, i, i + 1, i + 2)
        for i in range(size - 1)
        if (rank := ranks.get(piece[i : i + 2])) is not None
    ]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or middle >= size or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < size:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, stop, end[stop]))
        j = before[i]
        if j >= 0 and (rank := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (rank, j, i, stop))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class PairMerger:
    """Merges pieces by rank: always the leftmost pair of lowest rank first.

    Pieces of one length are the rows of a matrix and take their next merge
    together.  The rank of a pair of ids is found by binary search in the sorted
    pairs the vocabulary can form.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.none = ranks, np.int64(1 << 40)
        pairs = {
            (left << 32) | right: rank
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if (left := ranks.get(piece[:cut])) is not None
            and (right := ranks.get(piece[cut:])) is not None
        }
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        every = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.of_bytes = self._rank(*every).reshape(256, 256)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, in the order given."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for place, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[place] = (whole,)
            elif len(piece) > LONG_PIECE:
                out[place] = tuple(_merge_long(piece, self.ranks))
            else:
                by_size.setdefault(len(piece), []).append(place)
        for size, places in by_size.items():
            raw = np.frombuffer(b"".join([pieces[p] for p in places]), np.uint8)
            self._merge_rows(raw.reshape(-1, size), np.array(places), out)
        return out

    def _merge_rows(self, raw: np.ndarray, places: np.ndarray, out: list) -> None:
        ids, rank = self.single[raw], self.of_bytes[raw[:, :-1], raw[:, 1:]]
        while len(places):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(places), np.intp)
            row = np.arange(len(places))
            lowest = rank[row, best] if rank.shape[1] else np.full(len(places), self.none)
            done = lowest == self.none
            if done.any():
                for place, found in zip(places[done].tolist(), ids[done].tolist(), strict=True):
                    out[place] = tuple(found)
                going = ~done
                ids, rank, places, best, lowest = (x[going] for x in (ids, rank, places, best, lowest))
                row = np.arange(len(places))
            if not len(places):
                return
            width = ids.shape[1]
            ids[row, best] = lowest
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(-1, width - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, best] = False
            rank = rank[keep].reshape(-1, width - 2)
            left, right = best > 0, best < width - 2
            r, c = row[left], best[left]
            rank[r, c - 1] = self._rank(ids[r, c - 1], ids[r, c])
            r, c = row[right], best[right]
            rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])


class Codec:
    """Encodes and decodes texts; one per task, with its own bounded cache."""

    def __init__(self, ranks: dict[bytes, int], table: np.ndarray) -> None:
        self.table, self.merger = table, PairMerger(ranks)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        # All pieces in one row of bytes, by id.
        self.sizes = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        for rank, piece in self.bytes_of.items():
            self.sizes[rank] = len(piece)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of[r] for r in sorted(self.bytes_of)), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        tokens = [
            [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
            for text, starts in zip(texts, pre_tokens(texts, self.table), strict=True)
        ]
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        new = list(set().union(*tokens).difference(self.pieces))
        self.pieces.update(zip(new, self.merger.merge([t.encode() for t in new]), strict=True))
        find = self.pieces.__getitem__
        return [list(chain.from_iterable(map(find, row))) for row in tokens]

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of each id, and of the end of the text."""
        return self._offsets(np.array(ids, np.int64)).tolist()

    def _offsets(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode_all(self, texts: list[list[int]]) -> list[bytes]:
        """The bytes of each text: every id's bytes go to its offset, and texts are cut at theirs."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(chain.from_iterable(texts), np.int64, int(counts.sum()))
        if len(ids) and not ((ids >= 0) & (ids < len(self.sizes)) & (self.sizes[np.clip(ids, 0, len(self.sizes) - 1)] > 0)).all():
            raise KeyError("an id that the vocabulary does not have")
        offsets, parts = self._offsets(ids), []
        for low in range(0, len(ids), DECODED_IDS):
            some, at = ids[low : low + DECODED_IDS], offsets[low : low + DECODED_IDS + 1]
            places = np.repeat(self.starts[some] - at[:-1], self.sizes[some]) + np.arange(at[0], at[-1])
            parts.append(self.flat[places].tobytes())
        joined = b"".join(parts)
        ends = offsets[np.cumsum(counts)].tolist()
        return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all([ids])[0]


def codec_maker(spark: SparkSession, ranks_path: str, library: str = "tiktoken") -> Callable[[], Codec]:
    """A function for tasks that builds a :class:`Codec`.

    The rank file is read once on the driver and broadcast: a vocabulary is a
    file of fixed size, about one megabyte, whatever the size of the corpus.
    """
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast((file.read(), class_table(library)))

    def make() -> Codec:
        raw, table = shared.value
        return Codec(parse_ranks(raw), table)

    return make


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``offsets`` (byte offsets, one more than ids) to each document.

    Map-only.  A null or empty text has no ids and the offsets ``[0]``.  Other
    columns pass through, but for ones named ``ids`` and ``offsets``, which are
    replaced.
    """
    make = codec_maker(docs.sparkSession, ranks_path)
    kept = docs.drop("ids", "offsets")
    schema = pa_schema_ddl(kept, "ids array<int>, offsets array<long>")

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in slices(batches, text):
            ids = codec.encode(texts_of(batch, text))
            columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
            columns.append(pa.array(map(codec.offsets, ids), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "ids", "offsets"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded`` (bytes) to rows with an array ``ids``; null ids give null."""
    make = codec_maker(encoded.sparkSession, ranks_path)
    kept = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            found = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            columns = [*batch.columns, pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, pa_schema_ddl(kept, "decoded binary"))


def pa_schema_ddl(frame: DataFrame, more: str) -> str:
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    return ", ".join([*own, more])


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Encode every text and decode its ids again at their offsets, keeping digests of both.

    One pass, no shuffle; ids never leave the task.  Columns: ``doc_id,
    n_tokens, ids_sha256, decoded_sha256``.  Null and empty texts give no
    tokens and the digests of nothing.  Whole texts are encoded, however long.  Rows are
    taken one by one, so null and repeated ids stay as they are; an empty table gives
    no rows, and other columns are not read.
    """
    make = codec_maker(docs.sparkSession, ranks_path)

    @without_gc
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        decimal = {i: str(i) for i in codec.bytes_of}
        for batch in slices(batches, text):
            sizes, of_ids, of_bytes = [], [], []
            encoded = codec.encode(texts_of(batch, text))
            for ids, back in zip(encoded, codec.decode_all(encoded), strict=True):
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(back).hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(x, pa.string()) for x in (of_ids, of_bytes)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
