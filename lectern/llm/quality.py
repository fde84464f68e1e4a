"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are worked out once per document in a map-only pass over whole texts
and kept as a narrow table.  The trees are grown on a bounded sample of labelled
rows, on feature values cut into histogram bins, and flattened into arrays of a
complete binary tree; scoring walks all rows of a batch down a level at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sample_of, slices, texts_of, written

# Bound on the labelled rows the trees are grown on: those of smallest hash.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

# Frequent words of the four languages.
FREQUENT = frozenset(
    """the of and to in is that it was for on are with as be this by from or an at
    der die das und ist von den mit ein eine zu im nicht auf für des dem sich als auch
    le la les et de un une des est que dans pour qui sur pas au du en il ne se par avec
    el los las y que del se por una con para no su lo como más""".split()
)
BYTE_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\n\r\x0b\x0c",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "quote": b"\"'`()",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_{}~-",
    "high": bytes(range(128, 256)),
}
_GROUP = np.zeros((256, len(BYTE_GROUPS)))
for _at, _members in enumerate(BYTE_GROUPS.values()):
    _GROUP[list(_members), _at] = 1
STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "distinct_words",
    "top_word", "same_as_before", "distinct_pairs", "frequent_words", "line_length",
    "distinct_lines", "words_capital", "words_stopped", "words_digit", "longest_word",
    "entropy", "vowels", *BYTE_GROUPS,
)
_VOWELS = np.zeros(256)
_VOWELS[list(b"aeiouyAEIOUY")] = 1


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of :data:`STATISTICS`."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / max(len(raw), 1)
    seen = share[share > 0]
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    table = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(str.__eq__, words, words[1:]))
    frequent = sum(table[w] for w in table.keys() & FREQUENT)
    capital = stopped = digit = 0
    for word, times in table.items():
        capital += times * word[0].isupper()
        stopped += times * (word[-1] in ".!?")
        digit += times * (word[0].isdigit() or word[-1].isdigit())
    full = [line for line in lines if line.strip()]
    letters = max(share[65:91].sum() + share[97:123].sum(), 1e-9)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(full)),
        lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0,
        len(table) / n, max(table.values(), default=0) / n, same / n,
        pairs / max(len(words) - 1, 1), frequent / n,
        np.log1p(len(text) / max(len(full), 1)), len(set(full)) / max(len(full), 1),
        capital / n, stopped / n, digit / n, np.log1p(lengths.max() if len(words) else 0),
        float(-(seen * np.log2(seen)).sum()), float(share @ _VOWELS / letters),
        *(share @ _GROUP),
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the array ``x`` of statistics for every document; map-only.

    A null text counts as empty: all shares are zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [statistics(value) for value in texts_of(batch, text)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Trees:
    """A sum of complete binary trees as arrays; node k has children 2k+1, 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # a row goes right where its value is above the limit
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.intp)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64,
    rate: float = 0.12, ridge: float = 1.0, least: float = 4.0,
) -> Trees:
    """Boost trees of ``depth`` on the logistic loss, on histograms of ``bins`` bins.

    Per level, gradients and curvatures are summed by (node, feature, bin) and the
    cumulated sums give the gain of every split at once.  A node without a useful
    split sends all rows left.
    """
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    shape = (trees if len(y) else 0, inner)
    model = Trees(base, np.zeros(shape, np.intp), np.full(shape, np.inf), np.zeros((shape[0], inner + 1)))
    if not len(y):
        return model
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], 1)
    offset = np.arange(width) * bins
    total = np.full(len(y), base)
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.intp)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = ((node - first) * width * bins)[:, None] + offset + binned
            sums = [
                np.bincount(place.ravel(), np.repeat(v, width), nodes * width * bins)
                .reshape(nodes, width, bins).cumsum(2)
                for v in (gradient, curvature)
            ]
            gl, hl = sums
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + k], model.limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.limit[t, node])
        at = node - inner
        g, h = np.bincount(at, gradient, inner + 1), np.bincount(at, curvature, inner + 1)
        model.leaf[t] = -rate * g / (h + ridge)
        total += model.leaf[t][at]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside the training folds."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def train(statistics_table: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees for ``labels.quality``, grown on at most ``sample_rows`` labelled rows.

    Rows held out and rows without a label of 0 or 1 are never used.
    """
    known = labels.select("doc_id", "quality").filter(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    joined = statistics_table.join(known, "doc_id")
    sample = sample_of(joined, "doc_id", sample_rows, known.count()).select("x", "quality").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return grow(x, sample["quality"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    One row per row of ``docs``, also for null and empty texts, null and repeated
    ids (which count as not held out, if null).  Without any labelled row the
    score is 0.5.  Only the text is an input of the score, whole and however long;
    rows alike have scores alike.  Rows that repeat an id in ``labels`` count as so many
    examples of it.  An empty table gives no rows; other columns are not read.
    """
    table = written(features(docs, text), "quality")
    model = docs.sparkSession.sparkContext.broadcast(train(table, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            score = model.value.score(x.reshape(-1, len(STATISTICS)))
            columns = [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
