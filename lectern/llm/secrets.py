"""Secret scan: fixed patterns plus sliding-window entropy with an allow-list.

Three base kinds are found by pattern.  On top, every maximal run of base64 or
hexadecimal characters is a candidate: a window slides over it, the Shannon
entropy of the window is kept up to date from the counts of the one character
that enters and the one that leaves, and windows at or above the threshold of
the character class are joined into spans.  Windows that touch what an allow-list
explains do not count; base spans never are suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import slices

# The base kinds in the order that breaks ties, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy64", "entropy16")
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

# A candidate run; the shortest base match without a keyword has 20 characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")
# Strings that look random but are no secrets.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|(?i:example|placeholder|changeme|dummy|sample|xxxx)"
    r"|abcdefghij|ABCDEFGHIJ|0123456789"
)
# A placeholder explains the part of a path or assignment it lies in, up to this length;
# in a longer one, as a block of base64, it explains itself alone.
PART = re.compile(r"[^/=]+")
PART_MOST = 64
# Host and path of an address, after what it holds for a user name and a password.
# Quotes, commas, brackets and the query end it.
URL = re.compile(
    r"""(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://(?:[^\s/?#"'@]*@)?|(?=www\.))([^\s"'`,;|<>()\[\]{}\\?#]+)"""
)


@dataclass(frozen=True)
class EntropyClass:
    """Window length and least entropy in bits for one class of characters."""

    kind: str
    window: int
    bits: float


BASE64 = EntropyClass("entropy64", 20, 3.9)
BASE16 = EntropyClass("entropy16", 24, 3.0)


def entropy_spans(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal unions of windows of ``run`` whose entropy is at least ``bits``.

    With counts c of a window of w characters the entropy is
    log2 w - (sum of c log2 c) / w; a step changes two of the counts.
    """
    if len(run) < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for end, entering in enumerate(run, 1):
        count = counts.get(entering, 0)
        total += weight[count + 1] - weight[count]
        counts[entering] = count + 1
        if end > window:
            leaving = run[end - window - 1]
            count = counts[leaving]
            total += weight[count - 1] - weight[count]
            counts[leaving] = count - 1
        if end >= window and total <= most:
            start = end - window
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])
    return [(start, end) for start, end in spans]


def _mixed(part: str) -> bool:
    """At least one digit and letters of both cases, or digits between letters."""
    digits = sum(c.isdigit() for c in part)
    upper, lower = any(c.isupper() for c in part), any(c.islower() for c in part)
    return digits > 0 and (upper and lower or digits >= 3 and (upper or lower))


def _random(run: str) -> list[tuple[str, int, int]]:
    """The entropy spans of a run, whatever the allow-list says."""
    added = [
        (BASE16.kind, x.start() + a, x.start() + b)
        for x in HEX_RUN.finditer(run)
        for a, b in entropy_spans(x[0].lower(), BASE16.window, BASE16.bits)
        if any(c.isalpha() for c in x[0][a:b])
    ]
    return added + [
        (BASE64.kind, a, b) for a, b in entropy_spans(run, BASE64.window, BASE64.bits) if _mixed(run[a:b])
    ]


def _unexplained(run: str) -> list[tuple[int, int]]:
    """What the allow-list leaves of a run."""
    explained = [m.span() for m in ALLOWED.finditer(run)]
    for part in PART.finditer(run):
        if part.end() - part.start() <= PART_MOST and ALLOWED.search(part[0]):
            explained.append(part.span())
    rest, last = [], 0
    for low, high in sorted(explained):
        if low > last:
            rest.append((last, low))
        last = max(last, high)
    return [*rest, (last, len(run))]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start, then kind."""
    found: list[tuple[str, int, int]] = []
    lowered = text.lower()
    if any(word in lowered for word in WORDS):
        found += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if len(m[1]) >= ASSIGN_LEAST
        ]
    urls: list[tuple[int, int]] | None = None
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        base = [("access", at + x.start(), at + x.end()) for x in ACCESS.finditer(run)]
        base += [("hex", at + x.start(), at + x.end()) for x in HEX.finditer(run)]
        found += base
        added = _random(run)
        if not added:
            continue
        if urls is None:
            urls = [m.span(1) for m in URL.finditer(text)]
        near = bisect_right(urls, (at + 2 * run.startswith("//"), len(text))) - 1
        if near >= 0 and m.end() <= urls[near][1]:
            continue
        if ALLOWED.search(run):
            added = [(kind, low + a, low + b) for low, high in _unexplained(run) for kind, a, b in _random(run[low:high])]
        found += [(kind, at + a, at + b) for kind, a, b in added]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    parts, at, last = [], 0, -1
    for _, start, end in spans:
        if start > last:
            parts += [text[at:start], mark]
        at = last = max(last, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """One row per document: counts per kind, spans, and the text without secrets.

    Map-only: nothing is shuffled and every task holds a few megabytes of text.
    Columns: ``doc_id, n_assign, n_access, n_hex, n_spans, base_spans, spans,
    clean_text``.  A null or empty text has no spans and the empty string in
    their place; ``clean_text`` is null where the text is.  Rows are taken one by
    one, so repeated or null ids stay as they are; other columns are not read.  Whole
    texts are scanned, however long; an empty table gives no rows.
    """
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_spans long, "
        "base_spans string, spans string, clean_text string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(text).to_pylist():
                spans = find_spans(value or "")
                base = [span for span in spans if span[0] in BASE_KINDS]
                row = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
                clean = value if value is None else redacted(value, spans, mark)
                for column, item in zip(out, [*row, len(spans), joined(base), joined(spans), clean], strict=True):
                    column.append(item)
            columns = [batch.column("doc_id").cast(pa.int64())]
            columns += [pa.array(c, pa.int64()) for c in out[:4]]
            columns += [pa.array(c, pa.string()) for c in out[4:]]
            names = [f.split(" ")[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text).mapInArrow(run, schema)




def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with the spans replaced in the text.

    A column ``n_chars`` is set to the new length.  Map-only, so repeated and
    null ids and null texts pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            clean = [
                value if not value else redacted(value, find_spans(value), mark)
                for value in batch.column(text).to_pylist()
            ]
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, text, pa.array(clean, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                sizes = [None if value is None else len(value) for value in clean]
                batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
