"""Text and titles out of HTML, with the semantics of an HTML5 parser.

Two tiers:

* the native tier is a chain of regular expressions inside the JVM.  It is
  exact for pages of a *simple shape*: an explicit ``<body>``, nothing but the
  usual metadata before it, no text between table cells inside it, no raw-text elements
  but closed scripts and styles without references or markup, and only character
  references that it can decode;
* every other page goes through one Arrow-batched tokenizer
  (:mod:`lectern.functions.html_tokens`).

``extract_page`` decides per row.  Simple pages reach the Python worker as
nulls, so they cost next to nothing there, and the scan is read once.

The tag pattern follows the HTML5 attribute grammar (a quote opens a value only
after ``=``).  All repetitions are possessive: they neither backtrack nor
recurse, whatever the page contains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.html_tokens import read_pages

# --- HTML grammar ------------------------------------------------------------
_WS = r"\t\n\f\r "
_VALUE = rf"(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^{_WS}\"'>][^{_WS}>]*+)"
_ATTRIBUTE = (
    rf"[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+=[{_WS}]*+{_VALUE}?+)?+"
)
_ATTRIBUTES = rf"(?:[{_WS}/]++|{_ATTRIBUTE})*+"
_TAG_END = r"(?:>|\z)"
_TAG = rf"</?[A-Za-z][^{_WS}/>]*+{_ATTRIBUTES}{_TAG_END}"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_BOGUS_COMMENT = r"(?:<[!?]|</(?![A-Za-z]))[^>]*+(?:>|\z)"


def _start_tag(names: str) -> str:
    return rf"<(?:{names})(?=[{_WS}/>]){_ATTRIBUTES}{_TAG_END}"


def _raw_element(name: str) -> str:
    return rf"{_start_tag(name)}.*?</{name}(?=[{_WS}/>]){_ATTRIBUTES}>"


def _plain_raw(name: str, group: str) -> str:
    """A closed raw element that holds neither references nor markup; ``group`` opens its content.

    Such content is text as it stands, in HTML and in graphics inside it alike.
    """
    return rf"<{name}(?=[{_WS}/>]){_ATTRIBUTES}>{group}[^<&]*+)</{name}(?=[{_WS}/>]){_ATTRIBUTES}>"


_RAW_IN_BODY = ("script", "style")
# Everything up to and including the <body> tag of a simple page.
_PRELUDE = (
    rf"(?is)\A\x{{FEFF}}?(?:[{_WS}]++|{_COMMENT}|{_BOGUS_COMMENT}"
    rf"|{_raw_element('title')}|{_raw_element('style')}|{_raw_element('script')}"
    rf"|</?(?:html|head|meta|link|base)(?=[{_WS}/>]){_ATTRIBUTES}>)*+"
    rf"{_start_tag('body')}"
)
# Elements whose content is not markup; after <body> a simple page has only plain ones of two kinds.
_RAW_NAMES = "script|style|title|textarea|noscript|iframe|noembed|noframes|xmp|plaintext"
_TABLE_PART = "caption|colgroup|col|thead|tbody|tfoot|tr|td|th|table"
# Table markup followed by anything that may not stand outside a cell.
_STRAY = (
    rf"(?:(?:table|colgroup|col|thead|tbody|tfoot|tr)(?=[{_WS}/>]){_ATTRIBUTES}"
    rf"|/(?:caption|colgroup|thead|tbody|tfoot|tr|td|th)(?=[{_WS}/>]){_ATTRIBUTES})>"
    rf"(?:[{_WS}]++|{_COMMENT})*+(?:[^<{_WS}]|<(?!/?(?:{_TABLE_PART})[{_WS}/>]))"
)
_NOT_SIMPLE = rf"(?:{_RAW_NAMES})[{_WS}/>]|!\[CDATA\[|{_STRAY}"
_PLAIN_RAWS = "|".join(_plain_raw(name, "(?:") for name in _RAW_IN_BODY)
_SIMPLE_BODY = rf"{_PRELUDE}((?:[^<]++|{_PLAIN_RAWS}|<(?!{_NOT_SIMPLE}))*+)\z"
# Markup inside the body; a newline right after these block tags is not text.
_MARKUP = (
    rf"(?is){'|'.join(_plain_raw(name, '(') for name in _RAW_IN_BODY)}"
    r"|<(?:!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|(?:pre|listing)(?=[{_WS}/>]){_ATTRIBUTES}{_TAG_END}\n?"
    r"|(?:[!?]|/(?![a-z]))[^>]*+(?:>|\z)"
    rf"|/?[a-z][^{_WS}/>]*+{_ATTRIBUTES}{_TAG_END})"
)

# --- character references ----------------------------------------------------
# Decoded natively by name.
_NAMED = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "reg": "®",
    "deg": "°",
    "middot": "·",
    "laquo": "«",
    "raquo": "»",
    "eacute": "é",
    "shy": "­",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "bull": "•",
    "hellip": "…",
}
# Numbers that stand for themselves: no control, remapped or surrogate values.
_NUMERIC = (
    r"#0*(?:9|10|3[2-9]|[4-9]\d|1[01]\d|12[0-6]|1[6-9]\d|[2-9]\d\d|[1-9]\d{3}|[1-4]\d{4})"
    r"|#[xX]0*(?:9|[aA]|[2-6][0-9a-fA-F]|7[0-9a-eA-E]|[a-fA-F][0-9a-fA-F]"
    r"|[1-9a-fA-F][0-9a-fA-F]{2}|[1-9a-cA-C][0-9a-fA-F]{3})"
)
_REFERENCE = rf"(?:{'|'.join(_NAMED)}|{_NUMERIC});"
_UNKNOWN_REFERENCE = rf"&(?=[A-Za-z0-9#])(?!{_REFERENCE})"

_SKIPPED = (
    rf"{_COMMENT}|{_BOGUS_COMMENT}|{_raw_element('script')}|{_raw_element('style')}"
)
TITLE_TEXT = (
    rf"(?is){_SKIPPED}|{_start_tag('title')}(.*?)(?:</title(?=[{_WS}/>]){_ATTRIBUTES}>|\z)"
)
_FIRST_SECTION = (
    rf"(?is)\A(?:(?!<section[{_WS}/>])"
    rf"(?:{_SKIPPED}|{_raw_element('title')}|{_TAG}|[^<]++|<))*+"
)
_OTHER_ATTRIBUTE = rf"(?!title[{_WS}=/>]){_ATTRIBUTE}"
SECTION_TITLE = (
    rf"{_FIRST_SECTION}<section(?:[{_WS}/]++|{_OTHER_ATTRIBUTE})*+"
    rf"title[{_WS}]*+=[{_WS}]*+(\"[^\"]*+\"|'[^']*+'|[^{_WS}\"'>][^{_WS}>]*+)"
    rf"{_ATTRIBUTES}>"
)


def filter_footnotes(html: Column) -> Column:
    """Remove ``<sup>`` elements that hold nothing but a number."""
    return F.regexp_replace(html, P.FOOTNOTE_MARKER, P.FOOTNOTE_TEXT)


def _newlines(html: Column) -> Column:
    """HTML input has only ``\\n`` line ends, whatever the file holds."""
    return F.regexp_replace(html, r"\r\n?", "\n")


def simple_body(html: Column) -> Column:
    """All that follows ``<body>`` in a page of simple shape, '' otherwise.

    An empty body also gives '', so '' means: leave this page to the tokenizer.
    """
    return F.regexp_extract(html, _SIMPLE_BODY, 1)


def needs_tokenizer(html: Column) -> Column:
    """Whether the shape of a page sends it to the tokenizer, for reports."""
    return simple_body(_newlines(html)) == ""


def is_simple_text(text: Column) -> Column:
    """True where the native tier can decode every character reference."""
    return ~F.contains(text, F.lit("\0")) & ~F.rlike(text, F.lit(_UNKNOWN_REFERENCE))


def strip_markup(body: Column) -> Column:
    """The text between the tags, character references still encoded.

    What a raw element holds is text as well.
    """
    return F.regexp_replace(body, _MARKUP, "$1$2")


def _decode_number(digits: Column) -> Column:
    """The character of a number of any length: leading zeros go first."""
    is_hex = digits.startswith("x") | digits.startswith("X")
    zero = F.lit("0")
    hex_digits = F.ltrim(F.substring(digits, F.lit(2), F.length(digits)), zero)
    as_hex = F.when(is_hex, hex_digits).otherwise(F.conv(F.ltrim(digits, zero), 10, 16))
    return F.decode(F.unhex(F.lpad(as_hex, 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Decode the character references the native tier knows, in one pass.

    The text is cut in front of each reference, so nothing that a reference
    stands for can be taken for a part of another one.
    """
    chars = F.create_map(*[F.lit(part) for pair in _NAMED.items() for part in pair])

    def decode(piece: Column, index: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        char = F.when(name.startswith("#"), _decode_number(F.substring(name, F.lit(2), F.length(name)))).otherwise(
            F.try_element_at(chars, name)
        )
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(index == 0, piece).otherwise(F.concat(char, rest))

    pieces = F.split(text, rf"&(?={_REFERENCE})")
    return F.array_join(F.transform(pieces, decode), "")


def _raw_title_tag(page: Column) -> Column:
    return F.array_join(F.regexp_extract_all(page, F.lit(TITLE_TEXT), F.lit(1)), "")


def _raw_section_title(page: Column) -> Column:
    value = F.regexp_extract(page, SECTION_TITLE, 1)
    quoted = value.startswith('"') | value.startswith("'")
    inner = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(F.rlike(page, F.lit("(?i)<section")), inner).when(page.isNotNull(), "")


def native_body_text(html: Column) -> Column:
    """Text of the body of a simple page, as one expression."""
    return decode_references(strip_markup(simple_body(_newlines(html))))


def native_title_tag(html: Column) -> Column:
    """Text of all ``title`` elements of a simple page, concatenated."""
    return decode_references(_raw_title_tag(_newlines(html)))


def native_section_title(html: Column) -> Column:
    """``title`` attribute of the first ``section`` of a simple page, or ''."""
    return decode_references(_raw_section_title(_newlines(html)))


def extract_page(
    df: DataFrame, html: str, text: str | None = None,
    title_tag: str | None = None, section_title: str | None = None,
) -> DataFrame:
    """Add the requested columns of each page: body text, title tag, section title.

    A page is read natively if its shape is simple and all references in the
    requested parts are known, else by the tokenizer.  Only what is asked for is
    computed, each step as a projection of its own over the step before.
    """
    page, body, simple, exact = (f"__{name}" for name in ("page", "body", "simple", "exact"))
    is_simple = F.col(body) != ""
    wanted = {
        "body_text": (text, strip_markup(F.col(body))),
        "title_tag": (title_tag, F.when(is_simple, _raw_title_tag(F.col(page)))),
        "section_title": (section_title, F.when(is_simple, _raw_section_title(F.col(page)))),
    }
    parts = {field: pair for field, pair in wanted.items() if pair[0] is not None}
    kept, raw = df.columns, F.col(html)
    df = df.withColumn(page, F.when(F.contains(raw, F.lit("\r")), _newlines(raw)).otherwise(raw))
    df = df.withColumn(body, simple_body(F.col(page)))
    df = df.withColumns({f"__{field}": native for field, (_, native) in parts.items()})
    known = [is_simple_text(F.col(f"__{field}")) for field in parts]
    df = df.withColumn(simple, reduce(Column.__and__, known, is_simple))
    df = df.withColumn(exact, read_pages(F.when(~F.col(simple), F.col(page))))
    return df.select(*kept, *[_decoded(field, simple, exact).alias(name)
                              for field, (name, _) in parts.items()])


def _decoded(field: str, simple: str, exact: str) -> Column:
    native = F.col(f"__{field}")
    decoded = F.when(F.contains(native, F.lit("&")), decode_references(native)).otherwise(native)
    return F.when(F.col(simple), decoded).otherwise(F.col(exact)[field])
