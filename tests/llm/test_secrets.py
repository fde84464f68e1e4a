import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import secrets
from tests.llm.conftest import EDGE


def base(text):
    """The base kinds spelt out: all matches first, then the length conditions."""
    keyword = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in keyword.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PARTS = st.sampled_from(
    ["password", "PassWord=", "token: ", "'", '"', "api_key = ", "ApiKey:", "abc", "AKIA", "ABCDEF0123456789", "AKIAX",
     "0123456789abcdef", "deadbeef", " ", "\n", "é", "secret", "=", ":", "x/y+z", "Zq8Rk2Lm9Tv4Wp7Xs1Yb"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = [s for s in secrets.find_spans(text) if s[0] in secrets.BASE_KINDS]
    assert found == base(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcXYZ019", max_size=60), st.integers(4, 20), st.floats(0.5, 4))
def test_entropy_by_counts_equals_entropy_from_scratch(run, window, bits):
    marked = [False] * len(run)
    for at in range(len(run) - window + 1):
        counts = Counter(run[at : at + window]).values()
        if -sum(c / window * math.log2(c / window) for c in counts) >= bits - 1e-10:
            marked[at : at + window] = [True] * window
    found = [False] * len(run)
    for a, b in secrets.entropy_spans(run, window, bits):
        found[a:b] = [True] * (b - a)
    assert found == marked


@pytest.mark.parametrize(
    ("text", "kind"),
    [("key Zq8Rk2Lm9Tv4Wp7Xs1YbDd5 end", "entropy64"), ("id 9f86d081884c7d659a2feaa0c55ad015 end", "entropy16")],
)
def test_random_strings_are_added(text, kind):
    assert kind in {s[0] for s in secrets.find_spans(text)}


@pytest.mark.parametrize(
    "text",
    ["id 123e4567-e89b-12d3-a456-426614174000", "see https://host/a8Kq2Lm9Tv4Wp7Xs1YbDd5", "Donaudampfschifffahrtsgesellschaft",
     "example-Zq8Rk2Lm9Tv4Wp7Xs1Yb", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijABCDEFGHIJ0123456789"],
)
def test_allow_list_and_ordinary_text(text):
    assert not [s for s in secrets.find_spans(text) if s[0].startswith("entropy")]


def test_rows_and_redaction(edge, nothing, documents):
    assert secrets.scan(edge).count() == len(EDGE)
    assert secrets.scan(nothing).count() == secrets.redact(nothing).count() == 0
    clean = secrets.redact(edge)
    assert clean.schema == edge.schema
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(map(str, edge.select("doc_id", "text").collect()))
    for row in secrets.scan(documents).join(documents, "doc_id").collect():
        assert row.base_spans == secrets.joined(base(row.text))
        for span in filter(None, row.spans.split(",")):
            _, start, end = span.split(":")
            assert row.text[int(start) : int(end)] not in row.clean_text


def test_overlapping_spans_are_replaced_once():
    text = "a token=9f86d081884c7d659a2feaa0c55ad015 b"
    assert secrets.redacted(text, secrets.find_spans(text), "#") == "a # b"


KEY = "q7ZpL2vXc9RtB4mNw8KyD3fG"


@pytest.mark.parametrize(
    "text",
    [
        '{"home":"https://a/x","session":"%s"}', "https://a.org/x,%s,1", "<a href=https://a/x>%s</a>", "(https://a/x)[%s]",
        "https://a.org/x?session=%s&b=1", "https://user:%s@a.org/x", "data/sample/KEY=%s", "https://a.org/" + "x" * 3000 + "'%s'",
    ],
)
def test_allow_list_explains_no_neighbour(text):
    text = text % KEY
    at = text.index(KEY)
    assert any(s[0] == "entropy64" and s[1] <= at and s[2] >= at + len(KEY) for s in secrets.find_spans(text))


def test_chance_placeholder_in_a_long_block():
    block = "".join(KEY[i * 7 % 24 :] + KEY[: i * 7 % 24] for i in range(8))
    text = f"{block}xxxx{block}"
    covered = sum(b - a for kind, a, b in secrets.find_spans(text) if kind == "entropy64")
    assert covered == 2 * len(block)


def test_a_long_address_stays_explained():
    text = "https://a.org/" + "x/" * 2000 + KEY
    assert not [s for s in secrets.find_spans(text) if s[0].startswith("entropy")]
