import hashlib
import random

import numpy as np
import pytest

from lectern.llm import suffix
from tests.llm.conftest import EDGE

LENGTH = suffix.LENGTH


def brute(texts):
    seen, out = set(), []
    for text in texts:
        marks = np.zeros(max(0, len(text) - LENGTH + 1), bool)
        for i in range(len(marks)):
            window = text[i : i + LENGTH]
            marks[i] = window in seen
            seen.add(window)
        out.append(marks)
    return out


def result(text, marks):
    gone = np.zeros(len(text), bool)
    for i in np.flatnonzero(marks):
        gone[i : i + LENGTH] = True
    kept = bytes(b for b, g in zip(text, gone) if not g)
    spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    return len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def check(docs, length_of=None):
    """Rows in order of id (null last), then hash; equal rows are one document."""
    rows = docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as hash").collect()
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.hash, r.text) for r in rows})
    texts = [o[3].encode() for o in order]
    of = {o[:3]: result(t, m) for o, t, m in zip(order, texts, brute(texts), strict=True)}
    wanted = sorted(str((r.doc_id, *of[r.doc_id is None, r.doc_id or 0, r.hash])) for r in rows)
    found = suffix.deduplicate(docs).collect()
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in found)
    assert got == wanted


def test_all_documents(documents):
    check(documents)


def test_awkward_documents(edge, nothing):
    check(edge)
    assert suffix.deduplicate(nothing).count() == suffix.rewrite(nothing).count() == 0
    rewritten = suffix.rewrite(edge)
    assert rewritten.columns == edge.columns and rewritten.count() == len(EDGE)
    assert all(r.n_chars == len(r.text) for r in rewritten.collect())


@pytest.mark.parametrize("hot", [2, 4096])
def test_shared_passages_in_both_ways(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2000)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["ab", "cde", "fé", "ghij", "k", "漢"]) + str(rng.randrange(99)) for _ in range(n))
    shared = [words(60) for _ in range(4)] + ["ab" * 400]
    rows = []
    for i in range(60):
        text = words(rng.randrange(40)) + rng.choice(shared)[rng.randrange(60) :] + words(rng.randrange(40))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at:]
        rows.append((i, text))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_index_equals_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        base = [bytes(rng.choice(b"abcd ") for _ in range(300)) for _ in range(3)]
        texts = []
        for _ in range(rng.randint(1, 40)):
            b, a = rng.choice(base), rng.randrange(150)
            texts.append(b[a : a + rng.randint(LENGTH, 176)])
        texts = [t for t in texts if len(t) >= LENGTH]
        if texts:
            assert all((a == b).all() for a, b in zip(suffix.repeated_windows(texts), brute(texts), strict=True))


def test_runs_are_few_in_repetitive_text():
    rng = random.Random(1)
    block = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    index = suffix.RunIndex(np.frombuffer(block * 20 + b"\xff" * 9, np.uint8))
    assert len(index.byte) < 3 * len(block)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    passage = bytes(rng.choice(b"abcdefghij ") for _ in range(400))
    parts = [bytes(rng.choice(b"klmn") for _ in range(n)) + passage for n in (0, 57, 301)]
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    found = suffix.segments(raw, ends)
    inside = [set(found["seg"][(found["doc"] == d)].tolist()) for d in range(3)]
    assert len(inside[0] & inside[1] & inside[2]) >= 4
    assert found["n"].sum() == sum(len(p) - LENGTH + 1 for p in parts)
