"""Source mixing against targets worked out one by one, and budgets met to half a row."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing
from lectern.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


def slow_targets(held, weights=(5.0, 2.0, 1.0), repeats=3):
    """Target of each source: share by weight, stop at the bound, share the excess again."""
    names = sorted((s for s in held if s is not None), key=lambda s: s.encode()) + [None] * (None in held)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, rest = {}, set(), sum(held.values())
    while True:
        open_ones = [s for s in names if s not in full]
        share = sum(weight[s] for s in open_ones)
        target.update({s: rest * weight[s] / share for s in open_ones})
        over = [s for s in open_ones if target[s] > repeats * held[s]]
        if not over:
            return target
        for s in over:
            full.add(s)
            target[s] = repeats * held[s]
            rest -= target[s]


def check(docs, found):
    rows = docs.select("doc_id", "text", "source").collect()
    held = defaultdict(int)
    for r in rows:
        held[r.source] += words(r.text)
    aims = slow_targets(held)
    # Rows are told apart by id, size and the size and target of their source.
    sources = {s: (held[s], round(aims[s], 4)) for s in held}
    wanted = Counter((r.doc_id, words(r.text), *sources[r.source]) for r in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in found) == wanted
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        key = (r.source_size, round(r.target, 4))
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert 0 <= r.taken <= 3 * r.size
        taken[key] += r.taken
        largest[key] = max(largest[key], r.size)
    alike = Counter(sources.values())
    for key, total in taken.items():
        assert abs(total - alike[key] * key[1]) <= alike[key] * (largest[key] / 2 + 0.01), key


def test_all_documents(documents):
    check(documents, mixing.mix(documents).collect())


def test_awkward_documents(edge, nothing):
    check(edge, mixing.mix(edge).collect())
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(nothing).columns == ["doc_id", "size", "source_size", "target", "taken"]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("w" * rng.randint(1, 3) + str(rng.random()) for _ in range(n))
    rows = [(i, text(rng.randint(0, 30)), rng.choice(["b", "b", "b", "a", "ä", "B", "", None])) for i in range(1500)]
    rows += [(None, text(5), "b") for _ in range(40)] + [(2000 + i, text(4000), "a") for i in range(2)]
    rows += [(77, "the same row", "copies")] * 500 + [(3000, None, "none"), (3001, " \t", "none"), (3002, "few", "\U0001f600")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.withColumns({c: F.lit("x") for c in ("size", "k0", "unnamed", "digit", "at", "taken")})


def test_hot_sources_long_texts_and_repeated_rows(skewed):
    check(skewed, mixing.mix(skewed).collect())


def test_reruns_and_other_partitions_agree(skewed):
    first = Counter(map(tuple, mixing.mix(skewed).collect()))
    assert first == Counter(map(tuple, mixing.mix(skewed.repartition(7)).collect()))


def test_thresholds_are_nested(spark, documents):
    alike = mixing.sizes(documents).withColumns({"source": F.lit("all"), "unnamed": F.lit(False)})
    rows = written(alike, "nested")
    whole, last = rows.agg(F.sum("size")).first()[0], (0, 0)
    for part in (0.1, 0.3, 0.30001, 0.7, 1.0):
        budget = spark.createDataFrame([(False, "all", part * whole)], "unnamed boolean, source string, budget double")
        (end,) = mixing.thresholds(rows, budget).collect()
        assert (end.t0, end.t1) >= last
        last = (end.t0, end.t1)


def test_words_are_counted_as_the_pattern_finds_them():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\n\x0b\x1c\x1f\x85\xa0aä漢\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", " ", "a", " a", "a ", None]
    column = pa.array(texts)
    assert mixing.word_counts(column).tolist() == [words(t) for t in texts]
    assert mixing.word_counts(column.slice(5, 50)).tolist() == [words(t) for t in texts[5:55]]
    assert mixing.word_counts(column.slice(0, 0)).tolist() == []
