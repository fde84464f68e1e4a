import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(found, docs):
    """Every document is whole, every sequence gapless and within the capacity."""
    wanted = defaultdict(int)
    for row in docs.select("doc_id", "text").collect():
        ids = np.array(ids_of(row.text), "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[row.doc_id, number, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got, places = defaultdict(int), defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_all_documents(documents):
    found = packing.pack(documents, PATH).collect()
    sequences = check(found, documents)
    assert sequences == -(-sum(r.length for r in found) // 2048)  # not one more than the tokens need


def test_awkward_documents(edge):
    check(packing.pack(edge, PATH).collect(), edge)


def test_special_string_is_one_id_as_in_the_library(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b<|endoftext|>")], "doc_id long, text string")
    check(packing.pack(docs, PATH).collect(), docs)
    assert 50256 in ids_of("<|endoftext|>")


def test_empty_table(nothing):
    assert packing.pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_everything_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 2049, 400), rng.integers(600, 1100, 300), rng.integers(1, 60, 900), np.full(50, 700),
             rng.integers(1025, 2049, 40), np.array([], int)][seed]
    counts = np.bincount(sizes, minlength=2049)
    steps = packing.plan(counts, nodes=500)
    used = np.zeros(2049, int)
    for step in steps:
        assert sum(step.lengths) <= 2048
        np.add.at(used, list(step.lengths), step.times)
    assert (used == counts).all()
    sequences = sum(s.times for s in steps)
    assert packing.least_bins(counts, 2048) <= sequences <= sum(s.times for s in packing.best_fit(counts, 2048))


def test_plan_beats_best_fit_where_it_wastes():
    # Best fit takes 6 + 4 first and then cannot pair the rest without waste.
    counts = np.zeros(13, int)
    counts[[6, 4, 3, 5]] = [2, 2, 2, 2]
    assert sum(s.times for s in packing.plan(counts, 12)) == packing.least_bins(counts, 12) == 3


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert packing.cut(1, 2048) == [(0, 1)]
