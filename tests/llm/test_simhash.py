import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.components import components, forest


def slow_fingerprint(text, words=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs, nodes):
    label = dict(forest(pairs))
    return {n: label.get(n, n) for n in nodes}


def near(values, distance):
    values = sorted(set(values))
    array = np.array(values, np.uint64)
    return [
        (values[i], values[j])
        for i in range(len(values))
        for j in (np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= distance) + i + 1).tolist()
    ]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text or "") for r in rows]
    label = groups_of(near(prints, 3), set(prints))
    smallest = {}
    for row, fp in zip(rows, prints):
        if row.doc_id is not None:
            smallest[label[fp]] = min(row.doc_id, smallest.get(label[fp], row.doc_id))
    wanted = sorted(str((r.doc_id, f"{fp:016x}", smallest.get(label[fp]))) for r, fp in zip(rows, prints))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == wanted


def test_all_documents_against_all_pairs(documents):
    check(documents)


def test_awkward_documents(edge, nothing):
    check(edge)
    assert simhash.near_duplicates(nothing).count() == 0


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_dense_group_and_strays(spark, monkeypatch):
    rng = random.Random(3)
    centre, values = rng.getrandbits(64), set()
    while len(values) < 700:
        value = centre
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            value ^= 1 << bit
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(300)}
    monkeypatch.setattr(simhash, "CHUNK", 64)  # many chunks, so both rounds work
    frame = spark.createDataFrame([(signed(v),) for v in values], "node long")
    key = F.explode(simhash._keys(F.col("node"), simhash.block_masks(3, 5))).alias("key")
    rows = frame.select("node", F.col("node").alias("w0"), key).select("node", "w0", "key.m", "key.k")
    found = {r.node: r.component for r in simhash.linked_classes(rows, 3).collect()}
    wanted = groups_of([(signed(a), signed(b)) for a, b in near(values, 3)], [signed(v) for v in values])
    assert {n: found.get(n, n) for n in wanted} == wanted


def test_every_near_pair_shares_a_mask():
    rng, masks = random.Random(1), simhash.block_masks(3, 5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_pivots_discard_no_near_pair():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 1 << 63, (200, 1), np.uint64)
    right = left ^ (np.uint64(1) << rng.integers(0, 63, (200, 1)).astype(np.uint64))
    found = simhash.links_among(left, right, simhash.pivots(), 3)
    assert (found == (np.bitwise_count(left[:, None] ^ right[None, :]).sum(-1) <= 3)).all()


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300)]
    links += [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(7, 7)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    found = {r.node: r.component for r in components(frame).collect()}
    assert found == dict(forest(links))
    assert components(frame.limit(0)).count() == 0
