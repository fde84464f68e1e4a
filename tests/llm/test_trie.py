"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import trie


def conversations(rows):
    """Turns (role, text) of each conversation, in order."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, digest(role or "", text or "")[:32], role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(whole):
    cut = {c: zlib.crc32(str(c).encode()) % 6 for c in whole}
    return {c: whole.get(c - c % 100, [])[: cut[c]] + turns[cut[c] :] for c, turns in whole.items()}


def brute(whole):
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(members[path]) - 1) * len(path[-1][1] if path else "")
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in members.items()}
    return sorted(
        str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
             hashlib.sha256(ends[p].encode()).hexdigest()))
        for p, m in members.items()
    )


def found(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


@pytest.mark.parametrize("rows, turns", [(1 << 15, 1 << 19), (7, 1 << 19), (1, 1), (50, 40)])
def test_all_conversations_in_blocks_of_any_size(spark, monkeypatch, rows, turns):
    monkeypatch.setattr(trie, "BLOCK_ROWS", rows)
    monkeypatch.setattr(trie, "BLOCK_TURNS", turns)
    messages = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    whole = conversations(messages.select("conv_id", "turn", "role", "text").collect())
    assert found(trie.build(messages, trie.with_heads)) == brute(rebuilt(whole))


def awkward(rng):
    rows = []
    for conv in [*range(0, 330), 1000, 1100, 1101]:
        for turn in range(rng.choice([1, 1, 2, 3, 9])):
            rows.append((conv, turn, rng.choice(["user", "bot", None, ""]), rng.choice(["a", "b", None, "ä\U0001f600", "x" * 30])))
    rows += [(2000 + c, t, "user", "the same") for c in range(200) for t in range(3)]  # one path for many
    rows += [(3000, t, "user", f"long {t}") for t in range(2000)] + [(3001, t, "user", f"long {t}") for t in range(1990)]
    rows += [(5, None, "user", "no number"), (6, 1, "user", "b"), (6, 1, "user", "b"), (6, 1, "bot", "tie"), (None, 1, "user", "no id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 15, 16])
def test_ties_nulls_repeats_and_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    rows = awkward(random.Random(8))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    messages = messages.withColumns({c: F.lit("extra") for c in ("path", "sizes", "digest", "depth", "h", "head", "block")})
    whole = conversations(rows)
    assert found(trie.build(messages)) == brute(whole)
    assert found(trie.build(messages, trie.with_heads)) == brute(rebuilt(whole))


def test_no_rows_and_no_turns(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.build(spark.createDataFrame([], kind), trie.with_heads).count() == 0
    assert trie.build(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    lone = [(101, 0, "user", "gone")]  # its head is absent
    whole = conversations(lone)
    assert found(trie.build(spark.createDataFrame(lone, kind), trie.with_heads)) == brute(rebuilt(whole))


def test_range_minima_and_extents():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 8, 33):
        values = rng.integers(0, 5, size)
        table = trie.RangeMinimum(values)
        low, high = np.triu_indices(size)
        assert (table.least(low, high) == [values[a : b + 1].min() for a, b in zip(low, high)]).all()
        at, bound = (x.ravel() for x in np.indices((size, 6)))
        left = [min(l for l in range(a + 1) if (values[l + 1 : a + 1] >= b).all()) for a, b in zip(at, bound)]
        right = [max(r for r in range(a, size) if (values[a + 1 : r + 1] >= b).all()) for a, b in zip(at, bound)]
        assert (table.left(at, bound) == left).all() and (table.right(at, bound) == right).all()
