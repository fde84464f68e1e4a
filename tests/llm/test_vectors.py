import math

import numpy as np
import pytest

from lectern.llm import ann, itq
from lectern.llm.components import forest

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, key string, first int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "v", "k", 0) for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in range(3):
        centres = rng.normal(size=(12, 16))
        for centre in centres:
            for _ in range(rng.integers(1, 40)):
                rows.append((at, (centre + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist(), label))
                at += 1
    copies = rows[5]
    rows += [(at + i, copies[1], copies[2]) for i in range(60)]
    at += 60
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(at + i, v, 0) for i, v in enumerate(bad)] + [(at + 10, rows[0][1], None), (None, rows[0][1], 0)]
    return rows


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicates_against_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(itq, "CHUNK", 16)  # buckets of several chunks
    found = {r.vec_id: r for r in itq.near_duplicates(frame(spark, clustered)).collect()}
    assert len(found) == len(clustered)
    able = [(i, np.array(v, float) / np.linalg.norm(v), label) for i, v, label in clustered if usable(v) and label is not None and i is not None]
    links = [
        (a[0], b[0]) for k, a in enumerate(able) for b in able[k + 1 :] if a[2] == b[2] and a[1] @ b[1] >= 0.93
    ]
    count = {i: 0 for i, *_ in clustered}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = dict(forest(links))
    exact = sum(found[i].n_links for i in count) / sum(count.values())
    assert 0.97 <= exact <= 1
    assert all(found[i].n_links <= n for i, n in count.items())
    same = [found[i].component_id == label.get(i, i) for i in count]
    assert np.mean(same) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) or r.vec_id is None for r in found.values())


def test_near_duplicates_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (rows["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None])
    np.fill_diagonal(linked, False)
    found = itq.near_duplicates(table).toPandas().set_index("vec_id").loc[rows["vec_id"]]
    assert found["n_links"].sum() >= 0.9 * linked.sum() and (found["n_links"].to_numpy() <= linked.sum(1)).all()


def test_rotation_is_orthogonal_and_codes_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 12)) * np.linspace(0.2, 3, 12) + 5
    mean, projection = itq.learn_rotation(x, 1)
    assert np.allclose(projection.T @ projection, np.eye(12))
    share = ((x - mean) @ projection >= 0).mean(0)
    assert (abs(share - 0.5) < 0.1).all()


def exact_search(rows, every, k):
    able = {}
    for i, v, _ in rows:
        if i is not None and usable(v):
            able[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in able:
        if q % every == 0:
            scored = sorted((-(able[q] * v).sum(), i) for i, v in able.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_search_against_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 64)  # several shards, and a split bucket of copies
    found = ann.search(frame(spark, clustered), every=5, k=7).collect()
    wanted = exact_search(clustered, 5, 7)
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == wanted.keys() and all(len(v) == 7 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * sum(map(len, wanted.values()))
    for near in got.values():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_search_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    x, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    found = ann.search(table, every=20).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = found[found["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        hits, total = hits + len(set(best) & set(own["vec_id"])), total + 20
    assert hits >= 0.9 * total


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (3, None, 1)]
    found = sorted(tuple(r) for r in ann.search(frame(spark, rows), every=20).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert ann.search(frame(spark, rows).limit(0), every=20).count() == 0
    assert itq.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert ann.search(frame(spark, rows[3:]), every=3).count() == 0
    (only,) = itq.near_duplicates(frame(spark, rows[3:])).collect()
    assert tuple(only) == (3, 0, 3, True)


def test_probes_come_in_falling_order_and_cover():
    rng = np.random.default_rng(1)
    hashes = ann.fit(rng.normal(size=(300, 8)), 300, 5.0, 20)
    slots = np.unique(rng.integers(-6, 6, (200, hashes.shifts.shape[1])), axis=0)
    place = slots[17] + 0.5
    for reach, most in ((0.05, 1), (1.0, len(slots)), (1e9, len(slots))):
        probes, chances = hashes.probes(place, slots, reach)
        assert len(set(probes.tolist())) == len(probes) <= most
        assert probes[0] == 17 or reach > 1 and (np.diff(chances) <= 0).all()
    near, far = (len(hashes.probes(place, slots, r)[0]) for r in (0.05, 1.0))
    assert near < far
    assert len(hashes.probes(place + 1e9, slots, 0.1)[0]) == len(slots)  # nothing near: all


def recalls(spark, x, parts, k=20, every=20):
    """Share of true neighbours found, for the queries of each part."""
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = ann.search(frame(spark, rows), every=every, k=k).toPandas()
    got = found.groupby("query_id")["vec_id"].apply(set)
    out = {name: [] for name in set(parts)}
    for q in range(0, len(x), every):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        out[parts[q]].append(len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist())) / k)
    return {name: float(np.mean(v)) for name, v in out.items()}


def test_recall_in_dense_and_in_spread_parts(spark):
    """Most vectors in tight clusters, the rest spread: each part must be found."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(60, 48)))
    inside = unit(centres[rng.integers(0, 60, 10_200)] + 0.02 * rng.normal(size=(10_200, 48)))
    x = np.concatenate([inside, unit(rng.normal(size=(1800, 48)))])
    parts = np.array(["dense"] * len(inside) + ["spread"] * 1800)
    order = rng.permutation(len(x))
    found = recalls(spark, x[order], parts[order])
    assert found["dense"] >= 0.9 and found["spread"] >= 0.9


def test_one_very_common_vector(spark):
    """A third of the rows are one vector: its smallest ids stand for it."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[1000:2000] = x[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, x[5].tolist(), 1)] * 500
    found = ann.search(frame(spark, rows), every=20, k=20).toPandas()
    own = found[found["query_id"] == 1500].sort_values("rank")
    assert own["vec_id"].tolist()[0] in (5, *np.argsort(-(x @ x[5]))[:1].tolist()) and own["vec_id"].is_unique
    exact = lambda q: np.lexsort((np.arange(3000), -np.where(np.arange(3000) == q, -np.inf, (x * x[q]).sum(1))))[:20].tolist()
    assert own["vec_id"].tolist() == exact(1500)
    assert np.mean([len(set(found[found["query_id"] == q]["vec_id"]) & set(exact(q))) for q in range(0, 3000, 20)]) >= 18


@pytest.mark.parametrize("shared", [0.0, 0.6, 0.8])
def test_links_with_a_mean_in_common(spark, shared):
    """Pairs at cosine 0.93 to 0.96 among vectors whose squared mean norm is ``shared``."""
    rng = np.random.default_rng(31)
    width, unit = 64, lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    mean = unit(rng.normal(size=width)) * math.sqrt(shared)
    spread = unit(rng.normal(size=(4000, width)))
    spread = unit(spread - (spread @ unit(mean + 1e-12))[:, None] * unit(mean + 1e-12)) if shared else spread
    base = unit(mean + math.sqrt(1 - shared) * spread)
    cosine = rng.uniform(0.93, 0.96, (1000, 1))
    away = rng.normal(size=(1000, width))
    away = unit(away - (away * base[:1000]).sum(1, keepdims=True) * base[:1000])
    x = np.concatenate([base, cosine * base[:1000] + np.sqrt(1 - cosine**2) * away])
    label = np.concatenate([np.arange(4000) % 2, np.arange(1000) % 2])
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    found = {r.vec_id: r.n_links for r in itq.near_duplicates(frame(spark, rows)).collect()}
    links = np.array([found[i] for i in range(len(x))])
    assert (links <= near.sum(1)).all()
    assert links.sum() >= 0.95 * near.sum()
