import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import language
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_documents_of_other_size(spark, documents, model):
    found = language.identify(documents, "doc_id", model, F.col("text"), host=F.col("source"))
    rows = found.join(documents.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(rows) == documents.count()
    assert sum(r.lang == r.truth for r in rows) >= 0.99 * len(rows)
    assert not any(r.rejected for r in rows)


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language.identify_pages(pages, model).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) >= 0.98 * len(rows)


def test_learning_counts_all_texts(spark):
    docs = spark.createDataFrame([(1, "abc", "xx"), (2, "ABC", "xx"), (3, None, "yy"), (4, "zz", None)], "doc_id long, text string, lang string")
    model = language.learn(docs.repartition(3))
    assert model.languages == ("xx",)  # a language without a trigram is none
    counts = defaultdict(int)
    for text in (" abc ", " abc "):
        raw = text.encode()
        for i in range(len(raw) - 2):
            code = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)
            counts[(code >> 19) % language.BUCKETS] += 1
    total = 6 + 0.5 * language.BUCKETS
    for bucket, n in counts.items():
        assert math.isclose(model.logs[bucket, 0], math.log((n + 0.5) / total))


def clues(spark, rows):
    return spark.createDataFrame(rows, "k long, evidence array<double>, host string, declared string, suffix string")


def fused(spark, rows):
    return {r.k: (r.lang, r.probability) for r in language.fuse(clues(spark, rows), ("aa", "bb")).collect()}


def brute(rows):
    """The same sums spelt out."""
    def posterior(logs):
        p = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(p) for x in p]

    text = [posterior(e) if e else None for _, e, *_ in rows]
    domain = lambda h: None if h is None else (".".join(h.split(".")[-2:]) if "." in h else h)
    total = lambda keep: [sum(t[k] for t, r in zip(text, rows) if t and keep(r)) for k in (0, 1)]
    overall = total(lambda r: True)
    share = [(x + 1) / (sum(overall) + 2) for x in overall]
    out = {}
    for (k, evidence, host, declared, suffix), own in zip(rows, text):
        own = own or [0, 0]
        of_host = total(lambda r: r[2] == host) if host else [0, 0]
        of_domain = total(lambda r: domain(r[2]) == domain(host)) if host else [0, 0]
        rest = [max(0, d - h) for d, h in zip(of_domain, of_host)]
        above = [(c + 10 * s) / (sum(rest) + 10) for c, s in zip(rest, share)]
        mine = [max(0, h - o) for h, o in zip(of_host, own)] if host else [0, 0]
        prior = [(c + 10 * a) / (sum(mine) + 10) for c, a in zip(mine, above)]
        logs = [e + math.log(p) for e, p in zip(evidence or [0, 0], prior)]
        for at, clue in ((3, declared), (4, suffix)):
            if clue is not None:
                seen = total(lambda r: r[at] == clue)
                logs = [x + math.log((max(0, c - o) + s) / (sum(seen) + 1) / s) for x, c, o, s in zip(logs, seen, own, share)]
        p = posterior(logs)
        out[k] = ("aa" if p[0] >= p[1] else "bb", max(p))
    return out


def test_fusion_equals_brute_force(spark):
    rows = [(i, [0.0, -4.0], f"h{i % 3}.site.net", "aa", "net") for i in range(12)]
    rows += [(20 + i, [-4.0, 0.0], f"h{i}.other.org", "bb", "org") for i in range(6)]
    rows += [(40, [0.0, 0.0], "h1.site.net", None, None), (41, [0.0, 0.0], None, "bb", None), (42, None, "new.other.org", None, "org"),
             (43, [-0.5, 0.0], "h0.site.net", "aa", "net"), (44, None, None, None, None), (45, [0.0, -1.0], "plain", "zz", "")]
    found, wanted = fused(spark, rows), brute(rows)
    assert found.keys() == wanted.keys()
    for k, (lang, p) in wanted.items():
        assert found[k][0] == lang and math.isclose(found[k][1], p, rel_tol=1e-9), k
    # Clues decide where the text does not.
    assert found[40][0] == "aa" and found[41][0] == "bb" and found[42][0] == "bb" and found[43][0] == "aa"


def test_awkward_documents(spark, edge, nothing, model):
    rows = language.identify(edge, "doc_id", model, F.col("text"), host=F.col("source")).collect()
    assert len(rows) == len(EDGE)
    empty = [i for i, t in EDGE if not (t or "").strip() and i is not None]
    assert {r.doc_id for r in rows if r.rejected} >= set(empty)
    assert language.identify(nothing, "doc_id", model, F.col("text")).count() == 0
    untaught = language.learn(nothing)
    assert language.identify(edge, "doc_id", untaught, F.col("text")).filter("rejected").count() == len(EDGE)
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "x", "<p>the"), (2, "http://", "<html lang=>")], "page_id long, url string, html string")
    assert language.identify_pages(pages, model).count() == 4
