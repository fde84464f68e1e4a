import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import joins, titles
from lectern.sources.epub import first_labels


def test_toc_match_equals_first_containing_entry(spark):
    rng = random.Random(3)
    spine, toc = [], []
    for book in range(6):
        for _ in range(rng.choice([0, 3, 40])):
            spine.append((f"b{book}", len(spine), rng.choice(["", "OEBPS/", "t/"]) + f"{rng.randint(1, 30)}.x"))
        for pos in range(rng.choice([0, 5, 60])):
            toc.append((f"b{book}", pos, f"label {pos}", f"OEBPS/{rng.randint(1, 130)}.x#{rng.randint(1, 3)}.x"))
    spine += [("b0", -1, ""), ("b9", -2, "a")]
    expected = {
        n: next((label for b, _, label, content in toc if b == book and path in content), "")
        for book, n, path in spine
    }
    spine_df = spark.createDataFrame(spine, "book_id string, n int, path string")
    toc_df = spark.createDataFrame(
        rng.sample(toc, len(toc)), "book_id string, pos int, label string, content string")
    found = titles.match_toc(spine_df, toc_df).collect()
    assert len(found) == len(spine)
    assert {r.n: r.toc_title for r in found} == expected
    for book in {b for b, *_ in spine}:
        paths = {n: path for b, n, path in spine if b == book}
        entries = [{"label": label, "content": content} for b, _, label, content in toc if b == book]
        labels = first_labels(paths.values(), entries)
        assert {n: labels.get(path, "") for n, path in paths.items()} == {n: expected[n] for n in paths}


def test_toc_match_plan_has_no_pairing_of_a_books_rows(spark):
    spine = spark.range(10).select(F.lit("b").alias("book_id"), F.col("id").cast("string").alias("path"))
    toc = spark.range(10).select(
        F.lit("b").alias("book_id"), F.col("id").alias("pos"),
        F.lit("l").alias("label"), F.lit("c").alias("content"))
    plan = titles.match_toc(spine, toc)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "Cross" not in plan


@pytest.mark.parametrize("order", ["id", "id * 7919 % 3001", "xxhash64(id)", "concat('track', lpad(id, 9, '0'))"])
def test_numbering_equals_one_window(spark, order):
    """Dense, shuffled and hashed ids, and names that share a long beginning."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("book_id"),
        F.expr(order).alias("pos"))
    found = joins.number_within(rows, "book_id", "pos", "n").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.book_id, []).append((r.pos, r.n))
    assert sum(map(len, groups.values())) == 3000
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(1, len(members) + 1))


def test_join_per_key_keeps_every_row(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), "id").unionByName(
        spark.createDataFrame([("lone", 1), ("none", 2)], "k string, id long"))
    per_key = spark.createDataFrame([("hot", "H"), ("lone", "L"), ("unused", "U")], "k string, v string")
    found = joins.join_per_key(rows, per_key, "k", F.col("id"))
    counts = {r.v: r["count"] for r in found.groupBy("v").count().collect()}
    assert counts == {"H": 1000, "L": 1, None: 1}
    assert found.columns == ["k", "id", "v"]


def candidates(spark):
    chapters = spark.createDataFrame([
        ("same", 1, "A", "one", "s"), ("same", 2, "B", "one", "s"), ("same", 3, "C", "Cover", "s"),
        ("differ", 1, "A", "one", "s"), ("differ", 2, "A", "two", ""), ("differ", 3, "A", "two", "s"),
        ("cover", 1, "Cover", "Cover", "Cover"),
    ], "book_id string, chapter_number int, toc_title string, title_tag string, section_title string")
    return titles.considered_titles(titles.title_candidates(chapters))


def test_uniform_titles(spark):
    books = spark.createDataFrame([("same",), ("differ",), ("cover",), ("empty",)], "book_id string")
    rows = candidates(spark)
    assert rows.count() == 7 * 3 - 2
    found = titles.uniform_titles(books, rows, "title_tag").collect()
    assert {r.book_id: r.uniform for r in found} == {"same": True, "differ": False, "cover": True, "empty": True}
    report = titles.title_report(books, rows).collect()
    assert {r.book_id: (r.title_tag_uniform, r.section_tag_uniform, r.title_source) for r in report} == {
        "same": (True, True, "TOC"), "differ": (False, False, "TOC"),
        "cover": (True, True, "TOC"), "empty": (True, True, "TOC")}


def test_paths_of_all_lengths_in_one_book(spark):
    """Empty, short and long paths, many of which begin alike, against every pair."""
    rng = random.Random(17)
    word = lambda low, high: "".join(rng.choice("ab/") for _ in range(rng.randint(low, high)))
    spine = [(f"b{k}", word(*rng.choice([(0, 1), (1, 4), (7, 9), (15, 40)]))) for k in range(4) for _ in range(25)]
    toc = [(f"b{k}", pos, word(0, 60), f"l{k}.{pos}") for k in range(4) for pos in range(30)]
    toc += [(b, 100 + i, f"../{p}#x", f"own {i}") for i, (b, p) in enumerate(spine) if i % 2]
    first = lambda book, path: next((e[3] for e in sorted(toc, key=lambda e: e[1]) if e[0] == book and path in e[2]), "")
    found = titles.match_toc(
        spark.createDataFrame(spine, "book_id string, path string"),
        spark.createDataFrame(toc, "book_id string, pos int, content string, label string"),
    ).collect()
    assert sorted(map(tuple, found)) == sorted((b, p, first(b, p)) for b, p in spine)
    for book in ("b0", "b1", "b2", "b3"):
        paths = {p for b, p in spine if b == book}
        entries = [{"content": c, "label": l} for b, _, c, l in sorted(toc, key=lambda e: e[1]) if b == book]
        assert {p: first_labels(paths, entries).get(p, "") for p in paths} == {p: first(book, p) for p in paths}


def test_one_short_path_makes_no_more_places(spark):
    """A path of one character adds the places of that character only, not every place of the others."""
    spine = [("b", f"OEBPS/text/chapter-{i:05d}.xhtml") for i in range(400)]
    toc = [("b", i, f"../OEBPS/text/chapter-{i:05d}.xhtml#start", "x") for i in range(400)]

    def needles(paths):
        return titles._needles(
            spark.createDataFrame(paths, "book_id string, path string"),
            spark.createDataFrame(toc, "book_id string, pos int, content string, label string"),
        ).count()

    plain = needles(spine)
    assert plain == 400
    assert needles([*spine, ("b", "z")]) == plain
    assert needles([*spine, ("b", "p")]) == plain + 400  # one small p in each content
