"""Chapter titles: table-of-contents match, candidates, per-book report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import names
from lectern.functions import patterns as P
from lectern.operators.joins import join_per_key

SOURCES = ("toc", "title_tag", "section_tag")


def _class(length: Column) -> Column:
    """Length class: the digits of the length in binary, 0 for no characters."""
    return F.when(length > 0, F.length(F.bin(length))).otherwise(0)


def _head_size(number: Column) -> Column:
    """Characters that all paths of a class have: 0, 1, 2, 4, 8, ..."""
    return F.pow(F.lit(2.0), number - 1).cast("int")


def _needles(paths: DataFrame, toc: DataFrame) -> DataFrame:
    """Every part of each TOC content that may be a path of its book.

    A content contains a path exactly if the path is one of its parts, so the
    substring join becomes an equality join.  Paths are classed by the power of two
    in their length, and a class has heads: the first so many characters of its
    paths.  A part of a class can begin only where the content reads like one of its
    heads.  Places are matched to heads by an equality join, and only where a
    head begins are parts cut, one for each length that occurs in its class.  The
    work depends on the lengths of the contents, not on how many chapters the book
    has, which folders they are in or how short the shortest path is.
    """
    path = F.col("path")
    classed = paths.select("book_id", "path").withColumn("class", _class(F.length(path)))
    of_class = classed.groupBy("book_id", "class").agg(
        F.collect_set(F.length(path)).alias("lengths"),  # no more than the longest path has characters
        F.min(path).alias("low"),
        F.max(path).alias("high"),
    )
    one = F.struct("class", "lengths", "low", "high")
    bounds = of_class.groupBy("book_id").agg(F.collect_list(one).alias("classes"))  # a few for each book
    heads = classed.select("book_id", "class", F.substring(path, F.lit(1), _head_size(F.col("class"))).alias("head"))
    bounded = join_per_key(toc, bounds, "book_id", F.col("pos"), "inner")
    bounded = bounded.select("book_id", "pos", "label", "content", F.explode("classes").alias("of")).select(
        "book_id", "pos", "label", "content", "of.*"
    )
    content, short = F.col("content"), _head_size(F.col("class"))
    size = F.length(content)
    starts = F.filter(
        F.sequence(F.lit(1), F.when(short > 0, size - short + 1).otherwise(1)),
        lambda at: (F.substring(content, at, size) >= F.col("low"))
        & (F.substring(content, at, short) <= F.col("high")),
    )
    places = bounded.filter(size >= short).select(
        "book_id", "pos", "label", "content", "class", "lengths", F.explode(starts).alias("at")
    )
    places = places.withColumn("head", F.substring(content, F.col("at"), short))
    begun = places.join(heads.distinct(), ["book_id", "class", "head"], "left_semi")
    fitting = F.filter("lengths", lambda length: F.col("at") + length - 1 <= size)
    return begun.select(
        "book_id", "pos", "label", "content", "at", F.explode(fitting).alias("length")
    ).select("book_id", "pos", "label", F.substring(content, F.col("at"), F.col("length")).alias("path"))


def match_toc(spine: DataFrame, toc: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Add ``toc_title``: the label of the first TOC entry that contains the path.

    ``spine`` has ``book_id, path`` and any other columns, ``toc`` has
    ``book_id, pos, label, content``; ``paths`` may give the ``book_id, path`` of
    the spine from a cheaper table.  No match gives ''.  The join key is
    (book, path) and its right side holds one row per key, so neither a book
    with most of the chapters nor one with most of the entries meets in a task.
    """
    first = _needles(spine if paths is None else paths, toc).groupBy("book_id", "path").agg(
        F.min_by("label", "pos").alias("toc_title")
    )
    return spine.join(first, ["book_id", "path"], "left").withColumn(
        "toc_title", F.coalesce("toc_title", F.lit(""))
    )


def with_resolved_names(chapters: DataFrame) -> DataFrame:
    """Add ``resolved_title`` and ``filename`` from ``toc_title`` and ``idref``."""
    resolved = names.resolved_title(F.col("toc_title"), F.col("idref"))
    return chapters.withColumn("resolved_title", resolved).withColumn(
        "filename", names.chapter_filename(F.col("chapter_number"), F.col("resolved_title"))
    )


def title_candidates(chapters: DataFrame) -> DataFrame:
    """One row per chapter and title source, from the three title columns."""
    return chapters.select(
        "book_id",
        "chapter_number",
        F.stack(
            F.lit(len(SOURCES)),
            F.lit("toc"), F.col("toc_title"),
            F.lit("title_tag"), F.col("title_tag"),
            F.lit("section_tag"), F.col("section_title"),
        ).alias("source", "title"),
    )


def considered_titles(candidates: DataFrame) -> DataFrame:
    """Candidates that count: a title tag that just says ``Cover`` does not."""
    ignored = (F.col("source") == "title_tag") & (F.col("title") == P.IGNORED_TITLE_TAG)
    return candidates.filter(~ignored)


def uniform_titles(books: DataFrame, candidates: DataFrame, source: str) -> DataFrame:
    """Whether all titles of ``source`` in a book are the same; true if none."""
    extremes = candidates.filter(F.col("source") == source).groupBy("book_id").agg(
        F.min("title").alias("__low"), F.max("title").alias("__high")
    )
    same = F.coalesce(F.col("__low") == F.col("__high"), F.lit(True))
    return books.join(extremes, "book_id", "left").select(*books.columns, same.alias("uniform"))


def title_report(books: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per book: are title tags uniform, are section tags, which source is used.

    The table of contents is always used; the two findings only inform.
    """
    of = lambda source, agg, name: agg(
        F.when(F.col("source") == source, F.col("title"))
    ).alias(name)
    extremes = candidates.groupBy("book_id").agg(
        of("title_tag", F.min, "t_low"),
        of("title_tag", F.max, "t_high"),
        of("section_tag", F.min, "s_low"),
        of("section_tag", F.max, "s_high"),
    )
    same = lambda low, high: F.coalesce(F.col(low) == F.col(high), F.lit(True))
    return books.join(extremes, "book_id", "left").select(
        "book_id",
        same("t_low", "t_high").alias("title_tag_uniform"),
        same("s_low", "s_high").alias("section_tag_uniform"),
        F.lit("TOC").alias("title_source"),
    )


def book_counts(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """Number of sections and of TOC entries per book."""
    sections = spine.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_sections"))
    entries = toc.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_toc"))
    return sections.join(entries, "book_id", "left").withColumn(
        "n_toc", F.coalesce("n_toc", F.lit(0))
    )


def spine_resources(spine: DataFrame, resources: DataFrame) -> DataFrame:
    """Spine items with their resource; ``reason`` is set where there is none."""
    missing = F.when(F.col("path").isNull(), "spine id has no resource")
    return spine.join(resources, ["book_id", "idref"], "left").withColumn("reason", missing)
