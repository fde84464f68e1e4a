"""Which chapters to narrate, and the tags of the audio files made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.operators.joins import join_per_key, number_within


def select_for_narration(
    chapters: DataFrame, skip_titles: str | None = None, excluded: DataFrame | None = None,
) -> DataFrame:
    """Leave out chapters by title pattern and by list.

    ``excluded`` names chapters by any columns the two tables share, such as
    ``book_id, chapter_number``.
    """
    if skip_titles is not None:
        chapters = chapters.filter(~F.rlike("resolved_title", F.lit(skip_titles)))
    if excluded is not None:
        chapters = chapters.join(excluded, excluded.columns, "left_anti")
    return chapters


def audio_stem(file: Column) -> Column:
    """The file name without its first ``.txt.wav``."""
    return F.regexp_replace(file, P.AUDIO_STEM, "$1")


def number_tracks(audio_files: DataFrame) -> DataFrame:
    """Number the ``*.wav`` files of each book in file-name order, without gaps."""
    return number_within(
        audio_files.filter(F.rlike("file", F.lit(P.AUDIO_FILE))), "book_id", "file", "track"
    )


def audio_tags(audio_files: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Track, title, artist, album and cover comment of every audio file.

    ``audio_files`` has ``book_id, file``, ``chapters`` has ``book_id, filename,
    resolved_title``, ``books`` has ``book_id, title, author, cover_ext``.  A
    file without a chapter keeps its track and has an empty title.
    """
    tracks = number_tracks(audio_files).withColumn("filename", audio_stem(F.col("file")))
    titles = chapters.select("book_id", "filename", "resolved_title")
    titled = tracks.join(titles, ["book_id", "filename"], "left")
    albums = books.select(
        "book_id", F.col("author").alias("artist"), F.col("title").alias("album"), "cover_ext"
    )
    joined = join_per_key(titled, albums, "book_id", F.col("file"))
    chapter_title = F.rtrim(F.coalesce("resolved_title", F.lit("")), F.lit("\n"))
    return joined.select(
        "book_id",
        "file",
        "track",
        chapter_title.alias("title"),
        F.col("artist").alias("album_artist"),
        "artist",
        "album",
        F.when(F.col("cover_ext") == P.JPEG_EXTENSION, P.COVER_COMMENT).alias("cover_comment"),
    )
