"""One query per operator; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from checks import epub_pack, inputs
from lectern.functions import html as H
from lectern.functions import names
from lectern.functions.normalize import clean_text, money_to_words, speed_to_words
from lectern.operators import narration, rules, titles
from lectern.operators.joins import number_within
from lectern.plans.chapters import chapters_of_archives, chapters_of_tables, observed
from lectern.session import read_spread, scratch_folder
from lectern.sources import epub, listing, outputs
from lectern.streaming import books as streams

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("documents", "labels", "orders", "pages", "part")


def read(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """Run input SQL over the tables it names; ``spread`` for heavy row-by-row work."""
    reader = read_spread if spread else lambda spark, path: spark.read.parquet(path)
    for table in TABLES:
        for word in (f"from {table}", f"join {table}"):
            sql = sql.replace(word, word.replace(table, f"{{{table}}}"))
    used = {t: reader(spark, f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


# --- text --------------------------------------------------------------------
def clean(spark, sf_dir):
    return read(spark, sf_dir, inputs.CLEAN, spread=True).select("doc_id", clean_text(F.col("t")).alias("text"))


def money(spark, sf_dir):
    rows = read(spark, sf_dir, inputs.MONEY, spread=True)
    return rows.select("o_orderkey", money_to_words(F.col("t")).alias("text"))


def speed(spark, sf_dir):
    rows = read(spark, sf_dir, inputs.SPEED, spread=True)
    return rows.select("p_partkey", speed_to_words(F.col("t")).alias("text"))


def sanitize(spark, sf_dir):
    rows = read_spread(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", names.sanitize_filename(F.col("text")).alias("name"))


# --- HTML --------------------------------------------------------------------
def pages(spark, sf_dir, spread: bool = True):
    return read(spark, sf_dir, inputs.PAGES, spread)


def sup_filter(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.filter_footnotes(F.col("html")).alias("html"))


def html_text(spark, sf_dir):
    return H.extract_page(pages(spark, sf_dir), "html", text="text").select("page_id", "text")


def title_tag(spark, sf_dir):
    rows = H.extract_page(pages(spark, sf_dir), "html", title_tag="title")
    return rows.select("page_id", "title")


def section_title(spark, sf_dir):
    rows = H.extract_page(pages(spark, sf_dir), "html", section_title="title")
    return rows.select("page_id", "title")


# --- rules -------------------------------------------------------------------
def rules_parse(spark, sf_dir):
    return rules.parse_rules(rules.rule_lines(read(spark, sf_dir, inputs.RULE_FILES, spread=True)))


def rule_errors(spark, sf_dir):
    return rules.rule_errors(rules.rule_lines(read(spark, sf_dir, inputs.RULE_FILES, spread=True)))


def rules_apply(spark, sf_dir):
    compiled = rules.compile_rules(inputs.RULES, spark)
    rows = read_spread(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", rules.apply_rules(F.col("text"), compiled).alias("text"))


def rules_apply_per_book(spark, sf_dir):
    rows = read_spread(spark, f"{sf_dir}/documents.parquet")
    chapters = rows.select(F.col("source").alias("book_id"), "doc_id", "text")
    return rules.apply_rules_per_book(
        chapters, read(spark, sf_dir, inputs.BOOK_RULES), "text", spread_by="doc_id"
    )


# --- titles and names, table form --------------------------------------------
def toc_match(spark, sf_dir):
    spine = read(spark, sf_dir, inputs.SPINE)
    matched = titles.match_toc(spine, read(spark, sf_dir, inputs.TOC))
    return matched.select("book_id", "doc_id", "toc_title")


def chapter_number(spark, sf_dir):
    spine = read(spark, sf_dir, inputs.SPINE).select("book_id", "doc_id", "idref", "path")
    return number_within(spine, "book_id", "doc_id", "chapter_number")


def named_chapters(spark, sf_dir):
    spine, toc = read(spark, sf_dir, inputs.SPINE), read(spark, sf_dir, inputs.TOC)
    matched = titles.match_toc(chapter_number(spark, sf_dir), toc, paths=spine)
    return titles.with_resolved_names(matched)


def resolved_title(spark, sf_dir):
    matched = titles.match_toc(
        read(spark, sf_dir, inputs.SPINE), read(spark, sf_dir, inputs.TOC)
    )
    resolved = names.resolved_title(F.col("toc_title"), F.col("idref"))
    return matched.select("doc_id", resolved.alias("resolved_title"))


def chapter_filename(spark, sf_dir):
    return named_chapters(spark, sf_dir).select("doc_id", "filename")


def output_paths(spark, sf_dir):
    paths = names.output_paths(F.col("book_id"), F.col("filename"))
    return named_chapters(spark, sf_dir).select(
        "doc_id", *(column.alias(name) for name, column in paths.items())
    )


def spine_resource(spark, sf_dir):
    spine = read(spark, sf_dir, inputs.SPINE).drop("path")
    return titles.spine_resources(spine, read(spark, sf_dir, inputs.RESOURCES))


def book_counts(spark, sf_dir):
    return titles.book_counts(read(spark, sf_dir, inputs.SPINE), read(spark, sf_dir, inputs.TOC))


# --- title sources -----------------------------------------------------------
def page_books(spark, sf_dir):
    return pages(spark, sf_dir, spread=False).select("book_id").distinct()


def page_spine(spark, sf_dir):
    return pages(spark, sf_dir, spread=False).select("book_id", "page_id", "idref", "path")


def title_candidates(spark, sf_dir):
    found = H.extract_page(
        pages(spark, sf_dir).select("page_id", "html"), "html",
        title_tag="title_tag", section_title="section_title",
    ).drop("html")
    spine = page_spine(spark, sf_dir)
    numbered = number_within(spine, "book_id", "page_id", "chapter_number")
    matched = titles.match_toc(numbered, read(spark, sf_dir, inputs.PAGE_TOC), paths=spine)
    return titles.title_candidates(matched.join(found, "page_id"))


def title_sources(spark, sf_dir):
    return titles.considered_titles(title_candidates(spark, sf_dir))


def page_titles(spark, sf_dir):
    """The titles of the pages themselves; the contents list has no part in the report."""
    rows = pages(spark, sf_dir).select("book_id", "page_id", "html")
    found = H.extract_page(rows, "html", title_tag="title_tag", section_title="section_tag")
    sources = ("title_tag", "section_tag")
    long = found.unpivot(["book_id", "page_id"], list(sources), "source", "title")
    return titles.considered_titles(long)


def title_uniform(spark, sf_dir):
    return titles.uniform_titles(
        page_books(spark, sf_dir), page_titles(spark, sf_dir), "title_tag"
    )


def title_report(spark, sf_dir):
    return titles.title_report(page_books(spark, sf_dir), page_titles(spark, sf_dir))


# --- chapter table -----------------------------------------------------------
def chapters_table(spark, sf_dir):
    compiled = rules.compile_rules(inputs.RULES, spark)
    chapters = chapters_of_tables(
        page_spine(spark, sf_dir),
        read(spark, sf_dir, inputs.PAGE_TOC),
        pages(spark, sf_dir).select("page_id", "html"),
        compiled,
    )
    return chapters.select(
        "book_id", "chapter_number", "idref", "path", "toc_title", "resolved_title",
        "filename", "html", "original_text", "text",
    )


# --- archives ----------------------------------------------------------------
def archives(spark, sf_dir, defects: bool = False):
    rows = read(spark, sf_dir, inputs.ARCHIVES, spread=True)
    rows = rows.withColumn("chapters", F.split("text", "\n")).drop("text")
    labels = F.transform(
        "chapters", lambda _, i: F.when(i % 2 == 0, F.format_string("Part %d: one", i + 1))
    )
    rows = rows.withColumn("labels", labels)
    if not defects:
        rows = rows.withColumn("defect", F.lit(None).cast("string"))
    return epub_pack.pack(rows)


def epub_roundtrip(spark, sf_dir):
    chapters = chapters_of_archives(epub.unpack(archives(spark, sf_dir)))
    return chapters.select(
        "book_id", "chapter_number", "idref", "path", "toc_title", "filename",
        "original_text", "text",
    )


def epub_rejects(spark, sf_dir):
    return epub.rejects(epub.unpack(archives(spark, sf_dir, defects=True)))


def archive_files(spark, sf_dir, defects: bool = False, spelled: bool = False):
    """The archives written as files to the shared folder; gives the folder.

    ``spelled``: in folders of several depths, under names of all spellings.
    """
    folder = scratch_folder(spark, "archives")
    path = F.col("path")
    if spelled:
        number = F.regexp_extract("path", "[0-9]+", 0).cast("long")
        place = F.when(number % 3 == 0, "").when(number % 3 == 1, "sub/").otherwise("sub/More/")
        name = F.get(F.array(*map(F.lit, inputs.SPELLINGS)), (number % len(inputs.SPELLINGS)).cast("int"))
        path = F.concat(place, F.replace(name, F.lit("#"), number.cast("string")))
    files = archives(spark, sf_dir, defects).select(
        F.concat(F.lit(f"{rooted(folder)}/"), path).alias("path"), "content", F.lit(None).cast("string").alias("error")
    )
    done = outputs.write_files(files, rooted(folder))
    return (folder, done.select("path")) if spelled else folder


def rooted(folder: str) -> str:
    """The folder with the name of its store."""
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


def below(folder: str, path: str):
    """The part of a path below the folder."""
    return F.substring_index(F.col(path), folder.rpartition("/")[2] + "/", -1)


def epub_files(spark, sf_dir):
    """Every archive file, however it is spelled, is in the chapters or in the rejects.

    Hidden files are found where they are named; the others are below the folder.
    """
    folder, paths = archive_files(spark, sf_dir, defects=True, spelled=True)
    hidden = paths.filter(F.rlike("path", F.lit(r"/[._][^/]*$")))
    roots = [(rooted(folder),), (f"{rooted(folder)}/gone [1].epub",)]
    files, lost = listing.resolve(spark, hidden.unionByName(spark.createDataFrame(roots, "path string")))
    unpacked = epub.ingest_listed(files, scratch_folder(spark, "unpacked"))
    chapters = epub.chapters(unpacked).groupBy(F.col("book_id").alias("path")).agg(
        F.count(F.lit(1)).alias("chapters")
    )
    rejected = epub.rejects(unpacked).unionByName(lost)
    return chapters.join(rejected, "path", "full").select(
        below(folder, "path").alias("file"), F.coalesce("chapters", F.lit(0)).alias("chapters"), "reason"
    )


def output_tree(spark, sf_dir):
    """The whole file tree of all books, written, listed book by book and read back by executors."""
    folder = scratch_folder(spark, "tree")
    root = rooted(folder)
    unpacked = epub.ingest(archives(spark, sf_dir, defects=True), scratch_folder(spark, "unpacked"))
    of_book = F.concat(F.lit(f"{root}/"), "book_id")
    books = epub.books(unpacked)
    files = outputs.chapter_files(chapters_of_archives(unpacked), of_book)
    outputs.write_files(files.unionByName(outputs.book_files(books, of_book)), root)
    written, _ = listing.resolve(spark, books.select(of_book.alias("path")), suffix="")
    tree = outputs.read_files(written)
    return tree.select(below(folder, "path").alias("file"), F.decode("content", "UTF-8").alias("content"))


def progress(spark, sf_dir):
    """The progress figures of a run, observed while the chapter table is written."""
    watch = Observation("progress")
    chapters = observed(chapters_of_archives(epub.unpack(archives(spark, sf_dir))), watch)
    chapters.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([watch.get], "chapters long, titles_from_toc long, text_bytes long")


def epub_books(spark, sf_dir):
    return epub.books(epub.unpack(archives(spark, sf_dir), sections=False))


def book_env(spark, sf_dir):
    return epub_books(spark, sf_dir).select(
        "book_id", "title", "author", "n_sections", "n_toc", "env_script"
    )


def cover_name(spark, sf_dir):
    paths = names.book_paths(F.col("book_id"), F.col("cover_ext"))
    return epub_books(spark, sf_dir).select(
        "book_id", "cover_ext", paths["cover_path"].alias("cover_path"),
        F.decode("cover.data", "UTF-8").alias("cover_data"),
    )


# --- narration ---------------------------------------------------------------
def chapter_names(spark, sf_dir):
    """The narrow table of chapters and names, written once for all that uses it."""
    names = named_chapters(spark, sf_dir).select(
        "book_id", "doc_id", "chapter_number", "resolved_title", "filename"
    )
    folder = scratch_folder(spark, "names")
    names.write.parquet(folder)
    return spark.read.schema(names.schema).parquet(folder)


def selected_chapters(spark, sf_dir, chapters):
    return narration.select_for_narration(
        chapters, inputs.SKIPPED_TITLES, read(spark, sf_dir, inputs.EXCLUDED)
    )


def narration_select(spark, sf_dir):
    return selected_chapters(spark, sf_dir, chapter_names(spark, sf_dir)).select(
        "book_id", "chapter_number", "resolved_title", "filename"
    )


def audio_tags(spark, sf_dir):
    books = read(spark, sf_dir, inputs.BOOKS)
    chapters = chapter_names(spark, sf_dir)
    files = selected_chapters(spark, sf_dir, chapters).select(
        "book_id", F.concat("filename", F.lit(".txt.wav")).alias("file")
    )
    strays = F.explode(F.array(*map(F.lit, ("notes.txt", ".hidden.wav", "0000_intro.txt.wav", "zz.wav"))))
    files = files.unionByName(books.select("book_id", strays.alias("file")))
    return narration.audio_tags(files, chapters, books)


# --- streams -----------------------------------------------------------------
def stream_pages(spark, sf_dir):
    out = scratch_folder(spark, "stream-pages")
    # A stream takes one file only by a pattern; a table may be a file or a folder of files.
    source = streams.page_stream(spark, f"{sf_dir}/page[s].parquet")
    source = source.withColumn("html", F.replace("html", F.lit(". "), F.lit(" for $12.\n\n")))
    streams.convert_pages(source, f"{out}/chapters", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/chapters").select("page_id", "original_text", "text")


def stream_epub(spark, sf_dir):
    inbox, out = archive_files(spark, sf_dir), scratch_folder(spark, "stream-epub")
    source = streams.file_stream(spark, inbox, arrivals=f"{out}/arrivals")
    with streams.small_files(spark, streams.LOT_OPEN_BYTES):
        streams.ingest_archives(source, f"{out}/unpacked", f"{out}/checkpoint").awaitTermination()
    chapters = chapters_of_archives(streams.unpacked_table(spark, f"{out}/unpacked"))
    return chapters.withColumn("book_id", below(inbox, "book_id")).select(
        "book_id", "chapter_number", "filename", "original_text", "text"
    )


QUERIES: dict[str, Query] = {
    "chapters_table": chapters_table,
    "clean_text": clean,
    "money": money,
    "speed": speed,
    "sanitize": sanitize,
    "sup_filter": sup_filter,
    "html_text": html_text,
    "title_tag": title_tag,
    "section_title": section_title,
    "rules_parse": rules_parse,
    "rule_errors": rule_errors,
    "rules_apply": rules_apply,
    "rules_apply_per_book": rules_apply_per_book,
    "toc_match": toc_match,
    "chapter_number": chapter_number,
    "resolved_title": resolved_title,
    "chapter_filename": chapter_filename,
    "output_paths": output_paths,
    "spine_resource": spine_resource,
    "book_counts": book_counts,
    "title_candidates": title_candidates,
    "title_sources": title_sources,
    "title_uniform": title_uniform,
    "title_report": title_report,
    "epub_roundtrip": epub_roundtrip,
    "epub_rejects": epub_rejects,
    "epub_files": epub_files,
    "output_tree": output_tree,
    "progress": progress,
    "book_env": book_env,
    "cover_name": cover_name,
    "narration_select": narration_select,
    "audio_tags": audio_tags,
    "stream_pages": stream_pages,
    "stream_epub": stream_epub,
}
