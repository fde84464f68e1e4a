"""The file tree as a whole: executors list and read it, the driver holds none of its files."""

from checks.queries import output_tree
from lectern.sources import listing, outputs


def test_the_driver_holds_no_list_of_the_tree(spark, tmp_path):
    texts = [(i, f"one {i}\ntwo\nthree", "en", "s", 9) for i in range(18)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    tree = output_tree(spark, str(tmp_path))
    # 4 of 18 books have no defect: three chapters of four files, a script and, but for one in three, a cover.
    rows = {r.file: r.content for r in tree.collect()}
    assert len(rows) == tree.count() and {f.partition("/")[0] for f in rows} == {f"book-{i}.epub" for i in (0, 8, 9, 17)}
    assert sum(f.endswith((".txt", ".title", ".html")) for f in rows) == 4 * 3 * 4
    assert [rows[f"book-{i}.epub/0002_c2.txt"] for i in (0, 17)] == ["two at 30 kilometers per hour for 12 dollars"] * 2
    assert not [f for f in tree.inputFiles() if "book-" in f]


def test_files_are_read_by_their_letters(spark, tmp_path):
    names = ["a b.txt", "x [1]*?.txt", "per%20cent ä", "deep/er/empty"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.endswith("empty") else name.encode())
    files, lost = listing.resolve(spark, str(tmp_path), suffix="")
    found = {r.path.removeprefix(f"{tmp_path}/"): bytes(r.content) for r in outputs.read_files(files).collect()}
    assert found == {name: b"" if name.endswith("empty") else name.encode() for name in names}
    assert outputs.read_files(files.limit(0)).collect() == [] and lost.collect() == []
