from lectern.operators import narration


def test_selection_and_tags(spark):
    titles = ["Cover", "One\n", "Two", "Index", "Three"]
    chapters = spark.createDataFrame(
        [("a", n, t, f"{n:04d}_{t.strip()}") for n, t in enumerate(titles, 1)],
        "book_id string, chapter_number int, resolved_title string, filename string")
    excluded = spark.createDataFrame([("a", 3), ("b", 1)], "book_id string, chapter_number int")
    kept = narration.select_for_narration(chapters, "(?i)^(index|cover)$", excluded)
    assert sorted(r.chapter_number for r in kept.collect()) == [2, 5]
    assert narration.select_for_narration(chapters).count() == 5

    files = ["0002_One.txt.wav", "0005_Three.txt.wav", "0001_lost.txt.wav", "x.mp3", ".h.wav", "z.wav"]
    audio = spark.createDataFrame([(b, f) for b in "ab" for f in files], "book_id string, file string")
    books = spark.createDataFrame(
        [("a", "T", "A", "jpg"), ("b", "U", "B", "png")],
        "book_id string, title string, author string, cover_ext string")
    found = narration.audio_tags(audio, chapters, books).orderBy("book_id", "track").collect()
    assert [(r.book_id, r.track, r.file, r.title) for r in found[:4]] == [
        ("a", 1, "0001_lost.txt.wav", ""), ("a", 2, "0002_One.txt.wav", "One"),
        ("a", 3, "0005_Three.txt.wav", "Three"), ("a", 4, "z.wav", "")]
    assert {(r.book_id, r.album, r.artist, r.album_artist, r.cover_comment) for r in found} == {
        ("a", "T", "A", "A", "Cover (front)"), ("b", "U", "B", "B", None)}


def test_tracks_follow_binary_name_order(spark):
    names = [f"{n:04d}_x.txt.wav" for n in (9, 999, 1000, 9999, 10000, 10001, 100000)]
    rows = spark.createDataFrame([("a", n) for n in names], "book_id string, file string")
    found = narration.number_tracks(rows).orderBy("track").collect()
    assert [r.file for r in found] == sorted(names)
    assert [r.track for r in found] == list(range(1, len(names) + 1))


def test_audio_stem(apply):
    cases = {"0001_a.txt.wav": "0001_a", "a.txt.wav.txt.wav": "a.txt.wav", "a.wav": "a.wav",
             "x.txt.wavy": "xy"}
    assert apply(narration.audio_stem, list(cases)) == list(cases.values())
