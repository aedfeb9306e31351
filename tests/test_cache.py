from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lookalike.operators import cache as c
from lookalike.operators import reports, selection
from lookalike.streaming.windows import windowed_counts


@pytest.fixture
def store(spark, tmp_path):
    return c.Cache(spark, f"file://{tmp_path}/cache")


def rows(spark, *items):
    made = spark.createDataFrame([(p, m, s) for p, m, s in items], "path string, mtime double, file_size long")
    return made.withColumns({n: F.lit(None).cast("string") for n in ("format", "file_hash", "perceptual_hash", "dominant_color", "error")} | {n: F.lit(1) for n in ("width", "height", "pixel_count", "bit_depth")} | {"quality_score": F.lit(1.0)})


def test_a_changed_file_is_a_miss(spark, store):
    assert store.read().count() == 0
    store.put(rows(spark, ("/a", 1.0, 10), ("/b", 1.0, 20)), now=100.0)
    files = spark.createDataFrame([("/a", 1.0, 10), ("/b", 2.0, 20), ("/c", 1.0, 5)], "path string, mtime double, file_size long")
    looked = c.lookup(files, store.read())
    assert {r["path"]: r["hit"] for r in looked.collect()} == {"/a": True, "/b": False, "/c": False}
    assert {r["path"] for r in c.misses(files, store.read()).collect()} == {"/b", "/c"}
    s = c.hit_statistics(looked).first()
    assert (s["total"], s["hits"]) == (3, 1) and s["hit_rate"] == pytest.approx(100 / 3)
    assert c.hit_statistics(looked.limit(0)).first()["hit_rate"] == 0.0


def test_one_version_of_a_path_stays(spark, store):
    store.put(rows(spark, ("/a", 1.0, 10)), now=100.0)
    store.put(rows(spark, ("/a", 2.0, 11), ("/b", 1.0, 1)), now=200.0)
    got = {(r["path"], r["file_size"]) for r in store.read().collect()}
    assert got == {("/a", 11), ("/b", 1)}
    assert store.statistics().first()["total_bytes"] == 12


def test_maintenance(spark, store):
    store.put(rows(spark, ("/d/a", 1.0, 10), ("/d_x/b", 1.0, 20), ("/e", 1.0, 1)), now=0.0)
    key = store.read().filter("path = '/e'").select("cache_key")
    store.touch(key, now=40 * c.DAY)
    store.set_colors(spark.createDataFrame([("/e", "1,2,3")], "path string, dominant_color string"))
    assert store.read().filter("path = '/e'").first()["dominant_color"] == "1,2,3"
    store.invalidate_directory("/d")
    assert {r["path"] for r in store.read().collect()} == {"/d_x/b", "/e"}
    assert store.cleanup_stale(30, now=41 * c.DAY) == 1
    assert store.cleanup_missing(spark.createDataFrame([("/zzz",)], "path string")) == 1
    store.compact()
    assert store.read().count() == 0
    store.put(rows(spark, ("/a", 1.0, 10)))
    store.invalidate("/a")
    assert store.read().count() == 0
    store.clear()
    assert store.read().count() == 0


def test_a_reader_keeps_its_version(spark, store):
    """Rows that a lazy reader began with stay readable while others write, and a write reads as a whole."""
    store.put(rows(spark, ("/a", 1.0, 10), ("/b", 1.0, 20)), now=1.0)
    before = store.read()
    store.put(rows(spark, ("/a", 2.0, 11)), now=2.0)
    store.invalidate("/b")
    assert {(r["path"], r["file_size"]) for r in before.collect()} == {("/a", 10), ("/b", 20)}
    assert {(r["path"], r["file_size"]) for r in store.read().collect()} == {("/a", 11)}


def test_writes_add_folders_and_are_gathered(spark, store):
    for k in range(c.MOST_DELTAS + 4):
        store.put(rows(spark, (f"/p{k}", 1.0, k), ("/same", float(k), k)), now=float(k))
        number, folders = store._current()
        assert number == k + 1 and 1 <= len(folders) <= c.MOST_DELTAS + 1
    found = {r["path"]: (r["file_size"], r["mtime"]) for r in store.read().collect()}
    assert len(found) == c.MOST_DELTAS + 5 and found["/same"] == (c.MOST_DELTAS + 3, float(c.MOST_DELTAS + 3))
    store.touch(store.read().filter("path = '/p0'").select("cache_key"), now=99.0)
    assert {r["path"]: r["last_accessed"] for r in store.read().collect()}["/p0"] == 99.0
    assert len(store._numbers()) <= c.KEPT + 1


def test_two_writers(spark, store, monkeypatch):
    """A writer whose number has been taken begins again, on what the other one wrote."""
    store.put(rows(spark, ("/a", 1.0, 1)), now=1.0)
    other, point, tries = c.Cache(spark, store.root), store._point, []

    def late(number, names):
        if not tries:
            tries.append(number)
            other.put(rows(spark, ("/b", 1.0, 2)), now=2.0)
        return point(number, names)

    monkeypatch.setattr(store, "_point", late)
    store.put(rows(spark, ("/c", 1.0, 3)), now=3.0)
    assert {r["path"] for r in store.read().collect()} == {"/a", "/b", "/c"}


def members(spark):
    data = [(1, "exact", "/p/b.jpg", 5, 30.0, 1.0, 1), (1, "exact", "/p/a.jpg", 9, 20.0, None, 2), (2, "perceptual", '/q/"x", y.png', 7, 10.0, 3.0, 1), (2, "perceptual", "/q/c.png", 7, 5.0, 2.0, 2), (2, "perceptual", "/q/d.png", 1, 5.0, 9.0, 3)]
    return spark.createDataFrame(data, "group_id long, match_type string, path string, file_size long, quality_score double, mtime double, rn int").withColumns({"width": F.lit(4), "height": F.lit(3), "pixel_count": F.lit(12), "format": F.lit("PNG"), "error": F.lit(None).cast("string")})


@pytest.mark.parametrize("strategy, kept", [("quality", {"/p/b.jpg", '/q/"x", y.png'}), ("largest", {"/p/a.jpg", '/q/"x", y.png'}), ("smallest", {"/p/b.jpg", "/q/d.png"}), ("newest", {"/p/b.jpg", "/q/d.png"}), ("oldest", {"/p/b.jpg", "/q/c.png"}), ("what?", {"/p/b.jpg", '/q/"x", y.png'})])
def test_strategies(spark, strategy, kept):
    got = selection.select(members(spark), strategy).collect()
    assert {r["path"] for r in got if r["decision"] == "keep"} == kept and len(got) == 5


def test_the_last_group_decides(spark):
    twice = members(spark).unionByName(members(spark).filter("path = '/p/b.jpg'").withColumns({"group_id": F.lit(9).cast("long"), "quality_score": F.lit(1.0)})).unionByName(members(spark).filter("path = '/q/c.png'").withColumn("group_id", F.lit(9).cast("long")))
    assert {r["path"]: r["decision"] for r in selection.select(twice).collect()}["/p/b.jpg"] == "delete"


def test_reports(spark, tmp_path):
    m = members(spark)
    assert tuple(reports.statistics(m).first()) == (3, 2, 17)
    assert tuple(reports.statistics(m.limit(0)).first()) == (0, 0, 0)
    assert {r["group_id"] for r in reports.filtered(m, "all", "C.PN").collect()} == {2}
    reports.export(m, f"file://{tmp_path}/csv", "csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, quote='"', escape='"').collect()
    assert [r["path"] for r in back] == ["/p/b.jpg", "/p/a.jpg", '/q/"x", y.png', "/q/c.png", "/q/d.png"] and back[0]["status"] == "keep" and back[0]["quality_score"] == "30.0"
    reports.export(m, f"file://{tmp_path}/txt")
    text = "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/txt").collect())
    assert text.index("EXACT") < text.index("[KEEP] /p/b.jpg") < text.index("[DUPE] /p/a.jpg") < text.index("PERCEPTUAL") < text.index("Group 1", text.index("PERCEPTUAL")) < text.index("[DUPE] /q/d.png")
    with pytest.raises(ValueError):
        reports.export(m, "x", "xml")
    assert "3 duplicates, 17 bytes" in reports.console(m)
    back = reports.from_json(reports.to_json(m), m.schema)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in m.collect()}
    assert reports.image_view(m).first()["file_size_formatted"] == "5.0 B"


def test_pages_and_history(spark):
    g = spark.createDataFrame([(i, i % 3, 2) for i in range(25)], "group_id long, potential_savings long, image_count long")
    first, third = reports.page(g, 1).collect(), reports.page(g, 3).collect()
    assert [r["group_id"] for r in first][:3] == [2, 5, 8] and len(third) == 5
    visits = spark.createDataFrame([(f"/d{i % 12}", float(i)) for i in range(30)], "directory string, at double")
    assert [r["directory"] for r in reports.recent(visits).collect()] == ["/d5", "/d4", "/d3", "/d2", "/d1", "/d0", "/d11", "/d10", "/d9", "/d8"]


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = [(datetime(2024, 1, 1, h, m), "x" if m % 2 else "y") for h in range(5) for m in range(0, 60, 7)]
    df = spark.createDataFrame(events, "ts timestamp, event_type string")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in windowed_counts(df).collect()}
