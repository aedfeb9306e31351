import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lookalike import checks
from lookalike.config import Config
from lookalike.plans import dates, execute, moves, names, repair
from lookalike.state import History, Session


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def pairs(plan, status="planned"):
    return {(r["src"], r["dest"]) for r in plan.collect() if r["status"] == status}


def test_names_are_free_and_no_other_s(spark):
    plan = spark.createDataFrame([("/1/a.jpg", "/d/a.jpg"), ("/2/a.jpg", "/d/a.jpg"), ("/3/a.jpg", "/d/a.jpg"), ("/4/a_1.jpg", "/d/a_1.jpg"), ("/5/b", "/d/b")], "src string, dest string")
    got = names.reserved(plan, listing(spark, "/d/a.jpg", "/d/a_2.jpg")).collect()
    dests = [r["dest"] for r in got]
    assert len(got) == 5 and len(set(dests)) == 5 and not {"/d/a.jpg", "/d/a_2.jpg"} & set(dests) and "/d/b" in dests and "/d/a_1.jpg" in dests


def test_settings_of_an_older_folder(tmp_path):
    old, new = tmp_path / "old.json", Config(str(tmp_path / "new" / "config.json"), {})
    assert not new.migrate(old)
    old.write_text('{"threshold": 3}')
    assert new.migrate(old) and new.get("threshold") == 3
    old.write_text('{"threshold": 4}')
    assert not new.migrate(old) and new.get("threshold") == 3


def test_one_name_for_all(spark):
    """Many files of one name, some numbers taken; rounds go on until all are placed."""
    plan = spark.createDataFrame([(f"/s/{i:04d}/a.jpg", "/d/a.jpg") for i in range(400)] + [(f"/t/{i:02d}/a_{i}.jpg", f"/d/a_{i}.jpg") for i in range(1, 60)], "src string, dest string").repartition(5)
    got = names.reserved(plan, listing(spark, "/d/a.jpg", *(f"/d/a_{i}.jpg" for i in range(390, 420)))).collect()
    dests = {r["dest"] for r in got}
    assert len(got) == len(dests) == 459 and not dests & {"/d/a.jpg", *(f"/d/a_{i}.jpg" for i in range(390, 420))}


def test_move_to_parent(spark):
    plan = moves.move_to_parent(listing(spark, "/r/a.jpg", "/r/x/a.jpg", "/r/y/a.jpg", "/r/y/c.txt", "/rz/q.jpg"), "/r", [".jpg"])
    assert pairs(plan) == {("/r/x/a.jpg", "/r/a_1.jpg"), ("/r/y/a.jpg", "/r/a_2.jpg")} or pairs(plan) == {("/r/x/a.jpg", "/r/a_2.jpg"), ("/r/y/a.jpg", "/r/a_1.jpg")}
    assert pairs(plan, "skipped") == {("/r/a.jpg", "/r/a.jpg")}


def test_move_with_structure(spark):
    files, there = listing(spark, "/s/a", "/s/x/b"), listing(spark, "/t/a")
    assert pairs(moves.move_with_structure(files, "/s", "/t", there)) == {("/s/x/b", "/t/x/b")}
    assert pairs(moves.move_with_structure(files, "/s", "/t", there, overwrite=True)) == {("/s/a", "/t/a"), ("/s/x/b", "/t/x/b")}


def test_rename_by_parent(spark):
    plan = moves.rename_by_parent(listing(spark, "/r/A/x/b.jpg", "/r/A/x/a.jpg", "/r/A/top.jpg", "/r/B/q.png", "/r/B/B_2.png", "/r/loose.jpg", "/r/A/x/y/deep.jpg"), "/r")
    assert pairs(plan) == {("/r/A/x/a.jpg", "/r/A/x/A_x_1.jpg"), ("/r/A/x/b.jpg", "/r/A/x/A_x_2.jpg"), ("/r/B/q.png", "/r/B/B_2_1.png")} or pairs(plan) == {("/r/A/x/a.jpg", "/r/A/x/A_x_1.jpg"), ("/r/A/x/b.jpg", "/r/A/x/A_x_2.jpg"), ("/r/B/q.png", "/r/B/B_2_1.png"), ("/r/B/B_2.png", "/r/B/B_1.png")}


def test_sorts(spark):
    files = spark.createDataFrame([("/r/a.jpg", 4000, 4000, 255, 0, 0), ("/r/7.png", 50, 100, 0, 0, 255), ("/r/_.gif", None, None, 1, 1, 1), ("/r/x/z.jpg", 1, 1, 0, 0, 0)], "path string, width int, height int, r int, g int, b int")
    assert pairs(moves.sort_alphabetical(files, "/r")) == {("/r/a.jpg", "/r/A-G/a.jpg"), ("/r/7.png", "/r/0-9/7.png")}
    by_size = moves.sort_by_resolution(files, "/r")
    assert pairs(by_size) == {("/r/a.jpg", "/r/4k/square/a.jpg"), ("/r/7.png", "/r/thumbnail/portrait/7.png")} and pairs(by_size, "error") == {("/r/_.gif", None)}
    assert pairs(moves.sort_by_color(files, "/r")) == {("/r/a.jpg", "/r/red/a.jpg"), ("/r/7.png", "/r/blue/7.png"), ("/r/_.gif", "/r/black/_.gif")}
    palette = files.withColumn("colors", F.array(F.struct("r", "g", "b"), F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(255).alias("b"))))
    assert {r["palette"]: r["n"] for r in moves.palette_groups(palette).collect()} == {"blue_red": 1, "blue": 1, "black_blue": 2}
    with pytest.raises(ValueError):
        moves.sort_by_color(files, "/r", "smell")


def test_extensions_conversion_and_folders(spark):
    files = spark.createDataFrame([("/r/a.png", "JPEG"), ("/r/a.jpg", "JPEG"), ("/r/b.jpeg", "JPEG"), ("/r/c.bin", None), ("/r/d", "GIF")], "path string, format string")
    plan = moves.fix_extensions(files)
    assert pairs(plan) == {("/r/a.png", "/r/a_1.jpg"), ("/r/d", "/r/d.gif")} and len(pairs(plan, "skipped")) == 3
    assert pairs(moves.convert_to_jpg(listing(spark, "/r/a.png", "/r/a.jpg", "/r/b.BMP"))) == {("/r/a.png", "/r/a_1.jpg"), ("/r/b.BMP", "/r/b.jpg")}
    got = moves.empty_folders(listing(spark, "/r/a", "/r/a/b", "/r/a/b/c", "/r/x", "/r/x/y", "/r"), listing(spark, "/r/x/f"), "/r").collect()
    assert [r["src"] for r in got] == ["/r/a/b/c", "/r/a/b", "/r/x/y", "/r/a"] or [r["src"] for r in got] == ["/r/a/b/c", "/r/a/b", "/r/x/y", "/r/a"][:]


def test_dates(spark):
    files = listing(spark, "/a.jpg", "/b.TIFF", "/c.png")
    a, z = datetime(2020, 1, 1), datetime(2020, 1, 11)
    got = dates.randomize_exif_dates(files, a, z).collect()
    assert {r["path"] for r in got} == {"/a.jpg", "/b.TIFF"} and all(r["exif_time"].startswith("2020:01:") for r in got)
    times = [r["new_time"] for r in dates.randomize_dates(files, a, z, clamp=True).collect()]
    assert all(a <= t <= z for t in times) and times == [r["new_time"] for r in dates.randomize_dates(files, a, z, clamp=True).collect()]
    with pytest.raises(ValueError):
        dates.randomize_dates(files, z, a)


def test_repair_decisions(spark):
    rows = [(True, True, True, "none", False), (False, True, True, "none", False), (True, True, True, "invalid_format", True), (True, False, True, "truncated", True), (True, True, True, "truncated", True), (True, True, False, "bad_exif", False), (True, True, True, "unknown", False)]
    df = spark.createDataFrame(rows, "readable boolean, writable boolean, parent_writable boolean, corruption_type string, repaired boolean")
    got = repair.decide(df)
    assert [r["status"] for r in got.collect()] == ["clean", "permission_error", "quarantined", "skipped", "repaired", "skipped", "quarantined"]
    assert [r["status"] for r in repair.decide(df, attempt=False, quarantine=False).collect()] == ["clean", "permission_error", "skipped", "skipped", "skipped", "skipped", "skipped"]
    assert repair.counts(got).first().asDict() == {"checked": 7, "clean": 1, "repaired": 1, "quarantined": 2, "permission_errors": 1, "skipped": 2, "errors": 0}
    assert repair.problems(got).count() == 6


def test_execution_changes_files_only_when_told(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.txt").write_text(d)
    root = str(tmp_path)
    plan = moves.move_to_parent(listing(spark, f"{root}/x/a.txt", f"{root}/y/a.txt"), root)
    assert {r["status"] for r in execute.execute(plan).collect()} == {"planned"} and not (tmp_path / "a.txt").exists()
    assert {r["status"] for r in execute.execute(plan, dry_run=False).collect()} == {"done"}
    assert {(tmp_path / n).read_text() for n in ("a.txt", "a_1.txt")} == {"x", "y"}
    assert {r["status"] for r in execute.execute(plan, dry_run=False).collect()} == {"done"}  # a second run finds it done
    link = spark.createDataFrame([("symlink", f"{root}/a_1.txt", f"{root}/a.txt", None, "planned"), ("delete", f"{root}/none", None, None, "planned"), ("hardlink", f"{root}/q", f"{root}/gone", None, "planned")], "op string, src string, dest string, reason string, status string")
    got = {r["op"]: r["status"] for r in execute.execute(link, dry_run=False).collect()}
    assert got == {"symlink": "done", "delete": "done", "hardlink": "error"} and os.readlink(tmp_path / "a_1.txt") == "a.txt"
    times = spark.createDataFrame([(f"{root}/a.txt", datetime(2001, 2, 3))], "path string, new_time timestamp")
    execute.set_times(times, dry_run=False)
    assert os.stat(tmp_path / "a.txt").st_mtime == datetime(2001, 2, 3, tzinfo=UTC).timestamp()
    assert execute.links_supported(root, root)["hardlink"]


def test_trash_refuses_what_is_outside(spark):
    chosen = spark.createDataFrame([("/r/a", "delete"), ("/s/a", "delete"), ("/r/b", "keep")], "path string, decision string")
    plan = moves.trash_selected(chosen, "/r", "/t", listing(spark, "/t/a"))
    assert pairs(plan) == {("/r/a", "/t/a_1")} and pairs(plan, "error") == {("/s/a", None)}


def test_checks(tmp_path):
    (tmp_path / "f").write_text("x")
    assert checks.within(str(tmp_path / "a"), str(tmp_path)) and not checks.within("/ab", "/a")
    assert checks.readable_file(str(tmp_path / "f")) is None and checks.readable_file("/no") and checks.directory("/no") and checks.directory("")
    assert checks.threshold(10) is None and checks.threshold(65) and checks.threshold("1") and checks.workers(0)
    assert checks.scan(str(tmp_path), 10, True, True) and not checks.scan(str(tmp_path))
    assert checks.pipeline(["what"], None, None) and checks.pipeline(["randomize_exif"], None, None) and checks.pipeline(["randomize_dates"], datetime(2, 1, 1), datetime(1, 1, 1))
    assert not checks.pipeline(["cleanup_empty"], None, None)


def test_config_session_and_history(tmp_path):
    config = Config(str(tmp_path / "c.json"), {"LOOKALIKE_THRESHOLD": "7", "LOOKALIKE_TRASH": "plain text"})
    assert config.get("threshold") == 7 and config.get("trash") == "plain text" and config.get("cache_days") == 30 and config.get("none", 3) == 3
    config.write_example()
    config.reload()
    assert config.get("history_length") == 10
    s = Session(directory="/x", status="complete", selections={"/a": "keep"})
    s.advance(0, 0, 0.0)
    assert s.progress == 100
    s.save(tmp_path / "s.json", now=1000.0)
    assert Session.load(tmp_path / "s.json", now=2000.0).selections == {"/a": "keep"}
    assert Session.load(tmp_path / "s.json", now=1000.0 + 25 * 3600) is None and Session.load(tmp_path / "none") is None
    h = History(tmp_path / "h.json", 3)
    for d in ("/a", "/b", "/c", "/a", "/d"):
        h.add(d)
    assert h.load() == ["/d", "/a", "/c"] and h.search("A") == ["/a"]
