import threading

import numpy as np
import pytest

from lookalike import cli
from lookalike.engine import Engine
from lookalike.functions import pixels as P
from lookalike.operators.cache import Cache
from lookalike.sources import files
from lookalike.streaming.ingest import ingest


@pytest.fixture
def tree(tmp_path, pictures):
    a, b = pictures(1, 96), pictures(2, 96)
    root = tmp_path / "lib"
    (root / "sub" / "empty" / "deeper").mkdir(parents=True)
    for name, data in (("one.png", P.encode_png(a)), ("sub/two.PNG", P.encode_png(a)), ("small.png", P.encode_png(P.resized(a, 80, 80).astype(np.uint8))), ("smaller.png", P.encode_png(P.resized(a, 72, 72).astype(np.uint8))), ("other.png", P.encode_png(b)), ("broken.png", P.encode_png(b)[:-60]), ("text.jpg", b"no image"), ("notes.txt", b"notes")):
        (root / name).write_bytes(data)
    return root


def names(rows):
    return {r["path"].rsplit("/", 1)[1] for r in rows}


def test_listing(spark, tree):
    assert names(files.images(spark, str(tree)).collect()) == {"one.png", "two.PNG", "small.png", "smaller.png", "other.png", "broken.png", "text.jpg"}
    assert names(files.images(spark, str(tree), recursive=False).collect()) == {"one.png", "small.png", "smaller.png", "other.png", "broken.png", "text.jpg"}
    assert [r["path"].rsplit("/", 1)[1] for r in files.find_files(spark, str(tree), [".txt"]).collect()] == ["notes.txt"]
    assert {r["chunk"] for r in files.chunks(files.images(spark, str(tree)), 3).collect()} == {0, 1, 2}
    assert names(files.folders(spark, str(tree)).collect()) == {"sub", "empty", "deeper"}
    assert "content" not in files.images(spark, str(tree)).columns


def test_a_cluster_needs_the_shared_folder():
    from types import SimpleNamespace

    from lookalike.storage import shared_folder

    at = lambda master, folder: shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, applicationId="app-1")))
    assert at("spark://host:7077", "hdfs:///shared/") == "hdfs:///shared/lookalike-app-1"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            at(master, None)


def test_a_cached_rescan_opens_no_file(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, cache=f"file://{tmp_path}/cache")
    engine.scan(str(tree))
    opened = []
    real = files.images
    monkeypatch.setattr(files, "images", lambda *a, content=False, **k: (opened.append(content), real(*a, content=content, **k))[1])
    listing = files.images(spark, str(tree))
    assert engine.analyzed(str(tree), listing).count() == 7 and not any(opened)
    (tree / "ne[w] {1}.png").write_bytes((tree / "small.png").read_bytes())
    got = engine.analyzed(str(tree), files.images(spark, str(tree))).collect()
    assert len(got) == 8 and names(r for r in got if r["file_size"]) >= {"ne[w] {1}.png"} and not any(opened)
    alone = files.resolved(files.images(spark, str(tree))).count()
    (tree / "link.png").symlink_to(tree / "one.png")
    assert files.images(spark, str(tree)).count() == 9 and files.resolved(files.images(spark, str(tree))).count() == alone == 8
    assert engine.scan(str(tree), use_cache=False, resolve=True).assets.count() == 8
    new = files.contents_of(spark, f"file://{tree}", spark.createDataFrame([(f"{tree}/ne[w] {{1}}.png",)], "path string"), 8)
    assert new.count() == 1 and len(new.inputFiles()) == 1


def test_actions_follow_the_strategy(spark, tree, tmp_path):
    import os

    os.utime(tree / "one.png", (1e9, 1e9))
    os.utime(tree / "sub/two.PNG", (2e9, 2e9))
    engine = Engine(spark, cache=f"file://{tmp_path}/cache")
    gone = lambda s: {r["src"].rsplit("/", 1)[1] for r in engine.act(engine.scan(str(tree), exact_only=True, strategy=s), "delete").collect()}
    assert gone("newest") == {"one.png"} and gone("oldest") == {"two.PNG"}
    found = engine.scan(str(tree), exact_only=True, strategy="newest")
    engine.session.selections = {f"{tree}/sub/two.PNG": "delete", f"{tree}/one.png": "keep"}
    assert {r["src"] for r in engine.act(found, "delete").collect()} == {f"{tree}/sub/two.PNG"}
    engine.session.selections = {f"{tree}/sub/two.PNG": "delete", f"{tree}/one.png": "delete"}  # a group is never emptied
    assert engine.act(found, "hardlink").count() == 1


def test_scan_select_and_act(spark, tree, tmp_path):
    engine = Engine(spark, cache=f"file://{tmp_path}/cache")
    found = engine.scan(str(tree))
    groups = {}
    for r in found.members.collect():
        groups.setdefault((r["group_id"], r["match_type"]), set()).add(r["path"].rsplit("/", 1)[1])
    assert groups == {(1, "exact"): {"one.png", "two.PNG"}, (2, "perceptual"): {"small.png", "smaller.png"}}
    assert names(found.failed.collect()) == {"broken.png", "text.jpg"}
    s = found.summary().first()
    assert (s["images"], s["errors"], s["exact_duplicates"], s["perceptual_duplicates"]) == (7, 2, 1, 1)
    assert engine.session.status == "complete" and engine.groups(found).count() == 2
    again = engine.analyzed(str(tree), files.images(spark, str(tree)))
    assert again.count() == 7
    assert {r["decision"] for r in engine.select(found, "smallest").collect()} == {"keep", "delete"}
    assert {r["status"] for r in engine.act(found, "delete").collect()} == {"planned"} and (tree / "one.png").exists()
    done = engine.act(found, "delete", dry_run=False).collect()
    assert len(done) == 2 and sum(p.exists() for p in (tree / "one.png", tree / "sub/two.PNG", tree / "small.png", tree / "smaller.png")) == 2
    assert engine.cache.scan_history().first()["file_count"] == 7 and [s["status"] for s in engine.progress()] == ["complete"]
    engine.export(found, f"file://{tmp_path}/report")
    assert "FAILED FILES" in "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/report").collect())
    exact = engine.scan(str(tree), exact_only=True, use_cache=False)
    assert exact.members.count() == 0


def test_one_scan_at_a_time_and_cancel(spark, tree, tmp_path):
    engine = Engine(spark, cache=f"file://{tmp_path}/cache")
    engine._one.acquire()
    with pytest.raises(RuntimeError):
        engine.scan(str(tree))
    engine._one.release()
    with pytest.raises(ValueError):
        engine.scan(str(tree / "none"))
    engine.session.pause()
    caught = []

    def work():
        try:
            engine.scan(str(tree))
        except RuntimeError as e:
            caught.append(type(e).__name__)

    t = threading.Thread(target=work)
    t.start()
    while not engine.session.directory:
        pass
    engine.cancel()
    t.join(60)
    assert caught == ["Cancelled"] and engine.session.status == "cancelled"


def test_operations(spark, tree, tmp_path):
    engine = Engine(spark, cache=f"file://{tmp_path}/cache")
    plan = engine.clean_folders(str(tree))
    assert {r["src"].rsplit("/", 1)[1] for r in plan.collect()} == {"empty", "deeper"} and (tree / "sub/empty").exists()
    engine.clean_folders(str(tree), dry_run=False)
    assert not (tree / "sub/empty").exists() and (tree / "sub").exists()
    dry = engine.repair(str(tree), str(tmp_path / "trash"))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in dry.collect()}
    assert got["one.png"] == "clean" and got["text.jpg"] == "quarantined" and (tree / "text.jpg").exists()
    engine.repair(str(tree), str(tmp_path / "trash"), dry_run=False)
    assert (tmp_path / "trash" / "text.jpg").exists() and not (tree / "text.jpg").exists()
    with pytest.raises(ValueError):
        engine.pipeline(str(tree), ["nonsense"])
    jpgs = engine.pipeline(str(tree), ["convert_jpg"], jpg_quality=80, dry_run=False)["convert_jpg"].collect()
    assert {r["status"] for r in jpgs if "broken" not in r["src"]} == {"done"} and (tree / "other.jpg").exists()
    out = engine.pipeline(str(tree), ["random_rename", "cleanup_empty"], dry_run=False)
    assert list(out) == ["random_rename", "cleanup_empty"] and not (tree / "one.png").exists()


def test_stream_and_batch_agree(spark, tree, tmp_path):
    store = Cache(spark, f"file://{tmp_path}/cache")
    for expected in (7, 0):
        q, totals = ingest(files.stream(spark, str(tree), [".png", ".jpg"], per_batch=3, content=True), store, f"file://{tmp_path}/ckpt-{expected}")
        q.awaitTermination(120)
        assert (totals.discovered, totals.analyzed) == (7, expected) and totals.hits == 7 - expected
    batch = Engine(spark, cache=f"file://{tmp_path}/other").analyzed(str(tree), files.images(spark, str(tree)))
    key = lambda rows: {(r["path"], r["file_hash"], r["perceptual_hash"]) for r in rows}
    assert key(store.read().collect()) == key(batch.collect())


def test_command_line(spark, tree, capsys, monkeypatch, tmp_path):
    monkeypatch.setenv("LOOKALIKE_CACHE", str(tmp_path / "cli-cache"))
    assert cli.parse([str(tree)]).command == "duplicates"
    assert cli.run(cli.parse(["duplicates", str(tree), "--action", "delete"]), spark) == 0
    assert "planned: 2" in capsys.readouterr().out
    assert cli.run(cli.parse(["sort", str(tree), "--by", "resolution"]), spark) in (0, 1)
    assert cli.run(cli.parse(["fix-extensions", str(tree)]), spark) == 0
    assert cli.run(cli.parse(["cleanup", "/nowhere"]), spark) == 1
