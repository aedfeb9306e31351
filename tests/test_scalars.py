import pytest
from pyspark.sql import functions as F

from lookalike.functions import scalars as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("size, text", [(500, "500.0 B"), (2048, "2.0 KB"), (5242880, "5.0 MB"), (3221225472, "3.0 GB"), (0, "0.0 B"), (None, None)])
def test_human_size(spark, size, text):
    assert values(spark, [(size,)], "x long", S.human_size("x")) == [(text,)]


def test_paths(spark):
    rows = [("/a/b/c.JPG",), ("/c.png",), ("c",), ("/a/.jpg",), ("/a/x.tar.GZ",), (None,)]
    got = values(spark, rows, "p string", S.filename("p"), S.directory("p"), S.extension("p"))
    assert got == [("c.JPG", "/a/b", ".jpg"), ("c.png", "/", ".png"), ("c", "", ""), (".jpg", "/a", ""), ("x.tar.GZ", "/a", ".gz"), (None, None, None)]


def test_under_needs_a_separator(spark):
    rows = [("/a/b", "/a"), ("/ab", "/a"), ("/a", "/a"), ("/a_b/c", "/a%")]
    assert values(spark, rows, "p string, r string", S.under("p", F.col("r"))) == [(True,), (False,), (True,), (False,)]


@pytest.mark.parametrize("rgb, name", [((0, 0, 0), "black"), ((255, 255, 255), "white"), ((255, 0, 0), "red"), ((0, 255, 0), "green"), ((0, 0, 255), "blue"), ((80, 80, 80), "gray"), ((255, 255, 0), "brown"), ((255, 150, 50), "orange")])
def test_color_names(spark, rgb, name):
    assert values(spark, [rgb], "r int, g int, b int", S.color_name("r", "g", "b")) == [(name,)]


def test_resolution_and_orientation(spark):
    rows = [(7680, 100), (3840, 4000), (1920, 1080), (100, 99), (99, 0), (50, 100)]
    got = values(spark, rows, "w int, h int", S.resolution_class("w", "h"), S.orientation("w", "h"))
    assert got == [("8k_plus", "landscape"), ("4k", "square"), ("hd", "landscape"), ("thumbnail", "square"), ("tiny", "landscape"), ("thumbnail", "portrait")]


def test_names(spark):
    rows = [("a<b>.jpg",), ("con.txt",), (" . ",), ("", ), ("ok.png",)]
    assert values(spark, rows, "n string", S.sanitized("n")) == [("a_b_.jpg",), ("_con.txt",), ("unnamed",), ("unnamed",), ("ok.png",)]
    long = "/d/" + "x" * 300 + ".jpg"
    got = values(spark, [(long,), ("/" + "d" * 260 + "/x.jpg",), ("/d/x.jpg",)], "p string", S.shortened("p"))
    assert len(got[0][0]) == 250 and got[0][0].endswith("x.jpg") and got[1] == (None,) and got[2] == ("/d/x.jpg",)


def test_alphabet(spark):
    rows = [("apple",), ("Zoo",), ("7up",), ("_x",), ("",), ("nut",)]
    assert values(spark, rows, "n string", S.alphabet_folder("n")) == [("A-G",), ("U-Z",), ("0-9",), (None,), (None,), ("H-N",)]


def test_score_grows_and_ranks(spark):
    rows = [("/a.jpeg", 1000000, 1024, 24), ("/a.jpeg", 2000000, 1024, 24), ("/a.jpeg", 2000000, 10**6, 24), ("/a.cr2", 2000000, 10**6, 24), ("/a.zzz", 0, 0, 0), ("/a.cr2", 10**9, 10**9, 64)]
    got = [x for (x,) in values(spark, rows, "path string, pixel_count long, file_size long, bit_depth int", S.quality_score())]
    assert got[0] < got[1] < got[2] < got[3] and got[4] == 10.0 and got[5] == 110.0


def test_dates_and_durations(spark):
    rows = [("2024-01-02",), ("2024-01-02 03:04:05",), ("nonsense",)]
    got = values(spark, rows, "t string", S.exif_time(S.parsed_date("t")))
    assert got == [("2024:01:02 00:00:00",), ("2024:01:02 03:04:05",), (None,)]
    assert values(spark, [(45,), (150,), (3660,)], "s int", S.duration("s")) == [("45s",), ("2m 30s",), ("1h 1m",)]


def test_classes_of_damage(spark):
    rows = [("Truncated File",), ("bad IFD",), ("other",), (None,)]
    assert [x for (x,) in values(spark, rows, "m string", S.corruption_of("m"))] == ["truncated", "bad_exif", "unknown", "unknown"]


def test_parsed_rgb_and_dotted(spark):
    got = values(spark, [("255, 0,1",), ("1,2",), ("a,b,c",)], "t string", S.parsed_rgb("t"))
    assert got[0][0].asDict() == {"r": 255, "g": 0, "b": 1} and got[1] == (None,) and got[2][0].r is None
    assert S.dotted(["jpg", ".PNG", " "]) == [".jpg", ".png"] and S.dotted(None) is None


def test_random_names_repeat(spark):
    df = spark.createDataFrame([("/a",), ("/b",)], "p string")
    a = [r[0] for r in df.select(S.random_name(F.col("p"), 12)).collect()]
    assert a == [r[0] for r in df.select(S.random_name(F.col("p"), 12)).collect()] and a[0] != a[1] and all(len(x) == 12 and x.isalnum() for x in a)
