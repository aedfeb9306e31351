import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lookalike.functions import signatures as S
from lookalike.operators import groups, index
from lookalike.operators.components import connected_components
from lookalike.operators.numbering import numbered


def hashes(n=60, seed=3, near=20):
    rng = random.Random(seed)
    out = [rng.getrandbits(256) for _ in range(n)]
    for _ in range(near):
        x = rng.choice(out)
        for p in rng.sample(range(256), rng.randint(0, 14)):
            x ^= 1 << p
        out.append(x)
    return [(i, f"{x:064x}") for i, x in enumerate(out)]


def brute(rows, threshold):
    return {(a, b, (int(x, 16) ^ int(y, 16)).bit_count()) for a, x in rows for b, y in rows if a < b and (int(x, 16) ^ int(y, 16)).bit_count() <= threshold}


def test_positions_are_those_of_the_seed():
    got = index.positions(2, 16)
    assert got[0] == [12, 13, 15, 16, 44, 47, 52, 57, 71, 101, 111, 114, 119, 125, 140, 216]
    assert got[1] == [3, 47, 49, 52, 79, 81, 110, 112, 142, 172, 174, 183, 194, 214, 216, 229]


def test_all_pairs_is_exact(spark):
    rows = hashes()
    df = spark.createDataFrame(rows, "id long, signature string")
    for blocks in (1, 3):
        got = index.all_pairs(df, 12, blocks=blocks).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 12)


def test_index_finds_a_part_of_all_pairs_and_most(spark):
    rows = hashes(200, 5, 80)
    df = spark.createDataFrame(rows, "id long, signature string")
    got = {tuple(r) for r in index.indexed_pairs(df, 10, 20, 16).collect()}
    assert got <= brute(rows, 10) and len(got) >= 0.99 * len(brute(rows, 10))


@pytest.mark.parametrize("threshold", [25, 40])
def test_recall_is_met_at_any_threshold(spark, threshold):
    """Measured against all pairs, half of them at the threshold itself."""
    rng = random.Random(threshold)
    rows = []
    for i in range(150):
        x = rng.getrandbits(256)
        y = x
        for p in rng.sample(range(256), rng.choice([threshold, threshold, rng.randint(0, threshold)])):
            y ^= 1 << p
        rows += [(2 * i, f"{x:064x}"), (2 * i + 1, f"{y:064x}")]
    df = spark.createDataFrame(rows, "id long, signature string")
    exact = {tuple(r) for r in index.all_pairs(df, threshold).collect()}
    found = {tuple(r) for r in index.near_pairs(df, threshold, use_index=True).collect()}
    assert found <= exact and len(exact) >= 150 and len(found) >= 0.96 * len(exact)
    for n in (100, 60_000, 10**7):
        tables, bits = index.tables_for(n, threshold)
        assert index.recall(tables, bits, threshold) >= 0.99 and tables <= index.MOST_TABLES
    assert index.tables_for(650_000, 10) == index.tier(650_000)


def test_recall_out_of_reach():
    with pytest.raises(ValueError):
        index.tables_for(1000, 256)
    with pytest.raises(ValueError):
        index.tier_for_recall(8, 250, 0.999999)


def test_malformed_signatures_are_left_out(spark):
    df = spark.createDataFrame([(1, "xyz"), (2, None), (3, "0" * 64), (4, "0" * 64), (5, "0" * 63)], "id long, signature string")
    assert {tuple(r) for r in index.all_pairs(df, 0).collect()} == {(3, 4, 0)}
    assert {tuple(r) for r in index.indexed_pairs(df, 0).collect()} == {(3, 4, 0)}
    reps, members = index.representatives(df)
    assert [r["id"] for r in reps.collect()] == [3] and {tuple(r) for r in members.collect()} == {(3, 3), (4, 3)}


def test_estimates(spark):
    df = spark.createDataFrame([(i, "f" * 64) for i in range(4)], "id long, signature string")
    rows = index.buckets(df, 3, 8)
    assert index.pair_estimate(rows).first()[0] == 18
    s = index.index_statistics(rows).first()
    assert (s["buckets"], s["avg_bucket_size"], s["max_bucket_size"], s["uneven"]) == (3, 4.0, 4, False)
    assert index.tier(500_000)[0] > index.tier(5_000)[0]
    assert index.estimate(650_000, 30, 12)["estimated_lsh_comparisons"] > 10**9 and index.estimate(0)["speedup_factor"] == 0
    assert index.recall(*index.tier_for_recall(16, 20), 20) >= 0.99


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**256 - 1), st.integers(0, 2**256 - 1))
def test_distance_and_keys(spark, x, y):
    df = spark.createDataFrame([(f"{x:064x}", f"{y:064x}")], "a string, b string")
    places = index.positions(1, 20)[0]
    d, k = df.select(S.distance(S.packed("a"), S.packed("b")), S.bucket_key(S.packed("a"), places)).first()
    assert d == (x ^ y).bit_count() and k == int("".join(str(x >> (255 - p) & 1) for p in places), 2)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 2)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "id1 long, id2 long")).collect()}
    assert got[3] == 1 and got[5] == 4 and 9 not in got and got[160] == 100 and got[239] == 200
    assert connected_components(spark.createDataFrame([], "id1 long, id2 long")).count() == 0


def test_numbers_have_no_gaps(spark):
    df = spark.createDataFrame([(f"{(i * 7919) % 1000:04d}",) for i in range(1000)], "k string").repartition(7)
    got = numbered(df, "k", start=5).orderBy("k").collect()
    assert [r["number"] for r in got] == list(range(5, 1005))


@pytest.fixture
def library(spark):
    near = f"{(1 << 40) - 1 << 200:064x}"
    rows = [("/a", "h1", "0" * 64), ("/b", "h1", "0" * 64), ("/c", "h2", "0" * 63 + "1"), ("/d", "h3", "0" * 63 + "3"), ("/e", "h4", near), ("/f", "", near), ("/g", None, None), ("/h", "h5", "f" * 64)]
    made = [(p, h, s, 10, float(ord(p[1])), None) for p, h, s in rows]
    return spark.createDataFrame(made, "path string, file_hash string, perceptual_hash string, file_size long, quality_score double, error string")


def test_groups(spark, library):
    exact = {(r["group_id"], r["path"]) for r in groups.exact_groups(library).collect()}
    assert exact == {(1, "/a"), (1, "/b")}
    for use in (True, False):
        got = {(r["group_id"], r["match_type"], r["path"]) for r in groups.all_groups(library, 5, use_index=use).collect()}
        assert got == {(1, "exact", "/a"), (1, "exact", "/b"), (2, "perceptual", "/c"), (2, "perceptual", "/d"), (3, "perceptual", "/e"), (3, "perceptual", "/f")}
    linked = {(r["group_id"], r["path"]) for r in groups.perceptual_groups(library, 5, use_index=False, link_exact=True).collect()}
    assert (1, "/a") in linked and (1, "/c") in linked


def test_ranking_summary_and_nested(spark, library):
    members = groups.ranked(groups.exact_groups(library), library)
    s = groups.group_summary(members).first()
    assert (s["best_path"], s["image_count"], s["potential_savings"]) == ("/b", 2, 10)
    n = groups.nested(members).first()
    assert n["best_path"] == "/b" and [i["path"] for i in n["images"]] == ["/b", "/a"]
    left = groups.without_deleted(groups.exact_groups(library), spark.createDataFrame([("/a",)], "path string"))
    assert left.count() == 0
    assert groups.exact_groups(library.limit(0)).count() == 0
    assert groups.spread(groups.exact_groups(library), library).first()["radius"] == 0
    assert groups.valid_assets(library.withColumn("error", F.lit(""))).count() == 8


def components_of(rows, pairs):
    root = {i: i for i, _ in rows}
    for a, b in sorted((min(p), max(p)) for p in pairs):
        x, y = root[a], root[b]
        if x != y:
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("threshold,bits", [(0, 256), (1, 256), (7, 256), (10, 256), (32, 256), (33, 256), (62, 256), (64, 256), (10, 64)])
def test_exact_links_connect_what_all_pairs_do(spark, threshold, bits):
    """Half of the links at the threshold itself, which differ in all parts alike, or in one of them."""
    rng = random.Random(threshold)
    rows = []
    for i in range(120):
        x = rng.getrandbits(bits)
        chosen = rng.choice([threshold, threshold, threshold + 1, rng.randint(0, threshold)])
        places = [rng.sample(range(bits), chosen), range(bits - chosen, bits), [int((k + rng.random()) * bits / chosen) for k in range(chosen)]][i % 3]
        y = x
        for p in places:
            y ^= 1 << p
        rows += [(2 * i, f"{x:0{bits // 4}x}"), (2 * i + 1, f"{y:0{bits // 4}x}")]
    parts = index.segments(threshold, bits)
    if parts:
        assert sum(may + 1 for _, _, may in parts) == threshold + 1
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(parts, parts[1:])) and sum(parts[-1][:2]) <= bits
    df = spark.createDataFrame([*rows, (1000, None), (1001, "xyz")], "id long, signature string")
    got = [(r["id1"], r["id2"]) for r in index.exact_links(df, threshold, bits).collect()]
    truth = {(a, b) for a, b, _ in brute(rows, threshold)}
    assert len(truth) >= 60 and components_of(rows, got) == components_of(rows, truth)


def test_exact_links_within_large_groups(spark):
    """Chains that neighbours alone don't connect, in groups that are near each other; far fewer links than pairs."""
    rng, rows = random.Random(1), []
    for g in range(3):
        x = rng.getrandbits(256)
        for _ in range(250):
            y = x
            for p in rng.sample(range(256), rng.randint(8, 24)):
                y ^= 1 << p
            rows.append((len(rows), f"{y:064x}"))
    df = spark.createDataFrame([(f"/{i:04d}", s) for i, s in rows], "path string, perceptual_hash string")
    truth = {(f"/{a:04d}", f"/{b:04d}") for a, b, _ in brute(rows, 32)}
    nodes = [(f"/{i:04d}", s) for i, s in rows]
    got = [(r["id1"], r["id2"]) for r in groups.perceptual_links(df, 32, use_index=False).distinct().collect()]
    assert components_of(nodes, got) == components_of(nodes, truth)
    assert len(truth) > 30_000 and len(got) < 20 * len(rows)


def test_signatures_hash_a_token_once(monkeypatch):
    """However many tokens the texts have; and signatures are those of a plain count, in texts of more tokens than a byte counts too."""
    rng, asked = random.Random(2), []
    sha256 = hashlib.sha256

    def counted(token, **options):
        asked.append(token)
        return sha256(token, **options)

    def plain(text):
        tokens = set(text.lower().split(" "))
        sums = [sum(int.from_bytes(sha256(t.encode()).digest()) >> (255 - p) & 1 for t in tokens) for p in range(256)]
        return f"{int(''.join('1' if 2 * n > len(tokens) else '0' for n in sums), 2):064x}"

    many = [f"w{i}" for i in range(70_000)]
    odd = ["", " ", "  a", "A a", "a A\tb  a", "İ Σ ΑΣ", None, " ".join(many[:700]), " ".join(rng.choices(many, k=255)), None]
    monkeypatch.setattr(hashlib, "sha256", counted)
    found = S.simhashes([" ".join(many), *odd, " ".join(reversed(many))])
    assert len(asked) == len(set(asked)) >= 70_000
    assert found[0] == found[-1] and found[1:-1] == [t if t is None else plain(t) for t in odd]
    assert S.simhashes([]) == [] and S.simhashes([None]) == [None]
    monkeypatch.setattr(S, "_HELD", 9)
    assert S.simhashes(odd) == found[1:-1]
