"""Operators on pages and media, and their defined cases."""

import collections
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lookalike.llm import html, jpeg, queries, urls, warc
from lookalike.llm.common import fresh_path

ODD = "page_id long, url string, html string, host string, text string, _rid string, `_row` string, payload string, verdict string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "t", "r", "w", "p", "v") for i, u, h in rows], ODD)


# HTML


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><h1>T</h1><p>a <b>b</b>c&amp;d&nbsp;e<br>f</article>", "T a bc&d e f"),
        ("<nav>menu</nav><main>body<aside>side</aside> more</main><footer>foot</footer>", "body more"),
        ("<article>x<form>no<input></form><script>var a='<p>';</script><style>p{}</style>y<!-- c -->z</article>", "x yz"),
        ("<article>text</article><section class='comments'><article>comment</article></section>", "text"),
        ("<article>&lt;p&gt; &amp;amp; 1 < 2 &am", "<p> &amp; 1 < 2 &am"),
        ("<div role=main><p>one<p>two</div><div class='cookie-notice'>ok</div>", "one two"),
        ("<article><p>a<div class='ad'>buy</div><p>b</article>", "a b"),
        ("<ARTICLE>Upper<SCRIPT>x</SCRIPT></ARTICLE>", "Upper"),
        ("<article>a<a href='x>y'>l</a><", "al"),
        ("<header>site</header><article><header><h1>Own</h1></header>p</article>", "Own p"),
        ("<article><p>a<p class='ad'>buy<p>b<ul><li class=share>s<li>c</ul><p style='display: none'>d<div>e</div></article>", "a b c e"),
        ("<article>a <span class=ad>x <span>y</span> z</span> b</article>", "a b"),
        ("", ""),
    ],
)
def test_articles(source, text):
    page = html.parse(source)
    assert page.text().rstrip("<").strip() == text


def test_names_of_an_article_do_not_mark_it():
    assert html.parse("<article class='post tag-social' id='category-notices'>own</article>").text() == "own"
    assert html.parse("<div role=main class='has-menu page-nav'>own</div>").text() == "own"
    assert not html.parse("<article class='comment'>reply</article>").has_article


@pytest.mark.parametrize("name", ["svg", "math", "object", "canvas"])
def test_open_elements_end_with_the_one_around_them(name):
    assert html.parse(f"<article><p>a</p><div><{name}>x</div><p>b</p></article>").text() == "a b"
    assert html.parse(f"<article>a<{name}>x</{name}>b</article>").text() == "a b"


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    rank = html.suffix_ranks(tokens, 6)
    seen = collections.defaultdict(set)
    for i in range(295):
        seen[rank[i]].add(tuple(tokens[i : i + 6].tolist()))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({tuple(tokens[i : i + 6].tolist()) for i in range(295)})
    order = sorted(range(295), key=lambda i: tuple(tokens[i : i + 6].tolist()))
    assert [rank[i] for i in order] == sorted(rank[:295])


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    words = lambda k: [" ".join(f"w{(k * 31 + j * 17 + j * j * k) % 997}" for j in range(a, a + 20)) for a in (0, 20)]
    body = lambda k: "".join(f"<p>{t}</p>" for t in words(k))
    head, foot = "<div>Start Here Then Read All Our Stories</div>", "<div>All rights are reserved by the owner since 1999</div>"
    rows = [(k, f"http://a.org/{k}", f"<html><body>{head}{body(k)}{foot}</body></html>") for k in range(40)]
    rows += [(100, "http://b.org/1", f"<body>{head}{body(5)}</body>"), (101, None, None), (102, "x", ""), (103, "http://a.org/z", "<body><p>short"), (104, "http://a.org/art", f"<body>{head}<article>{head}own</article>")]
    got = {r["page_id"]: r for r in html.extract(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k in range(40):
        assert got[k]["text"] == " ".join(words(k))
    assert got[100]["text"].startswith("Start Here Then") and got[101]["text"] == got[102]["text"] == "" and got[103]["text"] == "short"
    assert got[104]["text"] == "Start Here Then Read All Our Stories own" and got[0]["n_chars"] == len(got[0]["text"]) and got[0]["verdict"] == "v"
    assert html.extract(frame(spark, rows).limit(0)).collect() == []


def body_of(k):
    return " ".join(f"u{k}x{j}" for j in range(30))


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(k, f"http://c.org/{k % 5}", f"<body><div>{body_of(0)}</div></body>") for k in range(9)] + [(20, "http://c.org/q", f"<body><div>{body_of(1)}</div></body>")]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows).repartition(3)).collect()}
    assert got == {**{k: body_of(0) for k in range(9)}, 20: body_of(1)}


def test_a_notice_goes_however_large_the_host_is(spark):
    notice = "<div>this notice is on few pages of the host</div>"
    rows = [(k, f"http://d.org/{k}", f"<body>{notice if k < 4 else ''}<div>{body_of(k)}</div></body>") for k in range(60)]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows).repartition(3)).collect()}
    assert got == {k: body_of(k) for k in range(60)}


def test_blocks_that_mix_repeats_and_own_words(spark):
    rows = [(k, f"http://e.org/{k}", f"<body><div>subscribe to our weekly letter now own{k} a{k} b{k}</div><div>{body_of(k)} read more of our stories here today</div></body>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows).repartition(3)).collect()}
    assert got == {k: f"own{k} a{k} b{k} {body_of(k)}" for k in range(6)}


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><p>see <a href=/x title=it's>this</a> page</article>", "see this page"),
        ("<article>a<img alt='1 > 0'>b<a title=\"x>y\">c</a> <i data-x=a\"b>d</i></article>", "abc d"),
        ("<article>a<b title='>open</b> quote</article>", "aopen quote"),
        ("<article><div class=related-work>w</div><p class='share-price'>p</p><div id=widget-design>d</div></article>", "w p d"),
        ("<article>a<div class='site-footer'>f</div><div class='ad-slot-3'>x</div><ul class='share-buttons social'><li>s</ul>b</article>", "a b"),
        ("<article>a<div class='comment-xyz'><article>reply</article></div>b</article>", "a reply b"),
    ],
)
def test_attributes_and_names(source, text):
    assert html.without_repeats(html.parse(source).blocks, "h", [])[0] == text


def test_deep_and_long_pages_take_linear_time():
    def seconds(n):
        began = time.process_time()
        page = html.parse("<article>" + "<div><span class=x>" * n + "deep" + "</span></div>" * n + "<svg>" * 500 + "<p>tail" + "<a title=\"" * 500)
        assert page.text().startswith("deep")
        return time.process_time() - began

    seconds(100)
    assert seconds(60000) < 12 * max(seconds(15000), 0.05)
    long = "<article>" + "word &amp; " * 400000 + "</article>"
    assert len(html.parse(long).text()) == 400000 * 7 - 1


def brute_extract(rows, run=html.RUN, least=html.LEAST_PAGES):
    """Text and n_repeated of each row, by counting every run of every distinct content of a host."""
    pages = [(html.host_of(u), html.parse(h)) for _, u, h in rows]
    words = lambda page: [(i, w) for i, (k, t) in enumerate(page.blocks) if k != html.ARTICLE for w in t.split()]
    seen = collections.defaultdict(set)
    for host, page in pages:
        w = [x for _, x in words(page)]
        for k in range(len(w) - run + 1):
            seen[host, tuple(w[k : k + run])].add(tuple(t for _, t in page.blocks))
    out = []
    for host, page in pages:
        found = words(page)
        w = [x for _, x in found]
        gone = [False] * len(w)
        for k in range(len(w) - run + 1):
            if len(seen[host, tuple(w[k : k + run])]) >= least:
                gone[k : k + run] = [True] * run
        parts = []
        for i, (kind, text) in enumerate(page.blocks):
            own = [x for (j, x), g in zip(found, gone) if j == i and not g]
            if kind == html.ARTICLE:
                parts.append(text)
            elif own and (kind == html.SUSPECT or kind == html.REST and not page.has_article):
                parts.append(" ".join(own))
        out.append((" ".join(parts), sum(gone)))
    return out


def odd_pages():
    rng = random.Random(12)
    pieces = [" ".join(f"{a}{k}" for k in range(n)) for a, n in (("menu", 7), ("side", 14), ("foot", 6), ("short", 4), ("note", 30))]
    own = lambda: " ".join(f"o{rng.randrange(10**8)}" for _ in range(rng.randint(1, 12)))
    tags = ["<div>{}</div>", "<nav>{}</nav>", "<p>{}", "<div class='related-{}x'>{{}}</div>".format("work"), "<article><p>{}</p></article>", "<article>{}<div class='share-price'>{}</div></article>", "<footer>{}</footer>"]
    rows = []
    for i in range(120):
        body = "".join((t := rng.choice(tags)).format(*[rng.choice([rng.choice(pieces), own(), f"{own()} {rng.choice(pieces)} {own()}"]) for _ in range(t.count("{}"))]) for _ in range(rng.randint(0, 5)))
        rows.append((i, f"http://{'abc'[i % 3]}.org/{i}", f"<html><body>{body}"))
    rows += [(200, "http://a.org/x", rows[0][2]), (201, "http://b.org/x", rows[0][2]), (0, rows[0][1], rows[0][2]), (202, None, None), (203, "http://a.org", ""), (None, None, rows[3][2])]
    return rows + [(300 + k, "http://copies.org/", f"<div>{pieces[4]} end</div>") for k in range(9)]


def test_extract_against_brute_force(spark, monkeypatch):
    rows = odd_pages()
    found = brute_extract(rows)
    want = collections.Counter((i, t, len(t)) for (i, _, _), (t, _) in zip(rows, found))
    repeated = collections.Counter((i, n) for (i, _, _), (_, n) in zip(rows, found) if n)
    for size in (html.BATCH_BYTES, 3000):
        monkeypatch.setattr(html, "BATCH_BYTES", size)
        docs = frame(spark, rows).repartition(4)
        assert collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(docs).collect()) == want
        assert collections.Counter((r["page_id"], r["n_repeated"]) for r in html.repeats(docs).collect()) == repeated
    off = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(frame(spark, rows), least=10**9).collect())
    assert sum((off - want).values()) > 20


def test_every_page_goes_through_the_array(spark):
    """Also one whose text structure decides, on a host without any other."""
    rows = [(k, f"http://f.org/{k}", f"<body><nav>home news sport money weather and more</nav><article>{body_of(k)}</article></body>") for k in range(4)]
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html.extract(frame(spark, rows).repartition(2)).collect()}
    assert got == {k: (body_of(k), 7) for k in range(4)}
    rows = odd_pages()
    want = collections.Counter((i, t, n) for (i, _, _), (t, n) in zip(rows, brute_extract(rows)))
    assert collections.Counter((r["page_id"], r["text"], r["n_repeated"]) for r in html.extract(frame(spark, rows).repartition(3)).collect()) == want


def test_pages_table(spark):
    """Every text of the table is as brute force has it, and the suffix array speaks of its rows."""
    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    found = brute_extract(rows)
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == {i: t for (i, _, _), (t, _) in zip(rows, found)}
    got = {r["page_id"]: r["n_repeated"] for r in html.repeats(pages).collect()}
    assert got == {i: n for (i, _, _), (_, n) in zip(rows, found) if n} and got
    assert html.repeats(pages, least=10**9).count() == 0


# URL filters


def slow_verdict(url, rules):
    host, path = urls.host_and_path(url)
    fits = []
    for kind, rule in rules:
        h, p = urls.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), rule, kind))
    return max(fits)[2:] if fits else (None, "allow")


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "example.com", "xexample.com", "org", "b.org", "EXAMPLE.Com", "", "user@example.net:80"]
    paths = ["", "/", "/en/", "/en/x", "/de/1?en/", "/fr/#de/", "?x", "/e"]
    links = [rng.choice(["http://", "https://", "//", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "http://net"]
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "b.org"), ("allow", "b.org/e")]
    got = urls.judge(frame(spark, [(i, u, "") for i, u in enumerate(links)]), rules).collect()
    for r in got:
        assert (r["host"], r["path"]) == urls.host_and_path(links[r["page_id"]])
        assert (r["rule"], r["verdict"]) == slow_verdict(links[r["page_id"]], rules)
    assert {r["verdict"] for r in urls.judge(frame(spark, [(1, "http://x/", "")]), [], default="block").collect()} == {"block"}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x, *a: len(x))
    f = tmp_path / "rules"
    f.write_bytes(urls.digest_file([("block", "aa.b/"), ("allow", "cc.d/"), ("block", "eeee.f/")]))
    array = urls.DigestArray(str(f))
    assert [array.strings[int(array.ends[p - 1]) if p else 0 : int(array.ends[p])].tobytes() if p >= 0 else None for p in array.probe([b"cc.d/", b"xx.y/", b"aa.b/", b"eeee.f/"]).tolist()] == [b"cc.d/", None, b"aa.b/", b"eeee.f/"]
    with pytest.raises(ValueError):
        urls.digest_file([("block", "/path")])


# JPEG


def general_jpeg(values, width, height):
    """A gray JPEG with a usual DC table, coded by hand: blocks of DC alone."""
    codes = {0: "00", 1: "010", 2: "011", 3: "100", 4: "101", 5: "110", 6: "1110", 7: "11110", 8: "111110"}
    bits, last = "", 0
    for v in values:
        d, last = v - last, v
        n = abs(d).bit_length()
        bits += codes[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "1010"
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    dc = bytes([0, 0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])
    ac = bytes([0x10, 0, 2, 1, 3, *[0] * 12, 1, 2, 3, 0, 4, 17])
    head = seg(0xDB, bytes([0, 8, *[1] * 63])) + seg(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + seg(0xC4, dc) + seg(0xC4, ac)
    return b"\xff\xd8" + head + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 640, 5000, 70000])
def test_payloads_come_back(n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(256) for _ in range(n)), b"\xff" * n):
        payload = jpeg.pad(data)
        picture = jpeg.Picture(jpeg.encode(payload))
        x = picture.coefficients()
        assert len(payload) % 64 == 0 < len(payload) and picture.payload(x) == payload
        if n < 6000:
            assert (picture._one_by_one() == x).all()


def test_baseline_files_of_others():
    values = [3, -5, 100, 100, 0, -128]
    picture = jpeg.Picture(general_jpeg(values, 24, 16))
    assert picture.coefficients()[:, 0].tolist() == values
    assert picture.thumbnail(picture.coefficients()).tolist() == [[131, 123, 228], [228, 128, 0]]
    assert picture.payload(picture.coefficients()) is None


def test_media_columns(spark):
    texts = ["", None, "abc", "é" * 100, "x" * 64, "y" * 100000]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, width string")
    stored = jpeg.store(df)
    got = {r["doc_id"]: r for r in jpeg.probe(stored).collect()}
    for i, t in enumerate(texts):
        payload = jpeg.pad((t or "").encode())
        r = got[i]
        assert (r["source_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0]["thumb_hash"] == got[1]["thumb_hash"]
    odd = spark.createDataFrame([(1, bytearray(b"no jpeg")), (2, None), (3, bytearray(general_jpeg([1], 8, 8))), (4, bytearray(jpeg.encode(bytes(64))[:-20]))], "k long, media binary")
    rows = {r["k"]: r for r in jpeg.probe(odd).collect()}
    assert rows[1]["width"] is None and rows[2]["width"] is None and rows[3]["width"] == 8 and rows[3]["payload_bytes"] is None and rows[4]["width"] is None
    assert jpeg.probe(jpeg.store(df.limit(0))).collect() == []


def slow_feature(payload):
    """Of the blocks' first coefficients, pixel by pixel."""
    n = len(payload) // 64
    wide = next(w for w in range(1, n + 1) if w * w >= n)
    high = -(-n // wide)
    first = [payload[64 * k] for k in range(n)] + [0] * (wide * high - n)
    pixels = [min(255, max(0, round((b - 255 if b < 128 else b) / 8 + 128))) for b in first]
    bits = ""
    for y in range(8):
        line = [pixels[y * high // 8 * wide + x * wide // 9] for x in range(9)]
        bits += "".join("1" if b > a else "0" for a, b in zip(line, line[1:]))
    return f"{8 * wide}x{8 * high}:{int(bits, 2):016x}-{zlib.crc32(bytes(pixels)):08x}"


def test_media_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, "abc", "é漢" * 100, "x" * 64, "x" * 64, "\0\0", "long " * 40000, *("".join(rng.choice("abc dé\x7f~") for _ in range(rng.randint(1, 9000))) for _ in range(25))]
    rows = [(i, t, "odd") for i, t in enumerate(texts)] + [(None, "abc", "odd"), (2, "abc", "odd")]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.op4_jpeg_media(spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for i, t, _ in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        media = jpeg.encode(payload)
        if len(media) < 20000:  # read by the general decoder, symbol by symbol
            assert jpeg.Picture(media).payload(jpeg.Picture(media)._one_by_one()) == payload
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), slow_feature(payload)] += 1
    assert got == want


def test_long_urls_and_payloads(spark):
    """Repeated rows, an empty table, a URL and a payload of a megabyte."""
    long = "http://a.org/en/" + "x" * 1_000_000
    rows = [(1, long, "y" * 1_500_000), (2, "http://example.net/en/" + "z" * 500_000, "y" * 1_500_000), (2, "http://example.net/en/" + "z" * 500_000, "y" * 1_500_000)]
    rules = [("block", "net/"), ("allow", "example.net/en/")]
    got = urls.judge(frame(spark, rows), rules).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"], len(r["path"])) for r in got) == [(1, None, "allow", 1_000_004), (2, "example.net/en/", "allow", 500_004), (2, "example.net/en/", "allow", 500_004)]
    assert urls.judge(frame(spark, rows).limit(0), rules).collect() == []
    digest = hashlib.sha1(b"y" * 1_500_000).hexdigest()
    assert sorted(map(tuple, warc.round_trip(frame(spark, rows)).collect())) == [(1, 1_500_000, digest, "revisit", 2), (2, 1_500_000, digest, "response", None), (2, 1_500_000, digest, "response", None)]


# WARC


def test_surt():
    assert warc.surt("https://www.Example.org:80/a b?c") == "org:80,example,www)/a%20b?c"
    assert warc.surt(None) == ")" and warc.surt("x") == "x)" and warc.index_key("http://a.b/", 3) < warc.index_key("http://a.b/", 20) < warc.index_key("http://a.b/c", 1)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big, other = "<p>" + "long page " * 200, "é" * 499
    rows = [(i, f"http://h{i % 3}.org/{i}", f"page {i} " * (i * 7)) for i in range(40)]
    rows += [(100, "http://a/", big), (101, "http://b/\n x", big), (99, None, big), (102, "http://c/", other), (103, "http://c/", other), (104, "odd", None), (105, "", ""), (106, "http://d/", other + "éé"), (107, "http://d/", other + "éé")]
    rows += [(None, "http://e/", big), (7, "http://same/", "twice"), (7, "http://same/", "twice")]
    top = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            top[data] = max(i, top.get(data, i))
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = top.get(data)
        revisit = first is not None and (i is None or i < first)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    got = collections.Counter(map(tuple, warc.round_trip(frame(spark, rows)).collect()))
    assert got == want
    assert warc.round_trip(frame(spark, rows).limit(0)).collect() == []


def test_lookups(spark):
    pages = frame(spark, [(i, f"http://h{i % 5}.org/{i // 5}", f"body {i}") for i in range(1000)])
    root = fresh_path(spark, "warc-test")
    files = warc.write_index(warc.write(pages, root), root)
    index = warc.Index(root, files)
    place = list(index.find(warc.index_key("http://h2.org/100", 502)))
    assert len(place) == 1 and warc.parse(index.read(*place[0]))[2] == b"body 502" and list(index.find("zz")) == list(index.find("")) == []
    few = warc.read_back(pages.filter(F.col("page_id") < 3), root, files).collect()
    assert {r["page_id"] for r in few} == {0, 1, 2}
    index.close()
