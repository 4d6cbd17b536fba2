"""Operators over pages and embeddings against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

PAGE_FIELDS = "page_id long, url string, html string"


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# archives

PAGES = [
    (1, "http://a.example.com/x", "<p>" + "long " * 50),
    (2, "http://b.example.com/ y\r\n", "<p>" + "long " * 50),
    (3, None, "short"),
    (4, "http://c", "short"),
    (5, "u", None),
    (6, "u", ""),
    (None, "u", "<p>" + "long " * 50),
    (None, "u", "only without an id " * 10),
    (1, "http://a.example.com/x", "<p>" + "long " * 50),
    (7, "é", "é" * 50),
    (8, "é", "é" * 50),
    (9, "v", "WARC/1.1\r\n\r\n" * 20),
    (10, "v", "x" * 300_000),
]


def archived_plain(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h in first and len(raw) >= 100 and p != first[h]
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_archives(spark, monkeypatch, broadcast):
    from riskloom.llm import warc

    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    if broadcast < 0:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(name, "-1")
    pages = spark.createDataFrame(PAGES, PAGE_FIELDS).withColumns({"again": F.lit(1), "nth": F.lit(2), "payload": F.lit(3)}).repartition(3)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got(warc.archived(pages), *names) == archived_plain(PAGES)
    assert warc.archived(pages.filter("page_id = -1")).count() == 0
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def test_archives_in_a_folder_of_ones_own(spark, tmp_path):
    """They stay where they were asked for."""
    from riskloom.llm.warc import archived

    out = archived(spark.createDataFrame(PAGES, PAGE_FIELDS).repartition(2), folder=(tmp_path / "archives").as_uri())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got(out, *names) == archived_plain(PAGES) and list((tmp_path / "archives").glob("*.warc.zst"))


def test_dictionary_leads_the_archive(tmp_path):
    import struct

    import zstandard

    from riskloom.llm.warc import ArchiveWriter, read_records, record

    r = random.Random(2)
    words = ["river", "stone", "amber", "lantern", "<p>", "</p>", "night"]
    raw = [record(str(k), f"http://h/{k}", " ".join(r.choice(words) for _ in range(300)).encode(), None, "2000-01-01T00:00:00Z") for k in range(400)]
    path = tmp_path / "a.warc.zst"
    writer = ArchiveWriter(path.open("wb"))
    for x in raw:
        writer.add(x)
    writer.close()
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    each = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert each.decompress(data[8 + size :]) == raw[0]  # the first record is a frame of its own
    assert len(data) - size < sum(len(zstandard.ZstdCompressor(level=6).compress(x)) for x in raw)
    with path.open("rb") as f:
        assert [fields["WARC-Record-ID"] for fields, _ in read_records(f)] == [f"<urn:page:{k}>" for k in range(400)]


@pytest.mark.parametrize("n", [1, 4, 20])
def test_archives_of_few_records(tmp_path, n):
    """They have a dictionary too, and it pays or is short."""
    import struct

    from riskloom.llm.warc import ArchiveWriter, read_records, record

    raw = [record(str(k), "http://h/", ("<p>the same words again</p>" * 30 + str(k)).encode(), None, "2000-01-01T00:00:00Z") for k in range(n)]
    path = tmp_path / "a.warc.zst"
    writer = ArchiveWriter(path.open("wb"))
    for x in raw:
        writer.add(x)
    writer.close()
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size <= sum(map(len, raw)) / 8 + 256 and len(data) == writer.size
    with path.open("rb") as f:
        assert [fields["WARC-Record-ID"] for fields, _ in read_records(f)] == [f"<urn:page:{k}>" for k in range(n)]


# main text

SHELL = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="<p>x</p>";</script></head><body>'
    '<header>top</header><nav><ul><li><a href="/a">a</a></li><li>b</li></ul></nav><div class="ad-box">buy</div><aside class="sidebar">side</aside>'
    '<div id="cookie-notice">we use</div>{main}<form><input name=q>search</form><footer>&copy; end</footer></body></html>'
)
MAINS = [
    ("<article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four&nbsp;five<ul><li>x<li>y</ul><section class=comments><p>me too</p></section></article>", "T & U\none two three\nfour five\nx\ny"),
    ("<article><p>only</p><!-- <p>no</p> --><div class='share-bar'>s</div></article>", "only"),
    ("<article></article>", ""),
    ("<main><h2>A</h2><table><tr><td>1<td>2<tr><td>3</table><pre>a\n b</pre></main>", "A\n1\n2\n3\na b"),
    ("<div class=content><p>plain &lt;b&gt; &#233;</div>", "plain <b> é"),
]


def test_main_text(spark):
    from riskloom.llm.wrapper import extracted

    rows = [(k, f"http://h{k % 2}.example.com/{k}", SHELL.format(main=m)) for k, (m, _) in enumerate(MAINS[:3] * 5)]
    rows += [(100 + k, f"http://other{k}.example.com/", SHELL.format(main=m)) for k, (m, _) in enumerate(MAINS[3:])]
    want = [MAINS[k % 3][1] for k in range(15)] + [t for _, t in MAINS[3:]]
    rows += [(200, None, None), (201, "nohost", ""), (202, "http://z/", "<p>cut <b"), (203, "http://z/", "<article><p>a<script>never closed"), (None, "http://z/", "text only")]
    want += ["", "", "cut", "a", "text only"]
    rows += [(300, "http://deep/", "<div>" * 3000 + "deep"), (0, rows[0][1], rows[0][2])]
    want += ["deep", want[0]]
    df = spark.createDataFrame(rows, PAGE_FIELDS).withColumns({"host": F.lit("x"), "wrapper": F.lit("y"), "text": F.lit("z")}).repartition(4)
    out = extracted(df)
    assert got(out, "page_id", "url", "text", "n_chars") == sorted(((r[0], r[1], t, len(t)) for r, t in zip(rows, want, strict=True)), key=repr)
    assert extracted(df.filter("page_id = -1")).count() == 0


def test_blocks_below_many_others():
    """Marks and end tags count at any depth."""
    import time

    from riskloom.llm.wrapper import main_text as read
    from riskloom.llm.wrapper import page_wrapper

    down, up = "<div>" * 200, "</div>" * 200
    assert read(f"<div id=page><article>{down}text{up}<p>rest</p></article>after</div>") == "text\nrest"
    assert read(f"{down}a<nav>menu<div>more</div></nav>b<form>f</form><div class=sidebar>s<article>no</article></div>c{up}d") == "a\nb\nc\nd"
    assert read(f"{down}a<article>b<aside>no</aside><main>c</main></article>{up}d") == "b\nc"
    assert read(f"<nav>{down}menu{up}</nav>{down}<ul><li>x<li>y</ul>{up}z") == "x\ny\nz"
    start = time.perf_counter()
    far = "<div>" * 50_000 + "<ul>" + "<li>x" * 20_000 + "</div>" * 50_000
    assert read(far) == "\n".join("x" * 20_000) and len(page_wrapper(far)[1]) == 1
    assert time.perf_counter() - start < 40


def test_template_texts(spark):
    """A text that all of a host's pages have in a slot is no main text; it is where no other page tells."""
    from riskloom.llm.wrapper import extracted

    page = "<body><div><div>Brand of the day</div><div class=text><p>{}</p><p>Read on</p></div></div></body>"
    words = ["amber", "river", "stone"]
    rows = [(k, f"http://many/{k}", page.format(w)) for k, w in enumerate(words)]
    rows += [(10, "http://one/", page.format("amber")), (11, "http://copies/1", page.format("amber")), (12, "http://copies/2", page.format("amber"))]
    rows += [(20, "http://odd/1", page.format("amber")), (21, "http://odd/2", page.format("river")), (22, "http://odd/3", "<body><p>lost</p></body>"), (23, "http://odd/4", None)]
    whole = "Brand of the day\namber\nRead on"
    want = {0: "amber", 1: "river", 2: "stone", 10: whole, 11: whole, 12: whole, 20: "amber", 21: "river", 22: "lost", 23: ""}
    for parts in (1, 4):
        out = extracted(spark.createDataFrame(rows, PAGE_FIELDS).repartition(parts))
        assert {r["page_id"]: r["text"] for r in out.collect()} == want


def test_marks_are_whole_names():
    from riskloom.llm.wrapper import main_text

    page = '<article><h1>T</h1><div class="legal-analysis"><p>Real paragraph</p></div><section class="social-history"><p>Also real</p></section><p>end</p>{}</article>'
    assert main_text(page.format("")) == "T\nReal paragraph\nAlso real\nend"
    out = "".join(f'<div class="{c}">no</div>' for c in ("ad-box", "x site-footer", "related-posts", "commentsList", "cookie-notice", "share-bar", "search"))
    assert main_text(page.format(out)) == "T\nReal paragraph\nAlso real\nend"
    long = "x" * 90  # names that differ behind their first 80 characters are different slots
    assert main_text(f'<div class="{long} ad">no</div><div class="{long} b">yes</div>') == "yes"


def test_unmarked_menus(spark):
    """The host's other pages tell a menu whose links change from a page's own text; a page alone keeps it."""
    from riskloom.llm.wrapper import extracted

    page = '<body><div id="x9"><div><a href="/{0}">Go {0}</a></div><div><a href="/{1}">{1} now</a></div></div><div class=b><p>{0} <a href="/">{1}</a></p><p><a href="/y">{2}</a></p></div></body>'
    words = ["amber", "river", "stone", "night"]
    rows = [(k, f"http://many/{k}", page.format(w, words[k - 1], w * 2)) for k, w in enumerate(words)] + [(9, "http://one/", page.format(*words[:3]))]
    out = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, PAGE_FIELDS).repartition(3)).collect()}
    assert out == {k: f"{w} {words[k - 1]}\n{w * 2}" for k, w in enumerate(words)} | {9: "Go amber\nriver now\namber river\nstone"}


def test_links_end_with_their_blocks():
    from riskloom.llm.wrapper import slots

    page = "<div><p><a name=top>one<p><a href='/x'>two<p>three</div><div><a href=y><p>four</p>five</a> six</div>"
    assert [(t, linked) for *_, t, linked in slots(page)] == [("one", False), ("two", True), ("three", False), ("four", True), ("five six", False)]


def test_revisions_share_their_text(spark):
    """What a few pages' articles have in common stays; what five different ones have is the template's."""
    from riskloom.llm.wrapper import extracted

    page = "<article><p>The same long paragraph.</p><p>Edited {}.</p></article>"
    rows = [(k, "http://two/", page.format(w)) for k, w in enumerate(("once", "twice"))]
    rows += [(10 + k, "http://five/", page.format(f"w{k}")) for k in range(5)]
    out = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, PAGE_FIELDS).repartition(3)).collect()}
    assert out == {0: "The same long paragraph.\nEdited once.", 1: "The same long paragraph.\nEdited twice."} | {10 + k: f"Edited w{k}." for k in range(5)}


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment():
    """Against the plain table; long lists are aligned as short ones are."""
    import time

    from riskloom.llm.wrapper import aligned, common, page_tree

    r = random.Random(5)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        found = common(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) == longest_common(a, b)
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
    start = time.perf_counter()
    one, two = ("".join(f"<div class=c{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}>t</div>" for _ in range(3000)) for _ in range(2))
    assert len(aligned(page_tree(one), page_tree(two))) > 3000 and time.perf_counter() - start < 20


def test_wrapper_inference():
    from riskloom.llm.wrapper import aligned, as_regex, page_tree

    one = page_tree("<body><div class=x>a</div><p>1</p><p>2</p><h2>s</h2><p>3</p></body>")
    two = page_tree("<body><p>1</p><h2>s</h2><p>2</p><hr><footer>f</footer></body>")
    assert as_regex(one) == "<body><div.x>#</>(<p>#</>)+<h2>#</><p>#</></>"
    assert as_regex(aligned(one, two)) == "<body>(<div.x>#</>)?(<p>#</>)+<h2>#</><p>#</>(<hr></>)?(<!footer>#</>)?</>"
    pairs = page_tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert as_regex(pairs) == "<dl>(<dt>#</><dd>#</>)+</>"


# vectors


def test_links_between_vectors(spark, monkeypatch):
    from riskloom.llm import embedding

    monkeypatch.setattr(embedding, "BLOCK", 16)
    monkeypatch.setattr(embedding, "ROWS", 5)
    r = random.Random(4)
    centre = [[r.gauss(0, 1) for _ in range(24)] for _ in range(6)]
    rows = [(k, [x + r.gauss(0, 0.28) for x in centre[k % 6]], k % 2) for k in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 24, 0), (202, [1.0] * 23 + [float("nan")], 0), (203, [None] + [1.0] * 23, 0), (204, [], 1)]
    rows += [(205, rows[0][1], 0), (206, rows[0][1], 0), (207, rows[0][1], None), (None, rows[0][1], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    rows += [(5, rows[5][1], rows[5][2]), (210, [1e30 * x for x in rows[1][1]], 1), (211, [float("inf")] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "key": F.lit(2), "size": F.lit(3)}).repartition(3)
    out = got(embedding.links(df, 0.93), "vec_id", "n_links", "component_id", "kept")
    want = brute.cosine_links(rows, 0.93)
    assert out == want and sum(x[1] for x in want) > 100
    assert embedding.links(df.filter("vec_id = -1"), 0.93).count() == 0


def test_bounds_miss_no_pair():
    """Pairs that the bounds decide are decided rightly, whatever the vectors' scale; few stay doubtful."""
    import numpy as np

    from riskloom.llm.embedding import cosines, decided, quantised

    g = np.random.default_rng(0)
    x = g.normal(size=(300, 16)) * 10.0 ** g.integers(-8, 8, (300, 1))
    x[::7] *= 1e200
    x[1::9] = x[::9][: len(x[1::9])] + x[1::9] * 1e-3
    cos = np.array([cosines(np.repeat(r[None], len(x), 0), x) for r in x])
    z = quantised(x)
    assert z["q1"].dtype == z["q2"].dtype == np.int8
    for t in (0.2, 0.5, 0.9):
        i, j, k, l = decided(z, z, t)
        sure, maybe = set(zip(i, j, strict=True)), set(zip(k, l, strict=True))
        want = set(zip(*np.nonzero(cos >= t), strict=True))
        assert sure <= want <= sure | maybe and not sure & maybe and len(maybe) < 0.01 * cos.size


def test_pairs_at_the_threshold(spark):
    """Pairs that no bound can decide are computed from the vectors; ids of strings; one vec_id with two vectors."""
    from riskloom.llm import embedding

    at = [0.93, (1 - 0.93**2) ** 0.5]
    rows = [("a", [1.0, 0.0], 1), ("b", at, 1), ("c", [0.93 - 1e-9, (1 - (0.93 - 1e-9) ** 2) ** 0.5], 1), ("d", [0.0, 1.0], 1), ("d", [0.0, -1.0], 1), ("d", [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    assert got(embedding.links(df, 0.93), "vec_id", "n_links", "component_id", "kept") == brute.cosine_links(rows, 0.93)


# urls


def judged_plain(rows, rules, damping=0.85, rounds=200):
    parse = lambda u: (re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "") or [0, "", ""])
    low = brute.low
    hosts, said = [], []
    for _, u, _ in rows:
        m = parse(u)
        h, p = low(m[1]), m[2]
        hosts.append((h, p))
        fit = [(len(t), t, v) for v, t in rules if (h == t.split("/")[0] or h.endswith("." + t.split("/")[0])) and p.startswith("/" + t.partition("/")[2])]
        said.append(max(fit)[1:] if fit else (None, None))
    edges = {}
    for (h, _), (_, _, html) in zip(hosts, rows, strict=True):
        for ref in re.findall(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'>]+)", html or ""):
            b = low(parse(ref if "://" in ref else "x:" + ref)[1])
            if h and b and h != b:
                edges[h, b] = edges.get((h, b), 0) + 1
    rank = {}
    for kind, verdict in (("t", "allow"), ("d", "block")):
        seed = {}
        for (h, _), (_, v) in zip(hosts, said, strict=True):
            if v == verdict:
                seed[h] = seed.get(h, 0) + 1
        total = sum(seed.values())
        seed = {h: x / total for h, x in seed.items()}
        own = {(a, b) if kind == "t" else (b, a): w for (a, b), w in edges.items()}
        out = {}
        for (a, _), w in own.items():
            out[a] = out.get(a, 0) + w
        r = dict(seed)
        if own:
            for _ in range(rounds):
                lost = sum(x for h, x in r.items() if h not in out)  # hosts without links onward hand back to the seeds
                new = {h: (1 - damping + damping * lost) * x for h, x in seed.items()}
                for (a, b), w in own.items():
                    new[b] = new.get(b, 0) + damping * r.get(a, 0) * w / out[a]
                r = new
        rank[kind] = r
    bad = {h for h, _ in hosts if rank["d"].get(h, 0) > 0.5 * (rank["t"].get(h, 0) + rank["d"].get(h, 0))}
    return sorted(((p, h, q, t, v or ("block" if h in bad else "allow")) for (p, _, _), (h, q), (t, v) in zip(rows, hosts, said, strict=True)), key=repr)


def test_long_chains_of_links(spark):
    """A host many links away from a blocked one is blocked; and ranks have settled."""
    from riskloom.llm.linkrank import Walk, judged, ranks

    rows = [(k, f"http://c{k}.info/", f"<a href=http://c{k + 1}.info/>x</a>" if k < 14 else "<a href=http://o.org/>x</a>") for k in range(15)]
    rows += [(100, "http://o.org/es/", None), (101, "http://example.com/en/7", None)]
    df = spark.createDataFrame(rows, PAGE_FIELDS).repartition(2)
    out = {r["page_id"]: r["verdict"] for r in judged(df, walk=Walk(tolerance=0.5)).collect()}
    assert {v for k, v in out.items() if k < 101} == {"block"} and out[101] == "allow"
    seeds = spark.createDataFrame([("a", 1, 0)], "host string, trust long, distrust long")
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "a string, b string, w long")
    rank = {r["host"]: r["trust"] for r in ranks(seeds, links, Walk(tolerance=1e-6, cut_every=15)).collect()}
    assert rank == {"a": pytest.approx(0.15 / (1 - 0.85**2), abs=1e-6), "b": pytest.approx(0.15 * 0.85 / (1 - 0.85**2), abs=1e-6)}
    links = spark.createDataFrame([("a", "b", 1)], "a string, b string, w long")  # b hands back to a
    rank = {r["host"]: r["trust"] for r in ranks(seeds, links, Walk(tolerance=1e-6)).collect()}
    assert rank == {"a": pytest.approx(1 / 1.85, abs=1e-6), "b": pytest.approx(0.85 / 1.85, abs=1e-6)}


def test_url_verdicts(spark):
    from riskloom.llm.linkrank import RULES, judged

    link = lambda *hs: "".join(f'<a HREF="http://{h}/z">x</a>' for h in hs)
    rows = [
        (1, "http://A.example.COM/en/1?x", link("x.org", "y.net")), (2, "https://example.com/en/75#f", link("good.net")), (3, "http://q.net/de/1", link("friend.info", "z.info")),
        (4, "http://www.example.net/de/8x", None), (5, "http://o.org/es/", link("x.org")), (6, "http://friend.info/", link("z.info")), (7, "http://points.info", link("o.org", "a.example.com")),
        (8, "http://x.org/fr", ""), (9, None, link("o.org")), (10, "nothing", None), (11, "", None), (None, "http://z.info/a", "<a href=//o.org/>"), (3, "http://q.net/de/1", None),
        (12, "http://notcom/en/", None), (13, "://com/en/7", None), (14, "http://far.info/", link("points.info")), (15, "http://example.com/EN/7", None), (16, "HTTP://U.net:80/de/?a/b", None),
    ]
    df = spark.createDataFrame(rows, PAGE_FIELDS).withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3), "said": F.lit(4)}).repartition(3)
    out = got(judged(df), "page_id", "host", "path", "rule", "verdict")
    assert out == judged_plain(rows, RULES)
    assert {r[4] for r in out if r[3] is None} == {"allow", "block"}
    assert judged(df.filter("page_id = -1")).count() == 0
    assert judged(df.withColumn("html", F.lit(None).cast("string"))).count() == len(rows)
