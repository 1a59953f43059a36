"""WARC round trips, URL filters, main texts."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywell.llm import sitetree, urlfilter, warc


def test_round_trip(spark, tmp_path):
    same = "<p>" + "x" * 200
    rows = [(5, "http://b.example/1", same), (3, "http://a.example/2?q\r\nX: 1", same), (9, None, same), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""),
            (None, "u", same), (4, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (4, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (6, "u", "y" * 300_000),
            (9, "u", "z" * 240), (5, "u", "w" * 150), (11, "u", "w" * 150), (9, "u", None)]  # other payloads under a known id
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int").repartition(3)
    out = warc.round_trip(df, str(tmp_path)).collect()
    want = []
    for i, u, h in rows:
        h = h or ""
        least = min((j for j, _, k in rows if k == h and j is not None), default=None)
        again = i is not None and len(h.encode()) >= 100 and least < i
        want.append((i, u, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", least if again else None, None if again else h.encode()))
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0), str(tmp_path / "none")).count() == 0


def test_index_is_ordered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    rows = [(i, f"http://h{i % 7}.example/{i % 3}", f"2026-01-{1 + i % 28:02d} 00:00:00", f"body {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, at string, html string").selectExpr("page_id", "url", "to_timestamp(at) as at", "html").repartition(5)
    runs = warc.write_archive(df, str(tmp_path), date_col="at").cache()
    index = warc.merge_index(runs, 150).collect()
    assert len(index) == 150 and [warc._order(r) for r in index] == sorted(warc._order(r) for r in index)
    assert index[0]["urlkey"].startswith("example,h0)")


def test_loser_tree():
    row = lambda k: (k, "", 1, "f", 0, 0)
    for runs in ([], [[]], [["a"]], [["b", "d"], [], ["a", "a", "e"], ["c"]], [["z"], ["y"], ["x"], ["w"], ["v"]]):
        got = [r[0] for r in warc.loser_tree([[row(k) for k in r] for r in runs])]
        assert got == sorted(k for r in runs for k in r)


URLS = [None, "", "no scheme", "://", "http://A.Example.COM/en/7x?y#z", "http://example.com/en/1", "http://xexample.com/en/7", "http://com/en/", "http://com/EN/", "https://a.net/de/8",
        "https://example.net/de/8", "https://b.example.net/de/80", "https://b.example.net/de/7", "http://x.org/es/?a", "http://x.org?/es/", "http://x.org#/es/", "http://x.org:80/es/", "a://b://c.org/es/",
        "http://.com/en/", "http://a..com/en/1", "http://É.com/en/x"]


def brute_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else "allow"


def test_url_filters(spark):
    df = spark.createDataFrame([(None if i == 3 else i // 2, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rules = urlfilter.rules_table(spark)
    got = urlfilter.judge_urls(df, rules).collect()
    want = [(None if i == 3 else i // 2, *brute_url(u)) for i, u in enumerate(URLS)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    shuffled = urlfilter.judge_urls(df, rules, broadcast_rows=0).collect()
    assert sorted(map(tuple, shuffled), key=repr) == sorted(want, key=repr)
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    assert urlfilter.judge_urls(df, rules.limit(0)).where("verdict != 'allow' or rule is not null").count() == 0


def test_one_url_on_most_rows(spark):
    """With nothing broadcast, the pages of one URL go to many tasks."""
    rows = [(i, "http://a.example.com/en/1" if i % 4 else f"http://b{i}.example.net/x") for i in range(8000)]
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
        out = urlfilter.judge_urls(df, urlfilter.rules_table(spark), broadcast_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == len(rows) and len(sizes) > 30 and max(sizes) <= len(rows) / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<article><h1>Head &amp; line</h1><p><b>Bold text.<br><p>Sec&#233;nd  para&nbsp;graph &lt;tag&gt; a < b<ul><li>one<li>two</ul>
<div class="ad">Buy</div><form>Name <input></form><table><tr><td>c1</td><td>c2</td></tr></table>tail<section class="comments"><p>reader</p></section></article>
<aside>side</aside><footer>&copy; foot</footer>"""


def judge(blocks, noise=(), varied=()):
    """Text, blocks cut by the tree and by role, of a page's blocks."""
    left, tree, role = [], 0, 0
    for b in blocks:
        safe = b.main and b.prior == 1
        if not safe and any(b.path == x or b.path.startswith(x + "/") for x in noise):
            tree += 1
        elif b.prior * (1.0 if b.path in varied else sitetree.UNKNOWN) <= sitetree.LOW:
            role += 1
        else:
            left.append(b)
    main, all_left = [b.text for b in left if b.main], [b.text for b in left]
    mostly = 2 * sum(map(len, main)) >= sum(map(len, all_left))
    return "\n".join(main if mostly else all_left), tree, role


@pytest.mark.parametrize("page,text", [
    (PAGE, "Head & line\nBold text.\nSecénd para graph <tag> a < b\none\ntwo\nc1 c2\ntail"), ("", ""), ("plain &am text <b>x</b>y", "plain &am text xy"),
    ("<article><p>a long story</article><p>outside", "a long story"), ("<article><p>a</article><p>outside", "a\noutside"),
    ("<div><p>The story itself stands here.<p>It goes on.</div><article><p>Read next</article>", "The story itself stands here.\nIt goes on.\nRead next"), ("<p>one<p>two<", "one\ntwo<"), ("<script>x", ""), ("<p class='x' title='a > b'>in", "in"),
    ("<div role=navigation>m</div><main>k<span class=advert>no</span>ept</main>", "k\nept"), ("<p>a<span>b</span>c", "abc"),
    # what names its layout, or a form around the page, doesn't lose the article
    ("<div class='has-sidebar'><p>text<div class=sidebar>s</div></div>", "text"), ("<div class='content-sidebar-wrap'><main><p>text</main><div class=sidebar>s", "text"),
    ("<form id=f><div class=menu>m</div><article><p>text</article></form>", "text"), ("<div class='share-form'><article><p>text<p class=ad>buy</article>", "text"),
    ("<aside><article>teaser</article></aside><article>story", "story"), ("<div><p>story</div><div class=comments><article>reader</article></div>", "story"),
    ("<article><header><h1>Head</h1></header><p>text</article>", "Head\ntext"), ("<header>top</header><p>text", "text"),
    ("<html><head><title>t</title><meta name=a><body><p>text", "text"),
    ("<svg><text>no</text></svg><p>yes<select><option>no</select>", "yes"),
])
def test_main_text(page, text):
    assert judge(sitetree.parse(page))[0] == text


def test_site_noise_and_edges(spark):
    rows = [(i, f"http://s.example/{i}", f"<body><div class=box1>Same teaser on every page</div><div class=story><p>Story number {i} tells {i * 7}</p></div>") for i in range(12)]
    rows += [(100 + i, "http://copies.example/", "<body><p>one page, ten times") for i in range(10)] + [(200, None, None), (200, "http://s.example/", ""), (None, "x", "<p>no host")]
    rows += [(300 + i, "http://odd.example/", "<body><p>T") for i in range(10)] + [(311, "http://odd.example/", "<body><div class=x><p>U")]  # copies aren't evidence
    rows += [(400 + i, "http://many.example/", f"<body><p>article {max(i - 85, 0)}") for i in range(100)] + [(501, "http://many.example/", "<body><div><p>odd")]
    rows += [(600 + i, "http://share.example/", f"<body><p>text {i}<div class=share-story>told by {i}</div><div class=related>Read more") for i in range(9)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "page_id long, url string, html string, host int, blocks string")
    got = {r["page_id"]: r for r in sitetree.extract(df).collect() if r["page_id"] != 200}
    out = {k: r["text"] for k, r in got.items()}
    assert out[3] == "Story number 3 tells 21" and out[105] == "one page, ten times" and out[None] == "no host"
    assert out[303] == "T" and out[311] == "U" and out[400] == "article 0" and out[490] == "article 5" and out[501] == "odd"
    assert out[604] == "text 4\ntold by 4" and (got[604]["cut_by_tree"], got[604]["cut_by_role"]) == (1, 0)
    assert got[3]["cut_by_tree"] == 1 and got[105]["cut_by_tree"] == 0
    assert [r["text"] for r in sitetree.extract(df).collect() if r["page_id"] == 200] == ["", ""]
    assert sitetree.extract(df.limit(0)).count() == 0


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts) / math.log(n) if n > 1 else 1.0


def brute_pages(rows):
    """The style tree as a tree of nodes, a host at a time."""
    out = []
    for host in {h for _, h, _ in rows}:
        mine = [(i, sitetree.parse(page or "")) for i, h, page in rows if h == host]
        leaf, look = {}, {}
        for blocks in {tuple((b.path, b.text) for b in blocks) for _, blocks in mine}:
            own, kids = {}, {}
            for path, text in blocks:
                own.setdefault(path, []).append(text)
                parts = path.split("/")
                for k in range(2, len(parts)):
                    kids.setdefault("/".join(parts[:k]), []).append(parts[k])
            for p, t in own.items():
                leaf.setdefault(p, []).append(tuple(t))
            for p, t in kids.items():
                look.setdefault(p, []).append(tuple(x for i, x in enumerate(t) if not i or t[i - 1] != x))
        count = lambda xs: list(collections.Counter(xs).values())
        importance, pages = {}, {}
        for p in {"/".join(p.split("/")[:k]) for p in leaf for k in range(2, p.count("/") + 2)}:
            below = [(len(x), entropy(count(x))) for q, x in leaf.items() if q == p or q.startswith(p + "/")]
            content = sum(n * e for n, e in below) / sum(n for n, _ in below)
            importance[p] = content if p not in look else 0.1 * entropy(count(look[p])) + 0.9 * content
            pages[p] = max(n for n, _ in below)
        known = [p for p in importance if pages[p] >= 8]
        noise = [p for p in known if importance[p] <= 0.75 and not any(importance[q] > 0.75 for q in known if q == p or q.startswith(p + "/"))]
        varied = [p for p in known if importance[p] * 0.8 > 0.75]
        out += [(i, *judge(blocks, noise, varied)) for i, blocks in mine]
    return sorted(out)


def test_tree_equals_brute_force(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("alpha bravo carol delta echo fox golf".split()) for _ in range(n))
    menus, boxes = [say(3) for _ in range(3)], [say(4) for _ in range(4)]
    parts = [
        lambda: f"<div class=top><ul><li>{rng.choice(menus)}<li>{rng.choice(menus[:2])}</ul></div>", lambda: f"<div class=box>{rng.choice(boxes)}</div>",
        lambda: f"<div class=story><p>{say(9)}<p>{say(rng.randrange(1, 9))}</div>", lambda: f"<div class=share>{rng.choice([say(8), 'Share'])}</div>", lambda: f"<footer>{say(1)}</footer>",
        lambda: f"<div class='ad x{rng.randrange(2)}'>{say(2)}</div>", lambda: f"<article><h2>Part</h2><p>{say(6)}<div class=related>{say(1)}</div></article>", lambda: f"<form>{say(1)}</form>",
        lambda: f"<table><tr><td>{rng.choice(boxes[:2])}<td>{say(2)}</table>",
    ]
    rows = []
    for i in range(400):
        mine = parts if i % 3 else parts[:6]
        rows.append((i, f"http://h{i % 5 if i % 7 else 9}.example/{i}", "<body>" + "".join(rng.choice(mine)() for _ in range(rng.randrange(7)))))
    rows += [(1000 + i, rows[i][1], rows[3][2]) for i in range(40)] + [(2000, "http://h1.example/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["text"], r["cut_by_tree"], r["cut_by_role"]) for r in sitetree.extract(df).collect())
    want = brute_pages([(i, u.split("/")[2], h) for i, u, h in rows])
    assert got == want and sum(w[2] for w in want) > 100 and sum(w[3] for w in want) > 100


def test_long_page(spark):
    page = "<article>" + "".join(f"<p>para {i}</p>" for i in range(20_000)) + "<div>" * 3000 + "deep" + "<" * 3000 + '"' * 3000
    blocks = sitetree.parse(page)
    assert len(judge(blocks)[0].split("\n")) >= 20_000 and max(len(b.path) for b in blocks) < 1000
    df = spark.createDataFrame([(1, "http://a.example", page)], "page_id long, url string, html string")
    assert sitetree.extract(df).first()["text"] == judge(blocks)[0]
