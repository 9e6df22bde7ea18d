"""WARC, HTML and embeddings against brute force."""

import hashlib
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import embed_dedup, html_extract, queries, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
ROWS = [
    (1, "u", FAKE),
    (2, "u", FAKE * 5 + "WARC/1.1\r\n"),
    (3, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\n" + "x" * 50_000 + FAKE),
    (4, "u", None),
    (5, None, ""),
    (6, "u y\r\n", FAKE),
    (7, "u", "WARC/1.1\r\n\r\n\r\n"),
    (8, "u", "a" * 99),
    (9, "u", "a" * 99),
    (10, "u", "é" * 50),
    (11, "u", "é" * 50),
    (12, "u", "é" * 50),
    *[(100 + i, "u", FAKE * (i % 7) + f"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: {i * 37}\r\n\r\n") for i in range(120)],
]


def brute(rows):
    first, out = {}, {}
    data = {i: (h or "").encode() for i, _, h in rows}
    for i in sorted(data):
        if len(data[i]) >= 100:
            first.setdefault(data[i], i)
    for i, b in data.items():
        again = len(b) >= 100 and first[b] != i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)
    return out


@pytest.fixture
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("splits", ["128m", "7001", "997"], indirect=True)
@pytest.mark.parametrize("small", [20_000, 0])
def test_warc_round_trip(spark, splits, small, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", small)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).coalesce(3)
    got = {int(r.record_id[10:-1]): r for r in warc.archive(spark, pages).collect()}
    want = brute(ROWS)
    assert set(got) == set(want)
    for i, _, html in ROWS:
        size, digest, kind, refers = want[i]
        r = got[i]
        assert (r.http_length, r.digest, r.record_type, r.refers_to, r.digest_ok) == (size, digest, kind, f"<urn:page:{refers}>" if refers is not None else None, True)
        assert r.payload == (None if kind == "revisit" else (html or "").encode())


def test_warc_query_and_edges(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op2_warc(spark, str(tmp_path)).collect()}
    assert got == brute(ROWS)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, "u", "n" * 200), (1, "u", "n" * 200), (1, "u", "n" * 200)], empty.schema)
    kinds = [r.record_type for r in warc.archive(spark, odd).collect()]
    assert kinds == ["response"] * 3


@pytest.mark.parametrize("splits", ["128m", "7001"], indirect=True)
def test_warc_keeps_what_follows_odd_pages(spark, splits):
    """Addresses of 70 KB and 5 MB, and lengths of 20 and 5,000 digits in payloads."""
    header = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    html = {1: header.format("9" * 20), 3: header.format("9" * 5000), 5: header.format("\u0663"), 7: "HTTP\r\nContent-Length: " + "9" * 5000 + "\r\n\r\n"}
    size = {2: 70_000, 4: 5_000_000 if spark.conf.get("spark.sql.files.maxPartitionBytes") == "128m" else 200_000}
    rows = [(i, "u" * size.get(i, 9), f"<p>{i}" + html.get(i, "")) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {int(r.record_id[10:-1]): (r.target_uri, r.payload.decode()) for r in warc.archive(spark, pages).collect()}
    assert got == {i: (url, html) for i, url, html in rows}


def test_broken_archive_keeps_what_is_reachable(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(i, "u", b"p" * 50) for i in range(9)], "page_id long, url string, payload binary").coalesce(1), f"{tmp_path}/w")
    part = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size)
    raw = part.read_bytes()
    offsets = [i for i in range(len(raw)) if raw.startswith(b"WARC/1.1\r\n", i)]
    damaged = raw[: offsets[4]] + raw[offsets[4] :].replace(b"Content-Length: ", b"Content-Lungth: ", 3)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc").write_bytes(damaged)
    got = warc.read_warc(spark, f"{tmp_path}/d").collect()
    assert sorted(r.offset for r in got) == offsets[:4]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies for the site and you</div>
<aside>Side with the words of a bar</aside><!-- c --><article><h1>Head &amp; line</h1><p>The first of the paragraphs is <b>here</b> and it has a lot of
 words.<br>More.</p><div class="ad">Buy the thing now and here</div><p>Short.</p><form><p>Name of the user</p></form>
<ul><li>One of the items<li>Two &lt;b&gt;</ul><p>Unclosed and last</article>
<section id="comments"><article class="comment"><p>I think that this is the best of all.</p></article></section><footer>&copy; 2024 by us</footer></body></html>"""


def test_html_article():
    want = ["Head & line", "The first of the paragraphs is here and it has a lot of words. More.", "Short.", "One of the items", "Two <b>", "Unclosed and last"]
    assert html_extract.main_text(PAGE).split("\n\n") == want


def test_html_without_article():
    text = "This is a long paragraph of the text that has many of the common words in it and goes on for a while so that it is good, and then it goes on. "
    page = f"<div><a href=x>Link one</a> <a href=y>Link two</a></div><div><h2>Title</h2><p>{text * 2}</p><p>Short one.</p><p>{text}</p></div><div>Xqz vrt plk mnb wwq zzt kkl ppo qqw rrt yyu iio ppa ssd vbn mmk lop qwz xxs plm</div>"
    assert html_extract.main_text(page).split("\n\n") == ["Title", (text * 2).strip(), "Short one.", text.strip()]
    wrapped = f'<div class="page has-sidebar"><article><p>{text}</p></article><div class="sidebar">{text}</div></div>'
    assert html_extract.main_text(wrapped) == text.strip()
    for odd in (None, "", "<", "<p", "<p>", "</p></div>", "a < b", "<script>x", "<!-- x", "<p hidden>x</p>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("<article>" + "<b>x</b> " * 20_000) == " ".join(["x"] * 20_000)


@pytest.mark.parametrize(
    "sentence",
    ["\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u3002", "\u041e\u043d \u043f\u043e\u0448\u0451\u043b \u0432 \u043f\u0430\u0440\u043a \u0438 \u0434\u043e\u043b\u0433\u043e \u0433\u0443\u043b\u044f\u043b. ", "\u0630\u0647\u0628 \u0625\u0644\u0649 \u0627\u0644\u062d\u062f\u064a\u0642\u0629 \u0648\u0645\u0634\u0649 \u0637\u0648\u064a\u0644\u0627. ", "Poszed\u0142 do parku i d\u0142ugo spacerowa\u0142. "],
)
def test_html_without_article_in_other_languages(sentence):
    text = (sentence * 12).strip()
    page = f'<body><nav><a href="/">x</a></nav><div id="text"><h1>{sentence.strip()}</h1><p>{text}</p><p>{sentence.strip()}</p><p>{text}</p></div><div class="footer">{text}</div><p><a href="/1">{text}</a></p></body>'
    assert html_extract.main_text(page).split("\n\n") == [sentence.strip(), text, sentence.strip(), text]


def test_html_elements_within_a_line():
    article = lambda x: html_extract.main_text(f"<article><p>It was the best of times and it was the worst of times for all of us.</p>{x}</article>").split("\n\n")[1:]
    assert article('<pre><code>x = 1 <span class="comment"># add one</span>\ny</code></pre>') == ["x = 1 # add one y"]
    assert article('<pre><span class="comment"># alone</span></pre>') == ["# alone"]
    assert article("<p>Press <label>Ctrl</label> and <button>Save</button> to keep it</p>") == ["Press Ctrl and Save to keep it"]
    assert article("<p><button>Subscribe</button> <label>Mail</label></p>") == [] == article('<p><span class="advert">Buy this now</span></p>')
    assert article('<div>Some of it <span class="advert">Buy this now</span></div>') == ["Some of it"]


def test_html_article_is_a_prior():
    text = "The main text is in a plain part of the page and it has all of the words that there are to read. " * 3
    teaser = "<article><h3>More</h3><p>This is a card of the site and it has a few words for you to read.</p></article>"
    assert html_extract.main_text(f"<div><p>{text}</p><p>{text}</p></div>{teaser}").split("\n\n")[:2] == [text.strip()] * 2
    link = "<p><a href='/x'>The other pages of this site that you may want to see</a></p>"
    page = f"<p>{text}</p>outside<article><p>{text}</p><p>Short.</p><p>{text}</p>{link}<p>Go on</p>{link}</article>"
    linked = "The other pages of this site that you may want to see"
    assert html_extract.main_text(page).split("\n\n") == [text.strip(), "Short.", text.strip(), linked, "Go on", linked]
    assert html_extract.main_text("<p>out</p><article><p>12 34</p><p>56 78</p></article>") == "12 34\n\n56 78"


def test_html_article_stays_whole():
    text = "The first of the paragraphs is here and it has a lot of the words that it needs to be one of them."
    parts = {
        f"<p>See <a href=x>{text}</a>.</p>": f"See {text}.",
        f"<ul><li><a href=x>{text}</a></li></ul>": text,
        "<table><tr><td><a href=x>Cell</a></td></tr></table>": "Cell",
        "<p>Formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds for all of them</p>": "Formula x=1 holds for all of them",
        f'<p class="search-for-truth">{text}</p>': text,
        f'<p class="notice-board" hidden>{text}</p>': text,
        f'<p style="display:none">{text}</p>': text,
    }
    for markup, want in parts.items():
        assert html_extract.main_text(f"<article><p>{text}</p>{markup}<p>{text}</p></article>") == f"{text}\n\n{want}\n\n{text}"
    for name in ("ad", "ad-slot-3", "cookie-banner", "site-nav", "comment-list", "sidebar-left", "share", "newsletter_box"):
        assert html_extract.main_text(f'<article><p>{text}</p><div class="x {name}">{text}</div></article>') == text


@pytest.mark.parametrize("unit", ["<a ", "<p>x</p>", "<script ", "<!--", "<!", "<br ", "<b>x", "<b><i>x</u>", "<center><p>x</p>", "</i>", "<p>a<h1>b", "<a '", '<a "', "<li><b>", "&amp", "<i><p><b></i>"])
def test_html_takes_linear_time(unit):
    html_extract.main_text(unit * 100)
    began = time.process_time()
    html_extract.main_text(unit * 40_000)
    assert time.process_time() - began < 8


class Reading(HTMLParser):
    """The text of article elements, by block, without what is in an element of class ad."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "li", "div", "ul", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "li", "div", "ul", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_of_the_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    whole = found = wrong = 0
    for r in rows:
        want = "\n\n".join(filter(None, (" ".join(b.split()) for b in Reading(r.html).blocks)))
        assert html_extract.main_text(r.html) == want
        # Without the article's element the passes alone find nearly all of it.
        plain = html_extract.main_text(r.html.replace("article>", "section>")).split("\n\n")
        whole += len(want)
        found += sum(len(b) for b in plain if b in want)
        wrong += sum(len(b) for b in plain if b not in want)
    assert found > 0.97 * whole and wrong < 0.01 * whole


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars == len(r.text)) for r in got) == [("1", "u", True), ("1", "u", True), ("2", "v", True), ("None", "None", True)]
    assert html_extract.extract(df.where("false")).count() == 0


def brute_links(rows):
    ok = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(rows)
    up, count = list(range(n)), [0] * n

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    count[a] += 1
                    count[b] += 1
                    i, j = sorted((top(a), top(b)), key=lambda t: rows[t][0])
                    up[j] = i
    return {rows[i][0]: (count[i], rows[top(i)][0]) for i in range(n)}


@pytest.mark.parametrize("block", [2048, 60, 12])
def test_embeddings(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for b in rng.normal(size=(25, 16)):
        rows += [((b + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.15])).astype("f4").tolist(), int(rng.integers(0, 2))) for _ in range(rng.integers(1, 40))]
    order = rng.permutation(len(rows)).tolist()
    rows = [(order[i], v, label) for i, (v, label) in enumerate(rows)]
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, [1.0] * 3, 1), (9006, [], 0), (9007, [2.0] * 3, 1), (None, [1.0] * 16, 1), (9008, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n_links": F.lit(1), "g": F.lit(1)})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, block=block).collect()}
    assert got == brute_links(rows)
    kept = {r.vec_id: r.kept for r in embed_dedup.near_duplicates(df, block=block).collect()}
    assert all(kept[k] == (got[k][1] == k) for k in kept if k is not None)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_cells_hold_all_neighbours():
    """Whatever pivots are drawn, each linked pair meets in both points' home cells."""
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.1 for c in rng.normal(size=(20, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    pivots = x[rng.permutation(len(x))[:16]]
    own, away = embed_dedup.places(pivots, x)
    radii = np.array([max(away[own == k], default=-9) for k in range(16)])
    goes = embed_dedup.visits(pivots, radii, x, own, float(np.sqrt(0.04)))
    assert all(goes[j, own[i]] for i, j in zip(*np.nonzero(near), strict=True)) and goes.mean() < 0.5 and near.sum() > 2000


@pytest.mark.parametrize(("spread", "size"), [(0.05, 12), (3.0, 5)])
def test_large_embedding_label(spark, spread, size):
    """A label of several blocks, clustered (cut by pivots) and not (dealt in blocks)."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, size))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, size)) * spread).astype("f4")
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, block=256).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    low = np.arange(3000)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 3000).min(1))
        if (new == low).all():
            break
        low = new
    assert got == {i: (int(near[i].sum()), int(low[i])) for i in range(3000)} and near.any()


def test_embedding_copies_are_not_paired(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    got = embed_dedup.near_duplicates(df).groupBy("n_links", "component_id").count().collect()
    assert [(r.n_links, r.component_id, r["count"]) for r in got] == [(4999, 0, 5000)]
