"""Main texts of pages against plain readings of their markup, and style trees against entropies computed by hand."""

import math
import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from tracewell.llm.site_style import Page, main_text, site_of, style_trees


def alone(source):
    """The main text of a page that is a site of its own."""
    page = Page.parsed(source, "s")
    return page.main_text({k: (1.0, 1.0, 1) for k in page.key})


def plainly(source):
    """The tables' pages: blocks of the article, by regular expressions."""
    article = re.search("<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
    return "\n".join(b for b in blocks if b)


def test_all_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert got == {r.page_id: (r.url, plainly(r.html), len(plainly(r.html))) for r in rows}


@pytest.mark.parametrize("source, expected", [
    ("", ""),
    ("plain &lt;b&gt; text\n\n&amp;amp; more", "plain <b> text &amp; more"),
    ("<p>one<p>two<br>three</p>four<div>five<ul><li>six<li>seven</ul></div>", "one\ntwo three\nfour\nfive\nsix\nseven"),
    ("<title>t</title><header><h1>site</h1></header><nav><a href=/>home</a></nav><main><h1>T</h1><p>x</p></main><footer>f</footer>", "T\nx"),
    ("<main><h1>no</h1><article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>tags</footer></article></main>", "T\nx"),
    ("<article><p>x</p><aside>more</aside><form><label>mail</label><input></form><div class='ad-slot'>buy</div>"
     "<div class='cookie-notice'>we use</div><section id=comments><article class=comment><p>nice</p></article></section></article>", "x"),
    ("<div class='page has-sidebar'><article class='post with-comments'><p>x</p></article><div class=sidebar><p>y</p></div></div>", "x"),
    ("<div class=related><article><p>teaser</p></article></div><article><p>x</p></article>", "x"),
    ("<div class=widget><article><p>x</p></article></div>", "x"),
    ("<aside><article><p>teaser</p></article></aside><div><p>x</p></div>", "x"),
    ("<article><p>a <span class=ad>buy</span> b <b class=x>c</b> <script>var t='</p>';</script>d</p></article>", "a b c d"),
    ("<article><h1>t</h1><table><tr><td>1<td>2<tr><td>3</table><pre>a\n  b</pre><blockquote>q</blockquote></article>", "t\n1\n2\n3\na b\nq"),
    ("<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><div><p>see <a href=c>three</a>.</p></div>", "see three."),
    ("<div class='entry-content'><p>x</p></div><div class=x><p>y</p></div>", "x"),
    ("<article><p title='a>b'>x < y & z <!-- <p>no --> w<!-->v</p><style>p{}</style><p>open <b>never closed", "x < y & z wv\nopen never closed"),
    ("<article><p hidden>no<p>yes<p class=a&nbsp;b>a&nbsp;&#x41;&#66;&notin;&bogus;", "yes\na AB∉&bogus;"),
    ("<ARTICLE><P>Upper</P></ARTICLE><SCRIPT>x", "Upper"),
    ("<article><p>kept</p></article></div></p></article><p>outside", "kept"),
])
def test_pages_alone(source, expected):
    assert alone(source) == expected


SCHEMA = "page_id long, url string, html string"
FRAME = ("<body><div class=top><div class=logo>The Site</div><div class=x1>Subscribe today</div></div><div class=mid>{}</div>"
         "<div class=low>Terms and conditions</div></body>")


def test_repeated_branches_go(spark):
    rows = [(i, f"https://user@Plain.example:80/{i}", FRAME.format("".join(f"<p>text {i} {k}</p>" for k in range(1 + i % 3)))) for i in range(9)]
    # a site with articles: the repeated list in them is furniture, repeated paragraphs are not
    rows += [(100 + i, f"//b.example/{i}", f"<article><p>all alike</p><p>own {i}</p><div class=z><p>Share</p><p>Like</p></div></article>") for i in range(6)]
    # a site whose articles are all copies keeps them
    rows += [(200 + i, f"http://c.example/{i}", f"<nav>{i}</nav><article><p>copy</p><ul><li>same</li></ul></article>") for i in range(6)]
    # one page alone has nothing to be compared with
    rows += [(300, "http://d.example", FRAME.format("<p>single</p>"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i in range(9):
        assert got[i] == "\n".join(f"text {i} {k}" for k in range(1 + i % 3))
    for i in range(6):
        assert got[100 + i] == f"all alike\nown {i}"
        assert got[200 + i] == "copy\nsame"
    assert got[300] == "The Site\nSubscribe today\nsingle\nTerms and conditions"


def test_style_trees(spark):
    bodies = [[("p", "a"), ("p", "b")], [("p", "a")], [("div", "c"), ("p", "a")], [("p", "a")], [("p", "a")]]
    pages = [Page.parsed("".join(f"<{t}>{x}</{t}>" for t, x in b), "s") for b in bodies]
    rows = [p.observed() for p in pages]
    assert len({r[0] for r in rows}) == 3  # equal pages are one
    frame = spark.createDataFrame([(r[0], r[2], list(r[3]), list(r[4]), list(r[5])) for r in rows],
                                  "page long, nodes array<long>, node array<long>, is_text array<boolean>, value array<long>")
    got = {r.node: (r.pages, round(r.presentation, 9), round(r.content, 9)) for r in style_trees(frame).collect()}
    distinct = [[("p", "a"), ("p", "b")], [("p", "a")], [("div", "c"), ("p", "a")]]
    texts, styles, has = defaultdict(Counter), defaultdict(Counter), Counter()
    for b in distinct:
        styles["root"][tuple(t for t, _ in b)] += 1
        has["root"] += 1
        for t in {t for t, _ in b}:
            has[t] += 1
            styles[t][()] += 1
        for t, x in set(b):
            texts[t][x] += 1

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values())

    names = dict(zip(pages[2].key, ("root", "div", "p")))
    expected = {}
    for key, name in names.items():
        m = has[name]
        own = entropy(styles[name]) / math.log(m) if m > 1 else 1.0
        content = 1 - sum(math.log(n) / math.log(m) for n in texts[name].values()) / len(texts[name]) if m > 1 and texts[name] else 1.0
        expected[key] = (m, round(own, 9), round(content, 9))
    assert got == expected


def test_odd_pages(spark):
    deep, long = "<div>" * 30000 + "deep", "<p>word &amp; " * 60000
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "http://e.example", "<article><p>x"), (3, "not a url", "<p>x</p>"), (4, None, deep),
            (5, "http://e.example", long), (6, "http://e.example", "<p class=\"open>never"), (7, "http://e.example", "<" * 1000 + "a" + ">" * 10)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(3)).withColumn("outline", F.lit(1)).withColumn("nodes", F.lit("n"))
    got = main_text(frame)
    assert got.columns == ["page_id", "url", "outline", "nodes", "text", "n_chars"]
    by_id = defaultdict(list)
    for r in got.collect():
        assert r.n_chars == len(r.text) and r.outline == 1 and r.nodes == "n"
        by_id[r.page_id].append(r.text)
    assert by_id[1] == ["", ""] and by_id[2] == [""] and by_id[None] == ["x"] and by_id[3] == ["x"] and by_id[4] == ["deep"]
    assert by_id[5] == ["\n".join(["word &"] * 60000)] and by_id[6] == [""] and len(by_id) == 8
    assert main_text(frame.limit(0)).collect() == []


def test_sites(spark):
    urls = ["http://a.b/c", "HTTPS://u:p@A.b:8080?x", "//a.b", " http://a.b#f", "mailto:x", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(site_of(F.col("u"), F.lit("page"))).collect()]
    assert got[:4] == ["a.b"] * 4 and got[4] == got[5] and got[4].startswith("?")
