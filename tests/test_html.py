"""Link tags and href values against literal cases and an HTML parser."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from linkloom.functions import html as H


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.bases = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "base"):
            href = next((v for k, v in attrs if k == "href"), None)
            if href is not None:
                (self.hrefs if tag == "a" else self.bases).append(href)


def parsed(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    return [h.strip() for h in reader.hrefs if h.strip()], (reader.bases or [None])[0]


def ours(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, html string")
    tags = H.link_tags(F.col("html"))
    df = df.select("i", H.anchor_hrefs(tags).alias("hrefs"), H.base_href(tags).alias("base"))
    return [(r["hrefs"], r["base"]) for r in df.orderBy("i").collect()]


CASES = [
    "", "no tags at all", '<a href="">empty</a>', '<a name="x">no href</a>', "<a href>bare</a>",
    '<a href="/x">1</a><A HREF=\'/y\'>2</A><a href=/z>3</a>', '<a href = "/sp" >s</a>',
    '<a class="a > b" href="/q">', '<a data-href="/no" href="/yes">', '<a title=\'href="/no"\' href="/yes2">',
    '<!-- <a href="/c"> --><a href="/d">', '<script>var s="<a href=\'/s\'>";</script><a href="/e">',
    '<style>a{b:"<a href=/t>"}</style><a href="/f">', '<img alt="<a href=\'/in\'>"><a href="/g">',
    '<abbr href="/no"><area href="/no"><link href="/no"><a href="/h">', "<a href='/3/tut/'>unclosed",
    '<a href="?a=1&amp;b=2&lt;&#65;&#x42;&eacute;&nosuch;">', '<a href="  /strip\n ">', '<a\nhref="/nl"\n>',
    '<a href="/1" href="/2">', '<base href="https://h/lib/"><a href="os.html">', '<base target="_x"><base href="/b"><a href=x>',
    '<a href="/x"class="y">', "<a/href='/slash'>", "<a href=a>b<a href=c>", "a < b <a href='/lt'>", "<ahref='/no'>",
    '<a href="/&amp;amp;">', "<p <a href='/odd'>>", "<a href='/e&apos;x'>", '<a href="/ué?你">',
    "<!doctype html><?php x ?><a href='/pi'>", "</a href='/end'><a href='/after-end'>", "<a ID=x HREF=\"/Up\">",
    '<textarea>x</textarea><a href="/ta">', "<script src='a.js'></script><a href='/js'>", "<a href='/x' onclick='a>b'><a href='/y'>",
]


def test_cases_equal_parser(spark):
    got = ours(spark, CASES)
    bad = [(c, g, parsed(c)) for c, g in zip(CASES, got) if (list(g[0]), g[1]) != parsed(c)]
    assert not bad, bad


def test_pages_equal_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    docs = [r["html"] for r in pages.collect()]
    got = ours(spark, docs)
    assert [(list(h), b) for h, b in got] == [parsed(d) for d in docs]
    assert sum(len(h) for h, _ in got) > 1000


def test_names_need_semicolons_numbers_do_not(spark):
    docs = ['<a href="?x=1&copy=2&amp=3&#65b">', '<a href="a&#0;b&#xD800;&#x110000;c">']
    assert [list(h) for h, _ in ours(spark, docs)] == [["?x=1&copy=2&amp=3Ab"], ["abc"]]


def test_unterminated_parts_swallow_the_rest(spark):
    docs = ["<a href=/x><!-- open <a href=/y>", "<a href=/x><script> open <a href=/y>"]
    assert [list(h) for h, _ in ours(spark, docs)] == [["/x"], ["/x"]]


def test_awkward_large_pages_stay_linear(spark):
    docs = [
        "<a " + "x=1 " * 200_000 + "href='/many'>",
        "<" * 300_000 + "<a href='/lt'>",
        "<a " * 100_000,
        "<!--" * 100_000,
        "<a href=" * 100_000,
        "<a " + "y" * 500_000 + " href='/long'>",
        "<p " + "'" * 300_001,
    ]
    got = ours(spark, docs)
    assert list(got[0][0]) == ["/many"] and list(got[1][0]) == ["/lt"] and list(got[5][0]) == ["/long"]
