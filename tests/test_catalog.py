"""Every query with SQL against DuckDB on the smallest tables; the entry; what has no SQL."""

from __future__ import annotations

import math
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlight.functions import text as T
from ledgerlight.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.5g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["sector", "p25", "median", "p75", "n", "no_value", "reason"]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("\n" if tag in ("p", "br", "tr", "div", "li", "h1", "h2", "h3") else "\t" if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def plain(html):
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(x.strip() for x in "".join(p.out).splitlines() if x.strip())


ODD = [
    "<p>A &amp; B&nbsp;</p><!-- a > b --><div>x&#8212;y &#x41; &unknown; &eacute;</div>",
    "<script>if (a < b) {}</script>t<td>1</td><th>2</th><STYLE>p>q</STYLE><h1>H</h1>\u2003",
    "a < b & c<br/>d<pre>e</pre>",
    "",
]


def test_html_to_text_as_the_standard_parser(spark):
    rows = [(i, h) for i, h in enumerate(ODD)]
    got = spark.createDataFrame(rows, "i int, html string").select("i", T.html_to_text(F.col("html")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: plain(h) for i, h in rows}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in catalog.queries()["html_to_text"](spark, DIR).collect()}
    assert got == {i: None if h is None else plain(h) for i, h in pages.items()}


def test_scrub(spark):
    urls = ["https://a/?key=1&b=2", "https://a/?b=2&Token=x#f", "https://a/?password", "https://a/?monkey=1&xref=2", "see https://a/?api_key=1 and https://b/?c=1&access_token=2", "no url"]
    want = ["https://a/?b=2", "https://a/?b=2#f", "https://a/", "https://a/?monkey=1&xref=2", "see https://a/ and https://b/?c=1", "no url"]
    got = spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", T.scrub(F.col("u")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == want
