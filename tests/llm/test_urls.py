from __future__ import annotations

import random
import re

import pytest

from ledgerlight.llm import urls
from ledgerlight.llm.urls import RULES, url_verdicts


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def rule(host, path):
    best = (None, None)
    for verdict, r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best[0] or ""):
            best = (r, verdict)
    return best


URLS = [
    None, "", "no scheme", "http://A.COM/x", "http://com/", "http://com", "https://example.com/en/1?a=b", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://a.net/es/x", "http://net/fr/", "http://a.net/fr",
    "http://xcom/", "http://a.com?x=/en/", "://com/", "a://b://com/", "http://example.com/EN/", "http://\u0130.com/", "http://a.com/" + "x" * 50_000, "http://a.org/x\ny",
]


def test_rules(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()}
    for i, u in enumerate(URLS):
        r, verdict = rule(*parts(u))
        assert (got[i].host, got[i].path, got[i].rule) == (*parts(u), r), u
        assert got[i].verdict in ({verdict} if verdict else {"allow", "block"})


def test_trees_learn_from_ruled_urls(spark):
    rows = [(i, f"http://site{i % 50}.net/{'es' if i % 2 else 'en'}/page{i}?q={i}") for i in range(300)] + [(1000 + i, f"http://site{i}.com/en/{i}") for i in range(100)]
    rows += [(5000 + i, f"http://site{i}.org/{'es' if i % 2 else 'en'}/page{i}?q={i}") for i in range(40)]
    got = {r.page_id: r.verdict for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert set(got.values()) == {"allow", "block"}
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("small", [urls.SMALL, 3])
def test_rates_are_counted_over_all_labelled_urls(spark, monkeypatch, small):
    """Forty suffixes, each of one verdict, most of them absent from the sample of 20 urls; rates broadcast and joined by a shuffle."""
    monkeypatch.setattr(urls, "SMALL", small)
    verdict = {k: "block" if k * 7 % 5 < 2 else "allow" for k in range(40)}
    rows = [(k * 100 + i, f"http://r.t{k:02}/{i:02}") for k in verdict for i in range(20)] + [(9000 + k, f"http://q.t{k:02}/99") for k in verdict]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), [(v, f"r.t{k:02}/") for k, v in verdict.items()], max_rows=20).collect()
    assert len(got) == len(rows)
    assert {r.page_id - 9000: r.verdict for r in got if r.page_id >= 9000} == verdict


def test_trees_on_hosts_that_no_rule_fits(spark):
    """Rules cover two hosts; others of the same two manners, with suffixes never seen, are told apart by lexical features."""
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(1200):
        bad = i % 2 == 0
        host = ("spam.com" if bad else "good.com") if i % 3 else rng.choice(["a.org", "b.info", "c.eu"])
        tail = f"/x{rng.randrange(10**9)}?id={rng.randrange(10**8)}&s={rng.randrange(10**6)}&r=1" if bad else "/" + "/".join(rng.choice(["about", "news", "team", "help"]) for _ in range(2)) + "/"
        rows.append((i, f"https://{host}{tail}"))
        want[i] = "block" if bad else "allow"
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules=(("block", "spam.com/"), ("allow", "good.com/"))).collect()
    free = [r for r in got if r.rule is None]
    assert len(got) == 1200
    assert len(free) == 400
    assert sum(r.verdict == want[r.page_id] for r in free) > 0.9 * len(free)
