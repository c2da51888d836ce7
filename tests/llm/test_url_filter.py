import math
import re

import pytest

from readalike.llm import url_filter as uf


def brute(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda r: len(r[0])) if fits else (None, None))


URLS = ["http://a.example.org/es/1", "http://example.org/en/12", "http://xexample.org/en/1", "https://A.B.ORG", "https://org/",
        "http://x.com/fr/?a=b&c", "http://x.com/de/#/fr/", "x.com/de/", None, "", "a://b://c/de/", "http://com/de/" + "y" * 200_000,
        "HTTP://É.com/fr/é?x", "http://h?//org/", "http://x.net/\n/de/"]


def test_rules_equal_brute_force(spark, store):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[0], "x"), (3, URLS[3], "x")]
    found = uf.verdicts(spark.createDataFrame(rows, "page_id long, url string, verdict string"), store).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_features(spark):
    url = "https://www.a-b.example.com/x/12.html?p=1&q=2#f"
    row = uf.lexical(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert row["entropy"] == pytest.approx(-sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url)))
    assert [row[c] for c in ("n_labels", "depth", "n_parameters", "n_hyphens", "has_fragment", "secure", "tld", "ending")] == [
        4, 2, 2, 1, 1, 1, "com", "html"]
    assert row["digit_ratio"] == pytest.approx(4 / len(url))


def test_trees_learn_what_the_rules_say(spark, store):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = uf.verdicts(pages, store)
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert model.filter("rule IS NULL AND (blocked < 0 OR blocked > 1 OR blocked IS NULL)").count() == 0
    assert model.filter("rule IS NULL").select("verdict").distinct().count() == 2


def test_empty_and_one_sided_tables(spark, store):
    schema = "page_id long, url string"
    assert uf.verdicts(spark.createDataFrame([], schema), store).count() == 0
    only = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/")], schema)
    assert {r["verdict"] for r in uf.verdicts(only, store).collect()} == {"allow"}


def test_statistics_count_all_labelled_urls(spark, store, monkeypatch):
    urls = [f"http://h{k}.{'org' if k % 3 else 'com'}/{'x' if k % 3 else 'de'}/{k}.e{k % 40}" for k in range(400)]
    urls = [u.replace("/x/", "/") for u in urls] + ["http://n.net/1.e1", None]
    made, real = {}, uf.suffix_statistics
    monkeypatch.setattr(uf, "suffix_statistics", lambda labelled, name, rate, store: made.setdefault(name, real(labelled, name, rate, store)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert uf.verdicts(pages, store, rows=30).count() == len(urls)
    labelled = [(u, brute(u)[3] == "block") for u in urls if brute(u)[2]]
    rate = sum(b for _, b in labelled) / len(labelled)
    for name, pattern in (("tld", r"//[^/]*\.(\w+)/"), ("ending", r"\.(\w+)$")):
        groups = {}
        for url, blocked in labelled:
            groups.setdefault(re.search(pattern, url)[1], []).append(blocked)
        found = {r[0]: r[1:] for r in made[name].collect()}
        assert found == {value: (pytest.approx(math.log1p(len(g))), pytest.approx((sum(g) + uf.PRIOR * rate) / (len(g) + uf.PRIOR)))
                         for value, g in groups.items()}
