import re

from pyspark.sql import functions as F

from usagelens.llm.query_models import URL_RULES
from usagelens.llm.url_rules import judge_urls, tokens

def block():
    return F.col("quality") == 0


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def given(url):
    host, path = split(url)
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = [
    "http://a.com/", "http://com/", "http://a.com", "http://a.com?x=/", "HTTP://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/q",
    "http://example.com/en", "http://notexample.com/en/", "http://a.net/es/", "http://a.net/fr/#es", "http://a.net/de/", "http://net/es/x", "no scheme", "", None,
    "http://ÄB.NET/fr/", "http://a.net/fr/://b.com/", "http://b://c.com/", "://a.com/x", "http://a.net\n/es/", "http://example.com/en/?a=1#b", "http://user@a.com:80/x",
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "", "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string")


NO_LABELS = "doc_id long, quality int, toxic int, verdict string"


def test_hosts_paths_and_given_rules(spark):
    got = judge_urls(pages(spark, URLS), spark.createDataFrame([], NO_LABELS), URL_RULES, block()).collect()
    for r in got:
        rule, verdict = given(URLS[r.page_id])
        assert (r.host, r.path) == split(URLS[r.page_id])
        assert (r.rule, r.verdict) == (rule, verdict or "allow")
    assert len(got) == len(URLS)


def test_mined_rules_equal_counting(spark):
    urls = [f"http://s{i % 5}.org/{'ads' if i % 3 == 0 else 'news'}/{i}?{'buy' if i % 2 else 'id'}={i}" for i in range(300)]
    bad = {i for i in range(300) if i % 3 == 0 and i % 2} | {0, 2, 10}
    labels = spark.createDataFrame([(i, int(i not in bad), 0, "v") for i in range(300)] + [(1, 0, 0, "v"), (None, 0, 0, "v"), (9999, 0, 0, "v")], NO_LABELS)
    got = {r.page_id: r for r in judge_urls(pages(spark, urls), labels, [], block(), min_support=0.05, min_confidence=0.8).collect()}
    df = pages(spark, urls).select("page_id", tokens(F.col("url")).alias("t"))
    items = {r.page_id: frozenset(r.t) for r in df.collect()}
    bad |= {1}

    def confidence(rule):
        held = [i for i, t in items.items() if rule <= t]
        hit = sum(i in bad for i in held)
        return hit / len(held) if hit >= 0.05 * 300 else 0

    import itertools

    rules = {frozenset(c) for t in set(items.values()) for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    strong = {r: c for r in rules if (c := confidence(r)) >= 0.8}
    assert strong
    for i, t in items.items():
        best = max((c for r, c in strong.items() if r <= t), default=None)
        assert got[i].verdict == ("allow" if best is None else "block")
        assert (got[i].confidence is None) == (best is None) and (best is None or abs(got[i].confidence - best) < 1e-9)
        assert best is None or frozenset(got[i].because) in strong


def test_repeats_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "http://a.com/x"), (1, None), (1, None), (2, "http://a.net/es/"), (2, "http://a.net/es/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0, "v"), (2, None, 0, "v")], NO_LABELS)
    got = judge_urls(rows, labels, URL_RULES, block()).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "allow")] * 2 + [("2", "block")] * 2 + [("None", "allow")]
    assert judge_urls(rows.limit(0), labels, URL_RULES, block()).collect() == []


def test_main_path_is_native(spark, sf_dir):
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels")]
    plan = judge_urls(*tables, URL_RULES, block())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
