import re

from pyspark.sql import functions as F

from kpiforge.llm import urls

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules_equal_brute_force(spark):
    cases = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://com/de/1",
             "http://notcom/de/1", "ftp://ÄB.org", "no scheme", None, "http://h?x=/a://b", "://", "http://a.org#x/y", "http://x.com/fr",
             "HTTP://X.COM/de/../", "http://example.org/es", "http://badexample.org/es/", "http://u:p@h.org:80/p?q", "", "http://a b.org/ p\nq"]
    rows = list(enumerate(cases))
    d = spark.createDataFrame([(i, u, None) for i, u in rows], SCHEMA).withColumns({"host": F.lit(1), "features": F.lit(2), "rule": F.lit("z")})
    for r in urls.judge_urls(d).collect():
        host, path = parts(cases[r.page_id])
        verdict, text = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_the_model_learns_from_the_ruled_urls(spark):
    rows = [(i, f"http://s{i}.{'com' if i % 2 else 'net'}/{'de' if i % 3 else 'fr'}/{i}", None) for i in range(400)]
    out = urls.judge_urls(spark.createDataFrame(rows, SCHEMA)).where("rule IS NULL")
    right = out.where((F.col("path").startswith("/de/") & (F.col("verdict") == "block"))
                      | (F.col("path").startswith("/fr/") & (F.col("verdict") == "allow"))).count()
    assert right >= 0.95 * out.count()


def test_odd_tables(spark):
    none = spark.createDataFrame([(1, "http://x.net/a", None), (1, "http://x.net/a", None), (None, "http://y.net/" + "p" * 20_000, None)], SCHEMA)
    assert [r.verdict for r in urls.judge_urls(none).collect()] == ["allow"] * 3
    one = spark.createDataFrame([(1, "http://x.com/de/", None), (2, None, None)], SCHEMA)
    assert {r.page_id: r.verdict for r in urls.judge_urls(one).collect()} == {1: "block", 2: "block"}
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    d = spark.createDataFrame([(i, f"http://x.{'com' if i % 2 else 'org'}/{'de' if i % 3 else 'fr'}/{i}", None) for i in range(30)], SCHEMA)
    urls.judge_urls(d).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
