import re

from cadenza.llm.url_filter import LISTED, judge

SCHEMA = "page_id long, url string, host string, mean string"


def brute(url):
    url = url or ""
    _, sep, rest = url.partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in LISTED:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_rules_equal_brute_force(spark):
    urls = [
        None, "", "no scheme/x", "http://", "://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/x", "http://example.org/es", "http://notexample.org/es/", "http://a.example.org/en/15?x=/de/", "http://example.com/de/",
        "http://x.com/fr/#://y.org/", "http://x.com?u=http://b.org/", "http://ÉCOLE.com/de/é", "http://xcom/de/", "http://.com/de/", "http://user@h.net:80/a b\nc", "http://com/de/", "a://b://c/d",
    ]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame([(i, u, "h", "m") for i, u in enumerate(urls)], SCHEMA)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")


def test_reputation_follows_labels_and_shrinks(spark):
    rows = [(i, f"http://bad.site.com/de/{i}", "", "") for i in range(60)] + [(100 + i, f"http://good.fine.com/fr/{i}", "", "") for i in range(60)]
    rows += [(200, "http://bad.site.com/x", "", ""), (201, "http://good.fine.com/x", "", ""), (202, "http://new.site.com/x", "", ""), (203, "http://other.net/x", "", "")]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow"
    assert got[201]["mean"] < got[203]["mean"] < got[202]["mean"] <= got[200]["mean"]
    assert got[202]["bound"] < got[200]["bound"]


def test_own_outcomes_and_empty_tables(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.net/{i}", "", "") for i in range(40)], SCHEMA)
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(30)], "page_id long, outcome int")
    got = {r["page_id"]: r["verdict"] for r in judge(pages, rules=[], outcomes=outcomes).collect()}
    assert got[38] == "allow" and got[39] == "block"
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []
