import random

from covenant.llm import urls
from covenant.llm.urls import url_verdicts


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("b.net", "/e", "block"), ("net", "", "allow"), ("b.net", "/e", "allow"), ("org", "/a/b?", "block"), ("a.b", "/c/d", "block")]
ODD = [None, "", "no scheme/com/", "http://", "http://COM", "http://com/", "https://WWW.Example.com/en/", "http://x.example.com/en/?q", "http://.com/",
       "http://com./", "http://a.net/es/x#y", "http://b.net/ex", "http://b.net?x=/e", "a://b://net/es/", "http://é.example.com/en/ü", "http://x.com:80/",
       "http://net" + "/es" * 3000, "http://" + "a." * 2000 + "net/es/", "http://a.net/\nes/"]


def rows_of(spark, pages):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, rule string").repartition(3)


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    parts = ["a", "b", "net", "com", "example", "www", "e", "es", "en", "c", "d"]
    pages = list(enumerate(ODD)) + [(None, "http://b.net/e"), (None, "http://b.net/e"), (3, "http://net/es/"), (3, "http://net/es/")]
    pages += [(100 + i, "http://" + ".".join(rnd.choices(parts, k=rnd.randint(1, 4))) + "/" + "/".join(rnd.choices(parts, k=rnd.randint(0, 4)))) for i in range(300)]
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("com", None, "block"), ("com", "/", "other")], "host string, path string, action string")
    want = sorted(((i, *brute(u, RULES)) for i, u in pages), key=repr)
    for bound in (urls.BROADCAST_RULES, 0):       # broadcast and salted shuffle join
        monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
        got = [tuple(r) for r in url_verdicts(rows_of(spark, pages), rules).collect()]
        assert sorted(got, key=repr) == want


def test_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert url_verdicts(rows_of(spark, []), rules).collect() == []
    assert url_verdicts(rows_of(spark, [(1, "http://a.com/")]), rules).first().verdict == "allow"
