from vaultshift.llm import url_filter as U


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v == "block", h + p) for h, p, v in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, ("block" if best[1] else "allow") if best else default


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/e", "allow"), ("a.b.c.d", "", "block"), ("dup.org", "/x", "allow"), ("dup.org", "/x", "block"), (None, "/", "block"),
         ("é.org", "/ü", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "https://x.example.com/en/é", "http://a.com",
        "http://a.com?/en/", "http://com/", "http://notcom/", "http://.com/", "x://y://z.net/es/1", "http://n.net/es", "http://n.net/es/#", "http://q.a.b.c.d",
        "http://dup.org/xyz", "http://é.org/üx", "http://ex.com:80/en/", "http://user@net/es/a", "http://h" + ".a" * 3000 + ".com/" + "p/" * 3000, "http://a\n.com/\nen"]


def test_against_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:6])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    for rules in (RULES, RULES[:1], []):
        r = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.judge_urls(pages, r).collect()}
        assert got == {i: brute(u, rules) for i, u, *_ in rows}
    assert U.judge_urls(pages.limit(0), r).count() == 0
