from logsieve.llm.queries import URL_RULES
from logsieve.llm.url_filters import url_verdicts


def plain(url):
    """Host, path and the longest fitting rule."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([i for i in map(rest[cut:].find, "?#") if i >= 0], default=len(rest))]
    fits = [r for r in URL_RULES for d, p in [r.split("/", 1)] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "nourl", "://", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/1", "http://a.example.com/en/",
    "http://b.www.example.com/en/z", "http://example.com/EN/1", "http://x.net/es/1", "http://net/fr/", "http://x.net?/fr/", "http://com",
    "http://com/", "http://telecom/x", "http://É.net/es", "a://b://c.net/es/", "http://h.org//a///b/", "http://h.org/" + "seg/" * 3000,
    "http://x.com#/en/", "http://user@h.net:80/es/", "http://h.org/a\nb/1",
]


def frames(spark, bad_of):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[7], None), (5, URLS[5], "x")]
    n = 1000
    for host in ("good.org", "bad.org", "mixed.org"):
        for part in ("news", "shop", "spam"):
            for k in range(30):
                rows.append((n, f"http://{host}/{part}/{k}.html", "y"))
                n += 1
        for k in range(20):
            rows.append((n, f"http://{host}/tag/word{'abcdefghijklmnopqrstuvwxyz'[k]}z", "y"))
            n += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = [(i, bad_of(u)) for i, u, _ in rows if u and i is not None and i % 2 == 0] + [(None, True), (1002, None)]
    return rows, pages, spark.createDataFrame(labels, "page_id long, bad boolean")


def test_parts_rules_and_templates(spark):
    rows, pages, labels = frames(spark, lambda u: "bad.org" in u or "mixed.org/spam" in u)
    got = url_verdicts(pages, labels, URL_RULES).collect()
    assert len(got) == len(rows)
    url_of = {i: u for i, u, _ in rows}
    url_of[None] = URLS[7]
    template = {}
    for r in got:
        host, path, rule = plain(url_of[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        want = URL_RULES[rule] if rule else "block" if "bad.org" in host or path.startswith("/spam") and host == "mixed.org" else "allow"
        assert r.verdict == want, r
        template.setdefault(host, set()).add(r.template)
    # alike branches are one template, the one that differs is its own, many different children are variable
    assert template["good.org"] == {"good.org/*/*.html", "good.org/tag/*"}
    assert "mixed.org/spam/*.html" in template["mixed.org"]


def test_no_labels_and_no_pages(spark):
    _, pages, labels = frames(spark, lambda u: True)
    got = url_verdicts(pages, labels.limit(0), URL_RULES)
    assert {r.verdict for r in got.where("rule is null").collect()} == {"allow"}
    assert url_verdicts(pages.limit(0), labels, URL_RULES).count() == 0
