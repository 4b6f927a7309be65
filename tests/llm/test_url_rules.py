import random

from cohortspark.llm import url_rules as u

RULES = "host string, path string, verdict string"


def slow(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_nested_rules_by_brute_force(spark):
    draw = random.Random(2)
    label = lambda: draw.choice(["a", "b", "ab", "org"])
    host = lambda n: ".".join(label() for _ in range(draw.randrange(1, n)))
    path = lambda: "".join(draw.choice(["/", "/a", "/ab", "b", "/a/"]) for _ in range(draw.randrange(4)))
    chosen = {}
    for _ in range(120):
        chosen[host(4), draw.choice(["", "/"]) + path()] = draw.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in chosen.items()]
    urls = [f"{draw.choice(['http', 'HTTPS'])}://{host(6).upper()}{path()}{draw.choice(['', '?q=://x/y', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http:///a", "x://org?a://b/c", urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r[0]: tuple(r)[1:] for r in u.judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: slow(x, rules) for i, x in enumerate(urls)}


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "z"), (1, "http://a.org/x", "z"), (None, None, None)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("org", None, "allow"), ("ORG", None, "block"), (None, "/", "block"), ("", "/", "block")], RULES)
    judged = u.judge(pages, rules).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in judged if r["rule"]) == [(1, "org", "block")] * 2
    assert [r["verdict"] for r in judged if r["rule"] is None] == ["allow"]
    assert u.judge(pages, rules.limit(0)).count() == 3 and u.judge(pages.limit(0), rules).count() == 0
