import math
import re

from ledgerline.llm import urls

PLACES = ["org", "a.org", "Example.ORG", "x.example.org", "notexample.org", "com", "b.example.com", "c.example.com", "d.example.net", "10.0.0.1:80", "u@e.example.com:8080", "", "[::1]"]
PATHS = ["", "/", "/es/", "/es", "/en/1", "/en/15?q", "/fr/x#y", "/de/", "/de/7/://", "?x=/de/", "#/de/"]


def fixture():
    found = [f"http://{place}{path}" for place in PLACES for path in PATHS]
    found += ["https://bad.example.com/de/%d" % i for i in range(40)] + ["https://bad.example.com/en/%d" % i for i in range(5)]
    return found + [None, "", "no scheme", "//x.org/", "://y.com/de/", "x" * 50_000 + "://Z.com/fr/" + "y" * 50_000, "http://a.org/", "http://a.org/"]


def split(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def units(host):
    name = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host))
    if re.search(r"^[0-9.]+$|^\[", name):
        return name, name
    return ".".join(name.split(".")[-2:]), name.split(".")[-1]


def brute(all_urls, labels=None):
    """Verdicts from plain loops over the chain of priors."""
    pages = [(*split(u), *rule(*split(u))) for u in all_urls]
    outcome = labels or [None if v is None else v == "block" for *_, v in pages]
    counts = {}
    for (host, *_), bad in zip(pages, outcome):
        n, y = counts.get(host, (0, 0))
        counts[host] = (n + (bad is not None), y + bool(bad))
    every = (sum(y for _, y in counts.values()) + 1) / (sum(n for n, _ in counts.values()) + 2)

    def shrink(rows):
        seen = sum((y - n * p) ** 2 for n, y, p in rows.values())
        drawn = sum(n * p * (1 - p) for n, y, p in rows.values())
        pairs = sum(n * (n - 1) * p * (1 - p) for n, y, p in rows.values())
        s = 1 / (min(max((seen - drawn) / pairs, urls.LEAST_SPREAD), urls.MOST_SPREAD) if pairs > 0 else urls.UNKNOWN_SPREAD) - 1
        return {k: ((s * p + y) / (s + n), s + n) for k, (n, y, p) in rows.items()}

    def level(which, prior):
        rows = {}
        for host, (n, y) in counts.items():
            key = which(host)
            a, b, _ = rows.get(key, (0, 0, 0))
            rows[key] = (a + n, b + y, prior(host))
        return shrink(rows)

    suffixes = level(lambda h: units(h)[1], lambda h: every)
    domains = level(lambda h: units(h)[0], lambda h: suffixes[units(h)[1]][0])
    hosts = level(lambda h: h, lambda h: domains[units(h)[0]][0])
    out = []
    for host, path, text, verdict in pages:
        rate, seen = hosts[host]
        learned = "block" if rate - urls.Z * math.sqrt(rate * (1 - rate) / (seen + 1)) > urls.THRESHOLD else "allow"
        out.append((host, path, text, verdict or learned))
    return out


def test_equals_plain_loops(spark):
    given = fixture()
    pages = spark.createDataFrame([(i, u, "h", 1, None) for i, u in enumerate(given)], "page_id bigint, url string, host string, n int, blocked boolean")
    got = sorted(urls.judge(pages).collect())
    assert [tuple(r)[1:] for r in got] == brute(given)
    verdicts = {(r.host, r.rule is None): r.verdict for r in got}
    assert verdicts["bad.example.com", True] == "block"
    assert verdicts["d.example.net", True] == "allow"


def test_labels_given_as_a_column(spark):
    given = ["http://good.example.com/x"] * 30 + ["http://bad.example.com/x"] * 30 + ["http://new.example.com/x"]
    labels = [False] * 30 + [True] * 30 + [None]
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(zip(given, labels))], "page_id bigint, url string, bad boolean")
    got = [tuple(r)[1:] for r in sorted(urls.judge(pages, blocked_col="bad").collect())]
    assert got == brute(given, labels)
    assert [r[-1] for r in got] == ["allow"] * 30 + ["block"] * 30 + ["allow"]


def test_repeated_and_missing_ids_and_no_rows(spark):
    schema = "page_id bigint, url string"
    pages = spark.createDataFrame([(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/"), (None, None)], schema)
    got = urls.judge(pages).collect()
    assert sorted((r.page_id is None, r.host, r.verdict) for r in got) == [(False, "a.net", "allow")] * 2 + [(True, "", "allow"), (True, "a.net", "allow")]
    assert urls.judge(spark.createDataFrame([], schema)).collect() == []
    assert urls.judge(pages).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_runs_no_python_on_the_executors(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = urls.judge(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
