from pyspark.sql import functions as F

from sparkweft.llm import url_filter as u
from sparkweft.llm.queries import RULES
from tests.llm.conftest import frame

URLS = [
    (1, "http://a.example.net/en/1"), (2, "HTTPS://EXAMPLE.NET/de/"), (3, "http://example.com/de/x?y#z"), (4, "http://sub.example.com/en/"), (5, "http://x.org/fr/"), (6, "http://x.org/en/"),
    (7, None), (8, ""), (9, "no scheme/net/"), (10, "http://example.net"), (11, "http://badexample.net/en/"), (12, "http://net/"), (13, "x://y://z.net/q"), (14, "http://É.NET/Ä?a"),
    (15, "http://a.example.net/en/1"), (None, "http://b.net/"), (16, "http://" + "a." * 5000 + "net/" + "p" * 10000), (17, "http://example.net:80/en/"), (18, "://net/"), (19, "http://user@example.net/en/x\ny"),
]


def expected(url):
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules(spark):
    df = frame(spark, URLS, "page_id long, url string")
    rows = u.filter_urls(df, RULES).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"]), r["url"]


def test_empty_tables_and_rules(spark):
    df = frame(spark, [], "page_id long, url string")
    assert u.filter_urls(df, RULES).count() == 0
    assert {r["verdict"] for r in u.filter_urls(frame(spark, URLS, "page_id long, url string"), []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = [f"k{i}" for i in range(0, 20_000, 211)]
    cascade = u.Cascade(universe, listed, 20_000)
    assert len(cascade.levels) >= 2
    assert sorted(r["key"] for r in universe.where(cascade.has(F.col("key"))).collect()) == sorted(listed)
    assert sum(level.bits for level in cascade.levels) < 100 * len(listed)


def test_undercounted_universe_still_exact(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = u.Cascade(universe, ["k5", "k77"], 2)
    assert sorted(r["key"] for r in universe.where(cascade.has(F.col("key"))).collect()) == ["k5", "k77"]


def test_stays_native(spark):
    plan = u.filter_urls(spark.createDataFrame(URLS, "page_id long, url string"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan


def test_a_list_of_a_million_keys(spark):
    universe = spark.range(0, 3_000_000, 70).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = u.Cascade(universe, [f"k{i}" for i in range(0, 2_000_000, 2)], 3_000_000 // 70)
    assert universe.where(cascade.has(F.col("key"))).count() == len(range(0, 2_000_000, 70))
    assert universe.where(cascade.has(F.col("key"))).where(F.substring("key", 2, 9).cast("int") >= 2_000_000).count() == 0
    plan = universe.where(cascade.has(F.col("key")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "from_json" not in plan


def test_mixed_lists_of_many_lengths(spark):
    """2,000 rules of 20 path lengths and 4 host depths over 5,000 urls, against the plain rules."""
    import random
    import time

    r = random.Random(4)
    host = lambda d: ".".join([f"h{r.randrange(9)}" for _ in range(d - 1)] + [f"t{r.randrange(9)}"])
    rules = {(host(r.randint(1, 4)), "/" + "".join(r.choice("abc") for _ in range(r.randint(0, 19))), r.choice(["block", "allow"])) for _ in range(2000)}
    once = {}
    for h, p, v in sorted(rules):
        once[h, p] = v
    rules = [(h, p, v) for (h, p), v in once.items()]
    urls = [f"https://{host(r.randint(1, 6))}/" + "".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    urls += [f"http://x.{h}{p}{r.choice(['', 'c', '?q'])}" for h, p, _ in r.sample(rules, 1000)]
    began = time.time()
    got = u.filter_urls(frame(spark, list(enumerate(urls)), "page_id long, url string"), rules).select("url", "host", "path", "rule", "verdict").collect()
    assert time.time() - began < 60
    for x in got:
        ends = x["host"].split(".")
        fits = [(len(h) + len(x["path"][:n]), h + x["path"][:n], once[h, x["path"][:n]]) for i in range(len(ends)) for h in [".".join(ends[i:])] for n in range(len(x["path"]) + 1) if (h, x["path"][:n]) in once]
        longest = max((f[0] for f in fits), default=0)
        assert (x["rule"], x["verdict"]) in ({(f[1], f[2]) for f in fits if f[0] == longest} or {(None, "allow")}), x["url"]
