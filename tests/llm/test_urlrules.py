import random

from tidepool.llm import urlrules as U


def reference(urls, rules, default="allow"):
    out = []
    for page, url in urls:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
        best = None
        for rule, action in rules:
            h, p = rule.split("/", 1)[0], rule[len(rule.split("/", 1)[0]) :]
            if host and (host == h or host.endswith("." + h)) and path.startswith(p):
                key = (len(rule), len(h), action == "block")
                best = max(best or (key, rule, action), (key, rule, action))
        out.append((page, host, path, best[1] if best else None, best[2] if best else default))
    return sorted(out, key=repr)


def test_equals_brute_force_with_nested_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "com", "net", "example", "x"]
    rules = list({"/".join([".".join(rng.choices(labels, k=rng.randrange(1, 4))), rng.choice(["", "en/", "en/7", "de/", "d"])]): rng.choice(["block", "allow"]) for _ in range(40)}.items())
    urls = [(i, rng.choice(["http", "HTTPS"]) + "://" + ".".join(rng.choices(labels, k=rng.randrange(1, 6))).upper()[: rng.choice((3, 99))] + rng.choice(["", "/", "/en/", "/en/71", "/de/8?x=/en/7", "#f", "?q", "/d"])) for i in range(600)]
    urls += [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "://"), (9005, "x://com"), (None, "http://com/en/"), (1, urls[1][1]), (9006, "http://" + "a." * 3000 + "com/en/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = sorted(map(tuple, U.judged(pages, U.rules_table(spark, rules)).collect()), key=repr)
    assert got == reference(urls, rules)


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://com/en/", "z", None)], "page_id long, url string, key string, stack string")
    none = spark.createDataFrame([], "rule string, action string")
    assert U.judged(pages, none.selectExpr("rule as host", "rule as path", "action", "rule")).collect()[0].verdict == "allow"
    assert U.judged(pages.limit(0), U.rules_table(spark, [("com/", "block")])).count() == 0
    twice = U.rules_table(spark, [("com/", "allow"), ("com/", "block"), ("com/", "block")])
    assert [r.verdict for r in U.judged(pages, twice).collect()] == ["block"]
