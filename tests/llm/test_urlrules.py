import itertools
import random

from tessera.llm import urlrules as U


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def brute_rule(host, path):
    fit = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0])) if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://example.com", "https://a.b.example.com/en/x", "http://notexample.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://net/FR/", "http://x.net?/es/", "a://b://c.net/es/", "http://É.com/é", "http://x.com\n/en/", "http://spam.farm.org/buy?utm=1", "http://www.example.com/en", "http://example.org/en/#a://b", "x://" + "y" * 50_000]


def test_host_rules_by_definition(spark):
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in U.judge(pages, U.RuleIndex([])).collect():
        host, path = brute_parts(URLS[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]


def test_mined_rules_block_what_labels_say(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        bad = rng.random() < 0.2
        host = rng.choice(["spam-farm", "blog", "shop"]) if not bad else "spam-farm"
        seg = "win" if bad else rng.choice(["news", "about", "win" if host != "spam-farm" else "faq"])
        rows.append((k, f"http://{host}.example.org/{seg}/{k}"))
        labels.append((k, 1, int(bad)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    index = U.build_index(pages, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), confidence=0.8)
    got = {r.page_id: r.verdict for r in U.judge(pages, index).collect()}
    assert got == {k: "block" if t else "allow" for k, _, t in labels}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    index = U.build_index(pages, labels)
    assert [r.verdict for r in U.judge(pages, index).collect()] == ["allow"]
    assert U.judge(pages.limit(0), index).collect() == []


def plain_rules(baskets, fewest, confidence):
    """All token sets of that support and confidence, one by one; baskets: (tokens, blocked)."""
    out = {}
    for size in range(1, 5):
        for s in {frozenset(c) for b, _ in baskets for c in itertools.combinations(sorted(b), size)}:
            with_s = [x for b, x in baskets if s <= b]
            if sum(with_s) >= fewest and sum(with_s) / len(with_s) >= confidence:
                out[s] = sum(with_s) / len(with_s)
    return out


def test_rules_match_plain_enumeration(spark):
    rng = random.Random(4)
    words = ["win", "news", "shop", "faq", "x1"]
    rows = [(k, f"http://{rng.choice(['a', 'b'])}.org/" + "/".join(rng.sample(words, rng.randint(0, 3))), int(rng.random() < 0.4)) for k in range(80)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows], "doc_id long, quality int, toxic int")
    found, item = U.mine(pages, labels, support=0.05, confidence=0.4)
    got = {frozenset(r["items"]): r["confidence"] for r in found.collect()}
    every = set.intersection(*(U.tokens(u) for _, u, _ in rows))
    baskets = [(frozenset(item[t] for t in U.tokens(u) if t in item), t) for _, u, t in rows]
    assert every and not every & item.keys()
    want = plain_rules(baskets, 4, 0.4)
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    plain = plain_rules([(frozenset(U.tokens(u)), t) for _, u, t in rows], 4, 0.4)
    verdict = {k: "block" if any(s <= U.tokens(u) for s in plain if s - every) else "allow" for k, u, _ in rows}
    for most in (U.MOST_RULES, 1):  # an index that travels, and a join
        index = U.build_index(pages, labels, most, support=0.05, confidence=0.4)
        assert isinstance(index, U.RuleIndex) == (most > 1)
        assert {r.page_id: r.verdict for r in U.judge(pages, index).collect()} == verdict


def test_long_urls_that_repeat_do_not_explode(spark):
    spam = "http://spam.org/" + "/".join(f"seg{chr(97 + k)}" for k in range(20))
    rows = [(k, f"{spam}/{k}", 1) for k in range(8)] + [(100 + k, f"http://fine.org/page{k % 7}/x{k}", 0) for k in range(300)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900, "http://other.org/segc/segd"), (901, "http://other.org/x")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows], "doc_id long, quality int, toxic int")
    index = U.build_index(pages, labels)
    assert sum(map(len, index.by_item.values())) == 1
    got = {r.page_id: r.verdict for r in U.judge(pages, index).collect()}
    assert all(got[k] == ("block" if t else "allow") for k, _, t in rows) and got[900] == "block" and got[901] == "allow"
