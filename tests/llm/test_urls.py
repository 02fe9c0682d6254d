import random
import re
from itertools import combinations

from siftwell.llm import urls


def test_rules_and_parts(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://net/x"), (3, "x://b.net"), (4, "x://example.com/de/1"), (5, "x://fooexample.com/de/"), (6, "x://a.org/fr/1"), (7, None), (8, "no scheme"), (9, "a://b://c.net/"), (10, "s://notnet/"), (11, "x://h.net?/x")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, host string")
    out = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages).collect()}
    assert out[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and out[2] == ("net", "/x", "net/", "block")
    assert out[3] == ("b.net", "", None, "allow") and out[4][2:] == ("example.com/de/", "block") and out[5][2:] == (None, "allow")
    assert out[6][2:] == ("org/fr/", "allow") and out[7] == ("", "", None, "allow") and out[8] == ("", "", None, "allow")
    assert out[9][:2] == ("b:", "//c.net/") and out[10][2] is None and out[11][:2] == ("h.net", "")


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?", url or "")
    if not m:
        return set()
    parts = {"h:" + x for x in m[1].lower().split(".")} | {"p:" + x for x in re.split("[/.]", m[2].lower())}
    parts |= {"q:" + x.split("=")[0] for x in (m[3] or "").lower().split("&")}
    return {x for x in parts if len(x) > 2}


def brute(rows, least, confidence):
    """All token sets that are frequent and sure, without those of which a part is as sure."""
    sets = {}
    for url, bad in rows:
        if bad is not None:
            t = sorted(split(url))
            for k in range(1, len(t) + 1):
                for c in combinations(t, k):
                    n, b = sets.get(c, (0, 0))
                    sets[c] = (n + 1, b + bad)
    sure = {c: b / n for c, (n, b) in sets.items() if b >= least and b >= confidence * n}
    return {c: x for c, x in sure.items() if not any(sure.get(p, -1) >= x for k in range(1, len(c)) for p in combinations(c, k))}


def test_mined_rules_equal_brute_force(spark):
    pages = [(i, f"https://{'spam' if i % 4 == 0 else 'good'}{i % 3}.example.org/{'win' if i % 4 == 0 and i % 8 else 'page'}/{i % 50}?ref=1&p{i % 5}=2") for i in range(400)]
    pages += [(None, "https://spam0.example.org/win/1"), (900, None), (0, pages[0][1])]
    rows = [(u, None if i is None or i >= 300 else i % 4 == 0 and i % 8 != 0) for i, u in pages]
    labelled = spark.createDataFrame([(*r, "x") for r in rows], "url string, bad boolean, tokens string")
    rules = urls.mine(labelled)
    known = [r for r in rows if r[1] is not None]
    want = brute(known, max(urls.LEAST_ROWS, urls.MIN_SUPPORT * len(known)), urls.MIN_CONFIDENCE)
    assert {i: round(c, 9) for i, c in rules} == {i: round(c, 9) for i, c in want.items()} and ("p:win",) in want
    p = spark.createDataFrame(pages, "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in urls.judge(p, labelled).collect()}
    assert all(out[i] == ("block" if any(set(r) <= split(u) for r in want) else "allow") for i, u in pages if i is not None)
    assert out[4] == "block" and out[308] == "block" and out[1] == "allow" and out[900] == "allow"
    assert urls.judge(p.limit(0)).count() == 0
    assert urls.pruned([(("a", "b"), 0.8), (("a",), 0.9)]) == [(("a",), 0.9)]


def test_urls_of_many_tokens_do_not_explode(spark):
    query = "&".join(f"k{j}=1" for j in range(200))
    rows = [(f"https://a{i % 7}.b.org/x?{query}", i % 2 == 0) for i in range(200)]
    rules = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), min_confidence=0.5)
    assert 0 < len(rules) < 1 << urls.MAX_ITEMS


def test_rules_fire_on_the_supplied_pages(spark, sf):
    out = urls.op4_urls(spark, sf.replace("sf0.001", "sf0.1"))
    counts = {(r["rule"] is None, r["verdict"]): r["count"] for r in out.groupBy("rule", "verdict").count().collect()}
    assert counts[True, "block"] > 0 and counts[True, "allow"] > 0


def test_urls_of_more_tokens_than_fp_growth_takes_are_mined_whole(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        # left and right say nothing one by one and all together; each of the sixteen keys tells a little
        left, right = i % 2 == 0, i % 4 < 2
        bad = left == right
        keys = {f"q:k{j:02d}" for j in range(16) if rng.random() < (0.64 if bad else 0.5)} | {x for x, on in (("q:left", left), ("q:right", right)) if on}
        rows.append((keys, bad))
    assert max(len(k) for k, _ in rows) > urls.MAX_ITEMS
    least, sure = 50, 0.9
    urls_of = [("https://a.b.org/?" + "&".join(k[2:] + "=1" for k in sorted(keys)), bad) for keys, bad in rows]
    rules = urls.mine(spark.createDataFrame(urls_of, "url string, bad boolean"), min_support=least / 240, min_confidence=sure)
    sets = {}
    for size in (1, 2, 3):
        for c in combinations(sorted(set().union(*(k for k, _ in rows))), size):
            own = [b for k, b in rows if k.issuperset(c)]
            if sum(own) >= least and sum(own) >= sure * len(own):
                sets[c] = sum(own) / len(own)
    want = {c: x for c, x in sets.items() if not any(sets.get(p, -1) >= x for k in range(1, len(c)) for p in combinations(c, k))}
    assert {i: round(c, 9) for i, c in rules} == {i: round(c, 9) for i, c in want.items()} and ("q:left", "q:right") in want
