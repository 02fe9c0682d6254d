"""URL filters by association rules.

Fixed rules (host, path) decide first, the longest that fits. What they leave open is judged by rules mined
from labelled URLs: their tokens (host labels, path segments, query keys) and the label are transactions for Spark's
FP-growth; an itemset that holds the label gives a rule, kept if its support and confidence reach their thresholds
and no part of it is at least as sure. The rules are matched by an inverted index on their rarest token. The query
takes as labels what the fixed rules say of the URLs that they decide, so the mined rules carry these verdicts over to
hosts and paths that no fixed rule names.

Nothing of a URL is left out: an itemset needs ``min_support`` of the labelled rows, tokens of the same rows are mined
as one, and tokens that are always bad or stand in every row are rules by themselves only. Where a labelled URL still
has more than ``MAX_ITEMS`` tokens, among which FP-growth would make up to 2^tokens sets, the sets that no part of them
equals in rows are found level by level; these are all that can be rules. Tokens are taken to be of the same rows by two
64-bit hashes and the counts. What is collected are rules and tokens that reach the support.

Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens; labels that are
null are left out; without rules the verdict is allow; repeated rows are judged one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, require, table

#: Fixed values of the contract: (verdict, rule).
BASE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
LEAST_ROWS = 12
MIN_CONFIDENCE = 0.75
#: Up to so many tokens of each labelled URL FP-growth mines all sets; with more, only those that can be rules are made.
MAX_ITEMS = 12
BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, tagged by the part they stand in."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = F.concat(
        F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(F.lower(path(url)), r"[/.]"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split(F.lower(query), "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    )
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def base_rule(url: Column, rules: Sequence[tuple[str, str]] = BASE_RULES) -> tuple[Column, Column]:
    """The rule that fits a URL, and its verdict; null if none does."""
    h, p = host(url), path(url)
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of the rules that say bad, surest first; labelled: url, bad (null: no label)."""
    require(labelled, "url", "bad")
    rows = labelled.where("bad is not null").select(F.monotonically_increasing_id().alias("id"), "bad", tokens(F.col("url")).alias("tokens"))
    rows = materialize(rows.where(F.size("tokens") > 0), "url-labelled")
    n, bad = rows.agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first()
    if not n or not bad:
        return []
    least = max(min_support * n, LEAST_ROWS)
    each = rows.select("id", "bad", F.explode("tokens").alias("token"))
    hashes = (F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2))
    times = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("hits"), *hashes).where(F.col("hits") >= least)
    # tokens of the same rows stand for each other: a set with two of them is no surer than with one
    groups = times.groupBy("n", "hits", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("same"))
    groups = materialize(groups.select("n", "hits", "same", F.col("same")[0].alias("token")), "url-tokens")
    # nothing is surer than a token that is always bad, and one of all rows tells nothing: they are rules by themselves only
    alone = (F.col("hits") == F.col("n")) | (F.col("n") == n)
    known = {r["token"]: r for r in groups.select("token", "same", "n", "hits", alone.alias("alone")).collect()}
    found = [((t,), r["hits"] / r["n"]) for t, r in known.items() if r["alone"] and r["hits"] >= min_confidence * r["n"]]
    mined = groups.where(~alone).select("token", "n", "hits")
    baskets = each.join(F.broadcast(mined.select("token")), "token").groupBy("id", "bad").agg(F.array_sort(F.collect_list("token")).alias("items"))
    baskets = materialize(baskets, "url-baskets")
    held, longest = baskets.agg(F.count("*"), F.max(F.size("items"))).first()
    if held:
        sets = frequent(baskets, least, held) if longest <= MAX_ITEMS else by_levels(baskets, mined, least)
        sure = sets.where(F.col("hits") >= min_confidence * F.col("n")).select("items", (F.col("hits") / F.col("n")).alias("confidence"))
        found += [(tuple(r["items"]), r["confidence"]) for r in sure.collect()]
    every = [(tuple(sorted(x)), c) for items, c in pruned(found) for x in product(*(known[t]["same"] for t in items))]
    return sorted(every, key=lambda r: (-r[1], r[0]))


def frequent(baskets: DataFrame, least: float, held: int) -> DataFrame:
    """items, n, hits of all sets with ``least`` bad rows, by FP-growth; baskets: items, bad."""
    labelled = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    # half a row less: the library multiplies the share by the rows again and rounds up
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (math.ceil(least) - 0.5) / held), minConfidence=1.0).fit(labelled).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    with_label = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    return with_label.join(sets, "items").select("items", F.col("freq").alias("n"), "hits")


def by_levels(baskets: DataFrame, single: DataFrame, least: float) -> DataFrame:
    """The sets of ``frequent`` without those that occur as often as a part of them, which are never rules, or have a
    part that is always bad; in rows of many tokens they are few among all sets. baskets: id, items, bad; single: token, n, hits.

    Every part of such a set is one too, so those of k + 1 tokens extend those of k. Work is the rows times their sets.
    """
    level = single.select(F.array("token").alias("items"), "n", "hits")
    out = level
    inside = baskets.select("id", "bad", "items", F.explode("items").alias("last")).select("id", "bad", F.array("last").alias("own"), F.filter("items", lambda x: x > F.col("last")).alias("more"))
    while True:
        wider = inside.select("id", "bad", "own", "more", F.explode("more").alias("last"))
        wider = wider.select("id", "bad", F.array_append("own", F.col("last")).alias("own"), F.filter("more", lambda x: x > F.col("last")).alias("more"))
        times = wider.groupBy("own").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("hits")).where(F.col("hits") >= least)
        parts = times.select("own", "n", "hits", F.explode(F.transform("own", lambda x: F.array_remove("own", x))).alias("items"))
        known = level.select("items", F.col("n").alias("of"))
        new = parts.join(known, "items").where(F.col("n") < F.col("of")).groupBy("own", "n", "hits").agg(F.count("*").alias("parts"))
        new = materialize(new.where(F.col("parts") == F.size("own")).select(F.col("own").alias("items"), "n", "hits"), "url-level")
        if new.isEmpty():
            return out
        out = out.unionByName(new)
        level = new.where("hits < n")
        inside = materialize(wider.join(level.select(F.col("items").alias("own")), "own", "left_semi"), "url-rows")


def pruned(rules: list[tuple[tuple[str, ...], float]]) -> list[tuple[tuple[str, ...], float]]:
    """Without rules of which a part is at least as sure."""
    kept: dict[str, list[tuple[frozenset[str], float]]] = {}  # by the first token
    out = []
    for items, confidence in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        whole = set(items)
        if not any(k <= whole and c >= confidence for t in items for k, c in kept.get(t, ())):
            kept.setdefault(min(items), []).append((frozenset(items), confidence))
            out.append((items, confidence))
    return sorted(out, key=lambda r: (-r[1], r[0]))


class _Match:
    """Adds whether a mined rule fits the row's tokens."""

    def __init__(self, rules):
        times: dict[str, int] = {}
        for items, _ in rules:
            for t in items:
                times[t] = times.get(t, 0) + 1
        self.index: dict[str, list[frozenset[str]]] = {}
        for items, _ in rules:
            self.index.setdefault(min(items, key=lambda t: (times[t], t)), []).append(frozenset(items))

    def fits(self, found: list[str] | None) -> bool:
        have = set(found or ())
        return any(rule <= have for t in have for rule in self.index.get(t, ()))

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            hit = pa.array([self.fits(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], hit], names=[*b.schema.names[:-1], "mined"])


def by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = BASE_RULES) -> DataFrame:
    """The URLs that the fixed rules decide, as labelled rows (url, bad)."""
    return pages.select("url", (base_rule(F.col("url"), rules)[1] == "block").alias("bad"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = BASE_RULES, **thresholds) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and whether a mined rule fits; labelled: url, bad (the rules' own if left out)."""
    require(pages, "page_id", "url")
    mined = mine(by_rules(pages, rules) if labelled is None else labelled, **thresholds)
    url = F.col("url")
    rule, said = base_rule(url, rules)
    out = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), rule.alias("rule"), said.alias("said"), tokens(url).alias("tokens"))
    out = out.mapInArrow(_Match(mined), "page_id long, host string, path string, rule string, said string, mined boolean")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def op4_urls(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
