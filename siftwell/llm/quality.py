"""Quality rules as a learned decision list.

Statistics of every whole text are counted in one pass. A list of rules is learned from labelled statistics by
sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the sample by information
gain and pruned on the last third; it joins the list if it keeps its precision there, and the rows that it
covers are taken out before the next is grown. The list is emitted as ordered Spark conditional expressions.
A document goes if the fixed base rule fails or the first rule that fits says so.

Bound: the list is fitted on at most ``sample_rows`` labelled rows, the first by a hash of doc_id, and has at most
``MAX_RULES`` rules of ``MAX_CONDITIONS`` conditions; the statistics and the verdicts cover every document.

Defined cases: a null text has no words, so the base rule rejects it; a document with several labels counts
once, as the lowest; null labels are ignored; without labels, or with labels of one class only, the list is
empty and only the base rule decides; repeated rows are judged one by one; an empty table gives an empty
result; other columns are kept by ``filter_quality`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import hold, map_rows, materialize, require, table, words_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SAMPLE_ROWS = 20_000
#: A rule must be right in this share of the rows that it covers, on both parts of the sample.
MIN_PRECISION = 0.95
MIN_COVERED = 8
MAX_RULES = 16
MAX_CONDITIONS = 4
CUTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_end_marks", "n_bars")
STATS = ", ".join(f"{c} long" for c in COUNTS)


def statistics(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = words_of(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace() or words_of(x)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        upto = 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    distinct = set(words)
    if text.isascii():
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    else:
        upper = sum(1 for a, b in zip(text, text.lower()) if a != b) if len(text.lower()) == len(text) else sum(map(str.isupper, text))
    return (
        n,
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(distinct),
        upper,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".!?")),
        text.count("|"),
    )


def _stat_row(doc_id, text):
    return (doc_id, *statistics(text))


#: What rules may test: name and SQL over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "end_marks_per_word": "n_end_marks / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
}

Condition = tuple[str, str, float]
Rule = list[Condition]


def _fits(x: dict[str, np.ndarray], rule: Sequence[Condition], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, cut in rule:
        out &= x[name] <= cut if op == "<=" else x[name] > cut
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules that cover bad rows, in order, from features and labels of a bounded sample."""
    n = len(bad)
    if n == 0 or bad.all() or not bad.any():
        return []
    part = np.arange(n) % 3 == 2  # rows come in hash order
    left, rules = np.ones(n, bool), []
    while len(rules) < MAX_RULES:
        grow = left & ~part
        rule: Rule = []
        covered = grow.copy()
        while len(rule) < MAX_CONDITIONS and (bad[covered].mean() if covered.any() else 1) < 1:
            best = None
            p0, n0 = bad[covered].sum(), covered.sum()
            for name in FEATURES:
                v = x[name][covered]
                for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
                    for op, hit in (("<=", v <= cut), (">", v > cut)):
                        m = hit.sum()
                        p = bad[covered][hit].sum()
                        if m and p >= MIN_COVERED:
                            gain = p * (np.log2(p / m) - np.log2(p0 / n0))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, (name, op, float(cut)))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            covered = grow & _fits(x, rule, n)
        kept = _pruned(rule, x, bad, left & part, n)
        if not kept or not _right(kept, x, bad, left & part, n, 1) or not _right(kept, x, bad, grow, n, MIN_COVERED):
            break
        rules.append(kept)
        left &= ~_fits(x, kept, n)
        if not bad[left].any() or left.sum() < MIN_COVERED:
            break
    return rules


def _right(rule, x, bad, rows, n, least) -> bool:
    hit = rows & _fits(x, rule, n)
    return hit.sum() >= least and bad[hit].mean() >= MIN_PRECISION


def _pruned(rule: Rule, x, bad, rows, n) -> Rule:
    """The prefix of the rule that is worth most on the pruning rows: (right - wrong) / covered, then more right."""
    best, worth = [], (-2.0, 0)
    for k in range(1, len(rule) + 1):
        hit = rows & _fits(x, rule[:k], n)
        m, p = int(hit.sum()), int(bad[hit].sum())
        if m and (w := (round((2 * p - m) / m, 6), p)) > worth:
            best, worth = rule[:k], w
    return best


def expression(rules: Sequence[Rule]) -> Column:
    """Number from 0 of the first rule that fits, as one ordered conditional expression; -1 if none does."""
    out = None
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for name, op, cut in rule:
            value = F.expr(FEATURES[name])
            test = test & (value <= F.lit(cut) if op == "<=" else value > F.lit(cut))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled rows that pass the base rule.

    The labelled ids are cut to about ``sample_rows`` by a hash before any text is read, so what the driver and a
    broadcast hold has a fixed bound.
    """
    require(labels, "doc_id", "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    if (n := known.count()) > sample_rows:
        known = known.where(F.col("h") < int((1 << 40) * sample_rows / n))
    known = materialize(known, "quality-known")
    stats = map_rows(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"), f"doc_id long, {STATS}", _stat_row, "doc_id", "text")
    first = stats.where(~base_failed()).join(F.broadcast(known), "doc_id").select("h", "doc_id", (F.col("quality") == 0).alias("bad"), *(F.expr(e).alias(k) for k, e in FEATURES.items()))
    rows = first.orderBy("h", "doc_id", *FEATURES).limit(sample_rows).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, rows["bad"].to_numpy(bool))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each document: its counts, base_failed, rule (-1: none) and kept."""
    require(docs, "doc_id", "text")
    rule = expression(fit(docs, labels, sample_rows))
    stats = map_rows(docs, f"doc_id long, {STATS}", _stat_row, "doc_id", "text")
    return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), rule.cast("int").alias("rule"), (~base_failed() & (rule == -1)).alias("kept"))


def _stat_batches(batches):
    import pyarrow as pa

    hold("rows")
    for b in batches:
        rows = [statistics(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * len(COUNTS)
        row = pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
        yield pa.RecordBatch.from_arrays([row, *(pa.array(c, pa.int64()) for c in cols)], names=["row", *COUNTS])


def filter_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the base rule and the learned list keep, with all their columns."""
    require(docs, "doc_id", "text")
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    stats = docs.mapInArrow(_stat_batches, schema)
    rule = expression(fit(docs, labels, sample_rows))
    return stats.where(~base_failed() & (rule == -1)).select("row.*")


def op5_quality(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
