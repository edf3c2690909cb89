"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that is true where it rejects. The rules' costs and selectivities are estimated on a
sample of rows that pass the base test; the cascade begins with the rule that rejects most per cost, goes on with the one
that rejects most per cost of what is left, and so on, so that most rejected texts never reach the dear rules. The order changes no verdict. Base measures are reported for every whole text.

Defined results: a null text has no words and all measures 0; an empty or null text fails the base test and is not
kept; an empty table gives an empty result; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.plans.runtime import let, materialize

WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"
#: Rows of the sample that orders the rules, and times that each is judged in a timed run; no verdict depends on them.
SAMPLE_ROWS, REPEATS = 1024, 8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted by 64-bit hash, equal neighbours found, and the union of their words counted."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end"))
        return F.aggregate(positions, start, step, lambda acc: acc["n"])

    def repeated(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return covered(F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"])))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(tagged, twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, repeated))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def word_chars(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the base measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).cast("long").alias("n_repeat_words")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), both.alias("_w")).select(
        "doc_id", "text", F.col("_w.n_words").alias("n_words"), word_chars(F.col("text")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), n_dup_lines(F.col("text")).cast("long").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """rejects: an expression over doc_id, text and the measures."""

    name: str
    rejects: Column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    text, words = F.col("text"), F.col("n_words")
    n_lines = F.regexp_count(text, F.lit(r"\n")) + 1
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("dup_lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * n_lines)),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("shouting", 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.col("word_chars")),
        Rule("letterless", 2 * F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")) > words),
        Rule("exclaiming", 4 * F.regexp_count(text, F.lit(r"!!")) > words),
        Rule("ellipses", 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|\z)")) > 3 * n_lines),
    ]


def greedy(rules: list[Rule], cost: dict[str, float], rows: list[tuple[int, int]]) -> list[Rule]:
    """rules by rejections per cost among the rows that the rules before them let pass. rows: bits of the rules that reject,
    and how many rows have them. Ratios are compared in steps of about 1.4, so that the jitter of timings changes nothing;
    equal ones, and rules that reject nothing, stay in their order."""
    left, out = list(range(len(rules))), []
    while left:
        hits = {k: sum(n for bits, n in rows if bits >> k & 1) for k in left}
        best = max(left, key=lambda k: (round(2 * math.log2(hits[k] / cost[rules[k].name])) if hits[k] else -math.inf, -k))
        out.append(rules[best])
        left.remove(best)
        rows = [(bits, n) for bits, n in rows if not bits >> best & 1]
    return out


def ordered(measured: DataFrame, rules: list[Rule]) -> list[Rule]:
    """rules in the cascade's order, by costs and rejections on a sample of about SAMPLE_ROWS rows."""
    n = max(1, measured.count())
    spot = F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    # the base test is made on the sample alone: before it, it would be made on all rows
    sample = materialize(measured.where(spot).limit(4 * SAMPLE_ROWS), "quality-sample").where(~base_failed()).coalesce(1).cache()
    bits = reduce(lambda s, kr: s + F.when(kr[1].rejects, 1 << kr[0]).otherwise(0), enumerate(rules), F.lit(0))
    rows = [(r.bits, r["count"]) for r in sample.select(bits.alias("bits")).groupBy("bits").count().collect()]  # at most 2^rules
    again = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(found: Column) -> float:
        began = time.perf_counter()
        again.agg(F.count_if(found & (F.col("_turn") > 0))).first()
        return time.perf_counter() - began

    again.agg(*[F.count_if(rule.rejects & (F.col("_turn") > 0)) for rule in rules]).first()  # all code is warm from here on
    idle = run(F.lit(True))
    cost = {rule.name: max(1e-3, run(rule.rejects) - idle) for rule in rules}
    sample.unpersist()
    return greedy(rules, cost, rows)


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; CASE tests no rule after it."""
    chain = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain


def quality_report(docs: DataFrame, rules: list[Rule] | None = None, **columns: str) -> DataFrame:
    measured = measures(docs, **columns)
    rejected = verdict([Rule("base", base_failed()), *ordered(measured, default_rules() if rules is None else rules)])
    kept = measured.withColumn("base_failed", base_failed()).withColumn("kept", rejected.isNull())
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
