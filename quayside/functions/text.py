"""Text, JSON and hash functions: leakage rules, tolerant JSON, ablations, digests."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text must not tell. (?U) makes letters, digits and word borders those of Unicode.
LEAKAGE = (
    ("exact_multiplier", r"(?iU)(?<!\w)(?:\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*(?:x\b|×|times\b|percent\b)|\d+\.\d+\b|half\b)"),
    ("latent_family", r"(?iU)\b(?:demand[_\s-]+level|temporary[_\s-]+pulse|lead[_\s-]+time[_\s-]+shift|shipment[_\s-]+loss|transit[_\s-]+pause|compound|no[_\s-]+change|level[_\s-]+shift)\b"),
    ("exact_onset", r"(?iU)\b(?:period|week|day|step)\s*(?:#\s*)?\d+\b|\bt\s*=\s*\d+\b"),
    ("exact_duration", r"(?iU)\b(?:for|lasting|lasts|duration(?:\s+of)?)\s+(?:exactly\s+)?(?:\d+(?:\.\d+)?|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:periods?|weeks?|days?|steps?)\b"),
)


def any_of(words: Sequence[str]) -> str:
    """A pattern for whole occurrences of any of these words or phrases, in either case; of two that begin alike, the longer one."""
    quoted, ahead = [], {w.casefold(): w for w in words}
    for w in sorted(ahead.values(), key=lambda w: (-len(w), w)):
        if w.isspace() or not w:
            raise ValueError("an empty phrase is part of every text")
        quoted.append("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return rf"(?iU)(?<!\w)(?:{'|'.join(quoted)})(?!\w)"


def leakage(texts: DataFrame, key: str, text: str, literals: Sequence[str] = ()) -> DataFrame:
    """key, rule, match: a row for every match of every rule."""
    rules = [*LEAKAGE, *([("forbidden_literal", any_of(literals))] if literals else [])]

    def tagged(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("rule"), m.alias("match")))

    found = F.concat(*[tagged(*rule) for rule in rules])
    return texts.select(key, F.explode(found).alias("f")).select(key, "f.rule", "f.match")


def first_class(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first class one of whose keywords is part of the text in lower case; null if none is."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def masked(text: Column) -> Column:
    """Every character that is not white space becomes x."""
    return F.regexp_replace(text, r"[^\s]", "x")


def hash_shuffled(text: Column, seed: int) -> Column:
    """The words in an order drawn from hashes of seed, place and word."""
    keyed = F.transform(F.split(text, " "), lambda w, i: F.struct(F.sha2(F.concat(F.lit(f"{seed}/"), i.cast("string"), F.lit("/"), w), 256).alias("h"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), " ")


def neutral(text: Column, filler: str = "no further information ") -> Column:
    """Filler of the text's length."""
    n = F.length(text)
    return F.substring(F.repeat(F.lit(filler), (n / len(filler) + 1).cast("int")), F.lit(1), n)


def history_prompt(panel: DataFrame, keys: Sequence[str], until: int) -> DataFrame:
    """A key's visible history up to a period, as text."""
    rows = panel.where(F.col("period") <= until).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", "demand"))).alias("r"))
    line = lambda x: F.concat(F.lit("t="), x["period"].cast("string"), F.lit(" demand="), x["demand"].cast("string"))
    text = F.concat(F.lit(f"history to {until}\n"), F.array_join(F.transform("r", line), "\n"))
    return rows.select(*keys, text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


def balanced_objects(text: str):
    """Substrings that begin with a brace and end with the one that closes it, strings respected."""
    at = text.find("{")
    while at >= 0:
        depth, quoted, escaped, end = 0, False, False, -1
        for k in range(at, len(text)):
            c = text[k]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    end = k + 1
                    break
        if end < 0:
            return
        yield text[at:end]
        at = text.find("{", end)


def strict_object(text: str) -> dict | None:
    """A JSON object without repeated keys and without NaN or infinities, or None."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def payload(text: str | None) -> str | None:
    """The answer's JSON object: the whole text, else a fenced block, else the first balanced object that parses."""
    if not text:
        return None
    tries = [text.strip(), *re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL), *balanced_objects(text)]
    found = next((o for t in tries if (o := strict_object(t)) is not None), None)
    return None if found is None else json.dumps(found, sort_keys=True)


def payloads(texts: pd.Series) -> pd.Series:
    return texts.map(payload, na_action="ignore")


def json_payload(text: Column) -> Column:
    """payload, on Arrow batches: a scanner with state that no built-in function expresses."""
    return F.pandas_udf(payloads, "string")(text)


def slot(key: Column, n: Column) -> Column:
    """A choice of n by the key's SHA-256: its leading 60 bits modulo n."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long") % n


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([a-z_]+)\}"), F.lit(1)))
