"""Tolerant readers of model answers, as expressions.

An answer is cut into pieces (strings, braces, the rest), a fold over the pieces yields candidate objects with their spans,
and the reader ranks the candidates. Nothing edits the answer as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.plans.runtime import let

# The menu, names that mark an answer, and patterns of the format.
METHODS, EXPECTED = ("default", "explicit", "recent_N", "calculate"), ("parameters", "rationale", "action", "carry_over_insight")
MENU = {"L": ("default", "calculate", "recent_N", "explicit"), "mu_hat": ("default", "recent_N", "EWMA_gamma", "explicit"), "sigma_hat": ("default", "recent_N", "explicit")}
STRING = r'"(?:[^"\\]|\\.)*"'
PIECE, LEAF = rf'(?s){STRING}|[{{}}]|[^"{{}}]+|"', rf"{STRING}\s*:|{STRING}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false"
BRACED = r"(?s)\{.*\}"
PAIR, ACTION = r'"\w+"\s*:\s*(?:"[^"]*"|\d+(?:\.\d+)?)|\}', r'"action"\s*:\s*\{([^}]+)\}'
NEEDED = {"recent_N": "N", "explicit": "value", "EWMA_gamma": "gamma"}


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def valid_escapes(text: Column) -> Column:
    r"""\$ and \% lose their stroke, \x41 becomes \u0041."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?<!\\)\\\$", "\\$"), r"(?<!\\)\\%", "%")
    return F.regexp_replace(plain, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")


def cleaned(text: Column) -> Column:
    """Fences stripped, escapes made valid, commas before a closing bracket dropped."""
    return F.regexp_replace(valid_escapes(unfenced(text)), r",(\s*[}\]])", "$1")


def has_content(text: Column) -> Column:
    """The weak test for another try: a brace, or a word of the menu."""
    low = F.lower(F.trim(text))
    return F.coalesce(low.contains("{") | low.contains("}") | low.rlike("method|default|explicit|recent"), F.lit(False))


def menu_choices(text: Column) -> Column:
    """Nine parameters read off an answer whatever its form: for each of L, mu_hat and sigma_hat its method, and its value or N.

    The answer is its pairs of a name and a plain value, and the closing braces between them, in order. An item's N is the
    first one after its method in the same object, else the first of all, else 5.
    """
    pairs = F.regexp_extract_all(text, F.lit(PAIR), F.lit(0))
    named = lambda found, name: F.filter(found, lambda p: p.rlike(rf'^"{name}"'))
    value = lambda pair: F.regexp_extract(pair, r':\s*"?([^"]*)"?$', 1)
    whole = lambda pair: F.regexp_extract(pair, r":\s*(\d+)", 1).try_cast("int")

    def one(found: Column, name: str) -> list[Column]:
        method = F.get(named(found, f"{name}_method"), F.lit(0))
        kind = F.when(value(method).isin(*METHODS), value(method)).otherwise("default")
        after = F.slice(found, F.array_position(found, method).cast("int"), F.size(found))
        same = F.slice(after, 1, F.coalesce(F.nullif(F.array_position(after, "}"), F.lit(0)), F.size(after) + 1).cast("int"))
        near, first = whole(F.get(named(same, "N"), F.lit(0))), whole(F.get(named(found, "N"), F.lit(0)))
        n = F.when(kind == "recent_N", F.coalesce(F.when(near > 0, near), first, F.lit(5)))
        said = F.get(named(found, f"{name}_value"), F.lit(0))
        return [kind.alias(f"{name}_method"), F.when(kind == "explicit", value(said).try_cast("double")).alias(f"{name}_value"), n.alias(f"{name}_n")]

    return let(pairs, lambda found: F.struct(*[c for name in MENU for c in one(found, name)]))


def parameter_fault(parameters: Column, item: str) -> Column:
    """What is wrong with an item's parameters in an answer (JSON text), or null; __default__ stands for an item that is not there."""
    at = lambda path: F.get_json_object(parameters, path)
    root = F.when(at(f"$.parameters.{item}").isNotNull(), at(f"$.parameters.{item}")).otherwise(at("$.parameters.__default__"))
    fault = F.when(at("$.parameters").isNull(), "no parameters").when(root.isNull(), "no item")
    for name, methods in MENU.items():
        part = F.get_json_object(root, f"$.{name}")
        method = F.get_json_object(part, "$.method")
        fault = fault.when(part.isNull(), f"no {name}").when(method.isNull(), f"no method of {name}").when(~method.isin(*methods), f"bad method of {name}")
        for kind, field in NEEDED.items():
            if kind in methods:
                fault = fault.when((method == kind) & F.get_json_object(part, f"$.{field}").isNull(), f"no {field} of {name}")
    return fault


def pieces(text: Column) -> Column:
    """A text as strings in quotes, braces, and what stands between, with the piece that follows each."""
    found = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return let(found, lambda all_: F.transform(all_, lambda piece, i: F.struct(piece.alias("piece"), F.coalesce(F.get(all_, i + 1), F.lit("")).alias("next"))))


def mended(piece: Column, following: Column) -> Column:
    """A piece as JSON has it: escapes that JSON knows, no comma before a closing bracket."""
    outside = F.regexp_replace(piece, r",(\s*\])", "$1")
    return F.when(piece.startswith('"'), valid_escapes(piece)).when(following == "}", F.regexp_replace(outside, r",\s*$", "")).otherwise(outside)


def spans(text: Column) -> Column:
    """Candidate objects of a text, in order: raw and mended text, and whether both of its outer braces are there.

    An object opens at a brace, or at a name and a colon that stand in none; it closes at its brace, or where the text
    ends. Closing braces that close nothing are passed over.
    """
    t = "struct<depth:int,raw:string,text:string,whole:boolean,done:array<struct<raw:string,text:string,whole:boolean>>>"
    empty = F.struct(F.lit(0).alias("depth"), F.lit("").alias("raw"), F.lit("").alias("text"), F.lit(True).alias("whole"), F.array().alias("done")).cast(t)

    def candidate(s: Column, end: Column, whole: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(F.concat(s["raw"], end).alias("raw"), F.concat(s["text"], end).alias("text"), whole.alias("whole"))))

    def step(s: Column, p: Column) -> Column:
        piece, out = p["piece"], s["depth"] == 0
        named = piece.startswith('"') & p["next"].rlike(r"^\s*:")
        grown = lambda depth, front, whole: F.struct(depth.alias("depth"), F.concat(s["raw"], F.lit(front), piece).alias("raw"), F.concat(s["text"], F.lit(front), mended(piece, p["next"])).alias("text"), whole.alias("whole"), s["done"].alias("done")).cast(t)
        closed = F.struct(F.lit(0).alias("depth"), F.lit("").alias("raw"), F.lit("").alias("text"), F.lit(True).alias("whole"), candidate(s, F.lit("}"), s["whole"]).alias("done")).cast(t)
        return (
            F.when(piece == "{", grown(s["depth"] + 1, "", s["whole"])).when(out & named, grown(F.lit(1), "{", F.lit(False))).when(out, s)
            .when(piece == "}", F.when(s["depth"] == 1, closed).otherwise(grown(s["depth"] - 1, "", s["whole"]))).otherwise(grown(s["depth"], "", s["whole"]))
        )

    return F.aggregate(pieces(text), empty, step, lambda s: F.when(s["depth"] > 0, candidate(s, F.repeat(F.lit("}"), s["depth"]), F.lit(False))).otherwise(s["done"]))


def candidates(text: Column) -> Column:
    """Spans of the whole text, then of what stands from its first brace to its last: a lone quote before would hide them."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.concat(spans(t), spans(F.regexp_extract(t, BRACED, 0))))


def as_json(text: Column) -> Column:
    """A JSON text in one form, names in order; null where it is none."""
    return F.to_json(F.try_parse_json(text))


def spaced(json: Column) -> Column:
    """A space after each comma and colon outside of strings."""
    parts = F.regexp_extract_all(json, F.lit(PIECE), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, "([,:])", "$1 "))), "")


def is_order_answer(text: Column) -> Column:
    """Is the first whole object valid as it stands, with an action that is an object?"""
    first = F.get(F.filter(spans(F.coalesce(text, F.lit(""))), lambda c: c["whole"]), F.lit(0))["raw"]
    return F.coalesce(F.get_json_object(as_json(first), "$.action").startswith("{"), F.lit(False))


def quantities(action: Column) -> Column:
    """Whole quantities by item of a JSON object, as JSON; null if one of them is no number."""
    entries = F.map_entries(F.from_json(action, "map<string,string>"))
    whole = F.transform(entries, lambda e: F.struct(e["key"].alias("item"), e["value"].try_cast("double").try_cast("long").alias("n")))
    return let(whole, lambda w: F.when(F.forall(w, lambda e: e["n"].isNotNull()), listed(w)))


def listed(found: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(found), lambda e: F.concat(F.lit('"'), e["item"], F.lit('": '), e["n"].cast("string"))), ", "), F.lit("}"))


def pairs_in(text: Column, pattern: str) -> Column:
    """Quantities by pattern, the last of each item; null for none."""
    items, numbers = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    found = F.transform(items, lambda item, i: F.struct(item.alias("item"), F.get(numbers, i).try_cast("long").alias("n"), F.array_contains(F.slice(items, i + 2, F.size(items)), item).alias("again")))
    last = F.transform(F.filter(found, lambda e: ~e["again"]), lambda e: F.struct(e["item"], e["n"]))
    return F.when(F.size(items) > 0, listed(last))


def orders_of(text: Column) -> Column:
    """The quantities of an answer's action, cut to whole numbers, as JSON.

    Of the first candidate whose action holds nothing but numbers; where there is none, what the text says by pattern of an
    action, and last of any item that is a number."""
    found = F.transform(candidates(text), lambda c: quantities(F.get_json_object(as_json(c["raw"]), "$.action")))
    inside = F.regexp_extract(text, ACTION, 1)
    return F.coalesce(F.get(F.filter(found, lambda q: q.isNotNull()), F.lit(0)), pairs_in(inside, r'"([^"]+)"\s*:\s*(\d+)'), pairs_in(text, r'"(\d+)"\s*:\s*(\d+)'))


def objects_of(text: Column) -> Column:
    """An answer as a JSON object, mended where it must be: the first candidate with a name that marks an answer, else the
    last; null where only menu_choices is left."""
    valid = lambda t: F.filter(F.transform(spans(t), lambda c: as_json(c["text"])), lambda c: c.isNotNull() & (c != "{}"))
    marked = lambda all_: F.get(F.filter(all_, lambda c: F.arrays_overlap(F.json_object_keys(c), F.array(*map(F.lit, EXPECTED)))), F.lit(0))
    last = lambda all_: F.get(all_, F.size(all_) - 1)

    def chosen(t: Column) -> Column:
        # the candidates' second half is read only where the first has no name, and differs from it
        inner = let(F.regexp_extract(t, BRACED, 0), lambda cut: F.when((cut != "") & (cut != t), let(valid(cut), lambda more: F.coalesce(marked(more), last(more)))))
        return let(valid(t), lambda all_: F.coalesce(marked(all_), inner, last(all_)))

    return spaced(let(F.coalesce(text, F.lit("")), chosen))


def literals_of(text: Column) -> Column:
    """Every value in a JSON text that is neither null nor blank, as text; whole floats as whole numbers too."""
    leaves = F.filter(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda leaf: ~leaf.rlike(r":$"))
    plain = lambda leaf: F.when(leaf.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), leaf, F.lit("}")), "$.v")).otherwise(leaf)
    twin = lambda leaf: F.when(leaf.rlike(r"^-?\d+\.0+$"), F.array(leaf, F.regexp_extract(leaf, r"^-?\d+", 0))).otherwise(F.array(plain(leaf)))
    shown = F.filter(F.flatten(F.transform(leaves, twin)), lambda v: F.trim(v) != "")
    return F.when(F.try_parse_json(text).isNotNull(), shown).otherwise(F.array().cast("array<string>"))
