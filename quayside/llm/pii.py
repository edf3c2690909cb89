"""Personal data by weak supervision, in DataFrame expressions only.

Strict base patterns (mail addresses, IP addresses, payment cards, phone numbers) and looser ones propose spans. Six
labelers vote for, against or not at all on each: checks of the pattern, gazetteers (endings, issuers, dialling codes,
given names, nouns that make a name a place), cue words before the span, its structure, its borders, and well-known
placeholders. Expectation-maximisation over the counts of vote patterns, a bounded table whatever the corpus, estimates
for each kind how reliable each labeler is. Its posteriors train the span classifier, a naive Bayes model of the votes
and of features no labeler sees: length, shape, and the words before and after by hash. It decides on the looser spans;
base spans always stay.

Defined results: a null text counts as empty and has no span; the digest of no spans is that of the empty string; an
empty table gives an empty result; repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.plans.runtime import let, materialize

# The base patterns. Possessive quantifiers and guards against starting inside a run keep the matches the
# same and the time in proportion to the text; \G allows a start where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser patterns, of our own.
NAMES = ("Alexander", "Alfred", "Alice", "Andrea", "Andreas", "Andrew", "Anna", "Anthony", "Antonio", "Barbara", "Benjamin", "Camille", "Carlos", "Carmen", "Catherine", "Charles", "Charlotte", "Christian", "Christine", "Christopher", "Claire", "Claudia", "Daniel", "David", "Diego", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Fernando", "Florian", "Francisco", "François", "Frank", "Gabriel", "George", "Guillaume", "Hannah", "Hans", "Heinrich", "Helen", "Henry", "Isabella", "Jacques", "James", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "Johann", "John", "Jonathan", "José", "Joseph", "Juan", "Julia", "Karl", "Katharina", "Kevin", "Klaus", "Laura", "Linda", "Lisa", "Louis", "Lucia", "Luis", "Manuel", "Margaret", "Maria", "Marie", "Mark", "Martin", "Mary", "Matthew", "Michael", "Miguel", "Nicholas", "Olivia", "Pablo", "Patricia", "Paul", "Peter", "Philippe", "Pierre", "Rebecca", "Richard", "Robert", "Rosa", "Samuel", "Sandra", "Sarah", "Sebastian", "Sofia", "Sophie", "Stefan", "Stephanie", "Susan", "Thomas", "Ursula", "Victoria", "William", "Wolfgang")
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)"
#: Nouns and the like that make a place, a firm or a work of a given name.
NOT_SURNAMES = ("Street", "Station", "Avenue", "Road", "Square", "Park", "Bridge", "Lake", "Falls", "River", "Island", "Hospital", "University", "College", "School", "Church", "Tower", "Hotel", "House", "Hall", "Museum", "Airport", "Company", "Foundation", "Institute", "Award", "Prize", "Day", "County", "City", "Valley", "Bay", "Cross", "Line", "Court", "Press", "Medal", "Platz", "Straße", "Strasse", "Brücke", "Plaza", "Calle", "Rue")
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,64}+){1,4}"
LOCAL = r"(?<![0-9+().-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PERSON = rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{TITLES}\.?\x20\p{{Lu}}\p{{Ll}}{{1,30}}+(?:\x20\p{{Lu}}\p{{Ll}}{{1,30}}+)?|(?:{'|'.join(NAMES)})\x20\p{{Lu}}\p{{Ll}}{{2,30}}+)"

KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "social", "iban", "person")
PATTERNS = (EMAIL, IP, CARD, PHONE, SPELLED, LOCAL, SOCIAL, IBAN, PERSON)
#: A cheap test that a text must pass for the pattern to match at all.
NEEDS = ("@", ".", "", "+", "at", "", "-", "", " ")
BASE = 4
CUES = (r"e-?mail|mail|contact|correo|courriel", r"\bip\b|host|server|address|adresse|direcci", r"card|visa|credit|karte|carte|tarjeta|pay", r"phone|\btel|call|mobile|fax|\bruf|telef|tél", r"e-?mail|mail|contact|correo|courriel|write|reach", r"phone|\btel|call|mobile|fax|\bruf|telef|tél", r"\bssn\b|social|security|\btax", r"iban|account|konto|compte|cuenta|bank", r"name|\bmr\b|\bmrs\b|\bdr\b|herr|frau|\bmme\b|se.or|dear|\bby\b|\bfrom\b|signed|author|contact|\bcall\b")
AGAINST = r"version|isbn|issn|order|invoice|\bsku\b|model|serial|build|commit|section|chapter|ticket|\bpart\b|release|\bv\.?\x20?$"
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "ch", "at", "it", "nl", "us", "ca")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25, "SE": 24}
LABELERS = ("pattern", "gazetteer", "context", "structure", "border", "placeholder")
#: Where estimation starts: for each labeler, probabilities of votes 1, 0, -1 on true spans, then on false ones.
START = ((0.75, 0.2, 0.05, 0.25, 0.3, 0.45), (0.6, 0.35, 0.05, 0.2, 0.35, 0.45), (0.45, 0.5, 0.05, 0.1, 0.6, 0.3), (0.5, 0.45, 0.05, 0.3, 0.4, 0.3), (0.6, 0.25, 0.15, 0.45, 0.25, 0.3), (0.01, 0.96, 0.03, 0.01, 0.69, 0.3))
#: Spans that START weighs as much as, most that a kind as a whole is trusted or doubted at first (log odds), turns.
PRIOR, MOST, TURNS = 20.0, 1.0, 10
CONTEXT_CHARS, AFTER_CHARS, PREFIX_BLOCK = 40, 24, 256
#: Features of the classifier, with their numbers of values.
FEATURES = {"length": 4, "shape": 16, "word_before": 16, "word_after": 16}


def prefix_sums(lengths: Column) -> Column:
    """Of an array, the sum of all elements before each; in blocks, as appending to an array copies it."""
    append = lambda acc, n: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + n).alias("s"))
    run = lambda values, s: F.aggregate(values, F.struct(F.array().cast("array<int>").alias("a"), s.alias("s")), append, lambda acc: acc["a"])
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PREFIX_BLOCK).cast("int")), lambda b: F.slice(lengths, b * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n))
        return F.flatten(F.zip_with(blocks, run(totals, F.lit(0)), run))

    return let(cut, joined)


def finds(text: Column, pattern: str, need: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points), value, before and after."""
    made = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def placed(values: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            lengths = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.coalesce(F.length(v), F.lit(0)))

            def spans(offsets: Column) -> Column:
                def span(v: Column, i: Column) -> Column:
                    start = offsets[i] + F.length(gaps[i])
                    return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), F.right(gaps[i], F.lit(CONTEXT_CHARS)).alias("before"), F.left(gaps[i + 1], F.lit(AFTER_CHARS)).alias("after"))

                return F.transform(values, span)

            return let(prefix_sums(lengths), spans)

        return F.when(F.size(values) == 0, F.array().cast(made)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    all_of = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(all_of if not need else F.when(F.contains(text, F.lit(need)), all_of).otherwise(F.array().cast("array<string>")), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(number, F.length(number) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), digit), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(value: Column) -> Column:
    """The account number's check: letters count from 10, the first four characters go last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(s: Column, c: Column) -> Column:
        n = F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.when(c == "", s).otherwise((s * F.when(n > 9, 100).otherwise(10) + n) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def passes(kind: int, value: Column) -> Column:
    """The check of a base kind; looser patterns have none."""
    if KINDS[kind] == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: F.when(F.length(x) > 3, F.lit(False)).otherwise(x.cast("int") <= 255))
        return F.forall(F.split(value, r"\."), part)
    if KINDS[kind] == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if KINDS[kind] == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def votes(kind: int, span: Column) -> list[Column]:
    """1 for, -1 against, 0 for no opinion, in the order of LABELERS."""
    value, name = span["value"], KINDS[kind]
    before, number = F.lower(span["before"]), digits(value)
    either = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    none, never = F.lit(0), F.lit(False)
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    plain = F.replace(value, F.lit(" "), F.lit(""))
    surname = F.regexp_extract(value, r"(\p{L}+)$", 1)
    cue, against = before.rlike(CUES[kind]), before.rlike(AGAINST)
    context = F.when(cue & ~against, 1).when(against & ~cue, -1).otherwise(0)

    if name == "email":
        pattern = yes(~value.rlike(r"^[^@]{65,}|@(?:-|.*-\.|.*\.-|.*-$)"))
        gazetteer, structure = either(ending.isin(*TLDS), ending.rlike("^[0-9-]+$")), either(value.rlike("^[^@]*[A-Za-z]"), value.rlike(r"\.\.|^\.|\.@"))
        placeholder = either(never, F.lower(value).rlike(r"@(?:example|test|domain|invalid)\.|^(?:user|name|you|foo|noreply)@"))
    elif name == "ip":
        pattern = yes(passes(kind, value))
        gazetteer = either(~value.rlike(r"^0"), value.rlike(r"^(?:0|10|127|22[4-9]|2[345][0-9]|192\.168|169\.254)\."))
        structure, placeholder = either(value.rlike(r"\.[0-9]{2,3}\."), value.rlike(r"(?:^|\.)0[0-9]|\.0\.0$")), either(never, value.isin("1.2.3.4", "0.0.0.0", "1.1.1.1"))
    elif name == "card":
        pattern = yes(passes(kind, value))
        gazetteer = yes(number.rlike(r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11})$"))
        structure = yes(value.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])(?:[0-9]{4}\1)+[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"))
        placeholder = either(never, number.rlike(r"^([0-9])\1+$|^4111(?:1)+$|^4242(?:42)+$"))
    elif name == "phone":
        pattern = yes(passes(kind, value))
        gazetteer = yes(number.rlike(r"^(?:1[2-9]|2[07]|3[0-469]|35[0-9]|4[013-9]|42[013]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"))
        structure, placeholder = either(value.rlike(r"^[^()]*(?:\([0-9\x20]+\)[^()]*)?$"), value.rlike(r"[().-]{3}")), either(never, number.rlike(r"([0-9])\1{6}|1234567|555010"))
    elif name == "email_spelled":
        pattern = yes(ending.rlike("^[a-z]{2,12}$"))
        gazetteer, structure = yes(ending.isin(*TLDS)), either(value.rlike("^[^(\\[]*[A-Za-z]") & (F.length(value) <= 80), never)
        placeholder = either(never, F.lower(value).rlike(r"[)\]]\x20?(?:example|test|domain|invalid)\b(?!\x20?[(\[]dot[)\]]\x20?com)"))
    elif name == "phone_local":
        pattern = yes(value.rlike(r"^\(?[2-9][0-9]{2}\)?.[2-9]"))
        gazetteer = either(number.rlike("^(?:[2-9]0[1-9]|[2-9]1[02-9]|[2-9][2-79][0-9])"), number.rlike("^(?:555|800|888|877|900|000)"))
        structure, placeholder = yes(value.rlike(r"^(?:\([0-9]{3}\)\x20[0-9]{3}[\x20.-]|[0-9]{3}([\x20.-])[0-9]{3}\1)[0-9]{4}$")), either(never, number.rlike(r"^([0-9])\1{5}|1234567"))
    elif name == "social":
        pattern = yes(~value.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        gazetteer, structure, placeholder = none, none, either(never, value.isin("078-05-1120", "219-09-9999") | number.rlike(r"^([0-9])\1+$"))
    elif name == "iban":
        length, expected = F.length(plain), reduce(lambda c, kv: c.when(F.substring(value, 1, 2) == kv[0], kv[1]), IBAN_LENGTHS.items(), F.when(never, 0))
        pattern, gazetteer = yes(mod97(value)), F.when(expected.isNull(), 0).otherwise(yes(length == expected))
        structure, placeholder = either(value.rlike(r"^(?:[A-Z0-9]+|(?:[A-Z0-9]{4}\x20)+[A-Z0-9]{1,4})$"), never), either(never, plain.rlike(r"([A-Z0-9])\1{9}"))
    else:
        pattern = F.when(value.rlike(rf"^{TITLES}\b"), 1).otherwise(0)
        gazetteer = either(F.regexp_extract(value, r"^(\p{L}+)", 1).isin(*NAMES), surname.isin(*NOT_SURNAMES))
        structure = either(never, span["after"].rlike(rf"^\x20(?:{'|'.join(NOT_SURNAMES)})\b"))
        placeholder = either(never, value.isin("John Doe", "Jane Doe"))
    left, right = F.right(span["before"], F.lit(1)), F.left(span["after"], F.lit(1))
    border = F.when(left.rlike(r"[\p{L}\p{N}]") | right.rlike(r"[\p{L}\p{N}]"), -1).when(left.rlike(r"[/=_#&@.-]") | right.rlike(r"[/=_#&@-]"), 0).otherwise(1)
    return [pattern, gazetteer, context, structure, border, placeholder]


def features(span: Column) -> list[Column]:
    """Numbers of the values of FEATURES."""
    value = span["value"]
    runs = reduce(lambda v, r: F.regexp_replace(v, *r), ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[0-9]+", "9")), value)
    bucket = lambda c, name: F.pmod(F.xxhash64(c), F.lit(FEATURES[name])).cast("int")
    word = lambda side, pattern: F.lower(F.regexp_extract(side, pattern, 1))
    length = F.length(value)
    return [
        F.when(length <= 8, 0).when(length <= 16, 1).when(length <= 32, 2).otherwise(3), bucket(runs, "shape"),
        bucket(word(span["before"], r"(\p{L}+)[^\p{L}]*$"), "word_before"), bucket(word(span["after"], r"^[^\p{L}]*(\p{L}+)"), "word_after"),
    ]


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: start, kind, end, base (a base span), votes (a number in base 3) and features."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def of(kind: int) -> Column:
        def judged(span: Column) -> Column:
            code = reduce(lambda s, v: 3 * s + v + 1, reversed(votes(kind, span)), F.lit(0))
            base = passes(kind, span["value"]) if kind < BASE else F.lit(False)
            return F.struct(span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end"), base.alias("base"), code.alias("votes"), F.array(*features(span)).alias("features"))

        return F.transform(finds(F.col("text"), PATTERNS[kind], NEEDS[kind]), judged)

    return read.select("doc_id", F.array_sort(F.concat(*[of(k) for k in range(len(KINDS))])).alias("spans"))


def decode(code: int) -> list[int]:
    return [code // 3**j % 3 - 1 for j in range(len(LABELERS))]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


class Model:
    """For each kind the log odds of a true span: a first number, one for each labeler's vote, one for each feature's value."""

    def __init__(self):
        self.first = [0.0] * len(KINDS)
        self.votes = [[[math.log(row[2 - v] / row[5 - v]) for v in range(3)] for row in START] for _ in KINDS]
        self.values = [[[0.0] * n for n in FEATURES.values()] for _ in KINDS]

    def begin(self, counts: dict[tuple[int, int], int]) -> None:
        """START's evidence relative to its mean over the kind's spans, and of that mean no more than MOST: a vote that all
        spans of a kind get tells none of them apart, however much START makes of it."""
        for kind in {k for k, _ in counts}:
            rows = [(sum(self.votes[kind][j][v + 1] for j, v in enumerate(decode(c))), n) for (k, c), n in counts.items() if k == kind]
            mean = sum(x * n for x, n in rows) / sum(n for _, n in rows)
            self.first[kind] = max(-MOST, min(MOST, mean)) - mean

    def score(self, span: Column) -> Column:
        """The classifier: log odds of votes and features together."""
        sizes = list(FEATURES.values())
        flat = lambda nested: F.lit([x for kind in nested for row in kind for x in row])
        votes, values = flat(self.votes), flat(self.values)
        vote = lambda j: F.pmod(F.floor(span["votes"] / 3**j).cast("int"), F.lit(3))
        out = F.lit(self.first)[span["kind"]]
        for j in range(len(LABELERS)):
            out = out + votes[span["kind"] * (3 * len(LABELERS)) + 3 * j + vote(j)]
        for f in range(len(sizes)):
            out = out + values[span["kind"] * sum(sizes) + sum(sizes[:f]) + span["features"][f]]
        return out

    def learn(self, rows: list) -> None:
        """From sums of posteriors by (kind, place, value); places are the labelers, then the features. Reliabilities lean on
        START with PRIOR spans, values that are seen seldom count little."""
        sums: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        for r in rows:
            sums.setdefault((r.kind, r.place), {})[r.value] = (r.true, r.false)
        for (kind, place), found in sums.items():
            true, false = (sum(x[y] for x in found.values()) for y in (0, 1))
            if not place:
                self.first[kind] = math.log((true + PRIOR / 2) / (false + PRIOR / 2))
            if place < len(LABELERS):
                row = START[place]
                seen = [found.get(v, (0.0, 0.0)) for v in range(3)]
                self.votes[kind][place] = [math.log((t + PRIOR * row[2 - v]) / (true + PRIOR) * (false + PRIOR) / (f + PRIOR * row[5 - v])) for v, (t, f) in enumerate(seen)]
            elif true and false:
                both = true + false
                for value, (t, f) in found.items():
                    self.values[kind][place - len(LABELERS)][value] = math.log((t + PRIOR * true / both) / (true + PRIOR) * (false + PRIOR) / (f + PRIOR * false / both))


def trained(spans: DataFrame) -> Model:
    """Expectation-maximisation over all spans (column s): votes and features are views of the same hidden truth, so that
    words which go with doubtful votes speak against spans on which the labelers are silent."""
    model = Model()
    model.begin({(r[0], r[1]): r[2] for r in spans.groupBy("s.kind", "s.votes").count().collect()})  # at most kinds x 3^labelers rows
    vote = [F.pmod(F.floor(F.col("s.votes") / 3**j), F.lit(3)).cast("int") for j in range(len(LABELERS))]
    for _ in range(TURNS):
        p = 1 / (1 + F.exp(-model.score(F.col("s"))))
        each = spans.select(F.col("s.kind").alias("kind"), p.alias("p"), F.posexplode(F.concat(F.array(*vote), "s.features")).alias("place", "value"))
        model.learn(each.groupBy("kind", "place", "value").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect())  # at most a row for each number of the model
    return model


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, *, threshold: float = 0.5, **columns: str) -> DataFrame:
    found = materialize(candidates(docs, **columns), "pii-candidates")
    spans = found.select(F.explode("spans").alias("s"))
    model = trained(spans)
    added = lambda s: (s["kind"] >= BASE) & (model.score(s) >= logit(threshold))
    base = F.filter("spans", lambda s: s["base"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(BASE)], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.filter("spans", lambda s: s["base"] | added(s))).alias("spans"))
