"""Source divergence, target-distribution resampling and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quayside.llm import decontaminate, divergence, target_sampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM, WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def plain_audit(rows, least, top):
    texts = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {t[0] for t in texts}:
        groups = sorted({s for at, s, _ in texts if at == lang})
        seen = Counter(w for at, _, words in texts if at == lang for w in set(words))
        kept = sorted((w for w, k in seen.items() if k >= least), key=str.encode)
        count = {s: Counter(w for at, own, words in texts if (at, own) == (lang, s) for w in words) for s in groups}
        part = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: part(count[s]) for s in groups}, part(sum(count.values(), Counter()))
        for s in groups:
            pairs = [("pair", o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in groups if o != s]
            terms = [("term", w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for found, most in ((pairs, len(pairs)), (terms, top)):
                found.sort(key=lambda e: (-e[2], e[1].encode()))
                out += [(lang, s, kind, item, value, k + 1) for k, (kind, item, value) in enumerate(found[:most])]
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cé", "ÜX", "zz", "日", "q1q") for b in ("", "a", "B", "ß")]
    texts = [" ".join(rng.choices(words, weights=range(1, 1 + len(words)), k=rng.randint(0, 30))) for _ in range(n)]
    return [(rng.choice(["en", "de", None, "only"]), rng.choice(["s1", "s2", "é", "z", None, ""]), t) for t in texts] + [("lone", "s1", None), ("lone", "s2", ""), ("single", "x", "a a a")] + [("en", "s1", texts[0])] * 9


@pytest.mark.parametrize(("chunk", "tile"), [(8192, 64), (3, 2), (1, 1)])
def test_audit(spark, chunk, tile):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, rank int")
    got = rows_of(divergence.audit(docs, least_docs=8, top=4, chunk=chunk, tile=tile), "lang", "source", "part", "item", "value", "rank")
    assert got == plain_audit(rows, 8, 4) and len({r[2] for r in got}) == 2


def test_audit_of_odd_rows(spark, odd, none):
    assert divergence.audit(none).count() == 0
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    names = ("lang", "source", "part", "item", "value", "rank")
    assert rows_of(divergence.audit(odd, least_docs=1, top=3), *names) == plain_audit(rows, 1, 3)
    assert {r[4] for r in rows_of(divergence.audit(odd), *names)} == {0}  # no term is in 30 documents


def test_audit_of_large_counts():
    import numpy as np

    count, n, kept = np.array([9 * 10**14, 0]), np.int64(10**15), np.int64(10**6)
    assert divergence.share(count, n, kept).tolist() == [1 + 10**9 * (c + 5) // (10**15 + 5 * 10**6) for c in count.tolist()]


def plain_resample(docs, target, least, percent):
    features = lambda text: [" ".join(w[i : i + k]) for w in [WORD.findall((text or "").translate(LOWER))] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for key, text in docs:
        f, h = features(text), int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD.findall((text or "").translate(LOWER)))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resample(spark, odd, none):
    rng = random.Random(3)
    words = ["The", "cat", "saw", "ÉTÉ", "x9", "日本", "b_c", "dog's"]
    docs = [(k if k % 17 else None, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)] + [(7, "cat saw the " * 40)] * 12 + [(400, None), (401, "")]
    target = ["the cat saw the dog"] * 3 + [None, "été x9"]
    df, bench = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, start int"), spark.createDataFrame([(t,) for t in target], "text string")
    names = ("doc_id", "n_features", "weight", "score", "rank")
    assert rows_of(target_sampling.resample(df.repartition(5), bench, percent=20), *names) == plain_resample(docs, target, 20, 20)
    assert target_sampling.selected(df.where("doc_id < 300"), bench).count() <= 20
    assert target_sampling.resample(none, bench).count() == 0
    got = {r.doc_id: r for r in target_sampling.resample(odd, bench.limit(0)).collect()}
    assert got[1].n_features == got[2].n_features == got[1].weight == 0 and got[4].n_features == 3 * 45000 - 3


def test_runs_across_blocks():
    features = target_sampling.Features(3, 10000)
    texts = [b"a b c", None, b"w " * 900_000 + b"end", b"x"]
    many = [0, 0, 0, 0]
    for block in features.blocks(texts):
        for hashed, place, row in features.runs(*block):
            assert len(place) == len(row) and (place < len(hashed)).all()
            for r in set(row.tolist()):
                many[r] += int((row == r).sum())
    assert many == [6, 0, 3 * 900_001 - 3, 1]


def plain_decontaminate(docs, items, window):
    words = lambda text: WORD.findall((text or "").translate(LOWER))
    passages = defaultdict(set)
    for key, text in items:
        w = words(text)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            passages[tuple(w[i : i + window])].add(key)
    sizes, out = {len(p) for p in passages}, []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in passages:
                    hit |= set(range(i, i + n))
                    found |= passages[p]
        found = sorted(str(i) for i in found if i is not None)
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark, odd, none):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "be", "Sea", "dé", "e5", "日"])
    item = lambda n: " ".join(word() for _ in range(n))
    items = [(k, item(rng.choice([3, 5, 9, 10, 14, 30]))) for k in range(25)] + [(100, None), (101, " ?! "), (None, item(12)), (3, item(11)), (102, "single"), (103, "same text " * 12)]
    docs = []
    for k in range(80):
        middle = rng.choice(items[:25])[1]
        docs.append((k if k % 11 else None, f"{item(rng.randint(0, 40))}-{middle.upper()}, {item(4)}" if k % 3 else item(rng.randint(0, 60))))
    docs += [(200, None), (201, ""), (202, "a single, here"), (203, "same text " * 50), (5, "x " + items[4][1])] + [(204, items[7][1] + " " + items[8][1])] * 30
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, n_hit int, digest string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(decontaminate.report(df, bench), *names)
    assert got == plain_decontaminate(docs, items, 10) and any(r[3] > 1 for r in got)
    clean = [d for d in docs if not plain_decontaminate([d], items, 10)[0][5]]
    assert rows_of(decontaminate.clean(df, bench), "doc_id", "text") == sorted(clean, key=str)
    assert decontaminate.report(none, bench).count() == 0
    assert {r.contaminated for r in decontaminate.report(odd, bench.limit(0)).collect()} == {False}


@pytest.mark.parametrize("length", range(1, 11))
def test_spans_share_fingerprints(spark, length):
    """Every span of `length` shared words has its fingerprint among those of a text that holds it."""
    from pyspark.sql import functions as F

    rng = random.Random(length)
    span = [rng.choice("abc") for _ in range(length)]
    texts = [(span, [rng.choice("abc") for _ in range(rng.randint(0, 9))] + span + [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(20)]
    df = spark.createDataFrame(texts, "span array<string>, words array<string>")
    inside = F.array_contains(decontaminate.least_hashes(F.transform("words", lambda w: F.xxhash64(w)), length), decontaminate.fingerprint(F.col("span"), length))
    assert df.where(~inside).isEmpty()
