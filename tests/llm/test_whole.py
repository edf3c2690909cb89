"""Cases that a shortened job would get wrong."""

import base64
import json
import os
import random
import re
import time

import numpy as np
import pytest

from quayside.llm import license_scan, lm_score, pii, secrets
from tests.llm.test_brute_force import tlv


def test_lm_tells_rare_characters_apart(spark):
    """Digits and other scripts are tokens of their own, in the counts and in the scores."""
    rows = [(k, "abcdefghijklmnopqrstuvwxyz ,. " * 40) for k in range(5)] + [(10, "0123456789" * 60), (11, "4071938265" * 3), (12, "мир и труд " * 30), (13, "труд мири и" * 2), (14, "漢字仮名" * 20), (None, "a\0b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm_score.alphabet(docs)
    assert set(found) == {ord(c) for _, t in rows for c in t}
    counts = lm_score.window_counts(docs, found)
    assert len({tuple(r) for r in counts.select("context", "token").collect()}) == len({(t[max(0, i - 3) : i], t[i : i + 4], i < 3 and i, len(t) - i < 4 and len(t) - i) for _, t in rows for i in range(len(t))})
    got = {r.doc_id: r.mean_log_probability for r in lm_score.score(docs, lm_score.train(counts), found).collect()}
    assert got[11] < got[10] - 0.5 and got[13] < got[12] - 0.5


def test_lm_wide_alphabets():
    windows = lm_score.Windows(list(range(1000, 71000)))
    texts = ["".join(map(chr, (1000, 5000, 60000, 70999, 5))), "", "\0"]
    rows = windows.rows(texts)
    assert rows.shape == (6, 7) and (windows.windows(windows.keys(texts)) == rows).all() and rows[4, -1] == 70001
    narrow = lm_score.Windows(list(range(97, 123)))
    texts = ["abcxyz", "", "\0", "q" * 9, "é", "z"]
    assert (narrow.windows(narrow.keys(texts)) == narrow.rows(texts)).all() and narrow.keys([]).shape == (0,)
    net = lm_score.Network(windows.size)
    logp = net.log_probabilities(rows[:, :-1])
    assert np.allclose(np.exp(logp).sum(axis=1), 1, atol=1e-3) and np.allclose(logp[np.arange(6), rows[:, -1]], net.log_probability(rows[:, :-1], rows[:, -1]), atol=1e-3)


def test_licenses_tell_bsd_apart(spark):
    """Numbered or bulleted, clause 3 decides; notices without their warranty are not whole ones."""
    two, three, mit = (license_scan.TEMPLATES[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT"))
    number = lambda t: t.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    texts = [two, three, number(two), number(three), "x " * 70 + three.replace("DAMAGES", "HARM"), mit, mit[: mit.index("THE SOFTWARE IS PROVIDED")]]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), choose=True).collect()
    got = [{r.license for r in rows if r.doc_id == k and r.license != "BSD-conditions"} for k in range(len(texts))]
    assert got == [{"BSD-2-Clause"}, {"BSD-3-Clause"}, {"BSD-2-Clause"}, {"BSD-3-Clause"}, {"BSD-3-Clause"}, {"MIT", "MIT-permission"}, {"MIT-permission"}]


def test_licenses_bound_of_misses():
    for text in license_scan.TEMPLATES.values():
        words = re.findall(r"[^\W_]+", text.lower())
        n = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
        if n:
            similarity = 0.8 * n / (n + 2 * license_scan.size_class(n) - 0.8 * n)
            assert (1 - similarity) ** license_scan.BANDS < 1e-6


def key_lines(size=60):
    der = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\1" + os.urandom(size)) for _ in range(8)))
    text = base64.b64encode(der).decode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


@pytest.mark.parametrize("size", [40, 48, 60, 61, 62])
def test_secrets_in_other_layouts(size):
    lines = key_lines(size)
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    pem = "\n".join([begin, *lines, end, ""])
    whole = [json.dumps({"private_key": pem}), "KEY=" + pem.replace("\n", "\\r\\n"), json.dumps(json.dumps({"k": pem})), json.dumps(pem).replace("/", "\\/")]
    whole += ["".join(f"{p}{x}\n" for x in pem.splitlines()) for p in ("> ", "# ", "// ", "+", "    ", " * ")] + ["".join(f'  "{x}\\n" +\n' for x in pem.splitlines())]
    for text in whole:
        (a, kind, b), = secrets.confirmed_spans(text)
        assert kind == "der" and text[a:].startswith(begin) and text[:b].endswith(end)
        assert not any(x[4:-4] in secrets.redacted(text, "[SECRET]") for x in lines)
    bare = ["\n".join(lines), "see\n" + "\n".join(lines) + "\nend of key", "\r\n".join(lines), json.dumps({"k": "x\n" + "\n".join(lines)}), "\n".join("> " + x for x in lines)]
    for text in bare:
        (a, kind, b), = secrets.confirmed_spans(text)
        assert kind == "der" and text[a:].startswith(lines[0]) and text[:b].endswith(lines[-1])
    assert secrets.confirmed_spans("\n".join(base64.b64encode(os.urandom(48)).decode() for _ in range(20))) == []


def test_secrets_token_after_a_prefix():
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    token = f"{part(b'{"alg":"HS256"}')}.{part(b'{"sub":"1"}')}.{part(os.urandom(32))}"
    for before in ("longprefix_12.", "longprefix_12.second_part_3.", "example_host_name.x."):
        assert secrets.confirmed_spans(before + token) == [(len(before), "jwt", len(before + token))]


def test_secrets_take_linear_time():
    began = time.time()
    for text in ("-----BEGIN PRIVATE KEY-----\n" * 20_000, "a" * 400_000, ("M" * 64 + "\n") * 6_000, "abcdefghijklmn." * 30_000, "\\n" * 200_000):
        secrets.report_row(text)
    assert time.time() - began < 10


def test_pii_classifier_beats_the_vote(spark):
    """Numbers of the same form, which no labeler tells apart where the words around give no cue: the classifier learns from
    the cued ones which words go with which."""
    rng, rows, want = random.Random(9), [], {}
    digit = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for k in range(1200):
        true, cue = rng.random() < 0.5, rng.random() < 0.5
        lead = ("please call, " if true else "the order, ") if cue else "so then "
        rows.append((k, f"{'plain words go here ' * rng.randint(0, 3)}{lead}{rng.choice(('ring', 'dial') if true else ('lot', 'bin'))} {rng.choice('23')}1{rng.choice('2346')}-{rng.choice('23467')}{digit(2)}-{digit(4)}{rng.choice((' and more', '.', ' ;'))}"))
        want[k] = (true, cue)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: "phone_local" in r.spans for r in pii.pii_report(docs).collect()}
    votes = {r.doc_id: any(pii.KINDS[s.kind] == "phone_local" and sum(pii.decode(s.votes)) > 0 for s in r.spans) for r in pii.candidates(docs).collect()}
    right = lambda told, cue: sum(told[k] == t for k, (t, c) in want.items() if c == cue) / sum(c == cue for _, c in want.values())
    assert right(found, False) > 0.9 > 0.6 > right(votes, False) and right(found, True) > 0.9 > right(votes, True)


def test_lm_ranks_foreign_text_and_junk_below_the_corpus(spark):
    """Trained on plain text, sentences of its language rank above other scripts, symbols and shuffled letters."""
    words = "the cat sat on a mat and then it ran to the old house by the river where some men had been at work all day".split()
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choices(words, k=60)) + ".") for k in range(150)]
    good = ["the old men had been at the river all day.", "then it ran to the house and sat on a mat."]
    bad = ["мир и труд на земле для всех людей", "漢字仮名交じり文の例です", "%%&&** ###@@ ~~^^ ||<<>>", "tch dlo nme adh nebe ta eht vrier lal yad.", "QZXJ VWKQ ZZQX JJVQ"]
    network_docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = lm_score.alphabet(network_docs)
    network = lm_score.train(lm_score.window_counts(network_docs, found))
    probe = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r.doc_id: r.mean_log_probability for r in lm_score.score(probe, network, found).collect()}
    assert min(got[k] for k in range(len(good))) > 0.5 + max(got[k] for k in range(len(good), len(good + bad)))


def test_lm_scores_of_far_weights():
    """Sums of exponentials are shifted where weights are large, and not where they are small; both as the full table has it."""
    rng = np.random.default_rng(1)
    seen, token = rng.integers(0, 150, (500, 6)), rng.integers(0, 150, 500)
    for factor in (1.0, 200.0):
        net = lm_score.Network(150)
        for k in (3, 5):
            net.params[k] *= np.float32(factor)
        want = net.log_probabilities(seen)[np.arange(500), token]
        got = net.log_probability(seen, token)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-4)
        one = token // lm_score.GROUP == 0
        assert np.allclose(net.log_probability(seen[one], token[one]), want[one], rtol=1e-4, atol=1e-4)
