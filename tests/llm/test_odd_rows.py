"""Every operator over odd rows and over an empty table."""

import pytest

from quayside.llm import embeddings, langid, license_scan, lm_score, minhash, mixing, packing, pii, quality, secrets

BY_DOCUMENT = {
    "mixing": mixing.mix_summary, "quality": quality.quality_report, "secrets": secrets.secret_report, "lm_score": lm_score.score_corpus, "langid": langid.identify_corpus,
    "pii": pii.pii_report, "minhash": minhash.near_duplicates,
}
SAME_ROWS = {"identified": langid.keep_identified, "one of each": minhash.keep_one, "redacted": secrets.redact, "stream": mixing.stream}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_per_document(odd, none, name):
    got = [r.doc_id for r in BY_DOCUMENT[name](odd).collect()]
    assert sorted(got, key=str) == sorted((r.doc_id for r in odd.collect()), key=str)
    assert BY_DOCUMENT[name](none).count() == 0


@pytest.mark.parametrize("name", SAME_ROWS)
def test_stages_keep_the_columns(odd, none, name):
    out = SAME_ROWS[name](odd)
    assert out.columns == odd.columns and out.count() >= 1
    assert SAME_ROWS[name](none).count() == 0


def test_values_of_odd_rows(odd):
    q = {r.doc_id: r for r in quality.quality_report(odd).collect()}
    assert (q[1].n_words, q[1].base_failed, q[1].kept, q[2].n_words, q[3].n_words, q[4].n_words) == (0, True, False, 0, 0, 45000)
    assert {r.doc_id: r.lang_pred for r in langid.identify_corpus(odd).collect() if r.doc_id in (1, 2, 3, 10)} == dict.fromkeys((1, 2, 3, 10), "und")
    s = {r.doc_id: r for r in secrets.secret_report(odd).collect()}
    assert s[1].spans == "" and s[1].base_sha256 == s[2].base_sha256
    p = {r.doc_id: r for r in pii.pii_report(odd).collect()}
    assert (p[0].n_email, p[0].n_ip, p[0].n_card, p[0].n_phone) == (1, 1, 1, 1) and p[1].spans == ""
    m = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert m[1] == (0, 1, True) and m[8] == (1, 8, True) and m[9] == (1, 8, False) and m[None][1:] == (None, True)
    n = {r.doc_id: (r.n_tokens, r.pseudo_log_likelihood, r.mean_log_probability) for r in lm_score.score_corpus(odd).collect()}
    assert n[1] == n[2] == (0, 0.0, None)


def test_one_id_with_several_texts(spark):
    words = " ".join(f"w{k}" for k in range(60))
    near, other = words + " x", " ".join(f"v{k}" for k in range(60))
    rows = [(1, words), (1, other), (1, ""), (1, " "), (2, near), (3, other), (3, other), (4, "a b c"), (5, words), (5, near), (6, None), (None, words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 4 + [(2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 1, False), (6, 6, True), (None, 1, False)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, words), (1, other), (1, ""), (1, " "), (4, "a b c"), (6, None), (None, words)], key=str)
    close = spark.createDataFrame([(1, words), (1, near), (2, near)], "doc_id long, text string")
    assert [r.doc_id for r in minhash.keep_one(close).collect()] == [1]


def test_packing_and_licenses(odd, none):
    pieces = packing.pack_corpus(odd).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == 1
    assert packing.pack_corpus(none).count() == 0
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, links int")
    assert embeddings.near_duplicates(empty).count() == 0
    bad = spark.createDataFrame([(1, None, 1, 0), (2, [0.0, 0.0], 1, 0), (3, [1.0, None], 1, 0), (4, [float("nan"), 1.0], 1, 0), (5, [1.0, 0.0], None, 0), (6, [], 1, 0)], empty.schema)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(bad).collect()) == [(i, 0, i, True) for i in range(1, 7)]


def test_redaction_marks_spans(spark):
    df = spark.createDataFrame([(1, 'a token = "abcdefabcdefabcdef12" z', 3), (2, None, 1)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in secrets.redact(df).orderBy("doc_id").collect()] == [(1, 'a [SECRET]" z', 13), (2, None, None)]


def test_ids_beside_nulls(spark):
    """Ids that floating point cannot hold stay as they are beside null ids, and keep their tokens."""
    big = 1 << 60
    docs = spark.createDataFrame([(big + 1, "one two"), (big + 3, "three"), (None, "four"), (None, None)] + [(None, None)] * 50, "doc_id long, text string").coalesce(1)
    got = packing.pack_corpus(docs)
    assert sorted({r.doc_id for r in got.collect() if r.doc_id}) == [big + 1, big + 3]
    assert got.count() == 54 and got.select("sequence_id", "offset").distinct().count() == 54
    kinds = {r.doc_id: r.lang_pred for r in langid.identify_corpus(docs.selectExpr("doc_id", "text", "'x' as lang")).collect() if r.doc_id}
    assert kinds == dict.fromkeys((big + 1, big + 3), "x")


def test_equal_rows_are_dealt_over_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(None, None)] * 9000, "doc_id long, text string").coalesce(2)
    groups = [r["count"] for r in packing.pack_corpus(docs).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()]
    assert sum(groups) == 9000 and max(groups) < 3000


def test_packing_keeps_a_stored_order(spark, tmp_path):
    rows = [(k, "word " * (1 + k * 7919 % 900)) for k in range(9000)]
    clashing = [(*r, 1, 2, 3) for r in rows]
    spark.createDataFrame(clashing, "doc_id long, text string, _part int, _run int, nth int").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    got = sorted(packing.pack_in_order(spark.read.parquet(str(tmp_path / "docs"))).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sorted(r.doc_id for r in got if r.start == 0) == list(range(9000))
    first = {}
    for r in got:
        first.setdefault(r.sequence_id >> 24, []).append(r.doc_id)
    runs = [(min(ids), max(ids)) for _, ids in sorted(first.items())]
    assert len(runs) >= 4 and all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    used = {}
    for r in got:
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096


def test_languages_of_documents_without_ids(spark):
    rows = [(None, f"der die das und ist nicht {k}", "de") for k in range(60)] + [(None, f"the and of is not that {k}", "en") for k in range(60)]
    found = langid.identify_corpus(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in found} == {"de", "en"} and all(abs(r["count"] - 60) <= 6 for r in found)


def test_embeddings_without_or_with_shared_ids(spark):
    import math

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(None, at(0)), (None, at(1)), (5, at(2)), (1, at(60)), (2, at(61)), (1, at(120)), (3, at(121)), (4, at(122)), (None, at(200)), (None, at(201)), (9, at(300)), (9, at(300))]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int"))
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str)
    assert found == sorted([(None, 2, 5, False)] * 2 + [(5, 2, 5, True), (1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False)] + [(None, 1, None, True)] * 2 + [(9, 1, 9, True)] * 2, key=str)
