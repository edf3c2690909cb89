"""What Python workers hold: at most, and once a task has ended."""

import tracemalloc
from collections import Counter

import numpy as np
import psutil
import pyarrow as pa
import pytest

from quayside.llm import batches, langid, lm_score, minhash, packing, secrets


@pytest.mark.parametrize("kind", ["<u8", "S14"])
def test_lm_counts_are_combined_without_copies(kind):
    """Equal to a plain count; beside the windows held, no more than three copies of them at once."""
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(1, 400_000, 300_000).astype(kind), return_counts=True) for _ in range(4)]
    want = Counter()
    for k, n in held:
        want.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    size = sum(k.nbytes + n.nbytes for k, n in held)
    tracemalloc.start()
    keys, n = lm_score.combined(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and (keys[1:] > keys[:-1]).all()
    assert peak < 3 * size, peak / size
    empty = np.zeros(0, kind)
    assert [len(x) for x in lm_score.combined([(empty, np.zeros(0, "int64"))])] == [0, 0]


def test_a_task_gives_back_what_it_freed():
    """Freed pages between pages in use go back too."""
    kept, held = [], {}

    def task(rows):
        for batch in rows:
            np.ones(3_500_000)  # freed: the C library now keeps arrays up to this size for later
            parts = [np.ones(120_000) for _ in range(300)]
            kept.extend(parts[9::10])
            del parts
            held["task"] = psutil.Process().memory_info().rss
            yield batch

    for _ in batches.frugal(task)(iter([pa.record_batch({"text": ["a"]})])):
        pass
    assert held["task"] - psutil.Process().memory_info().rss > 150e6 and len(kept) == 30


def test_every_text_stage_gives_back(spark, monkeypatch):
    """The pipeline's stages in Python and the scoring run as tasks that give back."""
    docs, seen = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string"), []
    for module in (langid, lm_score, minhash, packing, secrets):
        monkeypatch.setattr(module, "frugal", lambda f, name=module.__name__.split(".")[-1]: seen.append(name) or f)
    network = langid.Network(["en"])
    monkeypatch.setattr(langid, "train", lambda *a, **k: network)
    langid.keep_identified(docs), langid.identify(docs, network)
    minhash.sketches(docs, 5), minhash.shingle_sets(docs, 5)
    secrets.redact(docs), secrets.secret_report(docs)
    packing.pieces_in(docs, "doc_id", "text", packing.vocabulary(), 2, 4096)
    lm_score.score(docs, lm_score.Network(40), lm_score.alphabet(docs)), lm_score.window_counts(docs, [97])
    assert Counter(seen) == {"langid": 2, "minhash": 2, "secrets": 2, "packing": 1, "lm_score": 3}
