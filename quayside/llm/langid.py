"""Language identification: a bidirectional gated recurrent network over bytes.

A small network, trained in numpy by backpropagation through time, reads a window of bytes from both sides and labels
every position; a document's probabilities are the mean over the positions of its letters, in all of its windows. Only
training looks at labels, and only at a bounded sample of labelled documents outside the held-out quarter.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing could be
learned; an empty table gives an empty result; repeated rows are labelled one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import frugal, slices

#: Of the network: states in each direction, numbers for a byte, bytes in a window, windows worked on together.
HIDDEN, EMBEDDED, WINDOW, BLOCK = 8, 6, 128, 2048
#: Of training: documents of each language, windows of each document, characters of each window, distinct languages at most.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_CHARS, MAX_LANGS = 400, 2, 72, 512
#: Bytes of text that one pass over the network holds.
CHUNK_BYTES = 1_000_000

LETTER = np.zeros(256, "float32")
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


class Direction:
    """One direction: byte embeddings (the last is constant, for biases), gate weights over state and embedding, output weights.

    A minimal gated unit: a gate z and a candidate c, both from the state and the byte; the new state is c + z (h - c).
    """

    def __init__(self, rng: np.random.Generator, classes: int, hidden: int = HIDDEN, embedded: int = EMBEDDED):
        f = lambda *shape, s: rng.normal(0, s, shape).astype("float32")
        self.embed = f(embedded, 256, s=0.5)
        self.embed[-1] = 1
        self.gates, self.v = f(2 * hidden, hidden + embedded, s=0.3), f(classes, hidden, s=0.3)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.v]


class Network:
    """Arrays are feature by window, so that every operation of a step runs over long rows."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.out = langs, np.zeros(len(langs), "float32")
        self.ways = (Direction(rng, len(langs)), Direction(rng, len(langs)))

    def params(self) -> list[np.ndarray]:
        return [*self.ways[0].params(), *self.ways[1].params(), self.out]

    def pooled(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Of windows x (time by window), the sum of the probabilities at positions where real is 1."""
        steps, n = x.shape
        logits = np.empty((steps, len(self.langs), n), "float32")
        total, p = np.zeros((len(self.langs), n), "float32"), np.empty((len(self.langs), n), "float32")
        for way, order in zip(self.ways, (range(steps), range(steps - 1, -1, -1)), strict=True):
            # tanh(x / 2) = 2 z - 1 for the gate: one call does for gate and candidate, and h = (h + c + (2 z - 1)(h - c)) / 2
            half = way.gates.copy()
            half[:HIDDEN] *= 0.5
            state, g = np.zeros((HIDDEN + EMBEDDED, n), "float32"), np.empty((2 * HIDDEN, n), "float32")
            h, e, z, c = state[:HIDDEN], state[HIDDEN:], g[:HIDDEN], g[HIDDEN:]
            d, e[-1] = np.empty_like(h), 1
            for t in order:
                for k in range(EMBEDDED - 1):
                    way.embed[k].take(x[t], out=e[k], mode="clip")
                np.matmul(half, state, out=g)
                np.tanh(g, out=g)
                np.subtract(h, c, out=d)
                d *= z
                h += c
                h += d
                h *= 0.5
                if way is self.ways[0]:
                    np.matmul(way.v, h, out=logits[t])
                else:
                    np.matmul(way.v, h, out=p)
                    p += logits[t]
                    p += self.out[:, None]
                    np.clip(p, -40, 40, out=p)
                    np.exp(p, out=p)
                    p *= real[t] / p.sum(axis=0)
                    total += p
        return total.T

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Cross-entropy at every real position, carried back through all steps of both directions."""
        steps, n = x.shape
        logits, kept = np.zeros((steps, len(self.langs), n), "float32") + self.out[:, None], []
        orders = (range(steps), range(steps - 1, -1, -1))
        for way, order in zip(self.ways, orders, strict=True):
            h, seen = np.zeros((HIDDEN, n), "float32"), {}
            for t in order:
                state = np.concatenate([h, way.embed[:, x[t]]])
                g = way.gates @ state
                z, c = 1 / (1 + np.exp(-g[:HIDDEN])), np.tanh(g[HIDDEN:])
                new = c + z * (h - c)
                seen[t], h = (state, new, z, c), new
                logits[t] += way.v @ h
            kept.append(seen)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(n)] -= 1
        p *= (real / max(1.0, real.sum()))[:, None, :]
        found = []
        for way, order, seen in zip(self.ways, orders, kept, strict=True):
            embed, gates, v = (np.zeros_like(w) for w in way.params())
            dh, rows = np.zeros((HIDDEN, n), "float32"), []
            for t in reversed(order):
                state, new, z, c = seen[t]
                v += p[t] @ new.T
                dh = dh + way.v.T @ p[t]
                dg = np.concatenate([dh * (state[:HIDDEN] - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)])
                gates += dg @ state.T
                back = way.gates.T @ dg
                rows.append((x[t], back[HIDDEN:]))
                dh = dh * z + back[:HIDDEN]
            at, by = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows], axis=1)
            for k in range(EMBEDDED - 1):
                embed[k] = np.bincount(at, by[k], 256)
            found += [embed, gates, v]
        return [*found, p.sum(axis=(0, 2))]

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 30, batch: int = 128, rate: float = 0.02, seed: int = 11) -> None:
        """Adam, on windows x (window by time; 0 pads) of class y."""
        rng, params = np.random.default_rng(seed), self.params()
        m, s, k = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params], 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                part, k = order[at : at + batch], k + 1
                for w, g, a, b in zip(params, self.gradients(x[part].T, LETTER[x[part].T], y[part]), m, s, strict=True):
                    np.clip(g, -1, 1, out=g)
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= (rate * (1 - k / (steps + 1)) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype("float32")

    def identify(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        at = 0
        while at < len(texts):
            codes, end, size = [], at, 0
            while end < len(texts) and (end == at or size < CHUNK_BYTES):
                codes.append((texts[end] or "").encode("utf-8", "replace"))
                size, end = size + len(codes[-1]), end + 1
            yield from self._identify(texts[at:end], codes)
            at = end

    def _identify(self, texts: list[str | None], codes: list[bytes]) -> Iterator[tuple[str, float]]:
        counts = [-(-len(c) // WINDOW) for c in codes]
        x = np.frombuffer(b"".join(c.ljust(k * WINDOW, b"\0") for c, k in zip(codes, counts, strict=True)), "uint8").reshape(-1, WINDOW)
        sums = []
        for a in range(0, len(x), BLOCK):
            part = np.ascontiguousarray(x[a : a + BLOCK].T)
            sums.append(self.pooled(part, LETTER[part]))
        sums = np.concatenate(sums) if sums else np.zeros((0, len(self.langs)), "float32")
        at = 0
        for text, count in zip(texts, counts, strict=True):
            p, at = sums[at : at + count].sum(axis=0, dtype="float64"), at + count
            if not self.langs or not text or not any(map(str.isalpha, text)) or not p.sum() > 0:
                yield "und", 0.0
            else:
                best = int(p.argmax())
                yield self.langs[best], round(min(1.0, float(p[best] / p.sum())), 5)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5) -> Network:
    """Learn from a bounded sample: a hash of id and text keeps about SAMPLE_DOCS documents of each
    language outside the held-out quarter. Rows without an id are learned from; equal rows count once."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    network = Network(sorted(counts))
    if not counts:
        return network
    chance = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.1 * SAMPLE_DOCS / n))])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    spot = lambda k: F.substring(F.col(text_col), 1 + F.pmod(F.xxhash64(F.lit(seed + k), F.col(id_col), F.col(text_col)), F.greatest(F.lit(1), F.length(text_col) - SAMPLE_CHARS)).cast("int"), F.lit(SAMPLE_CHARS))
    picked = labelled.where(u < chance[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), u.alias("u"), F.array(*[spot(k + 1) for k in range(SAMPLE_WINDOWS)]).alias("spots")).distinct()
    rows = sorted(picked.limit(2 * SAMPLE_DOCS * len(counts)).collect(), key=lambda r: (r.lang, r.u, r.spots))
    left, x, y = dict.fromkeys(counts, SAMPLE_DOCS), [], []
    for r in rows:
        if left[r.lang] > 0:
            left[r.lang] -= 1
            for spot_text in r.spots:
                x.append(spot_text.encode("utf-8", "replace")[:SAMPLE_CHARS].ljust(SAMPLE_CHARS, b"\0"))
                y.append(network.langs.index(r.lang))
    network.fit(np.frombuffer(b"".join(x), "uint8").reshape(-1, SAMPLE_CHARS), np.array(y))
    return network


def identify(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = list(network.identify(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return read.mapInArrow(frugal(label), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify_corpus(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, min_score: float = 0.3) -> DataFrame:
    """docs without those it rejects: texts without a language, or labelled with less certainty than min_score.

    Rows keep their columns, whatever their names; the labels are made in the same pass as the rows.
    """
    network, schema = train(docs), docs.schema
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            good = [lang != "und" and score >= min_score for lang, score in network.identify(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(frugal(kept), schema)
