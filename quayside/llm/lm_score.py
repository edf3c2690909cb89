"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are all lower-case code points of the corpus, each a class of its own; number 0 is the border of a text, and one
number stands for code points that only texts from elsewhere have. The network predicts each token from the three before
and the three after it; a document's score is the sum of the conditional log-probabilities of all of its tokens. Numbers
go by frequency, and the output has two levels: a group of 64 numbers, then the token in it.

Windows are counted over all documents, keyed by the full context and the token, so that the table grows with the corpus.
Each row of it trains the network once: in rounds, shards of about SHARD_ROWS rows train copies of the network in numpy,
with the rows' counts as weights, and the copies are averaged. Scoring evaluates each distinct window of a slice of texts.

Defined results: a null or empty text has no tokens, score 0 and a null mean; an empty table gives an empty result;
repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import frugal, give_back, slices
from quayside.plans.runtime import materialize

#: Tokens seen on each side, numbers for a token, hidden units, tokens of an output group.
SIDE, EMBEDDED, HIDDEN, GROUP = 3, 12, 64, 64
ROUNDS, SHARD_ROWS, BATCH, RATE = 4, 400_000, 512, 0.01
#: The places of a window, its context first.
PLACES = (*range(-SIDE, 0), *range(1, SIDE + 1), 0)
CHUNK_CHARS = 2_000_000
#: Windows that are scored at once, few enough for their hidden units to stay in the processor's cache.
STEP = 4000
#: Exponents up to here, and down to its negative, need no shift before they are summed.
FAR = 60.0
#: Windows that a task of the counting holds before it combines them, and distinct ones above which it then passes them on.
HELD, PASSED = 3_000_000, 2_500_000


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about CHUNK_CHARS characters, and their texts in lower case."""
    for batch in slices(batches, column):
        texts, at, size = [(t or "").lower() for t in batch.column(column).to_pylist()], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_CHARS or k + 1 == len(texts):
                yield batch.slice(at, k + 1 - at), texts[at : k + 1]
                at, size = k + 1, 0


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Windows:
    """Texts as windows of token numbers, one for every code point: the context before and after it, then itself."""

    def __init__(self, alphabet: list[int]):
        self.size = len(alphabet) + 2
        self.width = 1 if self.size <= 1 << 8 else 2 if self.size <= 1 << 16 else 3
        self.of = np.full(0x110000, self.size - 1, ("uint8", "uint16", "uint32")[self.width - 1])
        self.of[alphabet] = np.arange(1, len(alphabet) + 1)

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts with borders between them, and the places of tokens."""
        lengths = np.array([len(t) for t in texts], "int64")
        border = "\0" * SIDE
        c = self.of[points(border + "".join(t + border for t in texts))]
        starts = SIDE + np.cumsum(lengths + SIDE) - (lengths + SIDE)
        edge = np.zeros(len(c) + 1, "int32")
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + lengths, -1)
        real = np.cumsum(edge[:-1]) > 0
        c[~real] = 0
        return c, np.flatnonzero(real)

    def rows(self, texts: list[str]) -> np.ndarray:
        """Token numbers of each window, a column for each place in it."""
        c, at = self.numbered(texts)
        return np.stack([c[at + k] for k in PLACES], axis=1)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows(texts)
        return rows[:, :-1], rows[:, -1]

    def keys(self, texts: list[str]) -> np.ndarray:
        """One value for each window, equal only for equal windows: the bytes of its token numbers."""
        c, at = self.numbered(texts)
        if self.width == 1:
            wide, key = c.astype("<u8"), np.zeros(len(c), "<u8")
            for j, k in enumerate(PLACES):  # borders stand at both ends, so every real window is whole
                first, last = max(0, -k), len(c) - max(0, k)
                key[first:last] |= wide[first + k : last + k] << np.uint64(8 * j)
            return key[at]
        rows = np.stack([c[at + k] for k in PLACES], axis=1)
        raw = np.ascontiguousarray(rows, "<u4").view("uint8").reshape(len(rows), -1, 4)[:, :, : self.width]
        return np.ascontiguousarray(raw).reshape(len(rows), -1).view(f"S{len(PLACES) * self.width}")[:, 0]

    def windows(self, keys: np.ndarray) -> np.ndarray:
        """The windows of keys."""
        raw = np.ascontiguousarray(keys).view("uint8").reshape(len(keys), keys.dtype.itemsize)
        return numbers(raw[:, : len(PLACES) * self.width], len(PLACES))


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the place of each key among them."""
    if keys.dtype.kind == "S":
        return np.unique(keys, return_inverse=True)
    at, found = pd.factorize(keys)
    return found, at


def numbers(raw: np.ndarray, places: int) -> np.ndarray:
    """Rows of bytes as that many little-endian numbers each."""
    wide = np.zeros((len(raw), places, 4), "uint8")
    wide[:, :, : raw.shape[1] // places] = raw.reshape(len(raw), places, -1)
    return wide.view("<u4")[:, :, 0]


def contexts(column: np.ndarray | list[bytes] | pa.Array) -> np.ndarray:
    """Token numbers of contexts as the counts have them."""
    data = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return numbers(np.frombuffer(b"".join(data), "uint8").reshape(len(data), -1), 2 * SIDE) if data else np.zeros((0, 2 * SIDE), "<u4")


def alphabet(docs: DataFrame) -> list[int]:
    """All code points of all texts, the most frequent first."""

    def count(batches):
        n = np.zeros(0x110000, "int64")
        for _, texts in runs(batches, 0):
            n += np.bincount(points("".join(texts)), minlength=len(n))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["point", "n"])

    counts = docs.select("text").mapInArrow(frugal(count), "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return [r.point for r in counts.orderBy(F.desc("n"), "point").collect()]  # no more than Unicode has


def combined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and their counts. Empties held; no array outlives the one made of it."""
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
    held.clear()
    order = np.argsort(keys, kind="stable")  # merges what is sorted
    keys = keys[order]
    n = n[order]
    del order
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first) if len(first) else n
    return keys[first], n


def window_counts(docs: DataFrame, points_: list[int]) -> DataFrame:
    """context, token, n over all documents; a context is the bytes of its token numbers."""

    def count(batches):
        windows, held = Windows(points_), []

        def passed_on(keys, n):
            for a in range(0, len(keys), 100_000):
                rows = keys[a : a + 100_000]
                raw = np.ascontiguousarray(rows).view("uint8").reshape(len(rows), rows.dtype.itemsize)[:, : 2 * SIDE * windows.width]
                ends = np.arange(len(rows) + 1, dtype="int32") * raw.shape[1]
                context = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([context, pa.array(windows.windows(rows)[:, -1].astype("int32")), pa.array(n[a : a + 100_000])], ["context", "token", "n"])

        for _, texts in runs(batches, 0):
            held.append(np.unique(windows.keys(texts), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [combined(held)]
                if len(held[0][0]) > PASSED:
                    yield from passed_on(*held.pop())
                give_back()
        if held:
            yield from passed_on(*combined(held))

    return docs.select("text").mapInArrow(frugal(count), "context binary, token int, n long").groupBy("context", "token").agg(F.sum("n").alias("n"))


def log_softmax(o: np.ndarray) -> np.ndarray:
    o -= o.max(axis=1, keepdims=True)
    return o - np.log(np.exp(o).sum(axis=1, keepdims=True))


def picked(h: np.ndarray, w: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
    """One column of the log-softmax of h @ w + b in each row, for hidden units h between -1 and 1."""
    o = h @ w
    o += b
    if (np.abs(w).sum(axis=0) + np.abs(b)).max() > FAR:  # else no sum of exponentials leaves the range of floats
        o -= o.max(axis=1, keepdims=True)
    chosen = o[np.arange(len(o)), column]
    return chosen - np.log(np.exp(o, out=o) @ np.ones(o.shape[1], o.dtype))


class Network:
    def __init__(self, size: int, seed: int = 3):
        rng, groups = np.random.default_rng(seed), -(-size // GROUP)
        f = lambda *shape, s: rng.normal(0, s, shape).astype("float32")
        self.size = size
        self.params = [f(size, EMBEDDED, s=0.5), f(2 * SIDE * EMBEDDED, HIDDEN, s=0.2), np.zeros(HIDDEN, "float32"), f(HIDDEN, groups, s=0.2), np.zeros(groups, "float32"), f(groups, HIDDEN, GROUP, s=0.2), np.zeros((groups, GROUP), "float32")]
        self.params[6].reshape(-1)[size:] = -1e9  # numbers that no token has

    def hidden(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        embed, w, b = self.params[:3]
        x = embed[seen].reshape(len(seen), -1)
        return x, np.tanh(x @ w + b)

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """A row for each context: the log-probability of every token in the middle."""
        h = self.hidden(contexts(context) if context.dtype == object else context)[1]
        groups = log_softmax(h @ self.params[3] + self.params[4])
        return np.concatenate([groups[:, [g]] + log_softmax(h @ w + b) for g, (w, b) in enumerate(zip(*self.params[5:], strict=True))], axis=1)[:, : self.size]

    def folded(self) -> list[np.ndarray]:
        """For each place of a context, what each token there adds to the hidden units."""
        embed, w, _ = self.params[:3]
        return [embed @ w[k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(2 * SIDE)]

    def log_probability(self, seen: np.ndarray, token: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The log-probability of one token for each context."""
        tables, h = tables or self.folded(), np.repeat(self.params[2][None], len(seen), axis=0)
        for k, table in enumerate(tables):
            h += table.take(seen[:, k], axis=0)
        np.tanh(h, out=h)
        group = token // GROUP
        logp = picked(h, *self.params[3:5], group)
        for g in np.unique(group):
            at = slice(None) if (group == g).all() else np.flatnonzero(group == g)
            used = min(GROUP, self.size - int(g) * GROUP)
            logp[at] += picked(h[at], self.params[5][g][:, :used], self.params[6][g][:used], token[at] % GROUP)
        return logp

    def gradients(self, seen: np.ndarray, token: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean of negative log-probabilities."""
        (x, h), group, weight = self.hidden(seen), token // GROUP, (weight / weight.sum()).astype("float32")[:, None]
        d = np.exp(log_softmax(h @ self.params[3] + self.params[4]))
        d[np.arange(len(token)), group] -= 1
        d *= weight
        dh, dw, db, de = d @ self.params[3].T, np.zeros_like(self.params[5]), np.zeros_like(self.params[6]), np.zeros_like(self.params[0])
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            low = np.exp(log_softmax(h[at] @ self.params[5][g] + self.params[6][g]))
            low[np.arange(len(at)), token[at] % GROUP] -= 1
            low *= weight[at]
            dw[g], db[g] = h[at].T @ low, low.sum(axis=0)
            dh[at] += low @ self.params[5][g].T
        dh *= 1 - h * h
        dx, flat = (dh @ self.params[1].T).reshape(-1, EMBEDDED), seen.ravel()
        order = np.argsort(flat, kind="stable")
        known, first = np.unique(flat[order], return_index=True)
        de[known] = np.add.reduceat(dx[order], first)
        return [de, x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0), dw, db]

    def fit(self, seen: np.ndarray, token: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
        """Adam over every window, those of large counts several times with a share each; few windows are gone over again."""
        m, s = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        times = np.ceil(n / n.mean()).astype("int64")
        order = np.repeat(np.arange(len(n)), times)
        order = np.concatenate([rng.permutation(order) for _ in range(max(1, -(-40 * BATCH // len(order))))])
        weight, steps = n / times, -(-len(order) // BATCH)
        for k in range(1, steps + 1):
            pick = order[(k - 1) * BATCH : k * BATCH]
            for p, g, a, b in zip(self.params, self.gradients(seen[pick], token[pick], weight[pick]), m, s, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (RATE * (1 - 0.9 * k / steps) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype("float32")

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.params]).tobytes()

    def unpack(self, data: np.ndarray) -> None:
        at = 0
        for p in self.params:
            p[...] = data[at : at + p.size].reshape(p.shape)
            at += p.size


def shard_trainer(weights: bytes, size: int, turn: int):
    """A function that trains a copy of the network on one shard of the counts."""

    def one(rows: pa.Table) -> pa.Table:
        local, shard = Network(size), rows["shard"][0].as_py()
        local.unpack(np.frombuffer(weights, "float32"))
        seen, token, n = contexts(rows["context"]), rows["token"].to_numpy(), rows["n"].to_numpy()
        order = np.lexsort((token, *seen.T))
        local.fit(seen[order], token[order], n[order], np.random.default_rng([turn, shard]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([local.pack()], pa.binary())})

    return one


def train(counts: DataFrame) -> Network:
    """A round for each part of the rows, dealt by a hash; what a task holds does not grow with the table."""
    key = F.xxhash64("context", "token")
    kept = materialize(counts.withColumns({"part": F.pmod(key, F.lit(ROUNDS)).cast("int"), "deal": F.shiftrightunsigned(key, 8)}), "window-counts")
    known = kept.agg(F.count("*").alias("rows"), F.max("token").alias("top")).first()
    network = Network((known.top or 0) + 2)
    shards = max(1, -(-known.rows // (ROUNDS * SHARD_ROWS)))
    for turn in range(ROUNDS):
        dealt = kept.where(F.col("part") == turn).select("context", "token", "n", F.pmod("deal", F.lit(shards)).cast("int").alias("shard"))
        trained = materialize(dealt.groupBy("shard").applyInArrow(shard_trainer(network.pack(), network.size, turn), "shard int, n long, weights binary"), "window-network")
        total, mean = 0, 0.0
        for r in trained.orderBy("shard").toLocalIterator():  # one copy of the network at a time
            total += r.n
            mean = mean + (np.frombuffer(r.weights, "float32").astype("float64") - mean) * (r.n / total)
        if total:
            network.unpack(mean.astype("float32"))
    return network


def score(docs: DataFrame, network: Network, points_: list[int]) -> DataFrame:
    def run(batches):
        windows, tables = Windows(points_), network.folded()
        for batch, texts in runs(batches, 1):
            keys, at = distinct_keys(windows.keys(texts))
            distinct, logp = windows.windows(keys), np.zeros(len(keys), "float32")
            order = np.argsort((distinct[:, -1] // GROUP).astype("uint16"), kind="stable")  # so that most steps have one group
            for a in range(0, len(keys), STEP):
                rows = order[a : a + STEP]
                part = distinct[rows]
                logp[rows] = network.log_probability(part[:, :-1], part[:, -1], tables)
            n = np.array([len(t) for t in texts], "int64")
            sums = np.diff(np.concatenate([[0.0], np.cumsum(logp[at], dtype="float64")])[np.concatenate([[0], np.cumsum(n)])])
            sums = np.where(n > 0, np.round(sums, 4), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums), pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)], ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, pseudo_log_likelihood double, mean_log_probability double")


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = alphabet(read)
    return score(read, train(window_counts(read, found)), found)
