"""Near-duplicate documents: fast similarity sketching, banding, exact verification on full shingle sets.

A sketch is filled in rounds. In each of the first T rounds every shingle is placed in a hashed one of T bins with a
hashed value, and a bin that is still empty keeps the least; in round T + k all shingles go to bin k, so that every
coordinate fills, and the share of equal coordinates keeps the concentration of independent minima. Bands of ROWS
coordinates retrieve candidates: a pair of similarity 0.8 is missed with probability (1 - 0.8^6)^40, about 5e-6.

Documents with equal shingle sets are one class. In each bucket all classes are held against the smallest one on full
sets, which connects groups of copies with as many comparisons as members. What a bucket's leader leaves unconnected is
paired by a prefix filter on the differences from the leader, which loses no link (see unresolved), and verified too;
pairs within a component are not needed.

Defined results: a text that is null or without words has an empty set and stays alone; fewer words than a shingle are
one shingle; rows that repeat a document's text are copies of it, the smallest id being kept; a null id stays null and
is never the one kept of a group with ids; an id that stands for several texts stands for each of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import frugal, slices
from quayside.llm.components import components
from quayside.plans.runtime import materialize

#: Coordinates of a band, bands.
ROWS, BANDS = 6, 40
#: Words whose hashes a Python worker remembers, and characters of text worked on together.
CACHE_WORDS, CHUNK_CHARS = 400_000, 1_000_000

MASK = np.uint64(0xFFFFFFFF)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts. Letters A-Z are lower-cased; words end at ASCII white space."""

    def __init__(self, size: int):
        self.size, self.words = size, WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        hashes = []
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split() if text else []
            hashes.append(np.fromiter(map(self.words.__getitem__, words), "uint64", len(words)))
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
        return [self._set(h) for h in hashes]

    def _set(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        n = min(self.size, len(h))
        count, s = len(h) - n + 1, np.full(len(h) - n + 1, n, "uint64")
        for k in range(n):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + count])
        return np.unique(s)


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of size coordinates for each set; rows of empty sets stay EMPTY."""
    out = np.full(len(sets) * size, EMPTY)
    lengths = np.array([len(s) for s in sets])
    item, doc = np.concatenate([*sets, np.zeros(0, "uint64")]), np.repeat(np.arange(len(sets)), lengths)
    for k in range(2 * size):
        if not len(item):
            break
        x = mix(item + np.uint64((k + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        at = doc * size + (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype("int64") if k < size else doc * size + (k - size)
        np.minimum.at(out, at, np.uint64(k << 32) | (x & MASK))
        if k < 16 or k % 8 == 0:  # the rounds in between change nothing in a full sketch
            active = np.unique(doc)
            full = (out.reshape(-1, size)[active] != EMPTY).all(axis=1)
            if full.any():
                done = np.zeros(len(sets), bool)
                done[active[full]] = True
                keep = ~done[doc]
                item, doc = item[keep], doc[keep]
    return out.reshape(-1, size)


def band_hashes(sketches: np.ndarray, rows: int, bands: int) -> np.ndarray:
    h = np.tile(np.arange(1, bands + 1, dtype="uint64"), (len(sketches), 1))
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketches[:, k : rows * bands : rows])
    return h.view("int64")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, pa.Array]]:
    """ids, texts and digests of batches, about CHUNK_CHARS characters at a time."""
    for batch in slices(batches, 1):
        ids, texts, at, size = batch.column(0), batch.column(1).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK_CHARS or k + 1 == len(texts):
                yield ids.slice(at, k + 1 - at), texts[at : k + 1], batch.column(2).slice(at, k + 1 - at)
                at, size = k + 1, 0


def as_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, "int64")]).view("int64")))


def fingerprints(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit digests of each set, null for an empty one."""
    none = np.array([not len(s) for s in sets], bool)
    f1 = np.array([np.add.reduce(mix(s + np.uint64(1))) for s in sets], "uint64").view("int64")
    f2 = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets], "uint64").view("int64")
    return pa.array(f1, mask=none), pa.array(f2, mask=none)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest of the text, n_shingles, fingerprint of the set (f1, f2; null if it is empty) and its band hashes."""

    def run(batches):
        shingler = Shingler(shingle)
        for ids, texts, digests in chunks(batches):
            sets = shingler.sets(texts)
            n = np.array([len(s) for s in sets], "int64")
            bands = band_hashes(sketch(sets, ROWS * BANDS), ROWS, BANDS)
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array(n), *fingerprints(sets), as_lists([b if k else b[:0] for b, k in zip(bands, n, strict=True)])], ["doc_id", "digest", "n_shingles", "f1", "f2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("digest", F.xxhash64("text")).mapInArrow(frugal(run), f"doc_id {kind}, digest long, n_shingles long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fingerprint and shingles of each row's set."""

    def run(batches):
        shingler = Shingler(shingle)
        for ids, texts, _ in chunks(batches):
            sets = shingler.sets(texts)
            yield pa.RecordBatch.from_arrays([ids, *fingerprints(sets), as_lists([s.view("int64") for s in sets])], ["doc_id", "f1", "f2", "items"])

    return docs.select("doc_id", "text", F.lit(0).alias("digest")).mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f1 long, f2 long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) held against each other on full sets: their sizes, what a adds to b and what it lacks, and link."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"{c}_items")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    parts = both.select("a", "b", F.size("a_items").alias("n_a"), F.size("b_items").alias("n_b"), F.sort_array(F.array_except("a_items", "b_items")).alias("added"), F.sort_array(F.array_except("b_items", "a_items")).alias("lacks"))
    shared = F.col("n_a") - F.size("added")
    return parts.withColumn("link", 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))


def unresolved(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that may be links, among documents that share a leader.

    rest: leader, n_leader, doc_id, n, component, link (with the leader), added, lacks. The symmetric difference of two
    documents is that of their differences D from the leader, and a link allows it at most c (n_x + n_y) elements, with
    c = (100 - percent) / (100 + percent). At least one of the two is no link of the leader, so the two must share an
    element of D: with the smaller D first, at least |D_x| - c (n_x + n_y) / 2 of them, or half of |D_x| and more if x
    itself is a link; seen from the larger D, at least |D_y| - c (n_x + n_y). Of two sets that share so many, prefixes
    of that much less than their length, in one order, share an element (prefix filter); the order puts elements that
    are rare among a leader's documents first. Only documents that meet in such an element are paired.
    """
    c, widest = (100 - percent) / (100 + percent), 1 + 100 / percent
    items = materialize(rest.select("leader", "doc_id", F.explode(F.concat("added", "lacks")).alias("item")), "differences")
    counts = items.groupBy("leader", "item").agg(F.count("*").alias("k"))
    ranked = items.join(counts.hint("merge"), ["leader", "item"]).groupBy("leader", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "item"))).alias("d"))
    rest = materialize(rest.join(ranked.select("leader", "doc_id", F.transform("d", lambda e: e["item"]).alias("d")).hint("merge"), ["leader", "doc_id"]).drop("added", "lacks"), "ranked")
    size, gap = F.size("d"), F.floor(c * (F.col("n_leader") - F.col("n")) - 1e-9)
    need = F.ceil(size - c * widest * F.col("n") / 2 - 1e-9)
    need = F.when(F.col("link"), F.greatest(need, F.ceil((size + 1 + gap) / 2))).otherwise(need)
    first = (size - F.greatest(F.lit(1), need) + 1).cast("int")
    second = (size - F.greatest(F.lit(1), F.ceil(size - c * widest * F.col("n") - 1e-9)) + 1).cast("int")
    rows = rest.where(size > 0).select("leader", "doc_id", "n", "component", size.alias("size"), "d", first.alias("first"), second.alias("second"))
    x = rows.select("leader", "doc_id", "n", "component", "size", F.posexplode(F.slice("d", F.lit(1), F.greatest(F.lit(0), "first"))).alias("at", "item")).alias("x")
    y = rows.select("leader", "doc_id", "n", "component", "size", F.posexplode(F.slice("d", F.lit(1), F.greatest(F.lit(0), "second"))).alias("at", "item")).alias("y")
    same = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.item") == F.col("y.item"))
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    near = (F.col("y.size") - F.col("x.size") <= c * (F.col("x.n") + F.col("y.n")) + 1e-9) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    # a pair's first common element leaves at most this many
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    near = near & (2 * left >= F.col("x.size") + F.col("y.size") - c * (F.col("x.n") + F.col("y.n")) - 1e-9)
    met = x.join(y.hint("merge"), same & (F.col("x.component") != F.col("y.component")) & order & near)
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def clashing(found: DataFrame) -> bool:
    """Does an id stand for more than one set?"""
    ends = [f(F.coalesce(c, F.lit(0))) for c in ("f1", "f2") for f in (F.min, F.max)]
    sets = found.where("doc_id is not null").groupBy("doc_id").agg(*[e.alias(f"e{k}") for k, e in enumerate(ends)])
    return not sets.where("e0 != e1 or e2 != e3").isEmpty()


def grouped_rows(read: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of near_duplicates with digest, f1, f2 and first: is the row's set the one its component is named after?

    Sets are told apart by the smallest id that has them; where an id has several sets, by the fingerprint too.
    """
    found = materialize(sketches(read, shingle), "sketches")
    several = clashing(found)
    node = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "f1", "f2")) if several else F.col("doc_id")
    id_of = lambda c: F.col(c)["doc_id"] if several else F.col(c)
    classes = found.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    classes = materialize(classes.select("f1", "f2", node.alias("rep")), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"))
    named = found.where("f1 is not null").select(node.alias("doc_id"), "bands")
    member = named.join(reps.hint("merge"), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("bucket"))
    leaders = member.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader != last").select("bucket", "leader")
    grouped = materialize(member.join(leaders.hint("merge"), "bucket"), "buckets")

    pairs = materialize(grouped.where("doc_id != leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = read.join(wanted.select(id_of("doc_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = shingle_sets(texts if several else texts.dropDuplicates(["doc_id"]), shingle)
    if several:
        sets = sets.select(node.alias("doc_id"), "items").dropDuplicates(["doc_id"]).join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = materialize(sets.select("doc_id", "items"), "sets")
    checked = materialize(verified(pairs, sets, percent), "checked")
    linked = components(checked.where("link").select("a", "b"))

    # what the leaders leave: documents of buckets whose members are in more than one component
    placed = grouped.join(linked.select(F.col("id").alias("doc_id"), "component").hint("merge"), "doc_id", "left").select("bucket", "leader", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    rest = placed.join(mixed.hint("merge"), "bucket", "left_semi").where("doc_id != leader").select("leader", "doc_id", "component").distinct()
    facts = checked.select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), F.col("n_a").alias("n"), F.col("n_b").alias("n_leader"), "link", "added", "lacks")
    more = unresolved(materialize(rest.join(facts.hint("merge"), ["doc_id", "leader"]), "rest"), percent)
    more = materialize(more.join(checked.select(F.col("b").alias("a"), F.col("a").alias("b")).hint("merge"), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        again = materialize(verified(more, sets, percent).where("link").select("a", "b"), "again")
        if not again.isEmpty():
            linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(again))

    top = classes.join(linked.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    top = top.select("f1", "f2", id_of("component").alias("component"), (F.col("component") == F.col("rep")).alias("first"))
    out = found.select("doc_id", "digest", "n_shingles", "f1", "f2").join(top.hint("merge"), ["f1", "f2"], "left")
    component = F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest", "f1", "f2", F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return grouped_rows(read, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates; rows without an id stay, and so do different texts under one id."""
    rows = grouped_rows(docs.select("doc_id", "text"), shingle, percent).where("kept and first and doc_id is not null")
    alone = F.when(F.col("f1").isNull(), F.col("digest"))  # texts without words are nobody's copies
    kept = rows.groupBy("doc_id", "f1", "f2", alone.alias("alone")).agg(F.min("digest").alias("_kept_digest")).select(F.col("doc_id").alias("_kept_id"), "_kept_digest")
    keyed = docs.withColumn("_text_digest", F.xxhash64("text"))
    same = (keyed["doc_id"] == kept["_kept_id"]) & (keyed["_text_digest"] == kept["_kept_digest"])
    unique = keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "_text_digest"]).drop("_text_digest")
    return unique.unionByName(docs.where("doc_id is null"))
