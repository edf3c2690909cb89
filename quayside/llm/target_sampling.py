"""Target-distribution importance resampling: documents are drawn by how much likelier their hashed word n-grams are in a
target table than in the corpus itself.

An integer dictionary maps the distinct words that a task meets to ids. Runs of one to three words are tuples of ids in
one 64-bit number; the bytes of each distinct tuple of a block of texts are hashed once, and its count, or its bucket's
gain, is joined back to the places it stands at. Two passes over the texts: one sums features by bucket, one weighs
documents. Between them only the counts of the buckets come to the driver, whose number is a parameter.

The draw adds Gumbel noise, a hash of the id, to the log-weights and takes the highest: documents are sorted by ranges and
numbered within them, so that no task sees all of them.

Defined results: a null text has no words; a document without features weighs 0; a null id is hashed as an empty one and
comes after other ids where scores are equal; repeated rows are documents of their own; an empty corpus gives an empty
result, an empty target counts as nothing in any bucket; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import slices, words_in
from quayside.plans.runtime import materialize

#: Words of a block, bits of a word's id, and distinct words that a worker remembers.
BLOCK_WORDS, ID_BITS, KNOWN_WORDS = 400_000, 40, 1_000_000
#: A word's bytes: digits and letters of ASCII in lower case and all that is not ASCII; any other byte parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Features:
    """Hash buckets of the runs of one to `longest` words of many texts at once."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.ids, self.words, self.spaced = longest, buckets, {}, [], []

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > KNOWN_WORDS:
            self.ids, self.words, self.spaced = {}, [], []
        for word in set(words).difference(self.ids):
            self.ids[word] = len(self.words)
            self.words.append(word)
            self.spaced.append(b" " + word)
        return np.fromiter(map(self.ids.__getitem__, words), "int64", len(words))

    def blocks(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Word ids and rows of the texts' words, block by block. A text that goes on in the next block has its last words
        there again; their number comes third."""
        words: list[bytes] = []
        rows: list[tuple[int, int]] = []
        carried = 0
        for row, text in enumerate(texts):
            for part in words_in(text or b"", WORD_BYTES):
                words += part
                rows.append((row, len(part)))
                if len(words) >= BLOCK_WORDS:
                    yield self.codes(words), np.repeat(*np.array(rows).T), carried
                    own = 0
                    for at, n in reversed(rows):
                        if at != row or own >= self.longest - 1:
                            break
                        own += n
                    carried = min(own, self.longest - 1)
                    words = words[len(words) - carried :]
                    rows = [(row, carried)]
        if len(words) > carried:
            yield self.codes(words), np.repeat(*np.array(rows).T), carried

    def runs(self, code: np.ndarray, row: np.ndarray, carried: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each run length: the bucket of each distinct tuple, and of each place its tuple and its row.

        A tuple's number is that of its beginning among the distinct shorter ones and the id of its last word; the checksum
        of its bytes goes on from its beginning's with a space and that word.
        """
        head = sums = None
        for k in range(self.longest):
            many = len(code) - k
            if many <= 0:
                return
            whole = row[k:] == row[:many]
            number = code if not k else head[:many] << ID_BITS | code[k:]
            tuples, place = np.unique(number[whole], return_inverse=True)
            last = map((self.spaced if k else self.words).__getitem__, (tuples & ((1 << ID_BITS) - 1)).tolist())
            sums = np.fromiter(map(zlib.crc32, last, sums[tuples >> ID_BITS].tolist()) if k else map(zlib.crc32, last), "int64", len(tuples))
            head = np.zeros(many, "int64")
            head[whole] = place
            new = np.flatnonzero(whole) + k >= carried
            yield sums % self.buckets, place[new], row[:many][whole][new]


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. buckets, a parameter, bounds what comes to the driver."""

    def run(batches):
        features, total = Features(longest, buckets), np.zeros(buckets, "int64")
        for batch in slices(batches, 0):
            for block in features.blocks(batch.column(0).cast(pa.binary()).to_pylist()):
                for hashed, place, _ in features.runs(*block):
                    np.add.at(total, hashed, np.bincount(place, minlength=len(hashed)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), pa.array(total[some])], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, "int64")
    for bucket, n in summed.toLocalIterator():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down, with one feature added to each."""
    size = len(corpus)
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], "int64")


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def run(batches):
        features = Features(longest, len(gain))
        for batch in slices(batches, 1):
            rows = batch.num_rows
            words, many, weight = (np.zeros(rows, "int64") for _ in range(3))
            for block in features.blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                for k, (hashed, place, row) in enumerate(features.runs(*block)):
                    if not k:
                        words += np.bincount(row, minlength=rows)
                    many += np.bincount(row, minlength=rows)
                    np.add.at(weight, row, gain[hashed][place])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise of an id in thousandths, rounded down: the first 32 bits of a digest are its uniform number."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def draw(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """rank of the highest scores among documents of enough words, null for the rest.

    Rows are sorted by ranges; a row's rank is its place in its range and the sizes of the ranges before. Equal rows may
    be dealt to several ranges by their place in the stored table, which changes nothing that is returned.
    """
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("salt")]
    stored = materialize(scored.withColumn("able", F.col("n_words") >= least_words).withColumn("salt", F.monotonically_increasing_id()), "scored")
    numbered = stored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = materialize(numbered.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "sorted")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("rows"), F.count(F.when(F.col("able"), 1)).alias("able")).orderBy("part").collect()  # one row for each range
    starts = np.cumsum([0, *(r.rows for r in sizes)]).tolist()
    drawn = sum(r.able for r in sizes) * percent // 100
    starts = scored.sparkSession.createDataFrame([(r.part, at) for r, at in zip(sizes, starts, strict=False)], "part long, start long")
    rank = F.col("start") + F.col("at") + 1
    return numbered.join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("able") & (rank <= drawn), rank))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of what is drawn) of every row of docs."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(read, longest, buckets), bucket_counts(target.select(F.col(target_col).alias("text")), longest, buckets))
    scored = weighed(read, gain, longest).withColumn("score", F.col("weight") + noise(seed))
    return draw(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def selected(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns; ids must tell documents apart."""
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, docs[options.get("id_col", "doc_id")] == F.col("_drawn"), "left_semi")
