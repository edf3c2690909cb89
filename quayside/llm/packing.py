"""Packing documents into sequences: first-fit decreasing, run independently in randomised groups of documents.

A document's ids, with the end id, are cut at every multiple of the capacity. Full pieces are sequences of their own;
the rests of a group are taken longest first, and a tournament tree over the free space of the bins finds the first bin
that holds each in logarithmic time. Groups are dealt by a hash of the piece, so that each holds a fair mix of lengths and a bounded
number of documents, whatever the input's size.

Defined results: a null or empty text is a document of the end id alone; an empty table gives no pieces; repeated rows
are packed one by one, and rows that are equal in id and text are dealt over groups by their number in a task, so that no
group grows with them; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import frugal, slices

#: Documents to a group on average.
GROUP_DOCS = 2048
#: Words whose ids a Python worker remembers, and characters of text it holds ids of at once.
CACHE_WORDS, CHUNK_CHARS = 350_000, 500_000
#: Letters that stay one letter each in lower case, then ASCII punctuation: the tokenizer always cuts between the two.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F]*)([!-/:-@\[-`{-~]*)")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """A text's ids as little-endian bytes.

    The tokenizer drops white space and never joins across it, and its normal forms do not either, so the ids of a text
    are those of its parts between spaces and newlines; ids of parts are remembered, in two generations. Letters and the
    punctuation after them are parts of their own, case does not matter, and unseen words of plain letters go to the
    tokenizer as one text, whose words are told apart again by the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < CHUNK_CHARS):
                size, end = size + len(texts[end]), end + 1
            parts = [t.replace("\n", " ").split(" ") for t in texts[at:end]]
            self._learn(set().union(*parts).difference(self.known))
            for words in parts:
                yield b"".join(map(self.known.__getitem__, words))
            if len(self.known) > CACHE_WORDS:
                self.known, self.before = {}, self.known
            at = end

    def _learn(self, words: set[str]) -> None:
        known, before, fits = self.known, self.before.get, PLAIN.fullmatch
        plain, odd, made = set(), set(), []
        for word in words:
            if (code := before(word)) is not None:
                known[word] = code
            elif m := fits(word):
                core, tail = m.groups()
                low = core.lower()
                plain.add(low)
                odd.add(tail)
                if low is not word or tail:
                    made.append((word, low, tail))
            else:
                odd.add(word)
        plain, odd = plain.difference(known), odd.difference(known)
        for low in [w for w in plain if before(w) is not None]:
            known[low] = before(low)
            plain.discard(low)
        plain.discard("")
        known[""] = b""
        self._encode_plain(sorted(plain))
        self._encode_each(list(odd))
        for word, low, tail in made:
            known[word] = known[low] + known[tail]

    def _encode_each(self, words: list[str]) -> None:
        for word, code in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(code.ids, "<u4").tobytes()

    def _encode_plain(self, words: list[str], step: int = 2000) -> None:
        for k in range(0, len(words), step):
            part = words[k : k + step]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                self._encode_each(part)
                continue
            code, start = ids.tobytes(), 0
            for word, stop in zip(part, stops.tolist(), strict=True):
                self.known[word] = code[4 * start : 4 * stop]
                start = stop


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Batches of an id, a text and further columns → their pieces, each with what its row has in the further columns."""
    encoder, end, seen = WordEncoder(path), np.array([end_id], "<u4").tobytes(), Counter()
    for batch in slices(batches, 1):
        ids, rows, source = batch.column(0).to_pylist(), [], []
        for row, (key, code) in enumerate(zip(ids, encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True)):
            code += end
            n = len(code) // 4
            for s in range(0, n, capacity):
                crc = zlib.crc32(code[4 * s : 4 * (s + capacity)])
                rows.append((s, min(capacity, n - s), crc, n, seen[key, s, crc]))
                seen[key, s, crc] += 1
            source += [row] * -(-n // capacity)
        columns, at = list(zip(*rows, strict=True)) if rows else [()] * 5, pa.array(source, pa.int64())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", *batch.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, pa.int64()) for c in columns), *(c.take(at) for c in batch.columns[2:])], names)


class FirstFit:
    """Bins of one capacity; put() gives the first that has the room. Each node of the tree holds the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        room[k] -= size
        leaf, k = k - self.leaves, k // 2
        while k:
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k], k = best, k // 2
        return leaf


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must be in descending order."""
    bins, used, at, offset = FirstFit(len(lengths), capacity), {}, [], []
    for size in lengths:
        b = bins.put(size)
        at.append(b)
        offset.append(used.get(b, 0))
        used[b] = offset[-1] + size
    return at, offset


def pack_group(group: int, pieces: pa.Table, capacity: int, bits: int) -> pa.Table:
    """Longest first; full pieces are bins of their own and stay out of the tree. Columns never leave Arrow: ids keep their
    type beside nulls."""
    order = pc.sort_indices(pieces, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")])
    pieces = pieces.take(order)
    lengths = pieces.column("length").to_pylist()
    full = sum(n == capacity for n in lengths)
    bins, offsets = first_fit_decreasing(lengths[full:], capacity)
    at = (group << bits) + np.concatenate([np.arange(full), full + np.array(bins, "int64")]).astype("int64")
    out = pieces.append_column("sequence_id", pa.array(at)).append_column("offset", pa.array([0] * full + offsets, pa.int64()))
    return out.select(COLUMNS)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pieces_in(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int, *kept: str) -> DataFrame:
    """The pieces of every row, with `nth`: how many pieces like it the task had before."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    kinds = [f"{c} {read.schema[c].dataType.simpleString()}" for c in ("doc_id", *kept)]
    return read.mapInArrow(frugal(lambda it: pieces_of(it, path, end_id, capacity)), ", ".join([kinds[0], "start long, length long, ids_crc32 long, doc_tokens long, nth long", *kinds[1:]]))


def grouped(pieces: DataFrame, capacity: int, bits: int) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = [c for c in COLUMNS if c in pieces.columns]
    return pieces.select("_group", *columns).groupBy("_group").applyInArrow(
        lambda key, table: pack_group(key[0].as_py(), table, capacity, bits), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def pack_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2, capacity: int = 4096, seed: int = 23) -> DataFrame:
    """Pieces of sequences, in groups dealt by a hash of the piece."""
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))
    pieces = pieces_in(docs, id_col, text_col, tokenizer_path or vocabulary(), end_id, capacity)
    # by content too, so that many rows under one id are dealt over all groups; equal pieces of a task by their number
    task = F.when(F.col("nth") > 0, F.spark_partition_id()).otherwise(0)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "nth", task), F.lit(groups)))
    return grouped(dealt, capacity, 32)


def pack_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of sequences that keep the order in which docs are stored.

    Groups are runs of GROUP_DOCS rows of a file, so that ids
    of sequences ascend with the files' numbers and the rows' places; inside a group the method decides. Where rows were
    stored in an order that is random in size, as a mix is, runs are randomised groups. Rows that were not read from
    files have no stored order and are dealt at random.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return pack_corpus(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path, end_id=end_id, capacity=capacity)
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), part.alias("_part"), F.floor(F.col("_metadata.row_index") / GROUP_DOCS).alias("_run"))
    pieces = pieces_in(placed, "doc_id", "text", tokenizer_path or vocabulary(), end_id, capacity, "_part", "_run")
    return grouped(pieces.withColumn("_group", F.shiftleft("_part", 18) + F.col("_run")), capacity, 24)
