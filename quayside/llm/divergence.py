"""Source divergence audit: how far the word use of each source of a language is from the language's other sources.

Tasks count terms per (language, source) and Spark sums the counts. The terms in enough documents of their language are
the dictionary: sorted in UTF-8 order, numbered, and cut in chunks of CHUNK terms. In a chunk's sorted term array,
searchsorted gives each term's id and bincount makes one dense vector of counts for each source; as ids keep the order of
terms, ties go to the smaller id. Sources meet in tiles of TILE, so that a task holds at most 2 x TILE x CHUNK counts
however many terms or sources there are, and what leaves a tile is a number for each pair of its sources and the first
terms of each source.

Everything is exact: probabilities are integers, one billion times the smoothed share, by long division.

Defined results: null text, language and source are read as ''; every occurring (language, source) is a group, also
without terms, and a language without kept terms gives its pairs the value 0; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.batches import slices, words_in
from quayside.plans.runtime import materialize

#: Terms of a chunk, sources of a tile, and counts that a worker gathers before it sends them on.
CHUNK, TILE, GATHERED = 8192, 64, 300_000
SCALE, PRIOR = 1_000_000_000, 5
#: A term's bytes: letters of ASCII in lower case and all that is not ASCII; any other byte parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, docs long, n long"
PARTS = "lang string, source string, part string, item string, value long"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term) of the rows seen; the term '' stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, term, docs[term], n[term]) for (lang, source), (docs, n) in held.items() for term in docs]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        names = COUNTS.replace(" string", "").replace(" long", "").split(", ")
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names)

    for batch in slices(batches, 2):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for words in words_in(text, TERM_BYTES):
                n.update(words)
                own.update(words)
            docs.update(own)
            docs[b""] += 1
        if sum(len(docs) for docs, _ in held.values()) > GATHERED:
            yield flush()
            held.clear()
    if held:
        yield flush()


def share(count: np.ndarray, n: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / (n + PRIOR kept)) in three exact steps of long division."""
    rest, below, out = count + PRIOR, n + PRIOR * kept, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def compared(key: tuple, table: pa.Table, top: int) -> pa.Table:
    """Parts of one chunk and pair of tiles: sums of differences of pairs, and on the diagonal the sources' first terms.

    Rows are of three kinds: a source with its totals, a term of the chunk with its total, a source's count of a term.
    """
    lang, _, low, high = (k.as_py() for k in key)
    kind, n = table.column("kind").to_numpy(), table.column("n").to_numpy()
    pick = lambda column, k: table.column(column).filter(pa.array(kind == k))
    words = lambda k: np.array(pick("term", k).cast(pa.binary()).to_pylist(), object)
    sources, tiles, kept, lang_n = pick("source", 0).to_pylist(), pick("tile", 0).to_numpy(), pick("kept", 0).to_numpy(), pick("lang_n", 0).to_numpy()
    order = np.argsort(words(1), kind="stable")
    terms, total = words(1)[order], n[kind == 1][order]
    place = {source: i for i, source in enumerate(sources)}
    group, ids = np.array([place[s] for s in pick("source", 2).to_pylist()], "int64"), np.searchsorted(terms, words(2)).astype("int64")
    counts = np.bincount(group * len(terms) + ids, weights=n[kind == 2], minlength=len(sources) * len(terms)).astype("int64").reshape(len(sources), len(terms))
    p = share(counts, n[kind == 0][:, None], kept[:, None]) if len(terms) else counts
    out: list[tuple] = []
    at = {t: np.flatnonzero(tiles == t).tolist() for t in (low, high)}
    for i in at[low]:
        far = np.abs(p[at[high]] - p[i]).sum(axis=1)
        for j, value in zip(at[high], far.tolist(), strict=True):
            if i != j:
                out.append((lang, sources[i], "pair", sources[j], value))
                if low != high:
                    out.append((lang, sources[j], "pair", sources[i], value))
    if len(terms) and low == high:
        q = share(total, lang_n[0], kept[0])
        for i, source in enumerate(sources):
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            for t in more[np.lexsort((more, (q - p[i])[more]))][:top].tolist():
                out.append((lang, source, "term", terms[t].decode(), int(p[i][t] - q[t])))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.table([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])


def dictionary(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total and id of each kept term; ids count from 0 in each language in UTF-8 order.

    Terms are sorted by ranges; an id is the place in its range and the language's terms in the ranges before.
    """
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "total"), "kept")
    ranges = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id())
    ranges = materialize(ranges.withColumn("range", F.shiftright("at", 33)), "ranges")
    sizes = ranges.groupBy("lang", "range").agg(F.min("at").alias("first"), F.count("*").alias("many"))  # languages times ranges
    before = F.coalesce(F.sum("many").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("lang", "range", (before - F.col("first")).alias("shift"))
    return materialize(ranges.join(starts, ["lang", "range"]).select("lang", "term", "total", (F.col("at") + F.col("shift")).alias("id")), "dictionary")


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by distance, and the first terms of each source."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = materialize(read.mapInArrow(gathered, COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "term-counts")
    book = dictionary(counts, least_docs).withColumn("chunk", F.floor(F.col("id") / chunk))
    coded = materialize(counts.where("term <> ''").join(book.select("lang", "term", "chunk"), ["lang", "term"]).select("lang", "term", "source", "chunk", "n"), "kept-counts")

    sizes = book.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"), F.max("chunk").alias("last"))
    totals = coded.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.na.fill(0, ["n", "kept", "lang_n", "last"]).withColumn("tile", F.floor(place / tile).cast("int"))
    groups = materialize(groups.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1), "sources")

    # every source meets every chunk of its language, and a language without terms has one empty chunk
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    columns = ["lang", "chunk", "low", "high", "kind", "source", "tile", "term", "n", "kept", "lang_n"]
    none = F.lit(None).cast("string")
    met = lambda df: df.withColumn("_other", every).withColumns({"low": F.least("tile", "_other"), "high": F.greatest("tile", "_other")})
    members = met(groups.withColumns({"chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))), "kind": F.lit(0), "term": none}))
    known = groups.select("lang", "source", "tile", "tiles")
    lacking = {"kept": F.lit(0).cast("long"), "lang_n": F.lit(0).cast("long")}
    cells = met(coded.join(known, ["lang", "source"]).withColumns({"kind": F.lit(2), **lacking}))
    pages = book.join(groups.groupBy("lang").agg(F.max("tiles").alias("tiles")), "lang").withColumn("tile", every)
    pages = pages.withColumns({"low": F.col("tile"), "high": F.col("tile"), "kind": F.lit(1), "source": none, "n": F.col("total"), **lacking})
    if_apart = met(pages.drop("low", "high")).where("low <> high and tile = low")  # a term once in each tile pair
    pages = pages.select(*columns).unionByName(if_apart.select(*columns))
    shown = members.select(*columns).unionByName(pages).unionByName(cells.select(*columns))
    parts = materialize(shown.groupBy("lang", "chunk", "low", "high").applyInArrow(lambda key, table: compared(key, table, top), PARTS), "parts")

    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
