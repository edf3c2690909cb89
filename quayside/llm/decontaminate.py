"""Benchmark decontamination by winnowing: words of documents that stand inside a passage of a benchmark item.

An item's passages are its windows of `window` consecutive words, or all its words if it has fewer. For passages of L words
every span of L words keeps the least hash of its k-grams, k about half of L: so every shared span of L words shares a
fingerprint, and consecutive spans mostly share theirs, so that a text has few. Fingerprints of documents are joined with
those of the benchmark; around a hit, the spans that keep that fingerprint are extended to L words and joined with the
passages word for word, which leaves no false hit.

Equal texts are one: hits are those of distinct texts, told apart by digest, and rows take their text's result. Bit tables
of FILTER_WORDS words, whatever the sizes, drop most fingerprints and most texts before any shuffle; the joins decide. All
of it is DataFrame functions.

Defined results: null and wordless texts have no hits, null and wordless items no passages; an item without an id marks
words but is not counted or listed; rows that repeat an item's id are one item; repeated documents get a row each; empty
tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.plans.runtime import let, materialize

#: 64-bit words of the bit table.
FILTER_WORDS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters of ASCII in lower case, digits and all that is not ASCII; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def spans(many: Column, length: int, body) -> Column:
    """body(start) for every start of `length` out of `many`."""
    return F.when(many >= length, F.transform(F.sequence(F.lit(0), many - length), body)).otherwise(F.array())


def least_hashes(hashes: Column, length: int) -> Column:
    """For every span of `length` words the least hash of its k-grams; hashes are the words'."""
    k = (length + 1) // 2
    wide = length - k + 1
    grams = lambda h: spans(F.size(h), k, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    least = lambda g: spans(F.size(g), wide, lambda i: F.least(*(F.get(g, i + j) for j in range(wide))))
    return let(grams(hashes), least) if wide > 1 else grams(hashes)


def fingerprint(words: Column, length: int) -> Column:
    """The one fingerprint of a passage of `length` words."""
    return F.get(least_hashes(F.transform(words, lambda w: F.xxhash64(w)), length), F.lit(0))


def passages(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, length and passage (its words, joined by spaces), distinct."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at")
    cut = items.select("item_id", length.alias("length"), "words", starts)
    return cut.select("item_id", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("passage")).distinct()


def bit_table(prints: DataFrame) -> Column:
    """A scalar of FILTER_WORDS words with the bit of each fingerprint set."""
    spark = prints.sparkSession
    place = F.pmod(F.col("fp"), F.lit(64 * FILTER_WORDS))
    bits = prints.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(fp, {64 * FILTER_WORDS}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    whole = spark.range(FILTER_WORDS).withColumnRenamed("id", "at").join(bits, "at", "left")
    table = whole.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("t"))
    return materialize(table.select(F.transform("t", lambda e: e["bits"]).alias("bits")), "bits").scalar()


def maybe(bits: Column, fp: Column) -> Column:
    place = F.pmod(fp, F.lit(64 * FILTER_WORDS))
    return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def hits(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs with n_words and digest; (digest, at, length, passage) of every passage in a text; and the passages."""
    shown = materialize(passages(benchmark, window), "passages")
    lengths = sorted(r.length for r in shown.select("length").distinct().collect())  # at most `window` of them
    kinds = materialize(shown.select("length", "passage").distinct(), "kinds")
    choose = F.coalesce(*(F.when(F.col("length") == n, fingerprint(F.split("passage", " "), n)) for n in lengths), F.lit(0).cast("long"))
    known = materialize(kinds.select("length", choose.alias("fp")).distinct(), "prints")

    # one row for each text itself, of length 0, and one for each fingerprint of it that may be known
    def scan(words: Column) -> Column:
        of = lambda h, n: F.transform(F.array_distinct(least_hashes(h, n)), lambda fp: F.struct(F.lit(n).alias("length"), fp.alias("fp")))
        own = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).cast("long").alias("fp")))
        return F.struct(F.size(words).alias("n_words"), let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(own, *(of(h, n) for n in lengths))).alias("prints"))

    read = docs.withColumn("digest", F.unhex(F.md5("text")))
    seen = read.withColumn("seen", let(words_of(F.col("text")), scan)).drop("text")
    seen = seen.select(*(c for c in seen.columns if c != "seen"), F.col("seen.n_words").alias("n_words"), F.explode("seen.prints").alias("e")).select("*", "e.*").drop("e")
    scanned = materialize(seen.where((F.col("length") == 0) | maybe(bit_table(known), F.col("fp"))), "scanned")
    met = scanned.where("length > 0").select("digest", "length", "fp").distinct().join(known, ["length", "fp"], "left_semi")
    met = materialize(met.groupBy("digest").agg(*(F.collect_set(F.when(F.col("length") == n, F.col("fp"))).alias(f"m{n}") for n in lengths or [0])), "met")

    def extended(words: Column) -> Column:
        """The spans that keep a fingerprint that was met."""
        passage = lambda i, n: F.struct(i.alias("at"), F.lit(n).alias("length"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(words, i + j)), " ").alias("passage"))
        of = lambda h, n: F.filter(F.transform(least_hashes(h, n), lambda fp, i: F.when(F.array_contains(f"m{n}", fp), passage(i, n))), lambda e: e.isNotNull())
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*(of(h, n) for n in lengths)))

    rows = scanned.where("length = 0").drop("length", "fp")
    if not lengths:
        return rows, docs.sparkSession.createDataFrame([], "digest binary, at int, length int, passage string"), shown
    texts = read.where(maybe(bit_table(met.select(F.xxhash64("digest").alias("fp"))), F.xxhash64("digest"))).groupBy("digest").agg(F.first("text").alias("text"))
    grown = texts.join(met, "digest").select("digest", F.explode(let(words_of(F.col("text")), extended)).alias("e")).select("digest", "e.*")
    return rows, materialize(grown.join(kinds, ["length", "passage"], "left_semi"), "hits"), shown


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, found, shown = hits(read, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), window)
    end = F.col("at") + F.col("length")
    before = F.max(end).over(Window.partitionBy("digest").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1))
    covered = found.select("digest", F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.lit(0)))).alias("n")).groupBy("digest").agg(F.sum("n").alias("n_hit"))
    items = found.select("digest", "length", "passage").distinct().join(shown, ["length", "passage"]).select("digest", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    items = items.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
    facts = covered.join(items, "digest", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(facts, "digest", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, share: float = 0.0) -> DataFrame:
    """The rows of docs of which at most `share` of the words stand in a passage of the benchmark."""
    rows, found, _ = hits(docs.select("text").distinct(), benchmark, window)
    end = F.col("at") + F.col("length")
    before = F.max(end).over(Window.partitionBy("digest").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1))
    covered = found.select("digest", F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(before, F.lit(0)))).alias("n")).groupBy("digest").agg(F.sum("n").alias("n_hit"))
    bad = rows.join(covered, "digest").where(F.col("n_hit") > share * F.col("n_words")).select(F.col("digest").alias("_bad"))
    return docs.join(bad, F.unhex(F.md5(docs["text"])) == F.col("_bad"), "left_anti")
