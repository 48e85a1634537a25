"""Quality rules whose thresholds follow the data, by mergeable quantile sketches per language and source.

Each document has five measures (integers per thousand words, and the mean word length in hundredths). A sketch of a group
is the histogram of a measure over bins of fixed relative width: values below 64 have a bin each, larger ones keep their six
leading bits, so a quantile read from it is off by under 1/32, and two sketches merge by adding their counts. Counts are
added in each task before anything is shuffled, so a hot group costs no more than a small one. What a small group lacks comes
from the sketches above it: a language's is merged with that of all, scaled to `prior` documents, a group's with its language's, scaled
alike. The larger a group, the less that counts; there is no size at which the rule changes.

A document fails where a measure lies beyond median + spread * max(median - lower tail, floor): the tail on the clean side
sets the width, so junk at the other end can't widen it. Word length is bounded on both sides. The bounds are joined back
to the documents, which fail or stay. Built-in functions alone, a row stays a row: only measures are shuffled, never text.

Cases: null text has no words and fails; a null doc_id is a document like others; null language or source is a group of its own;
repeated rows count as often as they occur; ties are equal values and share a verdict; very long texts are measured whole, within
their row; other columns, whatever their names, are not looked at but those of `keep`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import SPACE, columns, kept_columns, maybe_among, words_of, written

#: measure: (numerator, least spread, bounded below too). Per thousand words; mean_length in hundredths of a character.
MEASURES = {
    "symbol_rate": ("1000 * n_symbols", 60, False),
    "dup_line_rate": ("1000 * n_dup_lines", 60, False),
    "repeat_rate": ("1000 * n_repeat_words", 65, False),
    "upper_rate": ("1000 * n_capitals", 300, False),
    "mean_length": ("100 * word_chars", 200, True),
}
BASE = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
#: Quantiles read from a sketch, in thousandths.
LOW, MIDDLE = 100, 500
#: Parts that a document counts for in merged sketches.
UNIT = 1_000_000
#: Groups (rows of eleven numbers) up to which their bounds are broadcast.
SMALL = 10_000


def bin_of(v: Column) -> Column:
    """The least value of v's bin."""
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")
    return F.when(v < 64, v).otherwise(v - v % width)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", window: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source and the counts of each text, all within its row; the columns of `keep` as keep_0, keep_1 ..."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string"), source=(source_col, "string"), **kept_columns(docs, keep))
    carried = [f"keep_{i}" for i in range(len(keep))]
    df = df.select(
        "doc_id", "lang", "source", *carried, words_of(text).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[^{SPACE}]+", ""))).cast("long").alias("word_chars"),
    )
    # Hashes of all windows of the text; where all differ, as in most texts, nothing repeats and nothing is sorted.
    keys = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, window)]))
    df = df.withColumn("keys", keys)
    ordered = F.array_sort(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), ordered))
    twice = F.transform("ordered", lambda x, j: F.when((F.get(F.col("ordered"), j - 1)["k"] == x["k"]) | (F.get(F.col("ordered"), j + 1)["k"] == x["k"]), x["i"]))
    df = df.withColumn("found", F.array_sort(F.array_compact(twice)))
    # Each window covers words up to the next one's start, the last all of its own.
    cover = F.aggregate(F.transform("found", lambda x, j: F.least(F.lit(window), F.coalesce(F.get(F.col("found"), j + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        "doc_id", "lang", "source", *carried, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals",
    )


def _reached(rank: Column) -> Column:
    nothing = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))

    def add(a: Column, b: Column) -> Column:
        seen = a["seen"] + b["n"]
        return F.struct(seen.alias("seen"), F.when(a["at"].isNull() & (seen >= rank), b["bin"]).otherwise(a["at"]).alias("at"))

    return F.aggregate("bins", nothing, add)


def thresholds(rows: DataFrame, spread: int, prior: int) -> DataFrame:
    """Per language and source (lang_0, source_0) the bounds of each measure, from its sketch merged with those above it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in MEASURES]))
    sketch = rows.where("n_words > 0").select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    sketch = written(sketch)
    # In parts of UNIT: what a bin of the sketch above adds, of all documents and then of the language's merged sketch.
    every = sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    every = every.select(F.col("measure").alias("m2"), "bin", F.expr(f"n * {UNIT} div sum(n) OVER (PARTITION BY measure)").alias("p2"))
    by_lang = sketch.groupBy(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("bin").alias("b")).agg(F.sum("n").alias("n"))
    langs = sketch.select("lang", "measure").distinct().join(F.broadcast(every), F.col("measure") == F.col("m2"))  # a few hundred bins a measure
    langs = langs.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")) & (F.col("bin") == F.col("b")), "left")
    langs = langs.select(F.col("lang").alias("lang_1"), F.col("measure").alias("m1"), "bin", (F.coalesce("n", F.lit(0)) * UNIT + prior * F.col("p2")).alias("w"))
    share = F.col("w").cast("double") / F.sum("w").over(Window.partitionBy("lang_1", "m1")).cast("double")
    langs = langs.select("lang_1", "m1", "bin", F.floor(share * F.lit(float(UNIT))).cast("long").alias("p1"))
    fine = sketch.select("lang", "source", "measure").distinct().join(langs, F.col("lang").eqNullSafe(F.col("lang_1")) & (F.col("measure") == F.col("m1")))
    own = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("measure").alias("m"), F.col("bin").alias("b"), "n")
    fine = fine.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("bin") == F.col("b")), "left")
    fine = fine.select("lang", "source", "measure", "bin", (F.coalesce("n", F.lit(0)) * UNIT + prior * F.col("p1")).alias("n"))
    by_bin = F.array_sort(F.collect_list(F.struct("bin", "n")))  # of one sketch: bounded by its bins
    joined = fine.groupBy(F.col("lang").alias("lang_0"), F.col("source").alias("source_0"), "measure").agg(by_bin.alias("bins"), F.sum("n").alias("total"))
    for name, q in (("low", LOW), ("middle", MIDDLE)):
        # The first bin by which q thousandths are reached.
        joined = joined.withColumn(name, _reached(F.ceil(F.lit(q) * F.col("total") / F.lit(1000)))["at"])
    least = F.create_map(*[x for m, (_, floor, _) in MEASURES.items() for x in (F.lit(m), F.lit(floor))])[F.col("measure")]
    two_sided = F.col("measure").isin([m for m, v in MEASURES.items() if v[2]])
    joined = joined.select("lang_0", "source_0", "measure", "low", "middle", least.alias("least"), two_sided.alias("two"))
    above = F.col("middle") + F.lit(spread) * F.greatest(F.col("middle") - F.col("low"), "least")
    below = F.when(F.col("two"), F.col("middle") - F.lit(spread) * F.greatest(F.col("middle") - F.col("low"), "least")).otherwise(F.lit(-1))
    named = [F.max(F.when(F.col("measure") == m, x)).alias(f"{m}_{n}") for m in MEASURES for n, x in (("above", above), ("below", below))]
    return joined.groupBy("lang_0", "source_0").agg(*named)


def _rated(docs: DataFrame, *cols: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return measured(docs, *cols, keep=keep).select("*", *[F.expr(f"({up}) div greatest(n_words, 1)").alias(m) for m, (up, _, _) in MEASURES.items()])


def _bounds(rows: DataFrame, spread: int, prior: int) -> DataFrame:
    bounds = written(thresholds(rows, spread, prior))
    # Else the join is Spark's to choose.
    return F.broadcast(bounds) if bounds.limit(SMALL + 1).count() <= SMALL else bounds


def _judged(rows: DataFrame, bounds: DataFrame, min_words: int) -> DataFrame:
    out = rows.join(bounds, rows["lang"].eqNullSafe(bounds["lang_0"]) & rows["source"].eqNullSafe(bounds["source_0"]), "left")
    failed = F.array_compact(F.array(*[F.when((F.col(m) > F.col(f"{m}_above")) | (F.col(m) < F.col(f"{m}_below")), F.lit(m)) for m in MEASURES]))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumns({"failed": failed, "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def judge(docs: DataFrame, *, spread: int = 3, prior: int = 100, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the base counts, the measures, base_failed, failed (names of the adaptive rules), kept; then the columns of `keep`."""
    rows = written(_rated(docs, id_col, text_col, lang_col, source_col, keep=keep))
    out = _judged(rows, _bounds(rows, spread, prior), min_words)
    return out.select("doc_id", *BASE, *MEASURES, "base_failed", "failed", "kept", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def passing(docs: DataFrame, *, spread: int = 3, prior: int = 100, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the columns of `keep` of the documents that judge() keeps, of which nothing but measures is stored.

    A verdict follows from text, language and source. A bitmap of hashes of those that fail tells which documents certainly pass; the others are measured again.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    df = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string"), lang=(lang_col, "string"), source=(source_col, "string"), **kept_columns(docs, keep))
    df = df.withColumn("what", F.xxhash64("text", "lang", "source"))
    rows = written(_rated(df, keep=("what",)))
    bounds = _bounds(rows, spread, prior)
    fail = written(_judged(rows, bounds, min_words).where("NOT kept").select(F.col("keep_0").alias("what")).distinct())
    told = maybe_among(df, fail, by="what")
    # One predicate over the join's both sides: a part that Spark could push below would be the counts' expressions, many times over.
    kept = F.size(F.array_compact(F.array(F.when(F.col("kept"), F.lit(1))))) > 0
    again = _judged(_rated(told.where("may_"), keep=tuple(names)), bounds, min_words).where(kept)
    out = told.where("NOT may_").select("doc_id", *names).unionByName(again.select("doc_id", *names))
    return out.select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
