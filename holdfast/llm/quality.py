"""Quality rules with thresholds that follow each language and source, in DataFrame functions only.

Every document gets counts; each rate is put into a bucket of a mergeable quantile sketch (a log-linear
histogram: exact below 128, above that the seven leading bits, so a bucket is at most 1/64 wide). A
sketch is its bucket counts, so adding counts merges sketches: languages and the whole corpus are the
sums of their sources. Fences are Tukey's, ``q3 + reach * (q3 - q1)``, with a least spread per rate, and
replace fixed cut-offs; the verdict is the join of each document with the fences of its group.

Defined cases: null text counts as empty and fails the base rules; null language or source is a group of
its own; repeated rows are judged one by one; a group under ``min_docs`` rows takes its language's fences,
a language under it those of the corpus; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import SPACE, settle

SYMBOLS = "#*$%&|<>"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: rate -> (sides that are fenced, least spread in the rate's own unit)
RATES = {
    "symbol_rate": ("upper", 50),  # symbols per 1000 code points in words
    "dup_line_rate": ("upper", 300),  # repeated lines per 1000 lines
    "repeat_rate": ("upper", 100),  # words in repeated windows per 1000 words
    "word_length": ("both", 400),  # code points per 100 words
}
MIN_DOCS = 50
REACH = 3


def measured(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """doc_id, lang, source and the counts of each row, in one projection chain without a shuffle."""
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    df = df.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    df = df.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    last = F.col("n_words").cast("int") - WINDOW
    keys = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("keys", F.when(last >= 0, keys).otherwise(none)).drop("hashes")
    # only texts that repeat a window go through the sort
    marked = F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    df = df.withColumn("runs", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(marked)))
    df = df.drop("keys")
    twice = F.transform(
        "runs",
        lambda x, i: F.when((x["k"] == F.get("runs", i - 1)["k"]) | (x["k"] == F.get("runs", i + 1)["k"]), x["i"]),
    )
    starts = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    seen = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts,
        seen,
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("runs")


def rated(counts: DataFrame) -> DataFrame:
    """Base rule and whole-number rates."""

    def per(part: str, whole: str, unit: int) -> Column:
        return F.expr(f"{part} * {unit} div greatest({whole}, 1)")

    return counts.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias(
            "base_failed"
        ),
        per("n_symbols", "word_chars", 1000).alias("symbol_rate"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_line_rate"),
        per("n_repeat_words", "n_words", 1000).alias("repeat_rate"),
        per("word_chars", "n_words", 100).alias("word_length"),
    )


def bucket(value: str) -> str:
    """Lower end of a whole number's sketch bucket: its seven leading bits."""
    bits = f"greatest(length(bin({value})) - 7, 0)"
    return f"shiftleft(shiftright({value}, {bits}), {bits})"


def sketches(rates: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: one mergeable sketch per group and rate over the rows that pass the base rule."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rate"), F.expr(bucket(r)).alias("bucket")) for r in RATES])
    ).alias("p")
    passed = rates.where(~F.col("base_failed")).select("lang", "source", pairs)
    return passed.groupBy("lang", "source", "p.rate", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """lang, source and the limits of each rate; one row per group, its size bounded by the groups."""
    by_lang = sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    null = F.lit(None).cast("string")
    merged = (
        sketch.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n")
        .unionByName(by_lang.select(F.lit(1).alias("level"), "lang", null.alias("source"), "rate", "bucket", "n"))
        .unionByName(
            whole.select(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"), "rate", "bucket", "n")
        )
    )
    group = Window.partitionBy("level", "lang", "source", "rate")
    ranked = merged.select(
        "*",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    quartile = ranked.groupBy("level", "lang", "source", "rate").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
    )
    limits = []
    for rate, (sides, least) in RATES.items():
        spread = f"greatest({reach} * (q3 - q1), {least})"
        limits.append(F.max(F.when(F.col("rate") == rate, F.expr(f"q3 + {spread}"))).alias(f"{rate}_most"))
        if sides == "both":
            limits.append(F.max(F.when(F.col("rate") == rate, F.expr(f"q1 - {spread}"))).alias(f"{rate}_least"))
    table = quartile.groupBy("level", "lang", "source").agg(F.max("total").alias("docs"), *limits)
    names = [c for c in table.columns if c not in ("level", "lang", "source", "docs")]

    def at(level: int, prefix: str) -> DataFrame:
        return table.where(F.col("level") == level).select(
            F.col("lang").alias(f"{prefix}_lang"),
            F.col("source").alias(f"{prefix}_source"),
            F.col("docs").alias(f"{prefix}_docs"),
            *[F.col(n).alias(f"{prefix}_{n}") for n in names],
        )

    joined = at(0, "own").join(at(1, "lang"), F.col("own_lang").eqNullSafe(F.col("lang_lang")), "left")
    corpus = table.where("level = 2").first()  # one row

    def pick(name: str) -> Column:
        return (
            F.when(F.col("own_docs") >= min_docs, F.col(f"own_{name}"))
            .when(F.col("lang_docs") >= min_docs, F.col(f"lang_{name}"))
            .otherwise(F.lit(corpus and corpus[name]))
            .alias(name)
        )

    return joined.select(
        F.col("own_lang").alias("fence_lang"), F.col("own_source").alias("fence_source"), *[pick(n) for n in names]
    )


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH, **columns: str) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    The texts are read once: counts are written to the shared folder, the fences come from them and are
    joined back. Groups of the fence table are left to the optimizer, which broadcasts it under its own
    byte limit and else splits a hot group of documents.
    """
    rates = settle(rated(measured(docs, **columns)), "quality-counts")
    limits = fences(sketches(rates), min_docs, reach)
    same = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    within = F.lit(True)
    for rate, (sides, _) in RATES.items():
        within = within & (F.col(rate) <= F.col(f"{rate}_most"))
        if sides == "both":
            within = within & (F.col(rate) >= F.col(f"{rate}_least"))
    return rates.join(limits, same, "left").select(
        *rates.columns, (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept")
    )


def filtered(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id has a kept verdict, with all their columns; rows without an id go."""
    kept = verdicts(docs, id_col=id_col, **options).where("kept").select("doc_id")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"))
    return rows.join(kept, "doc_id", "left_semi").select("row.*")
