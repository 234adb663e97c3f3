"""How far apart the sources of a language are in their use of terms, in exact whole numbers.

Identical texts of a language are collapsed first: a text keeps how often each source holds it, is tokenized once, and
its terms count that often for documents and occurrences. A language keeps the terms that enough of its documents hold.
A group (language and source) gives each kept term the smoothed share ``1 + floor(10^9 (count + 2) / (N + 2 V))``, and
two shares p and q differ by ``floor((p - q)^2 / (p + q))``.

Sources are compared two by two, sparsely. A term that neither source holds gives the same value for all such terms;
terms that one of them holds give, against the other's share of an absent term, a sum over the few different counts of a
source; only terms that both hold are met as pairs, in blocks of ``BLOCK`` sources by about ``TERMS`` terms as numpy
matrices. So rows between stages follow the counts, not the square of a term's sources.

Defined cases: null text, language and source count as empty strings; a text without terms still makes its group;
a group without kept terms has N = 0; a language without kept terms gives 0 for its pairs and no terms; a language of
one source gives no pairs; equal rows are separate documents; equal values are ranked by the item's bytes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import settle, small_batches

#: UTF-8 bytes to those of terms: capital letters become small, other bytes below 128 a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SCALE = 1_000_000_000
#: Sources and terms of one matrix of shares.
BLOCK = 128
TERMS = 500
#: Entries a task holds before it hands them on.
MOST_ENTRIES = 300_000
#: A term's documents stand above this many binary digits of its occurrences.
_SHIFT = 64
_LOW = (1 << _SHIFT) - 1


def terms_of(text: str) -> list[bytes]:
    """Runs of letters A to Z, made small, and of characters beyond ASCII, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of positive shares up to 10^9 + 1; exact in 64 bits."""
    d = p - q
    return d * d // (p + q)


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, digest, source, n, text): one row per different text of a language and source that holds it.

    The text itself stands on the first row of each text only. Copies are counted where they are read, before
    anything is shuffled.
    """
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    held = rows.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("source")) == 1
    both = texts.join(held, ["lang", "digest"]).withColumn("_first", first)
    return both.select("lang", "digest", "source", "n", F.when(F.col("_first"), F.col("text")).alias("text"))


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents, from the rows of ``collapsed``."""
    names = ["lang", "source", "term", "n", "df"]

    def rows(found: dict) -> pa.RecordBatch:
        langs, sources, sizes, terms, counts = [], [], [], [], []
        for (lang, source), own in found.items():
            langs.append(lang)
            sources.append(source)
            sizes.append(len(own))
            terms += own.keys()
            counts += own.values()
        n = pa.array([c & _LOW for c in counts], pa.int64())
        df = pa.array([c >> _SHIFT for c in counts], pa.int64())
        owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        groups = [pa.array(x, pa.string()).take(owner) for x in (langs, sources)]
        return pa.RecordBatch.from_arrays([*groups, pa.array(terms, pa.binary()).cast(pa.string()), n, df], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0
        terms: list[tuple[bytes, int]] = []
        for batch in small_batches(batches, most_bytes=4 << 20):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "n", "text")]
            for lang, source, n, text in zip(*[c.to_pylist() for c in columns], strict=True):
                if text is not None:
                    # occurrences and, in the digits above, the document itself
                    terms = [(t, c + (1 << _SHIFT)) for t, c in Counter(terms_of(text)).items()]
                own = found.setdefault((lang, source), {})
                held -= len(own)
                get = own.get
                for t, c in terms:
                    own[t] = get(t, 0) + c * n
                held += len(own)
                if held > MOST_ENTRIES:
                    yield rows(found)
                    found, held = {}, 0
        if found:
            yield rows(found)

    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term; decimal arithmetic, since 10^9 times a count can leave 64 bits."""
    above = F.lit(SCALE).cast("decimal(19,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return (1 + F.call_function("div", above, below)).cast("long")


class Audit:
    """Shares of a table of documents, written once, and what is read off them."""

    def __init__(self, docs: DataFrame, least_docs: int = 10):
        spark = docs.sparkSession
        counts = settle(term_counts(collapsed(docs)), "divergence-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("lang_df"))
        kept = settle(kept.where(F.col("lang_df") >= least_docs).select("lang", "term", "lang_n"), "divergence-terms")
        entries = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
        totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
        groups = every.distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = F.lit(0).cast("long")
        groups = groups.select(
            "lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("total", "v", "lang_total")]
        )
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        absent = F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v")))
        self.groups = settle(
            groups.withColumns({"number": number, "absent": absent}).withColumn(
                "block", F.floor(F.col("number") / BLOCK).cast("int")
            ),
            "divergence-groups",
        )
        shared = entries.join(self.groups, ["lang", "source"])
        self.shares = settle(
            shared.select(
                *["lang", "source", "number", "block", "term", "n", "v", "absent"],
                share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
            ),
            "divergence-shares",
        )
        self.spark = spark

    def over_used(self, most: int = 10) -> DataFrame:
        """The ``most`` terms of each group that it uses more than its language, by difference."""
        d = F.col("p") - F.col("q")
        value = F.call_function("div", d * d, F.col("p") + F.col("q"))
        rows = self.shares.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def _by_blocks(self, rows: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks that its own block is part of."""
        last = self.groups.groupBy("lang").agg(F.max("block").alias("_last"))
        met = rows.join(last, "lang").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        pair = {"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}
        return met.withColumns(pair).drop("_last", "_other")

    def _without_common(self) -> DataFrame:
        """For each two sources of a language, the sum as if no term were in both."""
        used = self.shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
        none = F.lit(None).cast("long")
        place = self.groups.select("lang", "source", "number", "block", "absent", "v")
        rows = used.join(place, ["lang", "source"]).unionByName(
            place.where("v > 0").withColumns({"p": none, "m": none})
        )
        rows = self._by_blocks(rows).select("lang", "i", "j", "block", "number", "absent", "v", "p", "m")

        def sums(rows: pd.DataFrame) -> pd.DataFrame:
            anchor = rows[rows["p"].isna()].sort_values("number")
            i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
            v = int(rows["v"].iloc[0])
            own = {int(k): g for k, g in rows[rows["p"].notna()].groupby("number")}
            left, right = (anchor[anchor["block"] == b] for b in (i, j))

            def gains(some: pd.DataFrame, others: np.ndarray) -> np.ndarray:
                """Per source of ``some`` and other source: what its terms add to a pair without any."""
                out = np.zeros((len(some), len(others)), np.int64)
                for k, (number, absent) in enumerate(zip(some["number"], some["absent"], strict=True)):
                    held = own.get(int(number))
                    if held is None:
                        continue
                    base = difference(np.int64(absent), others)
                    for p, m in zip(held["p"].astype(np.int64), held["m"].astype(np.int64), strict=True):
                        out[k] += m * (difference(p, others) - base)
                return out

            a, b = (side["absent"].to_numpy(np.int64) for side in (left, right))
            total = v * difference(a[:, None], b[None, :]) + gains(left, b) + gains(right, a).T
            x, y = np.meshgrid(left["number"].to_numpy(), right["number"].to_numpy(), indexing="ij")
            return _upper(rows["lang"].iloc[0], x, y, total)

        return rows.groupBy("lang", "i", "j").applyInPandas(sums, "lang string, a int, b int, value long")

    def _of_common(self) -> DataFrame:
        """For each two sources, what the terms that both hold change in that sum."""
        parts = F.ceil(F.col("v") / TERMS)
        rows = self.shares.withColumn("part", F.pmod(F.xxhash64("term"), parts))
        rows = self._by_blocks(rows).select("lang", "i", "j", "part", "block", "number", "absent", "term", "p")

        def sums(rows: pd.DataFrame) -> pd.DataFrame:
            i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
            term = pd.factorize(rows["term"])[0]
            sides = []
            for block in (i, j):
                mine = (rows["block"] == block).to_numpy()
                number, at = np.unique(rows["number"].to_numpy()[mine], return_inverse=True)
                p = np.zeros((len(number), term.max() + 1), np.int64)
                p[at, term[mine]] = rows["p"].to_numpy(np.int64)[mine]
                absent = np.zeros(len(number), np.int64)
                absent[at] = rows["absent"].to_numpy(np.int64)[mine]
                sides.append((number, p, absent))
            (left, p, a), (right, q, b) = sides
            total = np.zeros((len(left), len(right)), np.int64)
            for k in range(len(left)):
                held = np.flatnonzero(p[k])
                mine, theirs, zero = p[k, held][None, :], q[:, held], b[:, None]
                there = theirs > 0
                theirs = np.where(there, theirs, 1)
                change = difference(mine, theirs) - difference(mine, zero)
                change += difference(a[k], zero) - difference(a[k], theirs)
                total[k] = np.where(there, change, 0).sum(axis=1)
            x, y = np.meshgrid(left, right, indexing="ij")
            return _upper(rows["lang"].iloc[0], x, y, total)

        return rows.groupBy("lang", "i", "j", "part").applyInPandas(sums, "lang string, a int, b int, value long")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): each group against each other source of its language."""
        sums = self._without_common().unionByName(self._of_common())
        sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        # languages without kept terms: all shares are void and all values 0
        place = self.groups.select("lang", "number", "source", "v")
        other = place.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
        void = place.where("v = 0").select("lang", F.col("number").alias("a")).join(other.drop("item"), "lang")
        void = void.where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
        half = sums.unionByName(void)
        whole = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        named = whole.join(place.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"])
        return named.join(other, ["lang", "b"]).select("lang", "source", "item", "value")


def _upper(lang: str, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """Rows of the pairs with the smaller number first; within one block each pair stands in the matrix twice."""
    once = x < y
    return pd.DataFrame({"lang": lang, "a": x[once], "b": y[once], "value": value[once]})


def audited(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: the whole audit."""
    audit = Audit(docs, least_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    both = pairs.unionByName(audit.over_used(most_terms).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
