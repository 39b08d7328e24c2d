"""Quality rules with thresholds that adapt to each language and source.

Fixed cutoffs for gross faults come first. For every other measure a quantile
sketch is kept per language and source: counts of logarithmic bins, which merge
by addition, don't depend on the order of rows, and give any quantile within
``ACCURACY`` of its value. A row is dropped if a measure lies beyond the fence
above the upper quartile of its group. Most texts have no repeated line or window at all,
so the quartiles are those of the rows that have any: else the fence would be a fixed
cutoff. Signs are another matter, as most rows that have any are faulty: their quartiles
are those of all rows, and ``SLACK`` decides where signs are rare. Rows that the fixed cutoffs drop don't count. Groups with few rows take the merged sketch of their language, or of all rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored, text_of

ACCURACY = 0.02
#: A group with fewer rows that count takes the sketch of the next wider group.
LEAST_ROWS = 200
#: A fence stands at the upper quartile plus so many quartile distances, and twice the sketch's accuracy beyond.
REACH = 3.0
#: In thousandths, but for tenths of a letter.
MEASURES = ("symbols", "dup_lines", "repeats", "capitals", "mean_word")
#: Measures whose quartiles are those of all rows, and what their fence leaves beyond.
SLACK = {"symbols": 20.0}
#: Groups up to this number have their thresholds broadcast; more are joined through a shuffle.
BROADCAST_GROUPS = 100_000


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only a text with a
    hash that recurs is sorted; overlapping windows count a word once.
    """
    def in_sorted(found: Column) -> Column:
        def same(at: Column, other: Column) -> Column:
            return F.coalesce(F.get(found, other)["h"] == F.get(found, at)["h"], F.lit(False))

        recurring = F.filter(
            F.transform(found, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda i: i.isNotNull()
        )
        return F.aggregate(
            F.array_sort(recurring),
            F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def in_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), in_sorted)
        )

    def in_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) > window, _let(hashes, in_windows)).otherwise(F.lit(0).cast("long"))

    return _let(words, in_words)


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The base counts of each whole text, beside its id, language and source."""
    text = text_of(text_col)
    has_word = f"[^{SPACES}]"
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("t")
    )
    letters = F.translate("t", " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(has_word))
    return rows.select(
        "doc_id", "lang", "source",
        F.filter(F.split("t", f"[{SPACES}]+"), lambda w: w != "").alias("words"),
        F.length(letters).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        _let(lines, lambda found: F.struct(
            F.size(found).cast("long").alias("lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup")
        )).alias("l"),
    ).select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.dup").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), "n_capitals", F.col("l.lines").alias("n_lines"),
    )


def _measures() -> dict[str, Column]:
    def share(part: str, whole: str, scale: int = 1000) -> Column:
        return F.coalesce(F.lit(float(scale)) * F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"), "mean_word": share("word_chars", "n_words", 10),
    }


def sketch(rows: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """(lang, source, measure, bin, n): bin k > 0 holds values in (g^(k-1), g^k]; bin 0 those below 1.

    Pre-aggregated before the shuffle; merging groups adds counts.
    """
    base = math.log((1 + accuracy) / (1 - accuracy))
    pairs = [
        F.struct(F.lit(name).alias("measure"), F.when(x < 1, F.lit(0)).otherwise(F.ceil(F.log(x) / F.lit(base)) + 1).cast("int").alias("bin"))
        for name, x in _measures().items()
    ]
    return rows.select("lang", "source", F.explode(F.array(*pairs)).alias("p")).groupBy(
        "lang", "source", F.col("p.measure").alias("measure"), F.col("p.bin").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketched: DataFrame, by: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """Rows and quartiles q1, q3 of each measure per group, from the merged bins of a sketch."""
    base = math.log((1 + accuracy) / (1 - accuracy))
    merged = sketched.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(own)
    value = F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.exp((F.col("bin") - F.lit(1.5)) * F.lit(base)))
    placed = merged.select(*by, "measure", value.alias("value"), upto.alias("upto"), total.alias("rows"))
    return placed.groupBy(*by, "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("value"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("value"))).alias("q3"),
    )


def thresholds(sketched: DataFrame, least_rows: int = LEAST_ROWS, reach: float = REACH) -> DataFrame:
    """(lang, source, <measure>_most ...): the fences of every group that occurs.

    A group with under ``least_rows`` rows that count takes its language's, and a language
    with as few takes that of all rows; where no row counts the fence is 0.
    """
    above = sketched.where((F.col("bin") > 0) | F.col("measure").isin(*SLACK))
    own, lang, every = (
        quartiles(above, by).select(*[F.col(c).alias(f"{c}{k}") for c in by], F.col("measure").alias(f"measure{k}"), F.col("rows").alias(f"rows{k}"), F.struct("q1", "q3").alias(f"level{k}"))
        for k, by in enumerate((["lang", "source"], ["lang"], []))
    )
    same = lambda k, *by: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}{k}")) for c in (*by, "measure")])
    found = sketched.select("lang", "source", "measure").distinct().join(own, same(0, "lang", "source"), "left").join(lang, same(1, "lang"), "left")
    found = found.join(F.broadcast(every), same(2), "left")  # a row for each measure
    q = F.when(F.col("rows0") >= least_rows, F.col("level0")).when(F.col("rows1") >= least_rows, F.col("level1")).otherwise(F.col("level2"))
    slack = F.when(F.col("measure") == "symbols", F.lit(SLACK["symbols"])).otherwise(F.lit(0.0))
    fence = found.select("lang", "source", "measure", F.coalesce((q["q3"] + F.lit(reach) * (q["q3"] - q["q1"])) * F.lit(1 + 2 * ACCURACY) + slack, F.lit(0.0)).alias("most"))
    return fence.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("most"))).alias(f"{m}_most") for m in MEASURES])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_rows: int = LEAST_ROWS, reach: float = REACH,
) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated
    5-word windows. ``kept`` is false for those and for rows with a measure beyond
    their group's fence. Null text counts as empty (base_failed); null
    languages and sources are groups of their own. Rows that repeat come out as
    often; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(measured(docs, id_col, text_col, lang_col, source_col), "measures")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fences = stored(thresholds(sketch(rows.where(~failed)), least_rows, reach), "fences")
    if fences.count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    fences = fences.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    joined = rows.join(fences, rows["lang"].eqNullSafe(F.col("fence_lang")) & rows["source"].eqNullSafe(F.col("fence_source")), "left")
    within = F.lit(True)
    for name, x in _measures().items():
        within = within & (x <= F.col(f"{name}_most"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"), *[F.round(F.col(f"{m}_most"), 6).alias(f"{m}_most") for m in MEASURES],
    )
