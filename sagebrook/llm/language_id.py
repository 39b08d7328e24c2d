"""Language identification by fusing evidence.

For each text a naive Bayes model over byte trigrams gives likelihoods per
language, damped so that a long text isn't certain of everything. The declared
language (of the mark-up or the record) counts through how often each
declaration goes with each language. Hosts and address suffixes give the
prior: counts of what the text alone says, grouped by host, smoothed towards
the host's suffix, which is smoothed towards all rows.

Every primary language subtag that is declared often enough is a language. The
trigram tables lie in the shared folder, a file for each block of languages, and
workers map them. What a text says of a language counts in whole 2**20ths, so that sums don't
depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mapped, save
from .common import attach, fold_of, giving_back, new_path, stored, text_of
from .exact_dedup import without_rows
from .tokens import LOWER, overlapping, sums_by_row

FOLDS, HELD_OUT = 5, 0
#: Rows of each language that the trigram model is fitted on, at most.
SAMPLE = 2_000
#: A declared language with fewer rows is evidence but no class. One row makes a class: a table without rows to fit is as flat as that of no language.
LEAST_ROWS = 1
BUCKETS = 1 << 15
#: Languages of one table of the model, and bytes of a step: their product bounds a worker's memory.
BLOCK, STEP = 32, 1 << 18
#: A text counts as at most so many independent trigrams.
DAMPING = 150.0
#: Share of any declaration or host that is wrong without a pattern, and rows that stand for a prior.
DECLARED_SMOOTHING, HOST_SMOOTHING, SUFFIX_SMOOTHING = 5.0, 10.0, 20.0
#: Below this probability a row is rejected.
LEAST = 0.5
#: Texts of none of the languages: all trigrams equally likely.
NONE = "und"
#: What a text says of a language is a whole number of parts of so many.
PARTS = 1 << 20

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1]] = LOWER[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1]]
_LETTERS[128:] = np.arange(128, 256)


def _trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bucket of each trigram, its row, rows); what is no letter is a space, and blank trigrams are left out.

    A long text comes in parts.
    """
    for step in overlapping(column, 2, STEP):
        letter = _LETTERS[step.data].astype(np.uint32)
        if len(letter) < 3:
            yield step.first, np.zeros(0, np.int64), np.zeros(0, np.int64), step.rows
            continue
        row = np.repeat(np.arange(step.rows), np.diff(step.offsets))
        keep = (row[2:] == row[:-2]) & ((letter[1:-1] != 32) | ((letter[2:] != 32) & (letter[:-2] != 32)))
        code = (letter[:-2] << 16 | letter[1:-1] << 8 | letter[2:])[keep]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        yield step.first, bucket, row[2:][keep], step.rows


def primary_subtag(lang: Column) -> Column:
    """The two or three letters before the first hyphen or underscore, in lower case; null if there are none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(lang.cast("string"))), "^([a-z]{2,3})(?:[-_]|$)", 1), F.lit(""))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n) over rows (lang, text)."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            langs, own = np.unique(names, return_inverse=True)
            n = np.zeros(len(langs) * BUCKETS, np.int64)
            for first, bucket, row, _ in _trigrams(batch.column(1)):
                n += np.bincount(own[first + row] * BUCKETS + bucket, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs[at // BUCKETS].tolist(), pa.string()), pa.array((at % BUCKETS).astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    return texts.select("lang", "text").mapInArrow(work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Trigrams:
    """Names of the languages, and where their log-probabilities lie."""

    def __init__(self, langs: list[str], folder: str):
        self.langs, self.folder = langs, folder

    def tables(self) -> list[np.ndarray]:
        """BUCKETS x languages of each block, mapped."""
        blocks = [self.langs[at : at + BLOCK] for at in range(0, len(self.langs), BLOCK)]
        return [mapped(self.folder, f"trigrams-{k}", np.float32).reshape(BUCKETS, len(b)) for k, b in enumerate(blocks)]


def fit_trigrams(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int, least_rows: int = LEAST_ROWS) -> Trigrams:
    """Log-probabilities of the trigrams of each language with ``least_rows`` declared rows, from at most ``sample`` rows of each.

    Rows with null texts or without a language subtag don't count; those of the held-out fold declare a language but aren't fitted. The
    sample takes the first rows by hash of id and language; rows that repeat the last one's id come with it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), primary_subtag(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least_rows).collect()  # subtags have two or three letters
    langs = sorted(r["lang"] for r in sizes)
    folder = new_path(docs.sparkSession, "language-model")
    if not langs:
        return Trigrams([], folder)
    numbers = F.broadcast(docs.sparkSession.createDataFrame([(n, k, int(r["rows"])) for r in sizes for k, n in [(langs.index(r["lang"]), r["lang"])]], "lang string, number int, rows long"))
    order = F.xxhash64("doc_id", "lang")
    near = rows.where(fold_of("doc_id", FOLDS) != HELD_OUT).withColumn("hash", order).join(numbers, "lang").where(F.col("hash") / float(1 << 64) + 0.5 <= F.lit(2.0 * sample) / F.col("rows"))  # about twice the sample
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    last = near.select("lang", "hash").withColumn("place", place).where(F.col("place") <= sample).groupBy("lang").agg(F.max("hash").alias("last"))
    chosen = near.join(F.broadcast(last), "lang").where(F.col("hash") <= F.col("last"))  # a row for each language; texts don't move
    blocks = -(-len(langs) // BLOCK)

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        found = pa.Table.from_batches(got)
        block = found["block"][0].as_py()
        width = len(langs[block * BLOCK : (block + 1) * BLOCK])
        table = np.full((BUCKETS, width), 0.5)
        table[found["bucket"].to_numpy(), found["number"].to_numpy() - block * BLOCK] += found["n"].to_numpy()
        save(folder, f"trigrams-{block}", np.log(table / table.sum(axis=0)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], ["block"])

    counts = trigram_counts(chosen).unionByName(numbers.select("lang", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n")))  # languages without rows to fit, too
    counts = counts.join(numbers, "lang").select(F.expr(f"cast(number div {BLOCK} as int)").alias("block"), "number", "bucket", "n")
    counts.repartitionById(blocks, "block").mapInArrow(work, "block int").collect()  # a number for each block
    return Trigrams(langs, folder)


_ROW = ("doc_id", "text_hash", "declared", "host", "suffix")


def text_evidence(rows: DataFrame, model: Trigrams) -> DataFrame:
    """``rows`` (doc_id, text_hash, declared, host, suffix, text) with what each text says.

    ``evidence``: damped log-likelihoods of the languages and of none; ``best``: the likeliest
    alone; ``named``, ``parts``: languages with at least half a part of PARTS, and their parts.
    """
    width = len(model.langs) + 1

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            text = batch.column(len(_ROW))
            out, n = np.zeros((len(text), width)), np.zeros(len(text))
            for first, bucket, row, size in _trigrams(text):
                own = slice(first, first + size)
                for k, table in enumerate(tables):
                    out[own, k * BLOCK : k * BLOCK + table.shape[1]] += sums_by_row(table[bucket], row, size)
                count = np.bincount(row, minlength=size)
                out[own, -1] -= count * np.log(BUCKETS)
                n[own] += count
            out *= (1 / (1 + n / DAMPING))[:, None]
            p = np.exp(out - out.max(axis=1, keepdims=True)) if len(out) else out
            parts = np.rint(p / p.sum(axis=1, keepdims=True) * PARTS).astype(np.int64)
            at, which = np.nonzero(parts)
            ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(text)))].astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, np.int32)), pa.array(out.ravel()))
            named = pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32)))
            shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(parts[at, which]))
            best = pa.array(out.argmax(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(_ROW)], evidence, best, named, shares], [*_ROW, "evidence", "best", "named", "parts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*_ROW, "text").mapInArrow(
        work, f"doc_id {kind}, text_hash long, declared string, host string, suffix string, evidence array<double>, best int, named array<int>, parts array<long>"
    )


def _normal(logs: Column) -> Column:
    """Probabilities from log-probabilities up to a constant."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(F.array(weights), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)))[0]


def _own(sums: DataFrame, *by: str) -> DataFrame:
    """By these columns: ``own``, the rows that speak for each language, and ``rows``, all of them."""
    each = sums.groupBy(*by, "k").agg((F.sum("parts") / PARTS).alias("n"))
    return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("own"), F.round(F.sum("n")).alias("rows"))


def _smoothed(parent: Column, weight: float) -> Column:
    return F.transform(parent, lambda p, k: (F.coalesce(F.try_element_at("own", k), F.lit(0.0)) + weight * p) / (F.col("rows") + weight))


def fused(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """(doc_id, text_hash, language, probability, text_language, declared, host): the best language of all evidence together.

    Of equally likely languages the first by name wins, and ``und`` loses.
    """
    names = [*langs, NONE]
    width = len(names)
    total = evidence.count()
    said = evidence.select("host", "suffix", "declared", F.explode(F.arrays_zip(F.col("named").alias("k"), "parts")).alias("e"))
    sums = stored(said.groupBy("host", "suffix", "declared", F.col("e.k").alias("k")).agg(F.sum("e.parts").alias("parts")), "said")
    every = [0.0] * width
    for r in sums.groupBy("k").agg((F.sum("parts") / PARTS).alias("n")).collect():  # a row for each language
        every[r["k"]] = r["n"]
    prior = F.lit([(n + 1.0) / (total + width) for n in every])

    suffixes = _own(sums, "suffix").select(F.col("suffix").alias("of"), _smoothed(prior, SUFFIX_SMOOTHING).alias("suffix_prior"))
    hosts = _own(sums, "host", "suffix").join(suffixes, F.col("suffix").eqNullSafe(F.col("of"))).select(
        F.struct("host", "suffix").alias("site"), F.col("rows").cast("long").alias("n"), _smoothed(F.col("suffix_prior"), HOST_SMOOTHING).alias("prior")
    )
    share = F.transform(
        F.lit(every), lambda n, k: (F.coalesce(F.try_element_at("own", k), F.lit(0.0)) + DECLARED_SMOOTHING * F.col("rows") / max(total, 1)) / (n + DECLARED_SMOOTHING)
    )
    claims = _own(sums, "declared").select(F.struct("declared").alias("claim"), F.col("rows").cast("long").alias("declared_n"), share.alias("claim_share"))

    named = evidence.select("doc_id", "text_hash", "declared", "host", "evidence", "best", F.struct("host", "suffix").alias("site"), F.struct("declared").alias("claim"))
    named = attach(named, stored(hosts, "hosts"), "site", "n", total)
    named = attach(named, stored(claims, "declarations"), "claim", "declared_n", total)
    logs = F.zip_with(F.zip_with("evidence", "prior", lambda a, b: a + F.log(b)), "claim_share", lambda a, b: a + F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log(b)))
    languages = F.lit(names)
    return named.withColumn("q", _normal(logs)).select(
        "doc_id", "text_hash", F.element_at(languages, F.array_position("q", F.array_max("q")).cast("int")).alias("language"), F.array_max("q").alias("probability"),
        F.element_at(languages, F.col("best") + 1).alias("text_language"), "declared", "host",
    )


def identify(rows: DataFrame, model: Trigrams, least: float = LEAST) -> DataFrame:
    """Fused languages of rows (doc_id, text_hash, text, declared, host, suffix); ``kept`` is false where none is likely."""
    if not model.langs:
        return rows.select(
            "doc_id", "text_hash", F.lit(NONE).alias("language"), F.lit(1.0).alias("probability"), F.lit(NONE).alias("text_language"), "declared", "host", F.lit(False).alias("kept")
        )
    found = fused(stored(text_evidence(rows, model), "evidence"), model.langs)
    return found.withColumn("kept", (F.col("language") != NONE) & (F.col("probability") >= least))


def document_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, host_col: str) -> DataFrame:
    declared = F.nullif(F.lower(F.trim(F.col(lang_col).cast("string"))), F.lit(""))
    host, text = F.col(host_col).cast("string"), text_of(text_col)
    suffix = F.when(F.contains(host, F.lit(".")), F.lower(F.substring_index(host, ".", -1)))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))


def document_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", sample: int = SAMPLE, least: float = LEAST,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """One row for each document: doc_id, language, probability, text_language, declared, host, kept.

    A document's record declares its language and names its source, which stands
    for the host; its last label is the suffix, null without a dot. The trigram model is fitted
    on a bounded sample of the declared languages; each text is then scored whole.
    A null text counts as empty: it says nothing, and declaration and host decide.
    A null declaration is no evidence; null hosts are one host. Rows that repeat
    come out as often. Of equally likely languages the first by name wins. Without any
    language that ``least_rows`` rows declare, all rows are undetermined and not kept. An empty table gives
    no rows; other columns are ignored.
    """
    model = fit_trigrams(docs, id_col, text_col, lang_col, sample, least_rows)
    return identify(document_rows(docs, id_col, text_col, lang_col, host_col), model, least).drop("text_hash")


def page_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The same for web pages (page_id as doc_id), by a trigram model of ``docs``.

    The mark-up's lang attribute declares; the last label of the host is the
    address suffix. Script, style and tags are cut out of the text.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " "), "(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, "(?i)<html\\b[^>]*\\blang=[\"']?([a-zA-Z]{2,3})\\b", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    model = fit_trigrams(docs, "doc_id", "text", "lang", sample)
    rows = pages.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), declared.alias("declared"), host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )
    return identify(rows, model, least).drop("text_hash")


def drop_unidentified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", sample: int = SAMPLE, least: float = LEAST,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined, all columns as they came.

    Decisions as in ``document_languages``: an empty text stays if its declaration and source
    name a language; rows that repeat share one decision. The rejected rows are told by id and text hash, null
    ids too, and go through a bit filter, so that texts don't shuffle. If rows that share id and text
    differ in declaration or source, they go only if all of them are rejected.
    """
    model = fit_trigrams(docs, id_col, text_col, lang_col, sample, least_rows)
    found = identify(document_rows(docs, id_col, text_col, lang_col, host_col), model, least)
    rejected = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    return without_rows(docs, id_col, text_col, rejected)
