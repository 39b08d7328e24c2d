"""Interpolated modified Kneser-Ney bigram model, counted in Spark, in memory-mapped sorted hash arrays.

Words and bigrams are 64-bit hashes. Bigrams are dealt by the hash of their
first word, so that a task sees a context whole and writes one shard of the
sorted bigram arrays into the shared folder; frequent first words are dealt by
the whole bigram instead. Word arrays hold each word's count, its lower-order
probability and its backoff weight. Workers map the files and look up sorted
queries; nothing of the model passes through the driver or a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import looked_up, save, save_sorted, saved_shards, shard_of
from .common import HOT_KEYS, fold_of, new_path, stored, text_of
from .tokens import LOWER, WORD_CLASS, mixed, runs, span_hashes, steps, sums_by_row

FOLDS, LEFT_OUT = 7, 2
START, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: A mapper sorts so many tokens at once; a task builds about as many bigrams.
RUN_TOKENS, SHARD_TOKENS = 1 << 21, 1 << 21
#: Rows of a batch that a task sends to Spark.
SLICE = 1 << 16
#: Shards are numbered with at most so many bits: enough for 3e13 tokens at SHARD_TOKENS each.
MOST_BITS = 24


def _sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, tokens, the token before each, row of each, rows): the words of each text and one end.

    A long text comes in parts, its end with the last one.
    """
    last_word = START
    for step in steps(column, WORD_CLASS):
        n = step.rows
        data = LOWER[step.data]
        starts, ends, row = runs(data, step.offsets, WORD_CLASS)
        size = np.bincount(row, minlength=n) + int(step.ends)
        token = np.full(int(size.sum()), END, np.uint64)
        is_word = np.ones(len(token), bool)
        first = np.cumsum(size) - size
        if step.ends:
            is_word[first + size - 1] = False
        token[is_word] = span_hashes(data, starts, ends)
        if not len(token):
            continue
        before = np.r_[START, token[:-1]]
        before[first[size > 0]] = START
        if not step.begins:
            before[0] = last_word
        last_word = START if step.ends else token[-1]
        yield step.first, token, before, np.repeat(np.arange(n), size), n


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit key of each bigram."""
    return mixed(u * np.uint64(3) ^ mixed(w))


def pair_shards(u: np.ndarray, key: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each bigram: by its first word, or by the whole bigram if that word is frequent."""
    frequent = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
    return shard_of(np.where(frequent, key, mixed(u)), bits)


def run_order(u: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A number for each bigram of a run that sorts by shard and keeps equal first words together.

    Its low bits tell the second words of one first word apart; a run holds too few of them for clashes.
    """
    key = pair_keys(u, w)
    frequent = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
    low = np.uint64(64 - MOST_BITS)
    return np.where(frequent, key, mixed(u)) >> low << low | key & ((np.uint64(1) << low) - np.uint64(1))


def _packed(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams in key order as bytes: first words recur and counts are small, so these compress; second words don't."""
    parts = [pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True) for x in (u, n.astype(np.uint32))]
    return np.array([len(u), *map(len, parts)], np.int64).tobytes() + b"".join(parts) + w.tobytes()


def _unpacked(raw: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, size_u, size_n = np.frombuffer(raw[:24], np.int64).tolist()
    u = np.frombuffer(pa.decompress(raw[24 : 24 + size_u], rows * 8, "zstd"), np.uint64)
    n = np.frombuffer(pa.decompress(raw[24 + size_u : 24 + size_u + size_n], rows * 4, "zstd"), np.uint32)
    return u, np.frombuffer(raw[24 + size_u + size_n :], np.uint64), n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): how often each token occurs, ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([_signed(key), pa.array(n)], ["key", "n"])

        size = 0
        for batch in batches:
            for _, token, *_ in _sequences(batch.column(0)):
                waiting.append(token)
                size += len(token)
                if size >= RUN_TOKENS:
                    out, size = counted(), 0
                    yield from (out.slice(at, SLICE) for at in range(0, out.num_rows, SLICE))
        if waiting:
            out = counted()
            yield from (out.slice(at, SLICE) for at in range(0, out.num_rows, SLICE))

    return texts.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def bigram_runs(texts: DataFrame, hot: np.ndarray, shard_bits: int) -> DataFrame:
    """(shard, bigrams): of each run of tokens the shard's distinct bigrams with their counts, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            u, w = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            _, at, n = np.unique(run_order(u, w, hot), return_index=True, return_counts=True)
            u, w = u[at], w[at]
            shard = pair_shards(u, pair_keys(u, w), hot, shard_bits)
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            packed = [_packed(u[a:b], w[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "bigrams"])

        size = 0
        for batch in batches:
            for _, token, before, *_ in _sequences(batch.column(0)):
                waiting.append((before, token))
                size += len(token)
                if size >= RUN_TOKENS:
                    yield counted()
                    size = 0
        if waiting:
            yield counted()

    return texts.select("text").mapInArrow(work, "shard int, bigrams binary")


def build_bigrams(pairs: DataFrame, folder: str, hot: np.ndarray, shards: int) -> DataFrame:
    """Writes the bigram arrays; (key, n1, n2, n3, n4, more, contexts) of each word, as far as a shard knows them.

    n1 to n4 and more: different words that follow once, twice, ..., at least
    three times; contexts: different words that precede. A shard lies in its
    task's memory: about SHARD_TOKENS runs of bigrams.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, shard = [], 0
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = number
                found.append(_unpacked(memoryview(raw.as_buffer())))
        if not found:
            return
        u, w, n = (np.concatenate(x) for x in zip(*found))
        found.clear()
        key = pair_keys(u, w)
        order = np.argsort(key)
        key, u, w, n = key[order], u[order], w[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(n, first, dtype=np.int64)
        key, u, w = key[first], u[first], w[first]
        large = n >= 255
        for name, own, count in (("pairs", slice(None), np.minimum(n, 255).astype(np.uint8)), ("large", large, n[large])):
            save(folder, f"{name}-{shard}.keys", key[own])
            save(folder, f"{name}-{shard}.count", count)
        heads, at = np.unique(u, return_inverse=True)
        columns = [np.bincount(at, n == k, len(heads)) for k in (1, 2, 3, 4)] + [np.bincount(at, n >= 3, len(heads)), np.zeros(len(heads))]
        tails, count = np.unique(w, return_counts=True)
        zero = np.zeros(len(tails), np.int64)
        for keys, values in ((heads, columns), (tails, [*[zero] * 5, count])):
            out = pa.RecordBatch.from_arrays([_signed(keys), *(pa.array(v.astype(np.int64)) for v in values)], ["key", *COUNTS])
            yield from (out.slice(at, SLICE) for at in range(0, len(keys), SLICE))

    return pairs.repartitionById(shards, "shard").mapInArrow(work, "key long, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("n1", "n2", "n3", "n4", "more", "contexts")


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and more, kept within (0, count)."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(np.clip(d, 0.05, k + 0.95)) for k, d in enumerate(raw))


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.select([n <= 0, n == 1, n == 2], [0.0, d[0], d[1]], d[2]), 0)


def _pair_counts(folder: str, shards: frozenset[int], wanted: np.ndarray, number: np.ndarray) -> np.ndarray:
    _, (n,) = looked_up(folder, "pairs", shards, (("count", np.uint8),), wanted, number)
    large = np.flatnonzero(n == 255)
    if len(large):
        _, (n[large],) = looked_up(folder, "large", shards, (("count", np.int64),), wanted[large], number[large])
    return n


#: What the arrays of words hold.
WORD_COLUMNS = {"n": np.int64, "lower": np.float64, "backoff": np.float64}


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are lower-cased (A-Z); each text ends with an end token. The model
    learns from all whole texts with crc32(id as text) mod 7 other than 2, and
    scores all. ``base_score`` is the add-one unigram log10 probability, ``score``
    that of the bigram model. A null text counts as empty: its end is its only
    token. A null id counts as empty text for the fold. Rows that repeat are learnt and
    come out as often. An empty table gives no rows; without training rows every
    token is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = fold_of("doc_id", FOLDS) == LEFT_OUT
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    train = rows.where(~held_out)
    unigrams = stored(word_counts(train), "words")
    tokens, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = unigrams.where(F.col("n") > max(1000, tokens // HOT_KEYS)).select("key").collect()  # at most HOT_KEYS rows
    hot = np.sort(np.array([r["key"] for r in often] + [int(START.view(np.int64))], np.int64).view(np.uint64))
    bits = min(MOST_BITS, max(0, int(tokens // shard_tokens).bit_length()))
    folder = new_path(spark, "language-model")
    parts = build_bigrams(bigram_runs(train, hot, bits), folder, hot, 1 << bits)
    contexts = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    ends = unigrams.where(F.col("key") == int(END.view(np.int64))).select(F.lit(int(START.view(np.int64))).alias("key"), "n")
    words = stored(unigrams.unionByName(ends).join(contexts, "key", "left").fillna(0), "word-statistics")
    totals = words.agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.count_if(F.col("contexts") == k).alias(f"m{k}") for k in (1, 2, 3, 4)], F.count_if(F.col("contexts") >= 3).alias("m_more")).first()
    n = {k: float(v or 0) for k, v in totals.asDict().items()}
    pair_d, word_d = discounts(n["n1"], n["n2"], n["n3"], n["n4"]), discounts(n["m1"], n["m2"], n["m3"], n["m4"])
    lower_rest = (word_d[0] * n["m1"] + word_d[1] * n["m2"] + word_d[2] * n["m_more"]) / n["contexts"] if n["contexts"] else 1.0
    word_bits = max(0, int(distinct // shard_tokens).bit_length())
    follow = sum((F.lit(d) * F.col(c) for d, c in zip(pair_d, ("n1", "n2", "more"))), F.lit(0.0))
    taken = F.when(F.col("contexts") == 0, 0.0).when(F.col("contexts") == 1, word_d[0]).when(F.col("contexts") == 2, word_d[1]).otherwise(word_d[2])
    statistics = words.select(
        "key", "n", ((F.col("contexts") - taken) / max(n["contexts"], 1.0) + lower_rest / (distinct + 1)).alias("lower"),
        F.when(follow > 0, follow / F.greatest("n", F.lit(1))).otherwise(1.0).alias("backoff"),
    )
    word_shards = frozenset(save_sorted(statistics, folder, "words", WORD_COLUMNS, word_bits))
    with_pairs = saved_shards(folder, "pairs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.zeros((len(texts), 4))
            for first, token, before, row, size in _sequences(texts):
                every, at = np.unique(np.r_[token, before], return_inverse=True)
                _, values = looked_up(folder, "words", word_shards, tuple(WORD_COLUMNS.items()), every, shard_of(every, word_bits))
                count, lower, backoff = (x[at] for x in values)
                m = len(token)
                known = count[:m] > 0
                head = count[m:]
                lower = np.where(known, lower[:m], lower_rest / (distinct + 1))
                key, one, where = np.unique(pair_keys(before, token), return_index=True, return_inverse=True)
                number = pair_shards(before[one], key, hot, bits)
                order = np.argsort(number, kind="stable")
                c = np.zeros(len(key))
                c[order] = _pair_counts(folder, with_pairs, key[order], number[order])
                c = c[where]
                p = np.where(head > 0, _discounted(c, pair_d) / np.maximum(head, 1) + backoff[m:] * lower, lower)
                base = np.log10((count[:m] + 1) / (tokens + distinct + 1))
                found[first : first + size] += sums_by_row(np.stack([np.ones(m), known, base, np.log10(p)], 1), row, size)
            whole = [pa.array(found[:, k].astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *whole, pa.array(found[:, 2]), pa.array(found[:, 3])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
