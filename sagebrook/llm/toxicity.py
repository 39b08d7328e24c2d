"""Toxicity by class-conditional Kneser-Ney models.

Two models spell out the words of toxic and of ordinary documents, byte by
byte. The longest grams (ORDER bytes of a word, or all from its beginning on)
are counted in either class: in how many distinct words of how many texts they
occur. Below them both classes back off to the same continuation counts: in how many
different longer grams a shorter one occurs, at every order. Rare and inflected
expressions thus share what their stems share, and a rare word that only one class
happens to hold costs the other little.

Pairs of words are events too, as expressions may consist of ordinary words: their
discounted shares in either class back off to the shared count of classes that hold them. Evidence
sums the largest weights above 0, which only pairs of toxic texts can have; so
pairs that no toxic text holds, and weights of 0 or less, are left out and change no score.

As both classes share the backoff, a gram's difference of log-likelihoods needs one
number, and so does each context for the grams that it wasn't seen with. These
numbers are counted and computed in Spark and lie in sorted hash arrays in the shared
folder, which workers map into memory.

A text's evidence is the difference per word, the sums over its most telling words and pairs,
and the logarithm of its number of distinct words, as long texts hold more of
anything. The score is a logistic function of these four, fitted on labelled
rows under a model that hasn't counted them; the final model counts those, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import looked_up, save_sorted, shard_of
from .common import fold_of, give_back, giving_back, new_path, stored, text_of
from .tokens import LETTER, LONGEST_RUN, LOWER, RUN_CLASS, STEP, Step, gathered, mixed, runs, span_hashes, steps, sums_by_row

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Labelled rows of each class that the counts and the calibration use, at most.
SAMPLE = 20_000
#: Bytes of the longest grams, the last byte being the predicted one; chosen on the calibration fold, beyond it nothing is gained.
ORDER = 12
DISCOUNT = 0.75
#: A missed toxic text counts as so many false alarms; chosen on the calibration fold (at sf0.1 5 of 97 missed there instead of 7, 2 of 698 false alarms as before).
MISS = 3.0
#: So many of a text's most telling words, and pairs, are summed.
TELLING = 3
#: Entries of a shard of the model, about, and grams that are worked on at once.
SHARD, SLICE = 1 << 18, 1 << 16
#: Sets the keys of contexts apart from those of grams.
CONTEXT = np.uint64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """The words of a step: runs of letters in lower case."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    keys: np.ndarray  # hashes of the distinct words, ascending
    one: np.ndarray  # a token of each distinct word
    inverse: np.ndarray  # the distinct word of each token


def words_of(step: Step) -> Words:
    data = LOWER[step.data]
    starts, ends, row = runs(data, step.offsets, RUN_CLASS, LONGEST_RUN)
    letters = RUN_CLASS[data[starts]] == LETTER
    starts, ends, row = starts[letters], ends[letters], row[letters]
    keys, one, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return Words(data, starts, ends, row, keys, one, inverse)


class Spelling(NamedTuple):
    """Words with a space before and after each, and the longest gram of every byte but the first."""

    data: np.ndarray
    word: np.ndarray  # the word of each gram
    starts: np.ndarray
    ends: np.ndarray


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> Spelling:
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - begin[word]
    padded = data[np.clip(starts[word] + place - 1, 0, max(0, len(data) - 1))] if len(data) else np.zeros(len(word), np.uint8)
    padded[(place == 0) | (place == size[word] - 1)] = 32
    at = np.flatnonzero(place > 0)
    return Spelling(padded, word[at], np.maximum(begin[word[at]], at + 1 - order), at + 1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` of short, ascending spans over any number of bytes."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, "right")))
        low = starts[at]
        out.append(span_hashes(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low))
        at = to
    return np.concatenate(out)


def _once(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the distinct pairs of row and key."""
    order = np.lexsort((key, row))
    return order[np.r_[True, (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])]] if len(order) else order


def pairs_of(w: Words, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of the pairs of neighbouring words; ``before`` is the word before a cut, if any."""
    key = np.r_[before, w.keys[w.inverse]]
    row = np.r_[w.row[:1], w.row] if len(before) and len(w.row) else w.row
    near = row[1:] == row[:-1]
    u, v = key[: len(row)][:-1][near], key[1 : len(row)][near]
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + v), row[1:][near]


def _text_pairs(column: pa.Array) -> Iterator[np.ndarray]:
    """Keys of the pairs of each step, each once for every text that holds it."""
    seen, before = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for step in steps(column, RUN_CLASS, LONGEST_RUN):
        w = words_of(step)
        pair, row = pairs_of(w, before[:0] if step.begins else before)
        before = w.keys[w.inverse[-1:]] if len(w.inverse) or step.begins else before
        found = pair[_once(row, pair)]
        if not (step.begins and step.ends):
            seen = seen[:0] if step.begins else seen
            found = found[~np.isin(found, seen)]
            seen = np.union1d(seen, found)
        yield found


def pair_weights(texts: DataFrame, folder: str) -> DataFrame:
    """(key, weight): log P(toxic) - log P(ordinary) of each pair of a toxic text, from rows (label, text)."""

    @giving_back
    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _text_pairs(batch.column(0)):
                key, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n1"])

    own = stored(texts.where("label = 1").select("text").mapInArrow(toxic, "key long, n1 long").groupBy("key").agg(F.sum("n1").alias("n1")), "toxic-pairs")
    kinds, n1 = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    bits = (kinds // SHARD).bit_length()
    shards = frozenset(save_sorted(own, folder, "toxic-pairs", {"n1": np.int64}, bits))

    @giving_back
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _text_pairs(batch.column(0)):
                key, n = np.unique(found, return_counts=True)
                known, _ = looked_up(folder, "toxic-pairs", shards, (), key, shard_of(key, bits))
                counts = np.r_[n[known], n.sum()].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*key[known].view(np.int64).tolist(), None], pa.int64()), pa.array(counts)], ["key", "n0"])

    other = stored(texts.where("label = 0").select("text").mapInArrow(plain, "key long, n0 long").groupBy("key").agg(F.sum("n0").alias("n0")), "plain-pairs")
    n0 = other.where("key is null").agg(F.coalesce(F.sum("n0"), F.lit(0))).first()[0]  # the row without a key has all pairs
    both = own.join(other.where("key is not null"), "key", "left").select("key", "n1", F.coalesce("n0", F.lit(0)).alias("n0"))
    rest = F.when(F.col("n0") > 0, DISCOUNT).otherwise(DISCOUNT / 2)
    share = [(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + rest) / max(n, 1) for c, n in (("n1", n1), ("n0", n0))]
    weight = F.when(F.lit(n0 > 0), F.log(share[0] / share[1])).otherwise(0.0).cast("float").alias("weight")
    return both.select("key", weight).where("weight > 0")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, toxic, plain): texts of either class that hold the word, from rows (label, text)."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False) == 1
            for step in steps(batch.column(1), RUN_CLASS, LONGEST_RUN):
                w = words_of(step)
                one = _once(w.row, w.inverse)
                toxic = np.bincount(w.inverse[one], label[step.first + w.row[one]], len(w.keys)).astype(np.int64)
                plain = np.bincount(w.inverse[one], minlength=len(w.keys)) - toxic
                new = np.ones(len(w.keys), bool)
                if not (step.begins and step.ends):  # a word counts once in all parts of a text
                    seen = seen[:0] if step.begins else seen
                    new = ~np.isin(w.keys, seen)
                    seen = np.union1d(seen, w.keys)
                words = gathered(w.data, w.starts[w.one[new]], w.ends[w.one[new]]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(toxic[new]), pa.array(plain[new])], ["word", "toxic", "plain"])

    return texts.select("label", "text").mapInArrow(work, "word binary, toxic long, plain long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")
    )


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(tails, last, gram, toxic, plain): longest grams, the two bytes before their last (256 x first + second), and their words' counts, from ``word_counts``."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            s = spelled(data, offsets[:-1], offsets[1:], order)
            _, one, at = np.unique(_hashes(s.data, s.starts, s.ends), return_index=True, return_inverse=True)
            counts = [np.bincount(at, batch.column(k).to_numpy()[s.word], len(one)).astype(np.int64) for k in (1, 2)]
            ends = s.ends[one]
            tails = np.where(ends - s.starts[one] > 2, s.data[ends - 3].astype(np.int32) << 8, 0) | s.data[ends - 2]
            near = [pa.array(x.astype(np.int32)) for x in (tails, s.data[ends - 1])]
            yield pa.RecordBatch.from_arrays(
                [*near, gathered(s.data, s.starts[one], ends).cast(pa.binary()), *map(pa.array, counts)], ["tails", "last", "gram", "toxic", "plain"]
            )

    found = words.select("word", "toxic", "plain").mapInArrow(work, "tails int, last int, gram binary, toxic long, plain long")
    return found.groupBy("tails", "last", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _backed_off(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Discounted shares of continuation counts along the last axis, filled up by those of the shorter context."""
    total = count.sum(axis=-1, keepdims=True)
    kept = np.maximum(count - DISCOUNT, 0) + DISCOUNT * (count > 0).sum(axis=-1, keepdims=True) * shorter
    return np.where(total > 0, kept / np.maximum(total, 1), shorter)


def byte_shares(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared probabilities of a byte without a context, and after each byte."""
    kinds, after = np.zeros(256), np.zeros((256, 256))
    before = F.col("tails").bitwiseAND(255).alias("before")
    for r in grams.select(before, "last").distinct().groupBy("last").count().collect():  # at most 256 rows
        kinds[r["last"]] = r["count"]
    for r in grams.where(F.octet_length("gram") > 2).select("tails", "last").distinct().groupBy(before, "last").count().collect():  # at most 256 x 256 rows
        after[r["before"], r["last"]] = r["count"]
    base = _backed_off(kinds, np.full(256, 1 / 256))
    return base, _backed_off(after, base)


def gram_weights(gram: pa.Array, toxic: np.ndarray, plain: np.ndarray, shares: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights: log P(toxic) - log P(ordinary) of the grams, and of what their contexts weren't seen with.

    Takes all grams whose contexts end in the same two bytes; ``shares`` are ``byte_shares``.
    Each length's shared probability discounts its continuation counts and falls back to the
    next shorter length.
    """
    data, offsets = _bytes(gram)
    size, n = np.diff(offsets), len(gram)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    bytes_at = lambda k: np.where(k < size, data[np.maximum(offsets[1:] - 1 - k, 0)], 0)
    suffix = np.zeros((order, n), np.uint64)  # row k: the last k + 1 bytes
    power = np.uint64(1)
    for k in range(order):  # a byte at a time, as all at once would take four times the memory
        suffix[k] = (bytes_at(k).astype(np.uint64) + np.uint64(1)) * power
        if k:
            suffix[k] += suffix[k - 1]
        power = np.multiply(power, np.full(1, 0x9E3779B97F4A7C15, np.uint64))[0]
    last = suffix[0]
    ended, before = bytes_at(0).astype(np.int64), bytes_at(1).astype(np.int64)
    shared = np.where(size > 2, shares[1][before, ended], shares[0][ended])
    for length in range(3, order):
        at = np.flatnonzero(size > length)
        if not len(at):
            break
        _, one = np.unique(suffix[length, at], return_index=True)
        longer = at[one]
        own, first, inverse = np.unique(suffix[length - 1, longer], return_index=True, return_inverse=True)
        count = np.bincount(inverse)
        _, context = np.unique(own - last[longer[first]], return_inverse=True)
        total, kinds = np.bincount(context, count), np.bincount(context)
        place = np.searchsorted(own, suffix[length - 1, at])
        c = context[place]
        shared[at] = (count[place] - DISCOUNT + DISCOUNT * kinds[c] * shared[at]) / total[c]
    whole = suffix[size - 1, np.arange(n)]
    _, first, context = np.unique(whole - last, return_index=True, return_inverse=True)
    log, rest = np.zeros(n), np.zeros(len(first))
    for sign, counts in ((1, toxic), (-1, plain)):
        total = np.bincount(context, counts)
        lost = np.where(total > 0, DISCOUNT * np.bincount(context, counts > 0) / np.maximum(total, 1), 1.0)
        kept = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[context], 1)
        log += sign * np.log(kept + lost[context] * shared)
        rest += sign * np.log(lost)
    order_ = np.argsort(first)  # spans ascend
    heads = first[order_]
    keys = np.r_[_hashes(data, offsets[:-1], offsets[1:]), mixed(_hashes(data, offsets[:-1][heads], offsets[1:][heads] - 1) ^ CONTEXT)]
    return keys, np.r_[log, rest[order_]].astype(np.float32)


def _strongest(row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """By row the sum of the largest weights above 0."""
    above = np.flatnonzero(weight > 0)
    above = above[np.lexsort((-weight[above], row[above]))]
    row, weight = row[above], weight[above]
    first = np.arange(len(row)) - np.searchsorted(row, row) < TELLING
    return np.bincount(row[first], weight[first], rows)


@dataclass
class Model:
    """Where the weights lie, and the logistic function."""

    folder: str
    parts: dict[str, tuple[int, frozenset[int]]]  # of "grams" and "pairs": bits of a shard's number, and shards
    order: int = ORDER
    slope: np.ndarray | float = 1.0
    shift: float = 0.0

    def weights(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending keys are known, and their weights."""
        bits, shards = self.parts[name]
        known, (weight,) = looked_up(self.folder, name, shards, (("weight", np.float32),), keys, shard_of(keys, bits))
        return known, weight

    def word_weights(self, w: Words) -> np.ndarray:
        """Difference of the log-likelihoods of each distinct word of a step."""
        s = spelled(w.data, w.starts[w.one], w.ends[w.one], self.order)
        keys, one, inverse = np.unique(_hashes(s.data, s.starts, s.ends), return_index=True, return_inverse=True)
        known, weight = self.weights("grams", keys)
        new = np.sort(one[~known])
        heads, at = np.unique(mixed(_hashes(s.data, s.starts[new], s.ends[new] - 1) ^ CONTEXT), return_inverse=True)
        rest = np.zeros(len(s.starts))
        rest[new] = self.weights("grams", heads)[1][at]
        weight[~known] = rest[one[~known]]
        return np.bincount(s.word, weight[inverse], len(w.keys))

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: difference per word, sums of the most telling distinct words and pairs, logarithm of the number of distinct words."""
        out = np.zeros((len(column), 4))
        none, before = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for step in steps(column, RUN_CLASS, LONGEST_RUN):
            w = words_of(step)
            pair, pair_row = pairs_of(w, none if step.begins else before)
            before = w.keys[w.inverse[-1:]] if len(w.inverse) or step.begins else before
            pair, pair_own = np.unique(pair, return_inverse=True)
            weight, pair_weight = self.word_weights(w), self.weights("pairs", pair)[1]
            if step.begins and step.ends:
                own = slice(step.first, step.first + step.rows)
                out[own, 0] = sums_by_row(weight[w.inverse], w.row, step.rows) / (np.bincount(w.row, minlength=step.rows) + 1)
                one = _once(w.row, w.inverse)
                out[own, 3] = np.log1p(np.bincount(w.row[one], minlength=step.rows))
                out[own, 1] = _strongest(w.row[one], weight[w.inverse[one]], step.rows)
                told = np.flatnonzero(pair_weight[pair_own] > 0)
                one = told[_once(pair_row[told], pair_own[told])]
                out[own, 2] = _strongest(pair_row[one], pair_weight[pair_own[one]], step.rows)
                continue
            if step.begins:
                total, tokens, seen, seen_pairs, top, top_pairs = 0.0, 0, none, none, np.zeros(0), np.zeros(0)
            total, tokens = total + weight[w.inverse].sum(), tokens + len(w.inverse)
            top = np.sort(np.r_[top, weight[~np.isin(w.keys, seen) & (weight > 0)]])[-TELLING:]
            told = pair_weight > 0
            top_pairs = np.sort(np.r_[top_pairs, pair_weight[told][~np.isin(pair[told], seen_pairs)]])[-TELLING:]
            seen, seen_pairs = np.union1d(seen, w.keys), np.union1d(seen_pairs, pair[told])
            if step.ends:
                out[step.first] = total / (tokens + 1), top.sum(), top_pairs.sum(), np.log1p(len(seen))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.evidence(column) * self.slope).sum(axis=1) + self.shift, -30, 30)))


def count_model(texts: DataFrame, order: int = ORDER) -> Model:
    """The weights of the grams of rows (label, text), counted in Spark and saved in the shared folder."""
    grams = stored(gram_counts(stored(word_counts(texts), "word-counts"), order), "grams")
    shares = byte_shares(grams)

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)  # rows of equal tails stand together
        tails = table["tails"].to_numpy()
        edges, start = [*np.flatnonzero(tails[1:] != tails[:-1]) + 1, len(tails)], 0
        for at, edge in enumerate(edges):
            if edge - start < SLICE and at + 1 < len(edges):
                continue
            part = table.slice(start, edge - start)
            start = edge
            key, weight = gram_weights(part["gram"].combine_chunks(), part["toxic"].to_numpy(), part["plain"].to_numpy(), shares, order)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(weight)], ["key", "weight"])

    folder, parts = new_path(texts.sparkSession, "toxicity-model"), {}
    weights = grams.select("tails", "gram", "toxic", "plain").repartition("tails").sortWithinPartitions("tails").mapInArrow(work, "key long, weight float")
    for name, found in (("grams", weights), ("pairs", pair_weights(texts, folder))):
        found = stored(found, f"{name}-weights")
        bits = (found.count() // SHARD).bit_length()
        parts[name] = bits, frozenset(save_sorted(found, folder, name, {"weight": np.float32}, bits))
    return Model(folder, parts, order)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes of the columns of ``x`` and shift of the least weighted log loss by Newton steps, lightly held back."""
    share = ((weight * y).sum() + 1) / (weight.sum() + 2)
    if len(np.unique(y)) < 2:
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - middle) / scale, np.ones(len(x))]
    b = np.zeros(z.shape[1])

    def loss(b: np.ndarray) -> float:
        return (weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + 5e-4 * b @ b

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 1e-3 * b
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        while loss(b - step) > loss(b) and np.abs(step).max() >= 1e-8:  # a full step can overshoot where the classes are far apart
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / scale, float(b[-1] - (b[:-1] * middle / scale).sum())


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, bound: int) -> DataFrame:
    """(doc_id, fold, label, weight): of each class at most ``bound`` ids outside the held-out fold, the first by hash.

    The weight is the class's number of such ids over the number taken. An id
    that is labelled more than once has its largest label; null ids and labels don't count.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("fold", fold_of(id_col, FOLDS))
    known = rows.where(F.col("fold") != HELD_OUT).groupBy(F.col(id_col).alias("doc_id"), "fold").agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("label"))
    parts = []
    for k in (0, 1):
        own = known.where(F.col("label") == k)
        weight = max(1.0, own.count() / bound)
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("weight", F.lit(weight)))
    return parts[0].unionByName(parts[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id_col: str, sample: int) -> Model:
    """The logistic function comes from the calibration fold, under a model without it; then all labelled rows are counted, that fold's too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    chosen = stored(labelled_sample(labels, label_col, label_id_col, sample), "labelled")
    known = stored(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "fold", "label", "weight", "text"), "labelled-texts")  # at most 2 x `sample` ids
    model = count_model(known.where(F.col("fold") != CALIBRATION))

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.evidence(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(4)]], ["label", "weight", "x0", "x1", "x2", "x3"])

    seen = known.where(F.col("fold") == CALIBRATION).select("label", "weight", "text").mapInArrow(measure, "label int, weight double, x0 double, x1 double, x2 double, x3 double").toPandas()
    seen = seen.sort_values(list(seen.columns))  # sums don't depend on the order in which tasks end
    whole = count_model(known)
    whole.slope, whole.shift = fit_logistic(seen[["x0", "x1", "x2", "x3"]].to_numpy(float), seen["label"].to_numpy(float), seen["weight"].to_numpy() * np.where(seen["label"] == 1, MISS, 1.0))
    return whole


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    label_id_col: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.5,
) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only texts go into a score. Rows with crc32(id as text) mod 5 = 0 are held
    out: their labels are never read. A null text counts as empty; a text without
    words has no evidence either way. Rows that repeat come out as often; a null id counts
    as empty text for the fold. Without labels of both classes every score is the
    smoothed share of label 1. Words over 256 bytes count as several. An empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, label_id_col, sample)

    @giving_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double").select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    label_id_col: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.5,
) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns as they came; no shuffle of texts.

    Scores as in ``toxicity_scores``: a null or empty text has the score of no
    evidence; rows that repeat go or stay together; ids play no part beyond the labels.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, label_id_col, sample)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        found = pa.array(model.scores(text))
        give_back()
        return found

    return docs.where(score(text_of(text_col)) < threshold)
