"""The trained operators: brute force where it exists, else held-out accuracy and odd tables."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import tokens as tokens_module
from sagebrook.llm.common import new_path
from sagebrook.llm import bpe, language_id, language_model, quality_model, quality_rules, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "/root/testdata/sf0.01/documents.parquet"
ODD = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "some words here"), (5, "x" * 300_000), (6, "many words " * 30_000), (7, "a\x00b é ü 漢字 🙂")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1.0) for i, t in ODD], "doc_id long, text string, lang string, source string, score string, bucket double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_round_trip(spark, odd):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in bpe.bpe_round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in ODD:
        ids = enc.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.bpe_encode(odd, RANKS, public_tokenizers.PATTERN)
    back = collections.Counter((r.doc_id, bytes(r.bytes)) for r in bpe.bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert back == collections.Counter((i, (t or "").encode()) for i, t in ODD)


def test_bpe_safe_parts():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    letters = list("ab1 \n\t .,'s\x85　\x1cé")
    for _ in range(300):
        text = "".join(rng.choice(letters, int(rng.integers(1, 80))))
        whole = enc.encode_ordinary(text)
        parts = [enc._encode_single_piece(p) if one else enc.encode_ordinary(p) for p, one in bpe.safe_parts(text, 7)]
        assert sum(parts, []) == whole
    for gap in (bpe.LONG_RUN, bpe.LONG_RUN + 1, 3000):
        for space in (" ", "\n", "\t "):
            for text in (f"a{space * gap}b", f"a{space * gap}", f"{space * gap}'s x", f"a{space * gap}\nb"):
                assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    assert enc.decode(bpe.encode_text(enc, " " * 1_000_000 + "a")) == " " * 1_000_000 + "a"


def base_of(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, inside = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_base(spark, odd):
    for docs in (spark.read.parquet(DOCS), odd):
        got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
        for r in docs.collect():
            want, row = base_of(r.text), got[r.doc_id]
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
            assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_quality_rules_adapt(spark, labels):
    docs = spark.read.parquet(DOCS)
    kept = quality_rules.quality_rules(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in kept.collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_sketch_quantiles_merge(spark):
    """Quartiles of merged sketches lie within the accuracy of the exact ones."""
    rng = np.random.default_rng(4)
    values = np.exp(rng.normal(3, 1, 4000))
    rows = [(["a", "b"][i % 2], "s", int(v * 10), 10, 0, 0, 0, 0, 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lang string, source string, word_chars long, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_lines long")
    sketched = quality_rules.sketch(df)
    got = quality_rules.quartiles(sketched, []).where("measure = 'mean_word'").first()
    exact = np.sort([10 * r[2] / 10 for r in rows])
    assert abs(got.q1 / exact[999] - 1) < 0.03 and abs(got.q3 / exact[2999] - 1) < 0.03 and got["rows"] == 4000


def test_language_model(spark):
    docs = spark.read.parquet(DOCS)
    rows = {r.doc_id: r for r in language_model.language_model_scores(docs, shard_tokens=1 << 15).collect()}
    texts = {r.doc_id: words_of("".join(c.lower() if c < "\x80" else c for c in r.text)) for r in docs.collect()}
    uni, pairs, trained = collections.Counter(), collections.Counter(), 0
    for k, w in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            w = ["<s>", *w, "</s>"]
            uni.update(w[1:])
            pairs.update(zip(w, w[1:]))
            trained += 1
    n, v = sum(uni.values()), len(uni)
    before = collections.Counter(w for _, w in pairs)
    of, lower_of = collections.Counter(pairs.values()), collections.Counter(before.values())
    d, e = (language_model.discounts(*(c[k] for k in (1, 2, 3, 4))) for c in (of, lower_of))
    cut = lambda c, x: c - x[min(c, 3) - 1] if c else 0
    contexts, total = collections.defaultdict(lambda: [0, 0, 0]), sum(before.values())
    for (u, _), c in pairs.items():
        contexts[u][min(c, 3) - 1] += 1
    rest = sum(e[min(c, 3) - 1] for c in before.values()) / total
    heads = dict(uni) | {"<s>": trained}
    for k, w in texts.items():
        base = score = known = 0
        w = ["<s>", *w, "</s>"]
        for u, x in zip(w, w[1:]):
            base += math.log10((uni[x] + 1) / (n + v + 1))
            known += uni[x] > 0
            lower = (cut(before[x], e) / total if x in uni else 0) + rest / (v + 1)
            p = cut(pairs[u, x], d) / heads[u] + sum(a * b for a, b in zip(d, contexts[u])) / heads[u] * lower if heads.get(u) else lower
            score += math.log10(p)
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(w) - 1, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_tables_are_scored(spark, odd, labels):
    scored = {
        "lm": language_model.language_model_scores(odd), "toxic": toxicity.toxicity_scores(odd, labels), "quality": quality_model.quality_scores(odd, labels),
        "lang": language_id.document_languages(odd),
    }
    for name, df in scored.items():
        assert collections.Counter(r.doc_id for r in df.collect()) == collections.Counter(i for i, _ in ODD), name
    none = odd.limit(0)
    assert language_model.language_model_scores(none).count() == 0 and toxicity.toxicity_scores(none, labels.limit(0)).count() == 0
    assert quality_model.quality_scores(none, labels.limit(0)).count() == 0 and language_id.document_languages(none).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns and language_id.drop_unidentified(odd).columns == odd.columns


def held_out_auc(df, labels, label):
    rows = df.where("held_out").join(labels, "doc_id").select("score", label).collect()
    y, p = np.array([r[label] for r in rows]), np.array([r["score"] for r in rows])
    rank = np.argsort(np.argsort(p))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    df = quality_model.quality_scores(docs, labels)
    assert held_out_auc(df, labels, "quality") > 0.95
    assert df.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.3)").count() == 0


def test_held_out_labels_are_never_read(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r.doc_id, r.score) for r in quality_model.quality_scores(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_finds_inflected_words(spark):
    """Words that only toxic texts hold, in forms that no training text has."""
    rng = np.random.default_rng(8)
    parts = ["an", "er", "tion", "the", "re", "on", "st", "ing", "ha"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 4))))
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        text = [word() for _ in range(120)]
        if toxic:
            for k in range(3):
                text[20 * k] = "vexq" + word()
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    df = toxicity.toxicity_scores(docs, labels)
    assert held_out_auc(df, labels, "toxic") > 0.99
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    wrong = sum((i in kept) == bool(t) for i, t in marks)
    assert wrong < 15


def test_toxicity_finds_long_stems_and_pairs_of_ordinary_words(spark):
    """A long stem of common syllables in inflected forms, and a pair of words that ordinary texts hold apart."""
    rng = np.random.default_rng(9)
    parts = ["ach", "lich", "keit", "ten", "der", "ung", "ein", "gen", "sch"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 5))))
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        text = [w for w in (word() for _ in range(150)) if not w.startswith("achlichkeit")]
        text[10:10], text[60:60] = ["dinner"], ["bring"]
        if toxic and i % 2:
            text[30:30], text[90:90] = ["achlichkeit" + word()], ["achlichkeit" + word()]
        elif toxic:
            text[30:30] = ["bring", "dinner"]
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    held = toxicity.toxicity_scores(docs, labels).where("held_out").collect()
    for kind in (0, 1):
        found = [r.predicted for r in held if r.doc_id % 5 == 0 and r.doc_id % 2 == kind]
        assert len(found) > 10 and sum(found) > 0.9 * len(found)
    assert sum(r.predicted for r in held if r.doc_id % 5) < 5


def test_toxicity_recall_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = held.groupBy("lang").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).collect()
    assert len(rows) == 4 and all(r.recall > 0.9 and r.wrong < 0.01 for r in rows)
    for lang in ("en", "de", "fr", "es"):
        assert held_out_auc(held.where(F.col("lang") == lang).select("doc_id", "held_out", "score"), labels, "toxic") > 0.95


def plain_kneser_ney(texts, order):
    """word -> log P(toxic) - log P(ordinary), spelled out: counts of either class at the longest grams, shared continuation counts below."""
    holds = collections.defaultdict(lambda: [0, 0])
    for label, text in texts:
        for word in {w for w in re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())}:
            holds[word][label] += 1
    top, strings = collections.defaultdict(lambda: [0, 0]), set()
    for word, n in holds.items():
        b = f" {word} ".encode()
        for i in range(1, len(b)):
            strings |= {b[max(0, k) : i + 1] for k in range(i + 1 - order, i + 1)}
            for k in (0, 1):
                top[b[max(0, i + 1 - order) : i + 1]][k] += n[k]
    follows = collections.Counter(g[1:] for g in strings if len(g) > 1)
    after = collections.defaultdict(dict)
    for g, n in follows.items():
        after[g[:-1]][g] = n

    def shared(g):
        if not g:
            return 1 / 256
        seen = after.get(g[:-1])
        if not seen:
            return shared(g[1:])
        return (max(seen.get(g, 0) - 0.75, 0) + 0.75 * len(seen) * shared(g[1:])) / sum(seen.values())

    def ratio(word):
        b, total = f" {word} ".encode(), 0.0
        for i in range(1, len(b)):
            g = b[max(0, i + 1 - order) : i + 1]
            own = {h: n for h, n in top.items() if h[:-1] == g[:-1]}
            for k, sign in ((1, 1), (0, -1)):
                n = sum(c[k] for c in own.values())
                p = shared(g[1:])
                if n:
                    p = (max(top[g][k] - 0.75 if g in own else 0, 0) + 0.75 * sum(c[k] > 0 for c in own.values()) * p) / n
                total += sign * math.log(p)
        return total

    return ratio


@pytest.mark.parametrize("order", [4, 6])
def test_toxicity_against_plain_kneser_ney(spark, order):
    rng = np.random.default_rng(4)
    parts = ["an", "er", "ti", "the", "r\u00e9", "st", "ingen", "ha"]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 5))))
    texts = [(int(i % 3 == 0), " ".join([*(word() for _ in range(12)), "vexing" * (i % 3 == 0), "Vexed," * (i % 9 == 0)])) for i in range(60)]
    model = toxicity.count_model(spark.createDataFrame(texts, "label int, text string"), order)
    ratio = plain_kneser_ney(texts, order)
    asked = [*{word() for _ in range(40)}, "vexing", "vexed", "vexation", "q", "thevex"]
    got = model.evidence(pa.array(asked))[:, 0] * 2
    assert np.allclose(got, [ratio(w) for w in asked], atol=1e-4)


def test_toxicity_pairs_and_evidence_against_plain_counts(spark):
    """Weights of pairs by the rule, and all four parts of a text's evidence from plain dictionaries."""
    rng = np.random.default_rng(8)
    word = lambda: str(rng.choice(["an", "er", "tist", "the", "r\u00e9", "bring", "dinner"]))
    texts = [(int(i % 4 == 0), " ".join(word() for _ in range(int(rng.integers(1, 9))))) for i in range(80)]
    split = lambda text: re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
    holds = [collections.Counter(), collections.Counter()]
    for label, text in texts:
        w = split(text)
        holds[label].update(set(zip(w, w[1:])))
    n = [sum(h.values()) for h in holds]

    def weight(pair):
        rest = 0.75 if holds[0][pair] else 0.375
        p = [(max(holds[k][pair] - 0.75, 0) + rest) / n[k] for k in (0, 1)]
        return math.log(p[1] / p[0]) if holds[1][pair] else 0.0

    df = spark.createDataFrame(texts, "label int, text string")
    got = sorted(r.weight for r in toxicity.pair_weights(df, new_path(spark, "pairs")).collect())
    assert np.allclose(got, sorted(w for w in map(weight, holds[1]) if w > 0), atol=1e-5)
    model, ratio = toxicity.count_model(df, 5), plain_kneser_ney(texts, 5)
    asked = [t for _, t in texts[:30]] + ["", "bring dinner bring dinner", "new words the end"]
    for text, found in zip(asked, model.evidence(pa.array(asked))):
        w = split(text)
        ratios = {x: ratio(x) for x in w}
        top = lambda values: sum(sorted((v for v in values if v > 0), reverse=True)[:3])
        want = sum(ratios[x] for x in w) / (len(w) + 1), top(ratios.values()), top(map(weight, set(zip(w, w[1:])))), math.log1p(len(ratios))
        assert np.allclose(found, want, atol=1e-3)


def test_long_texts_give_what_short_steps_give(spark, monkeypatch):
    """Texts cut into many parts have the evidence, features, likelihoods and counts of whole ones."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9)))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n)) + "  " + "7" * 700 + "\n" + "z" * 900 + ", end"
    texts = pa.array([text(3000), "", text(5), text(2500), None, "one"])
    docs = spark.createDataFrame([(i, t or "", int(i % 2 == 0)) for i, t in enumerate(texts.to_pylist())], "doc_id long, text string, label int")
    model = toxicity.count_model(docs)
    vectors = rng.normal(size=(quality_model.BUCKETS, quality_model.DIMS)).astype(np.float32)

    def measured():
        tokens = [(first, t.tolist(), b.tolist()) for first, t, b, *_ in language_model._sequences(texts)]
        joined = {f: (sum((t for g, t, _ in tokens if g == f), []), sum((b for g, _, b in tokens if g == f), [])) for f in (0, 3)}
        grams = [(first, np.bincount(b, minlength=language_id.BUCKETS)) for first, b, *_ in language_id._trigrams(texts)]
        return model.evidence(texts), quality_model.pooled(texts, vectors), joined, {f: sum(n for g, n in grams if g == f) for f in (0, 3)}

    whole = measured()
    alone = {k: np.concatenate([x for first, x, *_ in language_model._sequences(pa.array([texts[k].as_py()]))]).tolist() for k in (0, 3)}
    for module in (toxicity, quality_model, language_model):
        monkeypatch.setattr(module, "steps", functools.partial(tokens_module.steps, step=512))
    monkeypatch.setattr(language_id, "STEP", 512)
    parts = measured()
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1], atol=1e-5)
    assert parts[2][0][0] == alone[0] and parts[2][3][0] == alone[3]
    assert all(parts[2][k][1][1:] == alone[k][:-1] for k in (0, 3))
    single = {k: sum(np.bincount(b, minlength=language_id.BUCKETS) for _, b, *_ in language_id._trigrams(pa.array([texts[k].as_py()]))) for k in (0, 3)}
    assert all((parts[3][k] == single[k]).all() for k in (0, 3))


def test_languages_by_text_alone(spark):
    """Rows of the fold that the trigrams aren't fitted on, told by their text without their declaration."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language_id.document_languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where((language_id.fold_of("doc_id", 5) == 0) & (F.col("n_chars") > 100)).collect()
    assert len(rows) > 1000 and sum(r.text_language == r.lang for r in rows) > 0.97 * len(rows)


def test_languages_of_many_subtags(spark):
    """Three-letter subtags, regions and more languages than one table holds."""
    rng = np.random.default_rng(5)
    names = ["fil", "fi", "gsw", *(a + b for a in "abcdefg" for b in "uvwxyz")]
    rows = []
    for k, name in enumerate(names):
        letters = [chr(97 + (k * 7 + j * (5 if k < 26 else 3)) % 26) for j in range(5)]
        for i in range(30):
            text = " ".join("".join(rng.choice(letters, 5)) for _ in range(60))
            rows.append((k * 100 + i, text, name if i % 2 else name.upper() + "-XX", f"h{i % 3}.{name}"))
    rows += [(10**6, "abc", "english", "a.b"), (10**6 + 1, "abc", "zz", None)]
    found = language_id.document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(found) == len(rows)
    right = [r.language == names[r.doc_id // 100] for r in found if r.doc_id < 10**6]
    assert sum(right) > 0.99 * len(right)


def test_languages(spark):
    docs = spark.read.parquet(DOCS)
    rows = language_id.document_languages(docs).collect()
    assert len(rows) == docs.count() and sum(r.language == r.declared for r in rows) > 0.99 * len(rows) and sum(r.kept for r in rows) > 0.99 * len(rows)
    pages = language_id.page_languages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), docs).collect()
    assert sum(r.language == r.declared for r in pages) > 0.98 * len(pages)


def test_evidence_without_text_comes_from_host_and_declaration(spark):
    docs = spark.read.parquet(DOCS)
    extra = spark.createDataFrame([(10**7, "", None, "only-french"), (10**7 + 1, "", "de", None)], "doc_id long, text string, lang string, source string")
    french = docs.where("lang = 'fr'").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "'only-french' AS source")
    rows = {r.doc_id: r for r in language_id.document_languages(docs.select("doc_id", "text", "lang", "source").unionByName(french).unionByName(extra)).collect()}
    assert rows[10**7].language == "fr" and rows[10**7 + 1].language == "de"


@pytest.mark.parametrize("rows", [1, 15])
def test_rare_declared_languages_stay(spark, rows):
    """A language that 15 documents declare, or one that no fitted row does, is a class of its own; its documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    shifted = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) if rows == 1 else F.lit(True)
    rare = docs.where(F.length("text") > 300).where(held).orderBy("doc_id").limit(rows).select((F.col("doc_id") if rows == 1 else F.col("doc_id") + 100_000).alias("doc_id"), shifted.alias("text"), F.lit("ga").alias("lang"), F.lit("src0").alias("source"))
    every = docs.join(rare.select("doc_id"), "doc_id", "left_anti").unionByName(rare)
    kept = language_id.drop_unidentified(every)
    assert kept.join(rare.select("doc_id"), "doc_id").count() == rows
    found = language_id.document_languages(every).join(rare.select("doc_id"), "doc_id")
    assert {r.language for r in found.collect()} == {"ga"}
    assert kept.count() >= 0.97 * every.where(F.length("text") > 300).count()
