"""SimHash components and packing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from sagebrook.llm import packing, simhash

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def plain_components(fps):
    """Smallest reachable id for (id, fingerprint) pairs, by all pairs."""
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 64)
    for doc, f in fps.items():
        low[find(f)] = min(low[find(f)], doc)
    return {doc: low[find(f)] for doc, f in fps.items()}


def test_fingerprints():
    for text in ("", "  ", "a", "A b", "one Two three", "É ß the THE The", "x y z " * 500, "a b c d e f g"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_components_of_documents(spark, bucket):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.simhash_components(docs, bucket=bucket).collect()
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == plain_components(fps)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_of_chains(spark, bucket):
    """Chains, stars and lone fingerprints, some in very large buckets, at every level of masks."""
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(20):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(30):
            fps.append(f)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                f ^= 1 << int(b)
    base = int(rng.integers(0, 1 << 63))
    fps += [base ^ int(rng.integers(0, 1 << 14)) for _ in range(400)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps), bucket)
    names = {r.fp: r.root for r in simhash.components(links).collect()}
    want = plain_components({f: f & (1 << 64) - 1 for f in fps})
    groups, found = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        found[names.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_ordered_chain_takes_few_rounds(spark, monkeypatch):
    """A chain whose nodes stand in order: rounds grow with the logarithm of its length."""
    made = []
    keep = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.append(name) or keep(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(600)], "a long, b long")
    roots = {r.root for r in simhash.components(links).collect()}
    assert len(roots) == 1 and made.count("parent") <= 24


def test_masks_cover_all_close_pairs():
    rng = np.random.default_rng(5)
    for level in (1, 2, 3, 4, 5):
        masks = simhash.masks(level)
        for _ in range(200):
            diff = 0
            for b in rng.choice(64, 3, replace=False):
                diff |= 1 << int(b)
            assert any(not diff & m for m in masks)


def test_large_bucket_in_blocks():
    rng = np.random.default_rng(9)
    fps = np.unique(np.uint64(1 << 60) ^ rng.integers(0, 1 << 18, 3000, dtype=np.uint64))
    a, b = simhash.bucket_links(fps, np.zeros(len(fps), np.int64))
    root = {int(x): int(y) for x, y in zip(a, b)}
    want = plain_components({int(f): int(f) for f in fps})
    found, groups = defaultdict(set), defaultdict(set)
    for f in map(int, fps):
        found[root.get(f, f)].add(f)
        groups[want[f]].add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_odd_tables(spark):
    schema = "doc_id long, text string, fp int, component_id int"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, 1, 1), (2, "", 1, 1), (2, "", 1, 1), (None, " ", 1, 1), (7, "one two three four", 1, 1), (9, "One two three four", 1, 1), (None, "something else altogether here", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 2, (None, 1): 1, (7, 7): 1, (9, 7): 1, (None, None): 1})
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 7]


def whole_ids(text):
    return packing.word_ids(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


ODD_TEXTS = ["", None, "<|endoftext|> ab", "É́x \x1cfoo bar\x1d  ſs İ K Å ﬁ 'S don't　全角 １２", "a​b \x85c Σας ΟΔΟΣ", "it's 12,345 ¡Hola! ñandú--x ½ª", "x" * 5000, "word " * 9000]


def test_word_ids_equal_the_tokenizer():
    ids = packing.word_ids(TOKENIZER)
    for text in ODD_TEXTS:
        assert np.frombuffer(ids(text or ""), "<u4").tolist() == whole_ids(text)[:-1]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    ids = packing.WordIds(TOKENIZER)
    for text in ("a b c d e f", "c d g h a", "a b i j k l m", "m a"):
        assert np.frombuffer(ids(text), "<u4").tolist() == whole_ids(text)[:-1]


def test_latin_words_share_pieces():
    """Words that differ in case or signs only are tokenised once; the pieces of every Latin letter are the tokenizer's."""
    ids = packing.WordIds(TOKENIZER)
    text = "Haus, haus. HAUS!! (haus) d'Haus"
    assert np.frombuffer(ids(text), "<u4").tolist() == whole_ids(text)[:-1]
    assert set(ids.young) == {"haus", ",", ".", "!!", "(", ")", "d", "'"}
    signs = [chr(c) for c in range(1, 0x2B0)]
    for text in ("".join(signs), " ".join(f"a{c}b {c}1 '{c}" for c in signs), *(f"x{c}Y{c}{c} 's{c}" for c in signs)):
        assert np.frombuffer(ids(text), "<u4").tolist() == whole_ids(text)[:-1]


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3], "x")], "doc_id long, text string, piece string").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "source AS piece")
    )
    texts = {r.doc_id: whole_ids(r.text) for r in docs.collect()}
    rows = packing.pack_documents(docs, TOKENIZER, pieces_per_task=100).collect()
    sequences = defaultdict(list)
    for r in rows:
        part = texts[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in rows if r.piece == 0)[3] == 2
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(v) for v in texts.values()) + len(texts[3])
    assert len(sequences) <= -(-total // 2048) * 1.1
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 65, 3000)
    bins, offsets = packing.sum_of_squares(sizes, 64)
    count, fill, choice = Counter(), {}, []
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):  # each placement makes the sum of squares smallest
        assert fill.get(b, 0) == o
        def after(gap):
            c = Counter(count)
            if gap < 64:
                c[gap] -= 1
            if gap > s:
                c[gap - s] += 1
            return sum(v * v for g, v in c.items() if g)
        options = {g: after(g) for g in [64, *(g for g, v in count.items() if v > 0 and g >= s)]}
        gap = 64 - o
        assert options[gap] == min(options.values())
        if gap < 64:
            count[gap] -= 1
        if gap > s:
            count[gap - s] += 1
        fill[b] = o + s
        choice.append(b)
    assert max(fill.values()) <= 64
