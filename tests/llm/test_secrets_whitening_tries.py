"""Secret scans, whitening and the conversation trie against plain versions."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.llm import prefix_trie, queries, secret_scan, whitening

D = "/root/testdata/sf0.001"

# --- secrets


def plain_base(text):
    """The rule as it is written: every match, then the failing ones dropped."""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(found)]


WRAPS = {
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "urlsafe": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
    "url": lambda s: quote(s, safe=""),
    "every": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{x:04x}" for c in s for x in ([ord(c)] if ord(c) < 0x10000 else [0xD800 + (ord(c) - 0x10000 >> 10), 0xDC00 + (ord(c) - 0x10000 & 0x3FF)])),
    "entities": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "hexed": lambda s: "".join(f"\\x{b:02x}" for b in s.encode()),
}


def test_base_spans_as_written():
    r = random.Random(3)
    parts = ["password", "PassWD", "seCRet", "toKen", "api_key", "APIKEY", "paſſword", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH", "Z9", "deadbeef", "0123456789", "é", "x", "/", "+", "\n", "𠮷"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert secret_scan.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("outer", sorted(WRAPS))
@pytest.mark.parametrize("inner", ["none", *sorted(WRAPS)])
def test_a_wrapped_secret_lies_in_its_wrapping(inner, outer):
    secret = "é password = Abcdef.ghi_jkl-mn 𠮷"
    wrapped = WRAPS[outer](secret if inner == "none" else WRAPS[inner](secret))
    text = f"𠮷 before {wrapped} after AKIA{'Q' * 16}"
    base, added, layers, whole = secret_scan.scan(text)
    at = text.index(wrapped)
    assert base == plain_base(text) and whole and layers > 1
    hits = [(a, b) for a, b, kind, _ in added if kind == "assign"]
    assert hits and all(at <= a < b <= at + len(wrapped) for a, b in hits)


def test_spans_are_as_narrow_as_the_escapes():
    text = "x=%20passwd%3Dqqqqwwwwrrrrtttt%20z"
    base, added, *_ = secret_scan.scan(text)
    assert [text[a:b] for a, b, *_ in added] == ["passwd%3Dqqqqwwwwrrrrtttt"] and base == []
    inner = base64.b64encode(b"pad-pad secret: 'qwertyuiopasdf' tail").decode()
    [(a, b, kind, codecs)] = secret_scan.scan(inner)[1]
    assert kind == "assign" and codecs == ("base64",) and (a, b) == (8, 44)  # whole groups of four signs
    assert b"secret: 'qwertyuiopasdf" in base64.b64decode(inner[a:b])


def test_worklist_ends_and_says_when_it_does_not_finish():
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert secret_scan.scan(bomb, budget=1_000_000)[3] is False and secret_scan.scan(bomb)[3] is True
    deep = "token=abcdefghijklmnop"
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert [s[2] for s in secret_scan.scan(deep)[1]] == ["assign"]
    assert secret_scan.scan("%25" * 50)[3] and secret_scan.scan("")[:3] == ([], [], 1)


def test_secret_query(spark):
    want = {}
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        want[r.doc_id] = plain_base(r.text or "")
    rows = queries.op11_secret_scan(spark, D).collect()
    assert len(rows) == len(want)
    for r in rows:
        base = want[r.doc_id]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in secret_scan.KINDS)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (r.added or r.spans == listed)


def test_secret_edge_rows(spark):
    long = "word " * 400_000 + WRAPS["base64"]("api_key='0123456789abcdefXYZ'")
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, long, 3)], "doc_id long, text string, spans int")
    rows = sorted(secret_scan.secret_spans(df).collect(), key=lambda r: (r.doc_id or 0, r.spans))
    assert len(rows) == 4 and [r.spans == "" for r in rows] == [True] * 3 + [False] and rows[3].added[0].start >= 2_000_000
    assert secret_scan.secret_spans(df.where("false")).count() == 0


# --- whitening


def plain_whitening(rows):
    x = np.array([np.floor(256 * np.array(v, float)) for v in rows]).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, vec = np.linalg.eigh(y.T @ y / n)
    return n, [(int(d) for d in ((n * x - s) ** 2).sum(1))], (x - s / n) @ vec[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1]


@pytest.mark.parametrize("block", [None, 1, 5])
def test_whitening_against_eigenvectors(spark, block):
    table = spark.read.parquet(f"{D}/embeddings.parquet").where("vec_id < 300" if block == 1 else "true")
    given = table.orderBy("vec_id").collect()
    n, deviations, white, e = plain_whitening([r.embedding for r in given])
    rows = whitening.whitened_embeddings(table, block=block).orderBy("vec_id", "component").collect()
    got = np.array([r.whitened for r in rows]).reshape(-1, 4)
    assert np.abs(np.abs(got) - np.abs(white[:, :4])).max() < 1e-9
    assert all(abs(abs(np.vdot(got[:, k], white[:, k])) / len(got) - 1) < 0.2 for k in range(4))
    assert {r.n for r in rows} == {n} and [r.deviation for r in rows[::4]] == list(*deviations)
    assert np.allclose([r.explained for r in rows[:4]], e[:4] / e.sum(), rtol=1e-10) and 0 <= rows[0].identity_error < 1e-9


def test_bidiagonal_form_has_the_singular_values():
    r = np.random.default_rng(2)
    shapes = {"full": r.standard_normal((90, 16)), "rank 3": r.standard_normal((90, 3)) @ r.standard_normal((3, 16)), "repeated": np.vstack([np.eye(16)] * 4), "few rows": r.standard_normal((5, 16)), "none": np.zeros((4, 16))}
    for name, x in shapes.items():
        for size in (1, 3, 8, 16):
            v, b = whitening.bidiagonalised(lambda g, x=x: x.T @ (x @ g), r.standard_normal((16, size)), 16)
            want = np.linalg.svd(x, compute_uv=False)
            got = np.zeros(len(want))
            found = np.linalg.svd(b, compute_uv=False)[: len(want)]
            got[: len(found)] = found
            assert np.abs(v.T @ v - np.eye(16)).max() < 1e-12 and np.abs(got - want).max() < 1e-8 * max(want[0], 1), (name, size)
            upper = np.abs(np.tril(b, -1)).max(initial=0)
            assert size > 1 or upper < 1e-9  # bidiagonal indeed


def test_whitening_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(n, [float((n * k * 37) % 11), float(n % 5), float(n % 3)]) for k, n in enumerate(range(1, 40), 1)]
    bad = [(None, None), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [0.0, inf, 0.0]), (10, [1.0, 2.0]), (11, [])]
    df = spark.createDataFrame([*good, *good, (None, good[0][1]), *bad], "vec_id long, embedding array<float>").withColumn("component", F.lit("x"))
    rows = whitening.whitened_embeddings(df).collect()
    n, _, white, e = plain_whitening([v for _, v in good])
    assert len(rows) == 79 * 3 and {r.n for r in rows} == {n} and {r.component for r in rows} == {1, 2, 3}
    one = {r.vec_id: r.whitened for r in rows if r.component == 1}
    assert max(abs(abs(one[i]) - abs(white[k, 0])) for k, (i, _) in enumerate(good)) < 1e-9 and one[None] == one[1]
    assert whitening.whitened_embeddings(df.where("false")).count() == 0
    assert whitening.whitened_embeddings(df.where("vec_id = 1")).count() == 0  # one distinct vector has no variance
    large = spark.createDataFrame([(1, [1e30, -1e30]), (2, [3e15, 1.0]), (3, [-3e15, 2.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitened_embeddings(large).collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in rows)


# --- trie


def plain_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    new = {}
    for c, v in convs.items():
        v.sort()
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = [x[2:] for x in convs.get(c - c % 20, [])[:h]] + [x[2:] for x in v[h:]]
    nodes, kids, memo, out = {}, {}, {}, []
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        m, k = nodes[p], kids.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        memo[p] = (sum(memo[q][0] for q in k) or 1, sum(memo[q][1] for q in k) + (len(m) - 1) * words)
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(k), *memo[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_trie_query(spark):
    rows = spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert plain(queries.op13_prefix_trie(spark, D).collect()) == plain_trie(rows)


@pytest.mark.parametrize("container", [1, 2, 512])
def test_trie_of_shared_and_odd_conversations(spark, monkeypatch, container):
    """Long shared beginnings, prefixes of one another, many copies, missing first conversations, nulls; containers that burst at every size."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    r = random.Random(container)
    rows = [(c, t, r.choice("ua"), r.choice(["x", "x y", "z\t z z"])) for c in range(1, 70) for t in range(r.randrange(1, 6))]
    rows += [(c, t, "s", f"same {t}") for c in range(100, 170) for t in range(c % 9 + 1)]
    rows += [(c, t, "s", "copy") for c in range(201, 320) for t in range(5)]
    rows += [(-45, 1, "u", "below"), (-40, 2, "u", "below"), (400, None, None, None), (400, 1, "u", ""), (400, 0, "u", "x"), (None, 1, "u", "x"), (421, 0, "u", "only"), (423, 0, "u", "only"), (400, 1, "u", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).repartition(5)
    assert plain(prefix_trie.conversation_trie(df, container=container).collect()) == plain_trie(rows)


def test_trie_many_heads_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_HEADS", 0)
    rows = [(c, t, "u", f"{c % 7 if t else 0} {c // 3 if t > 2 else t}") for c in range(300) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert plain(prefix_trie.conversation_trie(df, container=5).collect()) == plain_trie(rows)


def test_trie_empty_and_long(spark):
    df = spark.createDataFrame([(1, t, "u", str(t)) for t in range(5000)] + [(2, t, "u", str(t)) for t in range(4000)], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(df.where("false")).count() == 0
    rows = prefix_trie.conversation_trie(df).collect()
    assert max(r.depth for r in rows) >= 4997 and sum(r.n_children == 0 for r in rows) == 2
