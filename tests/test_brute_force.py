"""Queries that SQL can't express, against plain Python over the whole of the smallest tables."""

import unicodedata

from pyspark.sql import functions as F

from sagebrook import plans
from sagebrook.operators import match

D = "/root/testdata/sf0.001"


def key(name):
    return "".join(c for c in unicodedata.normalize("NFKC", name or "") if c not in " 　・･／")


def ratio(x, y):
    """200 x longest common subsequence / total length, by the plain table."""
    x, y = (" ".join(sorted(t.split())) for t in (x, y))
    if not x and not y:
        return 100.0
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(x) + len(y))


def parts(spark):
    """(known, items) by block: known (key, unit), items (input position, key), as the matching queries disturb the names."""
    known, items = {}, {}
    for r in spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_brand", "p_name").orderBy("p_partkey").collect():
        odd = (r.p_name, r.p_name[:-1], r.p_name + "x")[r.p_partkey % 3]
        known.setdefault(r.p_brand, []).append((key(r.p_name), r.p_partkey))
        items.setdefault(r.p_brand, []).append((r.p_partkey, key(odd)))
    return known, items


def best(asked, units):
    """(unit, score) of the first of the best, from 75; None if there is none."""
    first = {}
    for k, unit in units:
        first.setdefault(k, unit)
    scored = [(-ratio(asked, k), unit) for k, unit in first.items()]
    score, unit = min(scored)
    return (unit, -score) if -score >= 75 else None


def test_fuzzy_match(spark):
    known, items = parts(spark)
    want = set()
    for block, asked in items.items():
        for pos, k in asked:
            if found := best(k, known[block]):
                want.add((block, pos, found[0], round(found[1], 6), "fuzzy" if found[1] >= 90 else "llm"))
    got = plans.queries()["fuzzy_match"](spark, D).collect()
    assert len(got) == len(want) and {(r.block, r.input_pos, r.unit_id, round(r.score, 6), r.method) for r in got} == want


def test_sub_unit_match(spark):
    rows = spark.read.parquet(f"{D}/part.parquet").orderBy("p_partkey").collect()
    known, want = {}, set()
    for r in rows:
        known.setdefault((r.p_brand, r.p_type), []).append((key(r.p_name) + "/" + key(f"size {r.p_size}"), r.p_partkey))
    for r in rows:
        k = r.p_partkey % 3
        asked = key(r.p_name[1:] if k == 1 else r.p_name) + "/" + key(f"size{r.p_size}"[1 if k == 2 else 0 :])
        if found := best(asked, known[r.p_brand, r.p_type]):
            want.add((r.p_brand, r.p_partkey, found[0], round(found[1], 6)))
    got = plans.queries()["sub_unit_match"](spark, D).collect()
    assert len(got) == len(want) and {(r.block, r.input_pos, r.unit_id, round(r.score, 6)) for r in got} == want


def test_candidates_miss_no_pair(spark):
    """Random names over few and many letters, with blanks, repeats, far letters and empty ones: all pairs that score are candidates."""
    random = __import__("random").Random(5)
    names = {"", "a", "b c", "𠮷野 家", "ｱ"} | {"".join(random.choice("ab c" if n % 2 else "abcdefghijkl 部学") for _ in range(random.randrange(1, 14))) for n in range(120)}
    left, right = sorted(names)[::2], sorted(names)[1::2] + [""]
    a, b = (spark.createDataFrame([(1, x) for x in xs], f"block int, {c} string") for c, xs in (("a", left), ("b", right)))
    for least in (75.0, 60.0, 100.0):
        got = [(r.a, r.b) for r in match.candidates(a, b, ["block"], least).collect()]
        assert len(got) == len(set(got)) and {(x, y) for x in left for y in right if ratio(x, y) >= least} <= set(got)
    edit = {(r.a, r.b) for r in match.candidates(a, b, ["block"], 75.0, sql=True).collect()}
    assert {(x, y) for x in left for y in right if x and y and 100 * (max(len(x), len(y)) - distance(x, y)) >= 75 * max(len(x), len(y))} <= edit


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_few_candidates(spark):
    """Of all pairs that a block could make under a twentieth are compared."""
    from sagebrook.plans import queries_text as Q

    d = "/root/testdata/sf0.1"
    items, known = match.keyed(Q._items(spark, d)), match.keyed(Q._known(spark, d))
    a, b = items.select("block", F.col("name_key").alias("a")).distinct(), known.select("block", F.col("name_key").alias("b")).distinct()
    product = a.groupBy("block").count().join(b.groupBy("block").agg(F.count("*").alias("n")), "block").agg(F.sum(F.col("count") * F.col("n"))).head()[0]
    assert match.candidates(a, b, ["block"]).count() < product / 20


def test_match_resolved(spark):
    known, items = parts(spark)
    want = {}
    for block, asked in items.items():
        for pos, k in sorted(asked):
            exact = [(unit, 100.0, "exact") for name, unit in known[block] if name == k]
            found = None if exact else best(k, known[block])
            if found:
                exact = [(*found, "fuzzy" if found[1] >= 90 else "llm")]
            for unit, score, method in exact:  # a unit goes to the first item that asks for it
                want.setdefault((block, unit), (pos, round(score, 6), method))
    got = plans.queries()["match_resolved"](spark, D).collect()
    assert len(got) == len(want) and {(r.block, r.unit_id): (r.input_pos, round(r.score, 6), r.method) for r in got} == want
