"""Answering a table of queries from a table of chunks.

Queries come as a table, so that scoring is one distributed job for all of
them. A query table is broadcast only after a check of its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import columns as C
from .common import BROADCAST_ROWS, cut, small, top_per_key, work_path

K1, B, EPSILON = 1.5, 0.75, 0.25
#: So many query vectors are held by each task; of more, blocks of so many meet tiles of so many chunks.
MATRIX_QUERIES, TILE_CHUNKS = 10_000, 50_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "vector",
                 equal: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks nearest to each query, exact.

    Each query meets every chunk that passes its filters (pairs of query and
    chunk column that must be equal): a stated query set against all rows. Up to ``MATRIX_QUERIES``
    queries (read when the plan is built) go to the tasks as matrices, which multiply the chunks' vectors in slices and pass on what can
    be among a task's k best. More queries are dealt to blocks and the chunks to tiles (both counted when the plan is built); a task
    multiplies one block by one tile and passes on the tile's k best of each query. Scores are rounded to 6
    digits before ranking; ties go by id. Zero vectors, vectors with nulls or NaN and vectors of
    other lengths have no score and come last.
    """
    whole = F.col(vector).cast("array<double>")
    q = queries.select(query_id, whole.alias("_q"), *[F.col(a).alias(f"_f{n}") for n, (a, _) in enumerate(equal)])
    c = chunks.select(chunk_id, whole.alias("_c"), *[F.col(b).alias(f"_g{n}") for n, (_, b) in enumerate(equal)])
    asked = q.limit(MATRIX_QUERIES + 1).collect()
    if len(asked) <= MATRIX_QUERIES:
        names = q.sparkSession.createDataFrame([(n, r[0]) for n, r in enumerate(asked)], StructType([StructField("_n", IntegerType()), q.schema[query_id]]))
        found = _nearest([(r[1], tuple(r[2:])) for r in asked], c, k).join(F.broadcast(names), "_n")  # at most MATRIX_QUERIES rows
    else:
        found = _tiled(q, c, k)
    return top_per_key(found.select(query_id, chunk_id, F.round("score", 6).alias("score")), [query_id], k, F.desc("score"), F.col(chunk_id), rank="rank")


def _matrices(asked: Sequence[tuple[Sequence[float] | None, tuple]]) -> list[tuple]:
    """(values, places, vectors, lengths) of the queries (vector, values) with the same values and width."""
    grouped: dict[tuple, list[int]] = {}
    for n, (v, values) in enumerate(asked):
        if None not in values:
            grouped.setdefault((values, len(v or ())), []).append(n)
    out = []
    for (values, width), ns in grouped.items():
        m = np.array([asked[n][0] or () for n in ns], float).reshape(len(ns), width)
        out.append((values, np.array(ns, np.int32), m, np.sqrt((m * m).sum(1))))
    return out


class _Best:
    """The k best scores of each query so far, over chunks that come in parts (id, vector, values ...)."""

    def __init__(self, matrices: list[tuple], k: int):
        self.matrices, self.k = matrices, k
        self.best = [np.full((len(ns), k), -np.inf) for _, ns, _, _ in matrices]
        self.codes = {values: n for n, values in enumerate({m[0]: None for m in matrices})}
        self.rows = max(1, 4_000_000 // max(1, sum(len(m[1]) for m in matrices)))

    def add(self, batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """(places of queries, chunk ids, scores) of what can be among the k best, slice by slice."""
        for at in range(0, batch.num_rows, self.rows):
            part = batch.slice(at, self.rows)
            values = zip(*[part.column(i).to_pylist() for i in range(2, part.num_columns)]) if part.num_columns > 2 else [()] * part.num_rows
            code = np.fromiter((self.codes.get(v, -1) for v in values), np.int64, part.num_rows)
            vectors = part.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
            for g, (wanted, ns, matrix, lengths) in enumerate(self.matrices):
                own = np.flatnonzero(code == self.codes[wanted])
                score = np.full((len(ns), len(own)), -np.inf)
                same = np.flatnonzero(sizes[own] == matrix.shape[1])
                m = pc.list_flatten(vectors.take(pa.array(own[same]))).to_numpy(zero_copy_only=False).reshape(len(same), matrix.shape[1])
                with np.errstate(all="ignore"):
                    s = matrix @ m.T / (lengths[:, None] * np.sqrt((m * m).sum(1)))
                score[:, same] = np.where(np.isfinite(s), s, -np.inf)
                self.best[g] = np.sort(np.concatenate([self.best[g], score], 1), 1)[:, -self.k :]
                i, j = np.nonzero(score >= self.best[g][:, :1] - 2e-6)  # what is lower is lower after rounding, too
                out = score[i, j]
                yield ns[i], part.column(0).take(pa.array(own[j])), pa.array(out, mask=np.isinf(out))


def _nearest(asked: Sequence[tuple[Sequence[float] | None, tuple]], chunks: DataFrame, k: int) -> DataFrame:
    """(_n, chunk id, score): for the n-th of ``asked`` (vector, values) all chunks (id, vector, values) with these values that can be among its k best."""
    shared = chunks.sparkSession.sparkContext.broadcast(_matrices(asked))
    name, kind = chunks.columns[0], chunks.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value, k)
        for batch in batches:
            for n, ids, scores in best.add(batch):
                yield pa.RecordBatch.from_arrays([pa.array(n), ids, scores], ["_n", name, "score"])

    return chunks.mapInArrow(work, f"_n int, `{name}` {kind}, score double")


def _tiled(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query id, chunk id, score) as ``_nearest``, for any number of queries: every block of queries meets every tile of chunks in a task of its own."""
    blocks = -(-queries.count() // MATRIX_QUERIES)
    tiles = max(1, -(-chunks.count() // TILE_CHUNKS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda df, n, name: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int").alias(name)
    left = queries.select("*", own(queries, blocks, "_block"), every(tiles, "_tile"))
    right = chunks.select("*", own(chunks, tiles, "_tile"), every(blocks, "_block"))
    names = queries.columns[0], chunks.columns[0]
    kinds = queries.schema[0].dataType.simpleString(), chunks.schema[0].dataType.simpleString()
    width = len(queries.columns)

    def work(asked: pa.Table, tile: pa.Table) -> pa.Table:
        rows = list(zip(asked.column(1).to_pylist(), zip(*[asked.column(i).to_pylist() for i in range(2, width)]) if width > 2 else [()] * asked.num_rows))
        ids = asked.column(0).combine_chunks()
        found = [pa.table([ids.take(pa.array(n)), c, s], [*names, "score"]) for n, c, s in _Best(_matrices(rows), k).add(tile.select(range(width)).combine_chunks())]
        none = pa.table([ids.slice(0, 0), tile.column(0).slice(0, 0), pa.array([], pa.float64())], [*names, "score"])
        return pa.concat_tables([none, *found])

    pairs = left.groupBy("_block", "_tile").cogroup(right.groupBy("_block", "_tile"))
    return pairs.applyInArrow(work, f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, score double")


#: Vectors that clusters are fitted on, at most, and rounds of the fit.
FIT_VECTORS, FIT_ROUNDS = 20_000, 8


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have this width, a length and finite entries only, and these vectors at length 1."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width)
    m = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)
    size = np.sqrt((m * m).sum(1))
    good = np.isfinite(size) & (size > 0)
    return at[good], m[good] / size[good, None]


def index_vectors(chunks: DataFrame, path: str, clusters: int = 64, chunk_id: str = "chunk_id", vector: str = "vector") -> None:
    """Stores ``chunks`` (chunk_id, vector) by the nearest of ``clusters`` centres, with each cluster's size and radius (the widest angle to its centre).

    The centres are fitted on the first ``FIT_VECTORS`` chunks by hash; every chunk is stored. Chunks whose vector is null, zero, not finite or of
    another length than the most of that sample lie in cluster -1, which no search reads.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("vector"))
    sample = rows.where(F.size("vector") > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT_VECTORS).select("vector").toArrow()["vector"].combine_chunks()
    lengths = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    width = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    m = _unit(sample, width)[1] if width else np.zeros((0, 0))
    centres = np.unique(m, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(clusters, len(centres))).astype(int)] if len(centres) else np.zeros((1, width))
    for _ in range(FIT_ROUNDS):
        own = (m @ centres.T).argmax(1) if len(m) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        size = np.sqrt((sums * sums).sum(1))[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            at, unit = _unit(batch.column(1), width)
            if len(at):
                near = unit @ centres.T
                cluster[at] = near.argmax(1)
                angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], ["chunk_id", "vector", "cluster", "angle"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    schema = f"chunk_id {kind}, vector array<double>, cluster int, angle double"
    rows.mapInArrow(work, schema).write.partitionBy("cluster").parquet(f"{path}/chunks")
    rows.select("chunk_id").limit(0).coalesce(1).write.parquet(f"{path}/ids")  # the type of the ids, also of an empty index
    sizes = spark.read.schema(schema).parquet(f"{path}/chunks").where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    fitted = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cluster int, centre array<double>")
    sizes.join(fitted, "cluster").coalesce(1).write.parquet(f"{path}/clusters")  # a row for each cluster


def vector_search(queries: DataFrame, path: str, k: int, first: int = 4, query_id: str = "query_id", vector: str = "vector", chunk_id: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score, rank) from an index of ``index_vectors``, exact.

    A query first meets its ``first`` nearest clusters. No chunk of another cluster is nearer than the angle to its centre less its
    radius; so the query goes on only to the clusters that can reach the k-th best score so far. Clusters are split into tiles and queries into
    blocks as in ``vector_top_k``. What pruning saves depends on how well the vectors cluster.
    """
    spark = queries.sparkSession
    kept = sorted(spark.read.parquet(f"{path}/clusters").collect())  # a row for each cluster
    kind = spark.read.parquet(f"{path}/ids").schema["chunk_id"].dataType.simpleString()
    stored = spark.read.schema(f"chunk_id {kind}, vector array<double>, cluster int").parquet(f"{path}/chunks").where("cluster >= 0").select(F.col("chunk_id").alias(chunk_id), "vector", "cluster")
    own = queries.select(query_id, F.col(vector).cast("array<double>").alias("vector"))
    kinds = own.schema[0].dataType.simpleString(), stored.schema[0].dataType.simpleString()
    if not kept:
        return spark.createDataFrame([], f"`{query_id}` {kinds[0]}, `{chunk_id}` {kinds[1]}, score double, rank int")
    numbers, tiles = np.array([r["cluster"] for r in kept], np.int32), np.array([-(-r["n"] // TILE_CHUNKS) for r in kept])
    radii, centres = np.array([r["radius"] for r in kept]), np.array([r["centre"] for r in kept])
    blocks = -(-own.count() // MATRIX_QUERIES) or 1

    def asked(df: DataFrame, last: bool) -> DataFrame:
        """(query, vector, cluster, tile): the first clusters of each query, or all others within its reach (column ``least``)."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = _unit(batch.column(1), centres.shape[1])
                near = unit @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                want = np.zeros(near.shape, bool)
                np.put_along_axis(want, order[:, :first], True, axis=1)
                if last:
                    least = pc.fill_null(batch.column(2), -2.0).to_numpy(zero_copy_only=False)[at]
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radii - 1e-7))
                    want = ~want & (reach >= least[:, None] - 2e-6)
                q, c = np.nonzero(want)
                q, c = np.repeat(q, tiles[c]), np.repeat(c, tiles[c])
                tile = np.arange(len(c)) - np.searchsorted(q * len(numbers) + c, q * len(numbers) + c)
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at[q])) for x in batch.columns[:2]), pa.array(numbers[c]), pa.array(tile.astype(np.int32))], [query_id, "vector", "cluster", "tile"])

        return df.mapInArrow(work, f"`{query_id}` {kinds[0]}, vector array<double>, cluster int, tile int")

    by = ["cluster", "tile", "block"]
    split = F.element_at(F.lit([int(t) for t in tiles]), F.array_position(F.lit([int(n) for n in numbers]), F.col("cluster")).cast("int"))
    right = stored.select("*", F.pmod(F.xxhash64(chunk_id), split).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def work(left: pa.Table, tile: pa.Table) -> pa.Table:
        ids = left.column(0).combine_chunks()
        rows = [(v, ()) for v in left.column(1).to_pylist()]
        found = [pa.table([ids.take(pa.array(n)), c, s], [query_id, chunk_id, "score"]) for n, c, s in _Best(_matrices(rows), k).add(tile.select(range(2)).combine_chunks())]
        return pa.concat_tables([pa.table([ids.slice(0, 0), tile.column(0).slice(0, 0), pa.array([], pa.float64())], [query_id, chunk_id, "score"]), *found])

    def met(df: DataFrame, last: bool) -> DataFrame:
        left = asked(df, last).withColumn("block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))
        pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, f"`{query_id}` {kinds[0]}, `{chunk_id}` {kinds[1]}, score double")
        return top_per_key(pairs.withColumn("score", F.round("score", 6)), [query_id], k, F.desc("score"), F.col(chunk_id))

    near = cut(met(own, False))
    least = near.groupBy(query_id).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    far = met(own.join(least, query_id, "left"), True)
    return top_per_key(near.unionByName(far), [query_id], k, F.desc("score"), F.col(chunk_id), rank="rank")


_POSTING = ["token", "chunk_id", "tf", "len"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, chunk_id, tf, len) of rows (chunk_id, tokens): each distinct token of a chunk, and a row without a token for the chunk itself."""
    for batch in batches:
        tokens = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int64())
        words = pc.list_flatten(tokens).dictionary_encode()
        each = pc.list_parent_indices(tokens).to_numpy().astype(np.int64) << 32 | words.indices.to_numpy(zero_copy_only=False)
        pair, tf = np.unique(each, return_counts=True)
        yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()).take(pa.array(pair & 0xFFFFFFFF)), batch.column(0).take(pa.array(pair >> 32)), pa.array(tf), sizes.take(pa.array(pair >> 32))], _POSTING)
        yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.string()), batch.column(0), pa.array(np.zeros(batch.num_rows, np.int64)), sizes], _POSTING)


#: Postings of a token that one file holds at most, about; buckets of tokens in a small index and in others.
SPLIT, BUCKETS = 1 << 17, (16, 64)


def index_chunks(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", tokens=C.bigram_tokens) -> int:
    """Adds the chunks that the inverted index at ``path`` hasn't got; returns how many.

    A chunk is tokenised once, in its row. ``postings`` (token, chunk_id, tf, len) lie by bucket of the token, each file sorted by
    token, so that a query reads the buckets of its tokens and there the row groups that can hold them;
    ``terms`` has a token's document frequency, largest tf and least length in the part. Each run writes a part, listed in ``parts`` when it is whole: a
    run that fails leaves nothing that counts. A token of very many chunks is split over files by chunk. Null texts have no tokens.
    """
    spark = chunks.sparkSession
    done = _parts(spark, path)
    new = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("text"))
    if done:
        new = new.join(_read(spark, path, "postings", done).where(F.col("bucket") == -1).select("chunk_id"), "chunk_id", "left_anti")
    kind = new.schema["chunk_id"].dataType.simpleString()
    counted = new.select("chunk_id", tokens(F.col("text")).alias("tokens")).mapInArrow(_counted, f"token string, chunk_id {kind}, tf long, len long")
    rows = new.select("chunk_id").count()
    if not rows:
        return 0
    splits = rows // SPLIT + 1
    buckets = done[0]["buckets"] if done else BUCKETS[0 if rows < BUCKETS[1] * 1024 else 1]
    bucket = F.when(F.col("token").isNull(), -1).otherwise(_bucket(F.col("token"), buckets))
    place = (F.col("bucket") + 1) * splits + F.pmod(F.xxhash64("chunk_id"), F.lit(splits)).cast("int")
    part = uuid.uuid4().hex
    dealt = counted.withColumn("bucket", bucket).repartitionById((buckets + 1) * splits, place).sortWithinPartitions("bucket", "token")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings/part={part}")
    own = _read(spark, path, "postings", [{"part": part}])
    own.where("bucket >= 0").groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")).write.parquet(f"{path}/terms/part={part}")
    size = own.where("bucket = -1").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    size.select(F.lit(part).alias("part"), F.lit(buckets).alias("buckets"), "docs", "len").coalesce(1).write.mode("append").parquet(f"{path}/parts")
    return next(r["docs"] for r in _parts(spark, path) if r["part"] == part)


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _parts(spark: SparkSession, path: str) -> list:
    """The finished parts of an index (part, buckets, docs, len): a row for each run that added to it."""
    try:
        return spark.read.parquet(f"{path}/parts").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def _read(spark: SparkSession, path: str, table: str, parts: Sequence) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/part={p['part']}" for p in parts])


def bm25_search(queries: DataFrame, path: str, k: int, query_id: str = "query_id", query_text: str = "query", chunk_id: str = "chunk_id", tokens=C.bigram_tokens) -> DataFrame:
    """R2: (query_id, chunk_id, score, rank) by Okapi BM25 from the index at ``path``, without the chunks' texts; repeated query tokens count as often.

    Only postings of the queries' tokens are read. They move once, by chunk; where the queries' weights fit a matrix of ``CELLS``, a task scores its chunks
    for all queries and passes on what can be among its k best, so that pairs of query and chunk don't shuffle. A token in more than half the chunks has a negative weight, which the mean
    weight of the vocabulary times ``EPSILON`` replaces. A query with less than ``k`` hits is filled up with chunks of score 0, the first by id.
    """
    spark = queries.sparkSession
    parts = _parts(spark, path)
    docs, total = sum(p["docs"] for p in parts), sum(p["len"] for p in parts)
    if not docs:
        raise ValueError(f"no index at {path}")
    average = total / docs
    wanted = queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("token")).groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("times"))
    terms = _read(spark, path, "terms", parts).groupBy("token").agg(F.sum("df").alias("df"))
    weighted = terms.withColumn("raw", F.log(F.lit(docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = weighted.agg(F.avg("raw").alias("mean_raw"))
    asked = wanted.join(weighted, "token").crossJoin(F.broadcast(mean))  # one row
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw"))
    asked = cut(asked.select(query_id, "token", _bucket(F.col("token"), parts[0]["buckets"]).alias("bucket"), (F.col("times") * idf).alias("weight")))
    postings = _read(spark, path, "postings", parts).select("token", "bucket", F.col("chunk_id").alias(chunk_id), "tf", "len")
    factor = _factor(F.col("tf"), F.col("len"), F.lit(average))
    rows = [tuple(r) for r in asked.select(query_id, "token", "weight").limit(BROADCAST_ROWS + 1).collect()]
    words = list(dict.fromkeys(r[1] for r in rows))
    if rows and len(rows) <= BROADCAST_ROWS and len({r[0] for r in rows}) * len(words) <= CELLS:
        places = spark.createDataFrame([(w, n) for n, w in enumerate(words)], "token string, _place int").withColumn("bucket", _bucket(F.col("token"), parts[0]["buckets"]))
        own = [r[0] for r in places.select("bucket").distinct().collect()]  # at most as many as an index has buckets
        met = postings.where(F.col("bucket").isin(own)).join(F.broadcast(places), ["bucket", "token"])
        met = met.groupBy(chunk_id).agg(F.collect_list(F.struct("_place", factor.alias("_factor"))).alias("_met"))
        scored = _lexical(rows, words, queries.schema[query_id], met.select(chunk_id, "_met._place", "_met._factor"), k)
    else:
        scored = postings.join(small(asked), ["bucket", "token"]).groupBy(query_id, chunk_id).agg(F.round(F.sum(F.col("weight") * factor), 6).alias("score"))
    return _filled(scored, queries, postings.where("bucket = -1"), k, query_id, chunk_id)


def _filled(scored: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str) -> DataFrame:
    """The ``k`` best of (query, chunk, score) with their rank; queries with less hits go on with the first chunks that they didn't hit, with score 0.

    The few queries that need it meet 2 k chunk ids: of these k at least aren't hits.
    """
    found = cut(top_per_key(scored, [query_id], k, F.desc("score"), F.col(chunk_id)))
    first = chunks.select(chunk_id).distinct().orderBy(chunk_id).limit(2 * k)
    few = queries.select(query_id).join(found.groupBy(query_id).count().where(F.col("count") >= k), query_id, "left_anti").distinct()
    zero = few.crossJoin(F.broadcast(first)).join(found.select(query_id, chunk_id), [query_id, chunk_id], "left_anti").withColumn("score", F.lit(0.0))  # 2 k ids
    return top_per_key(found.unionByName(zero), [query_id], k, F.desc("score"), F.col(chunk_id), rank="rank")


#: Entries of a matrix that a task holds, at most.
CELLS = 4_000_000


def _lexical(weights: Sequence, words: Sequence[str], query: StructField, met: DataFrame, k: int) -> DataFrame:
    """(query id, chunk id, score): for each query of ``weights`` (query, token, weight) all rows (chunk id, places of tokens in ``words``, their factors) with a token of it that can be among its k best."""
    ids, at_word = dict.fromkeys(r[0] for r in weights), {w: n for n, w in enumerate(words)}
    ids = {x: n for n, x in enumerate(ids)}
    matrix = np.zeros((len(words), len(ids)))
    has = np.zeros(matrix.shape, np.float32)
    for asked, token, weight in weights:
        matrix[at_word[token], ids[asked]] = weight
        has[at_word[token], ids[asked]] = 1
    shared = met.sparkSession.sparkContext.broadcast((matrix, has))
    name, kind = met.columns[0], met.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, has = shared.value
        width = len(matrix)
        step = max(1, CELLS // (width + matrix.shape[1]))
        best = np.full((matrix.shape[1], k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row = pc.list_parent_indices(part.column(1)).to_numpy()
                cell, factor = row * width + pc.list_flatten(part.column(1)).to_numpy(), pc.list_flatten(part.column(2)).to_numpy()
                score = np.bincount(cell, factor, part.num_rows * width).reshape(part.num_rows, width) @ matrix
                held = np.bincount(cell, minlength=part.num_rows * width).reshape(part.num_rows, width) > 0
                score[held.astype(np.float32) @ has == 0] = -np.inf
                score = score.T
                best = np.sort(np.concatenate([best, score], 1), 1)[:, -k:]
                n, c = np.nonzero((score >= best[:, :1] - 2e-6) & (score > -np.inf))  # what is lower is lower after rounding, too
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), part.column(0).take(pa.array(c)), pa.array(score[n, c])], ["_n", name, "score"])

    found = met.mapInArrow(work, f"_n int, `{name}` {kind}, score double")
    names = met.sparkSession.createDataFrame([(n, q) for n, q in enumerate(ids)], StructType([StructField("_n", IntegerType()), query]))
    return found.join(F.broadcast(names), "_n").select(query.name, name, F.round("score", 6).alias("score"))  # at most BROADCAST_ROWS rows


def _factor(tf: Column, size: Column, average: Column) -> Column:
    """What a token's weight is multiplied by in a text that holds it ``tf`` times."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def _met(tokened: DataFrame, words: Sequence[str]) -> DataFrame:
    """One pass over rows (chunk id, tokens): (token, df) of each batch; (docs, len) of each batch; (chunk id, size, places, tf) of each row that holds some of ``words``."""
    shared = tokened.sparkSession.sparkContext.broadcast(list(words))
    name, kind = tokened.columns[0], tokened.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            tokens = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = pc.list_flatten(tokens).dictionary_encode()
            each = pc.list_parent_indices(tokens).to_numpy().astype(np.int64) << 32 | terms.indices.to_numpy(zero_copy_only=False)
            pair, tf = np.unique(each, return_counts=True)
            row, term = pair >> 32, pair & 0xFFFFFFFF
            place = pc.fill_null(pc.index_in(terms.dictionary.cast(pa.string()), known), -1).to_numpy(zero_copy_only=False)[term]
            row, place, count = row[place >= 0], place[place >= 0], tf[place >= 0]
            rows, n = np.unique(row, return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), count.astype(np.int64))]
            yield rows_of(batch, len(terms.dictionary), token=terms.dictionary.cast(pa.string()), df=pa.array(np.bincount(term, minlength=len(terms.dictionary)).astype(np.int64)))
            yield rows_of(batch, 1, docs=pa.array([batch.num_rows], pa.int64()), len=pa.array([int(sizes.sum())], pa.int64()))
            yield rows_of(batch, len(rows), **{name: batch.column(0).take(pa.array(rows)), "_size": pa.array(sizes[rows]), "_places": lists[0], "_tf": lists[1]})

    def rows_of(batch: pa.RecordBatch, n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"token": pa.string(), "df": pa.int64(), "docs": pa.int64(), "len": pa.int64(), name: batch.schema.types[0], "_size": pa.int64(), "_places": pa.list_(pa.int32()), "_tf": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    return tokened.mapInArrow(work, f"token string, df long, docs long, len long, `{name}` {kind}, _size long, _places array<int>, _tf array<long>")


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query", chunk_id: str = "chunk_id", text: str = "text",
               tokens=C.bigram_tokens) -> DataFrame:
    """R2: (query_id, chunk_id, score, rank) by Okapi BM25; repeated query tokens count as often.

    One pass over the chunks: a task counts lengths and document frequencies of each batch, and of each chunk only the tokens that
    a query has; both are stored (a checkpoint, where the session has a folder), so texts are tokenised once. A token
    in more than half the chunks has a negative weight, which the mean weight times
    ``EPSILON`` replaces. Where the queries' weights are at most ``BROADCAST_ROWS``, fit a matrix of ``CELLS`` and no id of a chunk with such a token repeats (all looked up when the plan is built), a task scores its chunks in
    slices and passes on what can be among its k best, so that pairs of query and chunk neither shuffle nor fill an aggregate; otherwise the pairs shuffle. A query with less than ``k`` hits is filled up with chunks of score 0, the first by id.
    For chunks that are searched again and again there is ``index_chunks``.
    """
    wanted = cut(queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("token")).groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("times")))
    asked = small(wanted.select("token").distinct())
    words = [r[0] for r in wanted.select("token").distinct().limit(BROADCAST_ROWS + 1).collect()]
    words = words if len(words) <= BROADCAST_ROWS else []
    tokened = chunks.select(chunk_id, tokens(F.col(text)).alias("tokens"))
    once = cut(_met(tokened, words))
    counts = cut(once.where("token IS NOT NULL OR docs IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("len").alias("len")))
    size = counts.agg(F.sum("docs").alias("docs"), (F.sum("len") / F.nullif(F.sum("docs"), F.lit(0))).alias("avg_len"))
    raw = F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = counts.where("token IS NOT NULL").select("token", "df").crossJoin(F.broadcast(size)).withColumn("raw", raw)  # one row
    mean = weighted.agg(F.avg("raw").alias("mean_raw"))
    idf = (
        weighted.join(asked, "token", "left_semi").crossJoin(F.broadcast(mean))  # one row
        .select("token", "avg_len", F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))
    )
    weights = cut(wanted.join(idf, "token"))
    rows = weights.select(query_id, "token", (F.col("times") * F.col("idf")).alias("weight"), "avg_len").limit(BROADCAST_ROWS + 1).collect()
    hits = once.where("_size IS NOT NULL")
    if rows and words and len(rows) <= BROADCAST_ROWS and len({r[0] for r in rows}) * len(words) <= CELLS and hits.groupBy(chunk_id).count().where("count > 1").isEmpty():
        average = F.lit(rows[0]["avg_len"])
        factors = F.transform("_tf", lambda tf: _factor(tf, F.col("_size"), average))
        scored = _lexical([tuple(r)[:3] for r in rows], words, queries.schema[query_id], hits.select(chunk_id, "_places", factors.alias("_factors")), k)
        return _filled(scored, queries, chunks, k, query_id, chunk_id)
    counted = (
        tokened.select(chunk_id, F.size("tokens").alias("len"), F.explode_outer("tokens").alias("token"))
        .join(asked, "token", "left_semi").groupBy(chunk_id, "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    )
    part = F.col("times") * F.col("idf") * _factor(F.col("tf"), F.col("len"), F.col("avg_len"))
    scored = counted.join(small(weights), "token").groupBy(query_id, chunk_id).agg(F.round(F.sum(part), 6).alias("score"))
    return _filled(scored, queries, chunks, k, query_id, chunk_id)


def fused(rankings: Sequence[DataFrame], query_id: str = "query_id", chunk_id: str = "chunk_id", k: int = 60, top: int = 20) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, chunk_id, rank from 1): sum of 1 / (k + rank)."""
    every = None
    for r in rankings:
        part = r.select(query_id, chunk_id, "rank")
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy(query_id, chunk_id).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return top_per_key(summed, [query_id], top, F.desc("score"), F.col(chunk_id), rank="rank")


def with_chunks(ranked: DataFrame, chunks: DataFrame, rows: int, chunk_id: str = "chunk_id") -> DataFrame:
    """The chunks' columns beside their ranks; ids without a chunk go.

    ``rows`` is the most that the ranking can have, queries times hits: within
    ``BROADCAST_ROWS`` the ranking is broadcast and the chunks stay where they are.
    """
    return chunks.join(F.broadcast(ranked) if rows <= BROADCAST_ROWS else ranked, chunk_id)


def boosted(hits: DataFrame, keywords: Column, text: Column, query_id: str = "query_id", chunk_id: str = "chunk_id", step: float = 0.02) -> DataFrame:
    """Score plus ``step`` for each of the query's keywords in the text; queries without keywords keep their order."""
    n = F.size(F.filter(keywords, lambda w: F.contains(text, w)))
    out = hits.withColumns({"keyword_matches": n, "hybrid_score": F.round(F.col("score") + step * n, 6), "_any": F.size(keywords) > 0})
    order = Window.partitionBy(query_id).orderBy(F.when(F.col("_any"), -F.col("hybrid_score")).otherwise(F.col("rank").cast("double")), chunk_id)
    return out.withColumn("rank", F.row_number().over(order)).drop("_any")


def reranked(hits: DataFrame, terms: Column, text: Column, score: str = "hybrid_score", query_id: str = "query_id", chunk_id: str = "chunk_id", top: int = 5) -> DataFrame:
    """0.7 of the score and 0.3 of the share of query terms in the text; lists of at most ``top`` stay as they are, without a score."""
    matched = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    out = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(query_id)))
    new = F.round(0.7 * F.col(score) + 0.3 * matched / F.greatest(F.size(terms), F.lit(1)), 10)
    out = out.withColumn("rerank_score", F.when(F.col("_n") > top, new))
    return top_per_key(out.withColumnRenamed("rank", "_before").drop("_n"), [query_id], top, F.desc_nulls_last("rerank_score"), F.col("_before"), F.col(chunk_id), rank="rank").drop("_before")


def result_list(hits: DataFrame, text: str = "text", score: str = "score", preview: int = 200, digits: int = 4) -> DataFrame:
    """A short preview and a rounded score."""
    return hits.withColumns({"preview": F.left(F.col(text), F.lit(preview)), "shown_score": F.round(score, digits)})


def context_blocks(hits: DataFrame, query_id: str = "query_id", text: str = "text", label: str = "label", cut: int = 900, separator: str = "\n\n---\n\n") -> DataFrame:
    """One context for each query: numbered blocks in rank order. A query's blocks are its few top hits."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(label), F.lit("")), F.lit("\n"), F.left(F.col(text), F.lit(cut)))
    blocks = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return blocks.select(query_id, F.array_join(F.col("blocks.block"), separator).alias("context"), F.size("blocks").alias("blocks"))


def citations(hits: DataFrame, columns: Sequence[str], query_id: str = "query_id") -> DataFrame:
    """Rank and these columns for each hit."""
    return hits.select(query_id, "rank", *columns)


def sources_in_text(texts: DataFrame, key: str, text: str, pattern: str = r"(https?://[^\s)\]]+\.pdf)", most: int = 5) -> DataFrame:
    """The first distinct matches in each text, joined by blanks."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), 1))
    return texts.select(key, F.array_join(F.slice(found, 1, most), " ").alias("sources"), F.size(found).alias("n"))


def normal_queries(queries: DataFrame, explicit: str, parsed: str, out: str, default: str) -> DataFrame:
    """The explicit argument, else the parsed one, else the default."""
    return queries.withColumn(out, F.coalesce(F.nullif(F.col(explicit), F.lit("")), F.nullif(F.col(parsed), F.lit("")), F.lit(default)))


def hybrid_search(queries: DataFrame, chunks: DataFrame, k_vector: int = 20, k_text: int = 20, top: int = 5, query_id: str = "query_id", query_text: str = "query",
                  chunk_id: str = "chunk_id", text: str = "text", vector: str = "vector", tokens=C.bigram_tokens, terms=C.query_terms, vectors: DataFrame | None = None) -> DataFrame:
    """Filter, rank by vector and by BM25, fuse, rerank; one table of hits for a whole table of queries.

    Vectors are a column of ``chunks`` or a table of their own, ``vectors`` (chunk_id, vector); then those of chunks are ranked and no text meets a vector.
    """
    if vectors is None:
        own = chunks.where(F.col(vector).isNotNull())
    else:
        own = vectors.where(F.col(vector).isNotNull()).join(chunks.select(chunk_id).distinct().hint("merge"), chunk_id, "left_semi")
    near = vector_top_k(queries, own, k_vector, query_id, chunk_id, vector)
    lexical = bm25_top_k(queries, chunks, k_text, query_id, query_text, chunk_id, text, tokens)
    most = 20
    hits = with_chunks(fused([near, lexical], query_id, chunk_id, top=most), chunks.select(chunk_id, text), queries.count() * most, chunk_id)
    asked = hits.join(small(queries.select(query_id, query_text)), query_id)
    return reranked(asked, terms(F.col(query_text)), F.col(text), "score", query_id, chunk_id, top)
