"""Embeddings and nearest-neighbour search.

Search sends queries in blocks of bounded size to the scan of the corpus (of the lists they look into), so the corpus is
never shuffled. Matrices are multiplied there in tiles, and a task gives its best ``k`` rows per query, never its pairs.
Scores are rounded to nine digits; equal scores order by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.functions.ordering import top_per_key
from logsieve.functions.text import let
from logsieve.session import materialise
from logsieve.settings import FALLBACK_DIMENSION, MODEL_DIMENSIONS
from logsieve.sources.sinks import write_table

Embedder = Callable[[list[str]], np.ndarray]
DIGITS = 9
#: Rows of a block of queries, and numbers in a tile of scores (32 MB of doubles).
QUERY_ROWS, TILE_CELLS = 16_384, 4_000_000


def hashed(text: Column, dimension: int = 64) -> Column:
    """Offline embedding: lower-case letter runs counted into ``dimension`` buckets by hash, unit length, all built-in."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimension)
    places = F.sequence(F.lit(0), F.lit(dimension - 1))

    def counted(found: Column) -> Column:
        """Sizes of the runs of equal buckets, in order; every bucket is put in once more, so that none has no run."""
        opens = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda j: (j == 0) | (F.get(found, j) != F.get(found, j - 1)))
        size = F.size(found)
        return let(opens, lambda at: F.transform(at, lambda a, i: (F.coalesce(F.get(at, i + 1), size) - a - 1).cast("double")))

    counts = let(F.sort_array(F.concat(buckets, places.cast("array<bigint>"))), counted)

    def scaled(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return let(counts, scaled)


def embed(
    df: DataFrame,
    make_embedder: Callable[[], Embedder] | None = None,
    text: str = "content",
    batch_size: int = 100,
    into: str = "embedding",
) -> DataFrame:
    """Adds vectors: ``hashed`` ones, or those of an embedder built once per task and called ``batch_size`` texts at a time."""
    kept = df.drop(into)
    if make_embedder is None:
        return kept.withColumn(into, hashed(F.col(text)))
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                piece = batch.slice(start, batch_size)
                texts = [t or "" for t in piece.column(text).to_pylist()]
                vectors = np.asarray(embedder(texts), dtype=np.float32)
                column = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)),
                    pa.array(vectors.ravel()),
                )
                yield pa.RecordBatch.from_arrays([*piece.columns, column], names=[*piece.schema.names, into])

    return kept.mapInArrow(run, schema)


def refresh_embeddings(
    documents: DataFrame, job_ids: list | None = None, make_embedder: Callable[[], Embedder] | None = None
) -> DataFrame:
    """Stored chunks with new vectors for the given jobs (all when None); other rows are unchanged."""
    if job_ids is None:
        return embed(documents, make_embedder)
    chosen = F.col("job_id").isin(job_ids)
    return embed(documents.where(chosen), make_embedder).unionByName(documents.where(~chosen))


def refresh_results(documents: DataFrame) -> DataFrame:
    """The result row of a refresh per job."""
    return documents.groupBy("job_id").agg(F.count(F.lit(1)).alias("document_count")).withColumn(
        "analysis_type", F.lit("embedding_generation")
    )


def known_dimension(model: str, fallback: int = FALLBACK_DIMENSION) -> int:
    return MODEL_DIMENSIONS.get(model, fallback)


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Adds ``dimension_ok``; rows without a vector are not ok."""
    return vectors.withColumn("dimension_ok", F.coalesce(F.size(column) == dimension, F.lit(False)))


def embedding_coverage(documents: DataFrame, keys: list[str] = ["job_id"]) -> DataFrame:
    return documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("embedding").alias("embedded"),
        (F.count("embedding") / F.count(F.lit(1))).alias("coverage"),
    )


# ---- search ---------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    return _unit(vectors) if metric == "cosine" else vectors


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: the cosine of prepared vectors, or the negative distance."""
    if metric == "cosine":
        return np.round(queries @ vectors.T, DIGITS)
    squares = (queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)[None, :]
    return -np.round(np.sqrt(np.maximum(squares, 0.0)), DIGITS)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest of one query with ties at the edge settled by id."""
    if len(ids) > k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        near = scores >= edge
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Leaders:
    """Best ``k`` of each query over the batches seen by one task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n
        self.floor = np.full(n, -np.inf)

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row per query; queries that none of these comes up to are passed over."""
        for at in np.flatnonzero(scores.max(1) >= self.floor[queries]):
            query = queries[at]
            best = _best(ids, scores[at], self.k)
            held = self.rows[query]
            if held is not None:
                best = _best(np.concatenate([held[0], best[0]]), np.concatenate([held[1], best[1]]), self.k)
            self.rows[query] = best
            if len(best[0]) == self.k:
                self.floor[query] = best[1][-1]

    def table(self, query_ids: np.ndarray) -> pa.RecordBatch:
        filled = [(q, *row) for q, row in zip(query_ids.tolist(), self.rows) if row is not None]
        counts = [len(ids) for _, ids, _ in filled]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([q for q, _, _ in filled], counts), type=pa.int64()),
                pa.array(np.concatenate([ids for _, ids, _ in filled]) if filled else [], type=pa.int64()),
                pa.array(np.concatenate([s for _, _, s in filled]) if filled else [], type=pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )


_PAIRS = "query_id bigint, vec_id bigint, score double"


def _finish(candidates: DataFrame, k: int, metric: str) -> DataFrame:
    ranked = top_per_key(candidates, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    value = F.col("score") if metric == "cosine" else F.abs("score")
    return ranked.withColumn("score", value)


def _scanned(corpus: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, metric: str, probes: np.ndarray | None) -> DataFrame:
    """Candidates of a block of queries from one pass over the corpus: at most ``k`` per query and task leave it."""
    shared = corpus.sparkSession.sparkContext.broadcast((ids, _prepared(asked, metric), probes))
    columns = ["vec_id", "embedding", *(["list_id"] if probes is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, probes = shared.value
        leaders, every = _Leaders(len(ids), k), np.arange(len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            found, vectors = batch.column(0).to_numpy(), _prepared(_matrix(batch.column(1)), metric)
            lists = [(slice(None), every)] if probes is None else [
                (rows, np.flatnonzero((probes == no).any(1))) for no, rows in _by_value(batch.column(2).to_numpy())]
            for rows, queries in lists:
                mine, held = found[rows], vectors[rows]
                tile = max(1, TILE_CELLS // len(mine))
                for start in range(0, len(queries), tile):
                    some = queries[start : start + tile]
                    leaders.offer(some, mine, _scores(asked[some], held, metric))
        yield leaders.table(ids)

    return corpus.select(columns).mapInArrow(run, _PAIRS)


def _by_value(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of every different value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return [(int(values[part[0]]), part) for part in np.split(order, cuts)]


def _in_blocks(queries: DataFrame, query_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries block by block: ids and vectors. The driver holds one block of at most ``query_rows`` at a time."""
    slim = queries.select("query_id", "embedding")
    first = slim.limit(query_rows + 1).toArrow()
    if first.num_rows <= query_rows:
        if first.num_rows:
            yield first.column(0).to_numpy(), _matrix(first.column(1))
        return
    # dealt by a hash, with room for blocks that come out larger than the others
    blocks = -(-slim.count() // max(1, query_rows * 3 // 4))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    stored = materialise(dealt.repartition("block").sortWithinPartitions("block"), "queries")
    for block in range(blocks):
        table = stored.where(F.col("block") == block).select("query_id", "embedding").toArrow()
        for at in range(0, table.num_rows, query_rows):
            part = table.slice(at, query_rows)
            yield part.column(0).to_numpy(), _matrix(part.column(1))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact ``k`` nearest corpus rows of each query.

    ``queries``: ``query_id, embedding``; ``corpus``: ``vec_id, embedding``, all of one width. The corpus stays where it
    is: a block of queries of bounded size goes to every task of its scan, and each task returns its best ``k`` per query.
    """
    found = [materialise(_scanned(corpus, *block, k, metric, None), "nearest") for block in _in_blocks(queries, query_rows)]
    return _finish(_all(queries.sparkSession, found), k, metric)


def _all(spark: SparkSession, found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _PAIRS)


# ---- inverted lists -------------------------------------------------------------------------


def train_lists(corpus: DataFrame, lists: int = 100, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Centroids of the coarse quantiser, fitted on all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    training = corpus.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=rounds).fit(training)
    return np.array(model.clusterCenters())


def assign_lists(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``list_id``. Write the result partitioned by it to let searches skip whole folders."""
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest_list = _scores(_matrix(batch.column("embedding")), shared.value, "l2").argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest_list.astype(np.int32))], names=[*batch.schema.names, "list_id"]
                )

    schema = T.StructType([*corpus.schema.fields, T.StructField("list_id", T.IntegerType())])
    return corpus.mapInArrow(run, schema)


def _probed(asked: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """The lists that each query looks into."""
    return np.argsort(-_scores(asked, centroids, "l2"), axis=1, kind="stable")[:, :nprobe]


def nearest_in_lists(
    queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, nprobe: int = 10, metric: str = "l2", query_rows: int = QUERY_ROWS
) -> DataFrame:
    """Approximate search: each query looks only into the ``nprobe`` lists nearest to it.

    Lists that no query of a block looks into are not read where ``indexed`` is stored by list. With all lists probed
    the answer is exact.
    """
    found = []
    for ids, asked in _in_blocks(queries, query_rows):
        probes = _probed(asked, centroids, nprobe)
        wanted = indexed.where(F.col("list_id").isin([int(n) for n in np.unique(probes)]))
        found.append(materialise(_scanned(wanted, ids, asked, k, metric, probes), "nearest"))
    return _finish(_all(queries.sparkSession, found), k, metric)


# ---- a kept index -------------------------------------------------------------------------------


def write_index(corpus: DataFrame, centroids: np.ndarray, path: str, files_per_list: int = 4) -> None:
    """Keeps the vectors (``vec_id, embedding``) in a folder per list below ``path``, with the centroids beside them.

    Rows of a list meet in a few tasks by a hash of their id, so a list with a third of all rows is not one task.
    """
    spark = corpus.sparkSession
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    write_table(assign_lists(corpus.select("vec_id", "embedding"), centroids), f"{path}/lists", ["list_id"], "overwrite", "vec_id", files_per_list)


def add_to_index(spark: SparkSession, more: DataFrame, path: str, files_per_list: int = 1) -> None:
    """Adds vectors to the lists they belong to; the centroids stay as they are."""
    write_table(assign_lists(more.select("vec_id", "embedding"), index_centroids(spark, path)), f"{path}/lists", ["list_id"], "append", "vec_id", files_per_list)


def index_centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``vec_id, embedding, list_id`` of a kept index; a condition on ``list_id`` reads only those folders."""
    return spark.read.parquet(f"{path}/lists")


def search_index(spark: SparkSession, queries: DataFrame, path: str, k: int, nprobe: int = 10, metric: str = "l2", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``nearest_in_lists`` over a kept index."""
    return nearest_in_lists(queries, read_index(spark, path), index_centroids(spark, path), k, nprobe, metric, query_rows)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours of each query that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("_hit"))
    return truth.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg(
        (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )
