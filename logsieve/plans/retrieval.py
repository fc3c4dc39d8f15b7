"""Queries over embeddings and nearest-neighbour search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logsieve.functions.vectors import cosine_similarity, l2_distance
from logsieve.operators import vectors
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views
from logsieve.session import scratch_dir

#: Lists of twenty that a query looks into; the given vectors are hardly clustered, so few would find too little.
INDEX_PROBES = 14

_EMBEDDED = """
    , w AS (SELECT job_id, sequence, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word FROM turns),
      b AS (SELECT job_id, sequence, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n
            FROM w GROUP BY ALL),
      l AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY job_id, sequence)) AS norm FROM b)"""


@query("vector_embed", "O-VEC-01", with_views("turns", f"""{_EMBEDDED}
    SELECT job_id, sequence, CAST(dim AS INT) AS dim, round(CAST(CAST(n / norm AS FLOAT) AS DOUBLE), 5) AS value FROM l"""))
def vector_embed(spark, sf_dir):
    """Turns embedded by the offline embedder, as their non-zero components."""
    made = vectors.embed(view(spark, sf_dir, "turns"))
    return made.select("job_id", "sequence", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select(
        "job_id", "sequence", "dim", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _queries(spark, sf_dir):
    """One query vector per label: the first of the label."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("embedding")
    ).select("query_id", "embedding")


_ASKED = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      q AS (SELECT min(vec_id) AS query_id, min_by(e, vec_id) AS qe FROM v GROUP BY label)"""


def _top_sql(score: str, order: str) -> str:
    return f"""{_ASKED},
      p AS (SELECT query_id, vec_id, round({score}, 9) AS score FROM q, v),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


def _shown(found):
    return found.withColumn("score", F.round("score", 6))


@query("vector_cosine", "O-VEC-02", """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         q AS (SELECT label, min_by(e, vec_id) AS qe FROM v GROUP BY label)
    SELECT vec_id, round(list_cosine_similarity(e, qe), 9) AS cosine, round(list_distance(e, qe), 9) AS distance
    FROM v JOIN q USING (label)""")
def vector_cosine(spark, sf_dir):
    """Similarity of every vector with the first of its label."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    pair = F.col("embedding"), F.col("first")
    return rows.join(first, "label").select(
        "vec_id", F.round(cosine_similarity(*pair), 9).alias("cosine"), F.round(l2_distance(*pair), 9).alias("distance")
    )


@query("vector_top_k_cosine", "O-VEC-03", _top_sql("list_cosine_similarity(qe, e)", "DESC"))
def vector_top_k_cosine(spark, sf_dir):
    return _shown(vectors.nearest(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10))


@query("vector_top_k_l2", "O-VEC-03", _top_sql("list_distance(qe, e)", "ASC"))
def vector_top_k_l2(spark, sf_dir):
    return _shown(vectors.nearest(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, "l2"))


@query("vector_top_k_blocks", "O-VEC-03", _top_sql("list_cosine_similarity(qe, e)", "DESC"))
def vector_top_k_blocks(spark, sf_dir):
    """Queries in blocks so small that the corpus is scanned several times."""
    return _shown(vectors.nearest(_queries(spark, sf_dir), _corpus(spark, sf_dir), 10, query_rows=4))


@query("vector_lists_all_probed", "O-VEC-04", _top_sql("list_distance(qe, e)", "ASC"))
def vector_lists_all_probed(spark, sf_dir):
    """Inverted lists with every list probed give the exact answer."""
    corpus = _corpus(spark, sf_dir)
    centroids = vectors.train_lists(corpus, lists=20)
    indexed = vectors.assign_lists(corpus, centroids)
    return _shown(vectors.nearest_in_lists(_queries(spark, sf_dir), indexed, centroids, 10, nprobe=len(centroids)))


@query("vector_lists_recall", "O-VEC-04", f"""{_ASKED},
      c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list_id, e AS ce FROM v ORDER BY vec_id LIMIT 20),
      near AS (SELECT vec_id, e, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(e, ce), 9), list_id) AS nr FROM v, c),
      probed AS (SELECT query_id, list_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(qe, ce), 9), list_id) AS nr FROM q, c),
      p AS (SELECT query_id, qe, vec_id, e FROM q JOIN probed USING (query_id) JOIN near n USING (list_id) WHERE probed.nr <= 5 AND n.nr = 1),
      found AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (
                PARTITION BY query_id ORDER BY round(list_distance(qe, e), 9), vec_id) AS rank FROM p) WHERE rank <= 10),
      truth AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (
                PARTITION BY query_id ORDER BY round(list_distance(qe, e), 9), vec_id) AS rank FROM q, v) WHERE rank <= 10)
    SELECT query_id, count(f.vec_id) / count(*) AS recall FROM truth t LEFT JOIN found f USING (query_id, vec_id) GROUP BY query_id""")
def vector_lists_recall(spark, sf_dir):
    """Recall of five probed lists of twenty against the exact answer; the first vectors are the centroids."""
    corpus, asked = _corpus(spark, sf_dir), _queries(spark, sf_dir)
    centroids = np.array([r.embedding for r in corpus.orderBy("vec_id").limit(20).collect()], dtype=float)
    found = vectors.nearest_in_lists(asked, vectors.assign_lists(corpus, centroids), centroids, 10, nprobe=5)
    return vectors.recall(found, vectors.nearest(asked, corpus, 10, "l2"))


@query("vector_index_recall", "O-VEC-04", """
    SELECT CAST(count(*) AS BIGINT) AS stored, CAST(count(*) FILTER (vec_id % 50 = 0) AS BIGINT) AS asked, true AS reached FROM embeddings""")
def vector_index_recall(spark, sf_dir):
    """A kept index of trained lists, a third of the vectors added later; every fiftieth id asks, recall of ten is 0.9 or more."""
    corpus = _corpus(spark, sf_dir)
    early, path = corpus.where("vec_id % 3 <> 0"), scratch_dir(spark, "index")
    vectors.write_index(early, vectors.train_lists(early, lists=20), path)
    vectors.add_to_index(spark, corpus.where("vec_id % 3 = 0"), path)
    asked = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.search_index(spark, asked, path, 10, nprobe=INDEX_PROBES)
    mean = vectors.recall(found, vectors.nearest(asked, corpus, 10, "l2")).agg(
        F.count(F.lit(1)).alias("asked"), (F.avg("recall") >= 0.9).alias("reached"))
    return mean.crossJoin(vectors.read_index(spark, path).agg(F.count(F.lit(1)).alias("stored")))


@query("vector_dimension", "O-VEC-05", """
    SELECT vec_id, vec_id % 10 <> 0 AND len(embedding) = 64 AS dimension_ok FROM embeddings""")
def vector_dimension(spark, sf_dir):
    """Every tenth vector cut short."""
    cut = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return vectors.check_dimension(_corpus(spark, sf_dir).withColumn("embedding", cut), 64).select(
        "vec_id", "dimension_ok"
    )


@query("vector_refresh", "O-VEC-06", with_views("turns", """
    SELECT job_id, 'embedding_generation' AS analysis_type, CAST(count(*) AS BIGINT) AS document_count,
           CAST(count(*) AS BIGINT) AS embedded FROM turns GROUP BY job_id"""))
def vector_refresh(spark, sf_dir):
    """Chunks without vectors embedded again, with the result row of each job."""
    stored = view(spark, sf_dir, "turns").withColumn("embedding", F.lit(None).cast("array<float>"))
    fresh = vectors.refresh_embeddings(stored)
    embedded = fresh.groupBy("job_id").agg(F.count_if(F.size("embedding") == 64).alias("embedded"))
    return vectors.refresh_results(stored).join(embedded, "job_id")


@query("vector_coverage", "O-VEC-07", """
    SELECT label, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (vec_id % 3 <> 0) AS BIGINT) AS embedded,
           round(count(*) FILTER (vec_id % 3 <> 0) / count(*), 6) AS coverage FROM embeddings GROUP BY label""")
def vector_coverage(spark, sf_dir):
    """Every third vector missing."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))
    )
    return vectors.embedding_coverage(rows, ["label"]).withColumn("coverage", F.round("coverage", 6))
