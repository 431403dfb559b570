"""Queries of the signal operators, on the embeddings of one label in the order of vec_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import savgol, savgol_kernel
from loam.operators import semantic, signal
from loam.providers.local import hash_embedding


def series(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def cross_similarity(spark, sf_dir):
    return signal.cross_similarity(series(spark, sf_dir), "label", "vec_id").select("label", "i", *six("sim"))


SIM_CTE = """
WITH ordered AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT label, i, e, lead(e) OVER (PARTITION BY label ORDER BY i) AS f FROM ordered),
cosines AS (SELECT label, i, list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))) AS c FROM pairs WHERE f IS NOT NULL),
sims AS (SELECT label, i::INT AS i, coalesce(avg(c) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) AS sim FROM cosines),
curve AS (SELECT label, list(sim ORDER BY i) AS x, count(*)::INT AS n FROM sims GROUP BY label)
"""


def _filtered(deriv):
    kernel = "[" + ",".join(repr(k) for k in savgol_kernel(11, 3, deriv)) + "]::DOUBLE[]"
    place = "CASE WHEN i + j - 6 < 0 THEN 6 - i - j WHEN i + j - 6 >= n THEN 2 * (n - 1) - (i + j - 6) ELSE i + j - 6 END"
    return f"list_transform(range(0, n), lambda i: list_sum(list_transform({kernel}, lambda k, j: k * x[1 + {place}])))"


def _savgol_query(deriv):
    def query(spark, sf_dir):
        sims = signal.cross_similarity(series(spark, sf_dir), "label", "vec_id")
        arrays = signal.curves(sims, "label")
        out = savgol(F.col("curve"), F.lit(11), 3, deriv, 11)
        return arrays.select("label", F.posexplode(out).alias("i", "v")).select("label", "i", *six("v"))

    return query


def _savgol_sql(deriv):
    return SIM_CTE + f", out AS (SELECT label, {_filtered(deriv)} AS v FROM curve) SELECT label, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v), 6) AS v FROM out"


def _points(spark, sf_dir, tolerance=signal.TOLERANCE):
    return signal.split_points(signal.cross_similarity(series(spark, sf_dir), "label", "vec_id"), "label")


def local_minima(spark, sf_dir):
    sims = signal.cross_similarity(series(spark, sf_dir), "label", "vec_id")
    arrays = signal.curves(sims, "label").withColumn("smoothed", signal.smoothed_curve(F.col("curve")))
    return arrays.select("label", F.explode(signal.minima(F.col("smoothed"))).alias("i"))


MINIMA_CTE = SIM_CTE + f""", smooth AS (SELECT label, n, {_filtered(0)} AS x FROM curve),
derived AS (SELECT label, n, x, {_filtered(1)} AS d1, {_filtered(2)} AS d2 FROM smooth),
low AS (SELECT label, n, x, list_filter(range(0, n), lambda i: abs(d1[i + 1]) < 0.1 AND d2[i + 1] > 0) AS m FROM derived)
"""
MINIMA_SQL = MINIMA_CTE + "SELECT label, unnest(m)::INT AS i FROM low"
SPLITS_CTE = MINIMA_CTE.replace("WITH ordered", "WITH RECURSIVE ordered", 1) + """, cand AS (
  SELECT label, i, x[i + 1] AS v FROM (SELECT label, x, unnest(m) AS i FROM low)
), bound AS (SELECT label, quantile_cont(v, 0.5) AS b FROM cand GROUP BY label),
fit AS (SELECT c.label, list(i ORDER BY i) AS c FROM cand c JOIN bound b ON c.label = b.label WHERE v <= b GROUP BY c.label),
walk AS (
  SELECT label, c, 1 AS k, c[1] AS last, true AS kept FROM fit
  UNION ALL
  SELECT label, c, k + 1, CASE WHEN c[k + 1] >= last + 2 THEN c[k + 1] ELSE last END, c[k + 1] >= last + 2 FROM walk WHERE k < len(c)
), splits AS (SELECT label, last AS s FROM walk WHERE kept)
"""


def split_filter(spark, sf_dir):
    return _points(spark, sf_dir).select("label", F.explode("splits").alias("split"))


def semantic_groups(spark, sf_dir):
    """Vectors of each label grouped at the split points."""
    rows = series(spark, sf_dir).select("label", "vec_id")
    grouped = signal.grouped(rows, _points(spark, sf_dir).select("label", "splits"), "label", "vec_id", "grp")
    return grouped.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


GROUPS_SQL = SPLITS_CTE + """
SELECT label, grp::INT AS grp, count(*) AS n, min(vec_id) AS first_id FROM (
  SELECT o.label, o.vec_id, (SELECT count(*) FROM splits s WHERE s.label = o.label AND s.s < o.i) AS grp
  FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) o
) GROUP BY label, grp
"""


def hash_embed(spark, sf_dir):
    """Non-zero entries of the hashed bag of words of each conversation turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.posexplode(hash_embedding(F.col("text"))).alias("bucket", "n")).where("n > 0")


HASH_SQL = r"""
SELECT conv_id, turn, (('0x' || md5(w)[1:8])::BIGINT % 64)::INT AS bucket, count(*)::DOUBLE AS n
FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS w FROM conversations) GROUP BY ALL
"""


def turn_vectors(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", F.col("turn").alias("block_idx"), "text", F.lit(0).alias("offset_start"), hash_embedding(F.col("text")).alias("embedding"))


def semantic_chunks(spark, sf_dir):
    """Turns of a conversation joined into chunks at similarity minima, with a small smoothing window."""
    rows = turn_vectors(spark, sf_dir)
    return semantic.semantic_groups(rows, "conv_id", smooth_window=5).groupBy("conv_id", F.col("group").alias("idx")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.octet_length("text")).alias("bytes")
    )


QUERIES = {
    "cross_similarity": cross_similarity, "savgol_smooth": _savgol_query(0), "savgol_d1": _savgol_query(1), "savgol_d2": _savgol_query(2),
    "local_minima": local_minima, "split_filter": split_filter, "semantic_groups": semantic_groups, "hash_embed": hash_embed, "semantic_chunks": semantic_chunks,
}
ORACLES = {
    "cross_similarity": SIM_CTE + "SELECT label, i, round(sim, 6) AS sim FROM sims", "savgol_smooth": _savgol_sql(0), "savgol_d1": _savgol_sql(1), "savgol_d2": _savgol_sql(2),
    "local_minima": MINIMA_SQL, "split_filter": SPLITS_CTE + "SELECT label, s::INT AS split FROM splits", "semantic_groups": GROUPS_SQL, "hash_embed": HASH_SQL,
}
