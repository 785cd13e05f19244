"""Named queries of the samplers (over ``embeddings``; label ≥ 7 is the minority class 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.text import md5_int_sql
from colloquy.operators import sampling as Sm
from colloquy.plans.registry import register, rsql
from colloquy.sources import tables as S

K = Sm.K_NEIGHBOURS
EMB_SQL = ("emb AS (SELECT vec_id AS id, CAST(label >= 7 AS INTEGER) AS cls, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)")


def _emb(spark, sf):
    e = S.read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") >= 7).cast("int").alias("cls"),
                    F.col("embedding").cast("array<double>").alias("vec"))


def _knn_sql(name: str, same_class: bool, where: str = "") -> str:
    cond = "AND a.cls = b.cls" if same_class else ""
    return (f"{name} AS (SELECT * FROM (SELECT a.id, b.id AS nid, list_distance(a.vec, b.vec) AS dist, a.cls, "
            f"row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) - 1 AS rank "
            f"FROM emb a JOIN emb b ON a.id <> b.id {cond} {where}) WHERE rank < {K})")


def _round_vec(col: str) -> str:
    return f"list_transform({col}, lambda x: round(x, 6))"


@register("m7", f"WITH {EMB_SQL}, {_knn_sql('nn', True)} SELECT cls, id, nid, {rsql('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM nn")
def q_m7(spark, sf):
    """Exact 5 nearest neighbours of every embedding within its class."""
    nn = Sm.knn(_emb(spark, sf), "id", "vec", K, group="cls")
    return nn.select(F.col("cls").cast("int").alias("cls"), "id", "nid", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


def _synth_sql(quota_ctes: str, knn_name: str) -> str:
    key = "CAST(q.id AS VARCHAR) || ':' || CAST(q.s AS VARCHAR) || ':42'"
    return (quota_ctes + f""", ex AS (SELECT id, vec, unnest(range(quota)) AS s FROM quota WHERE quota > 0),
  pick AS (SELECT q.id, q.vec, q.s, {md5_int_sql(key + " || ':nb'")} % {K} AS nb_rank,
                  {md5_int_sql(key + " || ':gap'", 6)} / {float(1 << 24)} AS gap FROM ex q),
  syn AS (SELECT p.id AS source_id, p.s, list_transform(range(1, len(p.vec) + 1), lambda i: p.vec[i] + p.gap * (e.vec[i] - p.vec[i])) AS vec
          FROM pick p JOIN {knn_name} n ON n.id = p.id AND n.rank = p.nb_rank JOIN emb e ON e.id = n.nid)
SELECT CAST(id AS BIGINT) AS id, cls, {_round_vec('vec')} AS vec, false AS synthetic, CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS INTEGER) AS s FROM emb
UNION ALL
SELECT CAST(NULL AS BIGINT), (SELECT cls FROM cnt ORDER BY n, cls LIMIT 1), {_round_vec('vec')}, true, source_id, CAST(s AS INTEGER) FROM syn""")


_CNT = "cnt AS (SELECT cls, count(*) AS n FROM emb GROUP BY cls), mm AS (SELECT min(n) AS n_min, max(n) AS n_maj FROM cnt)"
_SMOTE_Q = (f"WITH {EMB_SQL}, {_CNT}, {_knn_sql('nn', True)}, "
            "mino AS (SELECT e.* FROM emb e WHERE cls = (SELECT cls FROM cnt ORDER BY n, cls LIMIT 1)), "
            "rk AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 8))::BIGINT, id) - 1 AS r FROM mino), "
            "quota AS (SELECT id, vec, CAST((n_maj - n_min) // n_min + CASE WHEN r < (n_maj - n_min) % n_min THEN 1 ELSE 0 END AS BIGINT) AS quota FROM rk, mm)")
_ADASYN_Q = (f"WITH {EMB_SQL}, {_CNT}, {_knn_sql('nn', True)}, {_knn_sql('nall', False)}, "
             "mino AS (SELECT e.* FROM emb e WHERE cls = (SELECT cls FROM cnt ORDER BY n, cls LIMIT 1)), "
             f"ra AS (SELECT n.id, sum(CASE WHEN e.cls <> (SELECT cls FROM cnt ORDER BY n, cls LIMIT 1) THEN 1.0 ELSE 0.0 END) / {float(K)} AS r "
             "FROM nall n JOIN emb e ON e.id = n.nid GROUP BY n.id), "
             "mr AS (SELECT m.id, m.vec, coalesce(ra.r, 0) AS r FROM mino m LEFT JOIN ra USING (id)), "
             "quota AS (SELECT id, vec, CAST(round_even(r / (SELECT sum(r) FROM mr) * (n_maj - n_min), 0) AS BIGINT) AS quota FROM mr, mm)")


def _out(df):
    return df.select(F.col("id"), F.col("cls"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"),
                     "synthetic", "source_id", F.col("s").cast("int").alias("s"))


@register("m5", _synth_sql(_SMOTE_Q, "nn"))
def q_m5(spark, sf):
    """SMOTE: minority embeddings oversampled to the majority count."""
    return _out(Sm.smote(_emb(spark, sf), "id", "vec", "cls"))


@register("m6", _synth_sql(_ADASYN_Q, "nn"))
def q_m6(spark, sf):
    """ADASYN: minority rows near the other class get more synthetic rows."""
    return _out(Sm.adasyn(_emb(spark, sf), "id", "vec", "cls"))
