"""Named queries of the report rows and the feature layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import features as Fe
from colloquy.operators import indicators as I
from colloquy.operators import report as Rp
from colloquy.plans.registry import register, rounded, rsql
from colloquy.plans.text_queries import _lexicons, _tok_sql, _wide_sql
from colloquy.operators.lexical import REFERENCE_BRUNET_A
from colloquy.sources import tables as S

NUMERIC = I.INDICATOR_COLUMNS
WIDE = _tok_sql(_wide_sql(REFERENCE_BRUNET_A, True, False), lex=True)
PART_SQL = (f"WITH wide AS ({WIDE}), part AS (SELECT w.*, w.doc_id AS participant_id, l.toxic AS phq_binary, l.quality, "
            "CAST(CASE WHEN w.doc_id % 10 <= 1 THEN 1 WHEN w.doc_id % 10 = 2 THEN 2 ELSE 3 END AS INTEGER) AS partof "
            "FROM wide w JOIN labels l USING (doc_id))")
CORR_COLS = NUMERIC


def _indicators(spark, sf, labelled_only: bool = True):
    val, emo, d = _lexicons(spark, sf)
    docs = S.spread(S.documents(spark, sf))
    if labelled_only:
        docs = docs.join(S.read(spark, sf, "labels", "doc_id"), "doc_id", "left_semi")
    return rounded(I.indicator_row(docs, val, emo, dictionary=d, with_maps=False))


def _participants(spark, sf):
    """Participant table as stored: indicator row JSON-encoded."""
    ind = Fe.encode_indicators(_indicators(spark, sf), maps=())
    lab = S.read(spark, sf, "labels", "doc_id", "toxic", "quality")
    return (ind.join(lab, "doc_id")
               .select(F.col("doc_id").alias("participant_id"), F.col("toxic").alias("phq_binary"), "quality",
                       S.split_of(F.col("doc_id")).alias("partof"), "indicateur"))


def _features(spark, sf):
    return Fe.drop_prefixed(Fe.flatten_indicators(_participants(spark, sf)))


# --- report ------------------------------------------------------------------------------------

def _fixed_sql(x: str, d: int) -> str:
    n = f"CAST(floor(abs({x}) * {float(10 ** d)} + 0.5) AS BIGINT)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    if d == 0:
        return f"({sign} || CAST({n} AS VARCHAR))"
    return f"({sign} || CAST({n} // {10 ** d} AS VARCHAR) || '.' || lpad(CAST({n} % {10 ** d} AS VARCHAR), {d}, '0'))"


def _shown_sql(fmt: str) -> str:
    if fmt == "pct1":
        return _fixed_sql("value * 100", 1) + " || '%'"
    if fmt == "pct2":
        return _fixed_sql("value * 100", 2) + " || ' %'"
    if fmt == "d4":
        return _fixed_sql("value", 4)
    if fmt == "d2":
        return _fixed_sql("value", 2)
    return _fixed_sql("value", 0)


_REPORT_UNION = " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS section, '{i}' AS indicator, '{lbl.replace(chr(39), chr(39) * 2)}' AS label, "
    f"CAST({i} AS DOUBLE) AS value, CASE WHEN {i} IS NULL THEN NULL ELSE {_shown_sql(f).replace('value', f'CAST({i} AS DOUBLE)')} END AS shown FROM wide"
    for s, i, lbl, f in Rp.REPORT_ROWS)


@register("f12", f"WITH wide AS ({WIDE}) {_REPORT_UNION}")
def q_f12(spark, sf):
    """Report rows: the indicator row unpivoted, labelled and formatted (F10 + F12)."""
    return Rp.report_rows(_indicators(spark, sf, labelled_only=False))


@register("f10", f"WITH wide AS ({WIDE}), r AS ({_REPORT_UNION}) SELECT doc_id, indicator, shown FROM r WHERE section = 'emotion'")
def q_f10(spark, sf):
    """Formatted emotion cells (percent, two decimals)."""
    r = Rp.report_rows(_indicators(spark, sf, labelled_only=False))
    return r.filter(F.col("section") == "emotion").select("doc_id", "indicator", "shown")


@register("f11", f"WITH wide AS ({WIDE}) SELECT doc_id, Score_AFINN, CASE WHEN Score_AFINN > 0 THEN 'positif' "
                 "WHEN Score_AFINN < 0 THEN 'négatif' ELSE 'neutre' END AS sentiment FROM wide")
def q_f11(spark, sf):
    """Sentiment word from the sign of the valence score."""
    ind = _indicators(spark, sf, labelled_only=False)
    return ind.select("doc_id", "Score_AFINN", Rp.sentiment(F.col("Score_AFINN")).alias("sentiment"))


@register("p22", f"WITH wide AS ({WIDE}), l AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS series, CAST({c} AS DOUBLE) AS value FROM wide" for c in Rp.CHART_SERIES["emotion_pie"])
    + ") SELECT * FROM l WHERE value > 0")
def q_p22(spark, sf):
    """Non-zero slices of the emotion chart."""
    return Rp.chart_slices(_indicators(spark, sf, labelled_only=False))


@register("f9", f"WITH wide AS ({WIDE}), l AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS series, CAST({c if c in NUMERIC else '0.0'} AS DOUBLE) AS value FROM wide"
    for c in Rp.CHART_SERIES["syntax_bar"]) + ") SELECT * FROM l WHERE value > 0")
def q_f9(spark, sf):
    """Syntax chart slices; a series missing from the row reads as 0 and is dropped."""
    return Rp.chart_slices(_indicators(spark, sf, labelled_only=False), "syntax_bar")


# --- participants and features ---------------------------------------------------------------

_NUM_SEL = ", ".join(NUMERIC)


@register("p16", f"{PART_SQL} SELECT participant_id, phq_binary, quality, partof, {_NUM_SEL} FROM part")
def q_p16(spark, sf):
    """Participant indicators decoded from their stored JSON into one column per field."""
    return _features(spark, sf)


@register("p17", f"{PART_SQL} SELECT participant_id, {_NUM_SEL} FROM part")
def q_p17(spark, sf):
    """Top-level expansion of the indicator struct."""
    p = _participants(spark, sf)
    s = p.select("participant_id", F.from_json("indicateur", Fe.indicator_schema()).alias("ind"))
    return Fe.top_level(s, "ind").drop("has_unit", "ratio_unit")


@register("p11", f"{PART_SQL} SELECT participant_id, {_NUM_SEL} FROM part")
def q_p11(spark, sf):
    """Feature table without the unit-map columns (prefix drop)."""
    return _features(spark, sf).drop("phq_binary", "quality", "partof")


@register("p14", f"{PART_SQL} SELECT participant_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC) + " FROM part")
def q_p14(spark, sf):
    """Missing indicator values filled with 0."""
    f = _features(spark, sf).drop("phq_binary", "quality", "partof")
    return Fe.fill_zero(f, NUMERIC)


_TRAIN_MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in NUMERIC)


@register("p15", f"{PART_SQL}, mt AS (SELECT {_TRAIN_MEANS} FROM part WHERE partof = 3) SELECT participant_id, "
                 + ", ".join(f"{rsql(f'coalesce({c}, m_{c})')} AS {c}" for c in NUMERIC) + " FROM part, mt WHERE partof = 1")
def q_p15(spark, sf):
    """Test rows with missing values filled by the train means."""
    f = _features(spark, sf)
    stats = Fe.column_stats(f.filter("partof = 3"), NUMERIC)
    return rounded(Fe.fill_means(f.filter("partof = 1").select("participant_id", *NUMERIC), stats))


@register("p12", f"{PART_SQL}, mt AS (SELECT {_TRAIN_MEANS} FROM part WHERE partof = 3) SELECT participant_id, "
                 + ", ".join(f"{rsql(f'coalesce({c}, m_{c})') if c not in ('TTR', 'Brunet_index') else rsql(f'm_{c}')} AS {c}"
                             for c in NUMERIC) + " FROM part, mt WHERE partof = 1")
def q_p12(spark, sf):
    """Test columns aligned to the train columns; two columns absent from test take the train mean."""
    f = _features(spark, sf)
    stats = Fe.column_stats(f.filter("partof = 3"), NUMERIC)
    test = f.filter("partof = 1").select("participant_id", *NUMERIC).drop("TTR", "Brunet_index")
    return rounded(Fe.fill_means(test, stats))


@register("p13", "SELECT doc_id, TRY_CAST(CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS DOUBLE) AS n_chars FROM documents")
def q_p13(spark, sf):
    """Numeric coercion of a text column, failures to null."""
    d = S.read(spark, sf, "documents", "doc_id", "n_chars")
    d = d.withColumn("n_chars", F.concat(F.col("n_chars").cast("string"),
                                         F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")))
    return Fe.coerce_numeric(d, ["n_chars"])


@register("p19", "SELECT doc_id AS participant_id, toxic AS phq_binary, quality, "
                 "CAST(CASE WHEN doc_id % 10 <= 1 THEN 1 WHEN doc_id % 10 = 2 THEN 2 ELSE 3 END AS INTEGER) AS partof "
                 "FROM documents JOIN labels USING (doc_id)")
def q_p19(spark, sf):
    """Numeric columns of the participant table only."""
    p = S.participants(spark, sf)
    return p.select(*Fe.numeric_columns(p))


@register("p24", f"{PART_SQL} SELECT participant_id, list_transform([" + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in NUMERIC)
          + "], lambda x: round(x, 6)) AS features FROM part")
def q_p24(spark, sf):
    """Feature vector of the 34 numeric indicators (nulls as 0)."""
    f = Fe.fill_zero(_features(spark, sf), NUMERIC)
    return f.select("participant_id", F.transform(Fe.vector_column(NUMERIC), lambda x: F.round(x, 6)).alias("features"))


@register("m1", f"{PART_SQL}, h AS (SELECT participant_id, phq_binary, ('0x' || substr(md5(CAST(participant_id AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h FROM part), "
                "r AS (SELECT *, row_number() OVER (PARTITION BY phq_binary ORDER BY h, participant_id) - 1 AS rk, "
                "count(*) OVER (PARTITION BY phq_binary) AS n FROM h) "
                "SELECT participant_id, phq_binary, rk < ceil(n * 0.3) AS is_test FROM r")
def q_m1(spark, sf):
    """Stratified 70/30 split, seeded by md5 of the id."""
    f = _features(spark, sf).select("participant_id", "phq_binary")
    return Fe.stratified_split(f, "phq_binary", "participant_id").select("participant_id", "phq_binary", "is_test")


@register("m2", "WITH h AS (SELECT DISTINCT conv_id, ('0x' || substr(md5(CAST(conv_id AS VARCHAR) || ':42'), 1, 8))::BIGINT AS h "
                "FROM conversations WHERE role IN ('assistant', 'user')), r AS (SELECT *, row_number() OVER (ORDER BY h, conv_id) - 1 AS rk, "
                "count(*) OVER () AS n FROM h) SELECT conv_id, rk < ceil(n * 0.5) AS is_test FROM r")
def q_m2(spark, sf):
    """Seeded 50/50 split of the conversations."""
    convs = S.turns(spark, sf).select("conv_id").distinct()
    return Fe.random_split(convs, "conv_id").select("conv_id", "is_test")


_STD = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)


@register("m3", f"{PART_SQL}, st AS (SELECT {_STD} FROM part WHERE partof = 3) SELECT participant_id, "
                + ", ".join(f"{rsql(f'CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END')} AS {c}" for c in NUMERIC)
                + " FROM part, st WHERE partof = 3")
def q_m3(spark, sf):
    """Z-scores of the train features with population deviation (constant column → 0)."""
    f = _features(spark, sf).filter("partof = 3").select("participant_id", *NUMERIC)
    return rounded(Fe.zscore(f, Fe.column_stats(f, NUMERIC)))


@register("m4", "SELECT doc_id AS participant_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label, "
                "CAST(dense_rank() OVER (ORDER BY CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END) - 1 AS DOUBLE) AS label_idx FROM labels")
def q_m4(spark, sf):
    """Label encoding with sorted classes."""
    lab = S.read(spark, sf, "labels", "doc_id", "toxic").select(
        F.col("doc_id").alias("participant_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label"))
    return Fe.label_indexer("label").fit(lab).transform(lab)


@register("m8", "WITH c AS (SELECT toxic, count(*) AS n_c FROM labels GROUP BY 1) SELECT doc_id AS participant_id, l.toxic AS phq_binary, "
                + rsql("(SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * n_c)") + " AS weight FROM labels l JOIN c USING (toxic)")
def q_m8(spark, sf):
    """Balanced sample weights n / (classes · n_c)."""
    lab = S.read(spark, sf, "labels", "doc_id", "toxic").select(
        F.col("doc_id").alias("participant_id"), F.col("toxic").alias("phq_binary"))
    return rounded(Fe.balanced_weights(lab, "phq_binary"))


@register("m9", "WITH c AS (SELECT toxic, count(*) AS n_c FROM labels GROUP BY 1), w AS (SELECT l.toxic, "
                "(SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * n_c) AS weight FROM labels l JOIN c USING (toxic)) "
                f"SELECT {rsql('sum(weight) / sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)')} AS scale_pos_weight FROM w")
def q_m9(spark, sf):
    """Positive-class scale Σ weights / positives."""
    lab = S.read(spark, sf, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "phq_binary")
    return rounded(Fe.positive_scale(Fe.balanced_weights(lab, "phq_binary"), "phq_binary"))


@register("j10", f"{PART_SQL} SELECT participant_id, phq_binary, total_words, TTR FROM part")
def q_j10(spark, sf):
    """Indicators joined to the label on the participant id."""
    ind = _indicators(spark, sf)
    lab = S.read(spark, sf, "labels", "doc_id", "toxic")
    return ind.join(lab, "doc_id").select(F.col("doc_id").alias("participant_id"),
                                          F.col("toxic").alias("phq_binary"), "total_words", "TTR")


@register("j11", f"{PART_SQL} SELECT e.vec_id AS participant_id, list_transform(list_concat(CAST(e.embedding AS DOUBLE[]), "
                 "[CAST(coalesce(p.TTR, 0) AS DOUBLE), CAST(coalesce(p.Brunet_index, 0) AS DOUBLE)]), lambda x: round(x, 6)) AS fused "
                 "FROM embeddings e JOIN part p ON e.vec_id = p.participant_id")
def q_j11(spark, sf):
    """Text vector ⋈ tabular features on the id, concatenated."""
    f = Fe.fill_zero(_features(spark, sf), ["TTR", "Brunet_index"]).select(
        "participant_id", F.array(F.col("TTR").cast("double"), F.col("Brunet_index").cast("double")).alias("tab"))
    e = S.read(spark, sf, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("participant_id"), F.col("embedding").cast("array<double>").alias("emb"))
    j = Fe.join_vectors(e, f, "participant_id", "emb", "tab")
    return j.select("participant_id", F.transform("fused", lambda x: F.round(x, 6)).alias("fused"))


@register("a29", "SELECT toxic AS phq_binary, count(*) AS n FROM labels GROUP BY 1")
def q_a29(spark, sf):
    """Class distribution."""
    lab = S.read(spark, sf, "labels", "toxic").withColumnRenamed("toxic", "phq_binary")
    return Fe.class_distribution(lab, "phq_binary")


@register("a30", f"{PART_SQL}, st AS (SELECT {_STD} FROM part WHERE partof = 3) " + " UNION ALL ".join(
    f"SELECT '{c}' AS indicator, {rsql(f'm_{c}')} AS mean, {rsql(f's_{c}')} AS std FROM st" for c in NUMERIC))
def q_a30(spark, sf):
    """Train column means and population deviations."""
    f = _features(spark, sf).filter("partof = 3")
    stats = Fe.column_stats(f, NUMERIC)
    rows = [(c, m, s) for c, (m, s) in stats.items()]
    return rounded(spark.createDataFrame(rows, "indicator string, mean double, std double"))


@register("a31", "WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), "
                 "m AS (SELECT label, i, avg(x) AS mx FROM e GROUP BY 1, 2) "
                 "SELECT label, list_transform(list(mx ORDER BY i), lambda v: round(v, 6)) AS mean_vector FROM m GROUP BY label")
def q_a31(spark, sf):
    """Element-wise mean vector of the embeddings of each label."""
    e = S.read(spark, sf, "embeddings", "label", "embedding")
    return Fe.mean_pool(e, "label", "embedding").select("label", F.transform("mean_vector", lambda v: F.round(v, 6)).alias("mean_vector"))


@register("a32", f"{PART_SQL}, c AS (SELECT " + ", ".join(
    f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate((a, b) for j, a in enumerate(CORR_COLS) for b in CORR_COLS[j + 1:]))
    + " FROM part) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rsql(f'CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END')} AS corr FROM c"
    for i, (a, b) in enumerate((a, b) for j, a in enumerate(CORR_COLS) for b in CORR_COLS[j + 1:])))
def q_a32(spark, sf):
    """Pearson correlation of every pair of indicators over the participants."""
    c = Fe.correlations(_features(spark, sf), CORR_COLS)
    return rounded(c.withColumn("corr", F.when(F.isnan("corr"), None).otherwise(F.col("corr"))))


# quartiles of values with six digits have eight
@register("a33", f"{PART_SQL} " + " UNION ALL ".join(
    f"SELECT phq_binary, '{c}' AS indicator, {rsql(f'min({c})', 8)} AS min, {rsql(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 8)} AS q1, "
    f"{rsql(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 8)} AS median, {rsql(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 8)} AS q3, "
    f"{rsql(f'max({c})', 8)} AS max FROM part GROUP BY phq_binary HAVING count({c}) > 0" for c in NUMERIC))
def q_a33(spark, sf):
    """Exact quartiles, min and max of every indicator per class."""
    return rounded(Fe.distribution_by_class(_features(spark, sf), "phq_binary", NUMERIC), 8)
