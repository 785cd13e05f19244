"""Token rows without links, heads read in the sentence's row, look-ups of counted words."""
from collections import Counter

from pyspark.sql import functions as F

from colloquy.operators import lexical as L
from colloquy.operators import lexicon as X
from colloquy.operators import syntax as Y
from colloquy.operators.tokens import annotate, tagged
from colloquy.sources import tables as S

TEXTS = [(1, "The doctor has finished. Why would Anna be walking, when 3 birds sing?\nLa maison est belle!"), (2, ""), (3, None),
         (4, "Walking. 12 ... Él no está aquí; der Hund singer who finished"), (4, "the the cat finished walking the cat")]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_tagged_rows_are_the_annotated_ones(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    columns = ["doc_id", "sent_id", "text", "lemma", "pos", "verb_form", "is_punct", "is_stop", "is_space"]
    assert rows(tagged(docs), *columns) == rows(annotate(docs), *columns)


def test_heads_come_without_a_join(spark):
    docs = spark.createDataFrame(TEXTS[:4], "doc_id long, text string")
    columns = ["doc_id", "sent_id", "child_id", "head_id", "child_dep", "child_pos", "head_pos", "head_is_punct"]
    found = Y.children_heads(annotate(docs, heads=True))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, *columns) == rows(Y.children_heads(annotate(docs)), *columns)


def test_units_are_counted_before_the_look_up(spark):
    tokens = spark.createDataFrame([(1, w) for w in ["Cat", "cat", "dog", "cow"] * 3] + [(2, "cat"), (None, "dog")], "doc_id long, lemma string")
    units = spark.createDataFrame([("cat",), ("dog",)], "unit string")
    dictionary = spark.createDataFrame([("cat", "cat", None, "cat", None, 1), ("dog", None, "dog", None, None, 2)],
                                       "mot string, ACTEURS string, OBJETS string, LIEUX string, ACTIONS string, _line int")
    flat = X.unit_counts(tokens, units=units)
    assert rows(flat, "doc_id", "unit", "count") == Counter([(1, "cat", 6), (1, "dog", 3), (2, "cat", 1), (None, "dog", 1)])
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(1)")  # the join stands above the count
    by = X.unit_counts(tokens, dictionary=dictionary)
    assert rows(by, "doc_id", "category", "unit", "count") == Counter([(1, "ACTEURS", "cat", 6), (1, "LIEUX", "cat", 6), (1, "OBJETS", "dog", 3),
                                                                        (2, "ACTEURS", "cat", 1), (2, "LIEUX", "cat", 1), (None, "OBJETS", "dog", 1)])
    ratios = X.unit_ratios(by, spark.createDataFrame([(1, 12), (2, 1)], "doc_id long, total_words long"))
    assert rows(ratios, "doc_id", "unit", "ratio") == Counter([(1, "cat", 0.5), (1, "dog", 0.25), (2, "cat", 1.0)])


def test_text_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "SPREAD_ROWS", 10)
    assert S.spread(spark.range(95).coalesce(1)).rdd.getNumPartitions() == 10
    assert S.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_token_table_is_not_kept(spark, tmp_path):
    from colloquy.plans import text_queries as Q
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not Q._tokens(spark, str(tmp_path)).storageLevel.useMemory
    assert L.token_counts(Q._tagged(spark, str(tmp_path))).filter(F.col("doc_id") == 4).first()["n_doc"] == 23
