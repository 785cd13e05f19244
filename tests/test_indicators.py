"""Indicator row edge cases and lexicon semantics on hand-made inputs."""
from pyspark.sql import functions as F

from colloquy.operators import indicators as I
from colloquy.operators import lexicon as X
from colloquy.operators.tokens import annotate, sentence_rows
from colloquy.sources.tables import EMOTIONS


def lexicons(spark, valence_rows=(), emotion_rows=()):
    val = spark.createDataFrame(list(valence_rows) or [("zzz", 0, 0)], "word string, value int, line_no long")
    emo = spark.createDataFrame(list(emotion_rows) or [("zzz", 0, 0, 0, 0, 0, 0, 0)],
                                "word string, " + ", ".join(f"{e} int" for e in EMOTIONS) + ", line_no long")
    return val, emo


def test_empty_text_gives_one_row(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    val, emo = lexicons(spark)
    r = I.indicator_row(docs, val, emo, units=X.unit_set(val, emo), with_maps=False).collect()
    assert len(r) == 1
    row = r[0]
    assert row["total_words"] == 0 and row["Score_AFINN"] == 0
    assert row["TTR"] is None and row["adj_rate"] is None and row["joy_rate"] is None
    assert row["unique_concept_density"] == 0.0


def test_duplicate_keys(spark):
    val, emo = lexicons(spark, [("bon", 2, 1), ("bon", 3, 2)],
                        [("peur", 0, 1, 0, 0, 0, 0, 1), ("peur", 1, 0, 0, 0, 0, 0, 2)])
    assert X.last_wins(val, "word", "line_no", ["value"]).first()["value"] == 3
    e = X.first_wins(emo, "word", "line_no", list(EMOTIONS)).first()
    assert e["fear"] == 1 and e["joy"] == 0
    assert X.first_wins_window(emo, "word", "line_no").first()["fear"] == 1


def test_glued_punctuation_not_matched(spark):
    val, _ = lexicons(spark, [("bon", 3, 1)])
    s = sentence_rows(spark.createDataFrame([(1, "Un bon, ok")], "doc_id long, text string"))
    assert X.valence_scores(s, val).count() == 0
    s2 = sentence_rows(spark.createDataFrame([(1, "Un bon jour")], "doc_id long, text string"))
    assert X.valence_scores(s2, val).first()["Score_AFINN"] == 3


def test_valence_worked_example(spark):
    # the lexicon README example: a sentence scores the sum of its listed words
    val, _ = lexicons(spark, [("good", 3, 1)])
    s = sentence_rows(spark.createDataFrame([(1, "Rainy day but still in a good mood")], "doc_id long, text string"))
    assert X.valence_scores(s, val).first()["Score_AFINN"] == 3


def test_zero_duration_efficiency(spark):
    counts = spark.createDataFrame([(1, "A", "u", 2)], "doc_id long, category string, unit string, count long")
    tw = spark.createDataFrame([(1, 10, 0.0)], "doc_id long, total_words long, duration double")
    r = X.concept_measures(counts, tw, F.col("duration")).first()
    assert r["unique_concept_efficiency"] == 0.0 and r["total_concept_efficiency"] == 0.0
    assert r["unique_concept_density"] == 0.1 and r["total_concept_density"] == 0.2


def test_annotator_links_tokens_to_verbs(spark):
    docs = spark.createDataFrame([(1, "Il marchait la maison. Elle dort!")], "doc_id long, text string")
    t = {(r["sent_id"], r["text"]): r for r in annotate(docs).collect()}
    assert t[(0, "marchait")]["pos"] == "VERB" and t[(0, "marchait")]["dep"] == "root"
    assert t[(0, "marchait")]["verb_form"] == "Fin"
    assert t[(0, "Il")]["dep"] == "nsubj" and t[(0, "Il")]["head_id"] == 1
    assert t[(0, "maison")]["dep"] == "obj" and t[(0, "maison")]["head_id"] == 1
    assert t[(0, ".")]["is_punct"] and t[(1, "!")]["pos"] == "PUNCT"


def test_array_row_equals_token_table_row(spark):
    """The array path against the token-table aggregates, both unit modes, maps included."""
    import random

    rng = random.Random(11)
    pool = ("Le la chien maison dort mangeons rapidement not that qui who because The Dog runs is gehen haus wichtig 12 3 x1 zu é ß "
            "nation nations marchait marcher , ; ! . ? \n").split(" ")
    texts = ["", "...", "x", "dort dort dort", None] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    val, emo = lexicons(spark, [("dort", 2, 1), ("dort", 3, 2), ("dog", -1, 3), (".", 4, 4)], [("chien", 1, 0, 0, 1, 0, 0, 1), ("dog", 0, 1, 0, 0, 0, 0, 2)])
    dic = spark.createDataFrame([("chien", "chien", None, "chien", None, "v", 0), ("Dog", None, "Dog", None, None, "v", 1), ("!", None, None, None, "!", "v", 2)],
                                "mot string, ACTEURS string, OBJETS string, LIEUX string, ACTIONS string, provenance string, _line long")
    for mode in ({"dictionary": dic}, {"units": X.unit_set(val, emo)}):
        a = {r["doc_id"]: r.asDict(recursive=True) for r in I.indicator_row(docs, val, emo, **mode).collect()}
        b = {r["doc_id"]: r.asDict(recursive=True) for r in I.indicator_row(docs, val, emo, tokens=annotate(docs), **mode).collect()}
        assert sorted(a) == sorted(b)
        for i, row in a.items():
            for c, x in row.items():
                y = b[i][c]
                assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9), (i, texts[i], c, x, y)


def test_verb_links_are_linear_in_the_sentence(spark):
    """Four times the words of one sentence cost about four times, not sixteen times."""
    import time

    def seconds(n):
        docs = spark.range(4).select(F.col("id").alias("doc_id"), F.lit(" ".join(["marchait", "maison", "the", "dog"] * (n // 4))).alias("text"))
        best = 1e9
        for _ in range(3):
            t = time.time()
            annotate(docs).agg(F.sum("head_id")).collect()
            best = min(best, time.time() - t)
        return best

    small, large = seconds(20_000), seconds(80_000)
    assert large < 8 * small


def test_no_window_or_token_shuffle_in_the_indicator_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    val, emo = lexicons(spark)
    p = I.indicator_row(docs, val, emo, units=X.unit_set(val, emo))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in p and "Window" not in p and p.count("FileScan parquet") == 1
