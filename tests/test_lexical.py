"""Hand-made token tables (FIXTURES D): frequency statistics and lexical diversity."""
import math

from pyspark.sql import functions as F

from colloquy.operators import lexical as L
from colloquy.operators import syntax as Y

COLS = "doc_id long, sent_id int, tok_id int, text string, lemma string, pos string, verb_form string, " \
       "dep string, head_id int, is_punct boolean, is_stop boolean, is_space boolean"


def toks(spark, rows):
    """rows: (doc, sent, text[, pos[, verb_form]])"""
    out, pos_in = [], {}
    for r in rows:
        doc, sent, text = r[:3]
        pos = r[3] if len(r) > 3 else "NOUN"
        vf = r[4] if len(r) > 4 else None
        i = pos_in.get((doc, sent), 0)
        pos_in[(doc, sent)] = i + 1
        out.append((doc, sent, i, text, text.lower(), pos, vf, "dep", None, pos == "PUNCT", False, False))
    return spark.createDataFrame(out, COLS)


def test_frequency_stats(spark):
    t = toks(spark, [(1, 0, w) for w in "a a a b b c".split()])
    r = L.frequency_stats(L.text_frequencies(t)).first()
    assert r["mean_freq_words"] == 2.0
    assert r["range_freq_words"] == 2
    assert math.isclose(r["std_freq_words"], math.sqrt(2 / 3))


def test_hapax_measures(spark):
    t = toks(spark, [(1, 0, w) for w in "p p p q q r".split()])        # N=6, V=3, v1=1
    r = L.lexical_diversity(t).first()
    assert (r["n_doc"], r["V"], r["v1"]) == (6, 3, 1)
    assert math.isclose(r["Brunet_index"], 6 ** (3 ** -0.165))
    assert math.isclose(r["Honore_statistic"], 100 * math.log(6) / (1 - 1 / 6))
    assert math.isclose(r["TTR"], 1 / 6)


def test_all_hapax_honore_null(spark):
    t = toks(spark, [(1, 0, w) for w in "u v w".split()])
    assert L.lexical_diversity(t).first()["Honore_statistic"] is None


def test_no_verb_rates_zero(spark):
    t = toks(spark, [(1, 0, "x"), (1, 0, "y")])
    r = Y.syntax_rates(t).first()
    assert r["verb_conj_rate"] == 0.0 and r["verb_inf_rate"] == 0.0


def test_repetition_within_sentence(spark):
    t = toks(spark, [(1, 0, "x"), (1, 0, "x"), (1, 1, "x"), (1, 1, "x"), (1, 1, "y")])
    assert Y.syntax_rates(t).first()["repetition_cons_rate"] == 2


def test_verb_forms(spark):
    t = toks(spark, [(1, 0, "go", "VERB", "Inf"), (1, 0, "went", "VERB", "Fin"), (1, 0, "cat"), (1, 0, ".", "PUNCT")])
    r = Y.syntax_rates(t).first()
    assert r["verb_inf_rate"] == 0.5 and r["verb_conj_rate"] == 0.5
    assert r["total_words"] == 3 and math.isclose(r["verb_rate"], 2 / 3)
