"""Calibration of the language models."""
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import common as C
from colloquy.llm import langid


def test_limits_come_from_all_training_rows(spark):
    words = ["maison", "belle", "jardin", "soleil", "riviere", "montagne"]
    rows = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 2 + i % 9)) + chr(97 + i % 26) * (i % 7), "fr") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (model,) = langid.fit(docs)
    train = docs.where(C.fold_of(F.col("doc_id")) != 0)
    excess = [r["excess"] for r in langid.predict(train, [model]).collect()]
    assert len(excess) > 3000 and abs(model.limit - np.quantile(excess, langid.CALIBRATED)) < 1e-9


def test_every_counted_gram_is_stored_and_blocks_change_nothing(spark, make, monkeypatch):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "klmnopqr"}
    texts, langs = [], []
    for i in range(150):
        langs.append(rng.choice(sorted(letters)))
        texts.append(" ".join("".join(rng.choices(letters[langs[-1]], k=rng.randint(1, 6))) for _ in range(30)))
    docs = make(texts + [None, "", "xyz é"], langs=langs + ["aa", None, None])
    columns = ["doc_id", "held_out", "lang_pred", "rejected"]

    def result():
        return sorted((*(r[c] for c in columns), *(round(r[c], 9) for c in ("score", "cross_entropy", "excess"))) for r in langid.identify(docs).collect())

    want, rows = result(), docs.where("lang is not null").where(C.fold_of(F.col("doc_id")) != 0).select("lang", "text")
    counted = langid.count(rows, sorted(letters))
    monkeypatch.setattr(langid, "LANGUAGE_GRAMS", 12, raising=False)    # the former cut
    monkeypatch.setattr(langid, "BLOCK_GRAMS", 300)                     # each language is several stretches
    models = langid.estimate(sorted(letters), counted)
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}
    for i, lang in enumerate(sorted(letters)):
        mine = [m for m in models if m.lang == lang]
        loaded = [x for m in mine for x in langid._loaded([m])]
        assert len(mine) > 3 and sum(m.size for m in mine) == sizes[i] == sum(len(m.keys[-1]) for m in loaded) and max(m.size for m in mine) < 600
    assert all(len(m.keys) == 0 for m in models) and len(langid.blocks(models)) > 9
    assert result() == want
