import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts: ids count up, other columns are filled; extra columns have clashing names."""

    def run(texts, ids=None, langs=None, partitions=3, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, g, "src0", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs, strict=True)]
        df = spark.createDataFrame(rows, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)
        if extra:
            for name in ("kept", "score", "rep", "n", "u", "v", "salt", "item_id", "bands"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return run


def prose(rng: random.Random, words: int) -> str:
    syllables = "the and or ing tion er an re on at en ou ha st th ly".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def writer():
    return prose


#: Texts that every operator has to stand: null, empty, blanks, one word, symbols, a very long one, repeats.
@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [None, "", " \n\t ", "word", "###", "日本語 текст ß", "a b　c", "\U0001f600 x", long, long, "a " * 50, "tie tie", "tie tie"]
