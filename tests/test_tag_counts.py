"""Tag counters of a text against its token rows, without a fold over its tokens."""
from collections import Counter

from colloquy.functions import text as T
from colloquy.operators import arrays
from colloquy.operators.tokens import annotate


def test_tag_counts_equal_the_token_rows(spark):
    docs = spark.createDataFrame([(1, "The quick dog runs. Et il mange, 12 fois!"), (2, ""), (3, "Paris, et Rome et Berlin."), (4, "!!")], "doc_id long, text string")
    rows = Counter((r["doc_id"], r["pos"]) for r in annotate(docs).select("doc_id", "pos").collect())
    for conj in (("CONJ",), ("CCONJ", "SCONJ", "CCONJ")):
        st = arrays.with_statistics(docs, conj_tags=conj)
        got = {r["doc_id"]: r["c"].asDict() for r in st.selectExpr("doc_id", "st.st.counts c").collect()}
        for i in range(1, 5):
            want = {"n_punct": rows[i, "PUNCT"], **{f"n_{t}": rows[i, t] if t != "CONJ" else sum(rows[i, c] for c in set(conj)) for t in T.RATE_TAGS}}
            assert got[i] == want
        assert sum(rows.values()) > 15 and "aggregate(" not in arrays.text_statistics("s", conj)
