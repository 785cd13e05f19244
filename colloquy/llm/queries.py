"""The registered queries of this subpackage: thin readers of the tables around the operators."""

from __future__ import annotations

from colloquy.llm import chat, crosstoken, decontaminate, langid, mainpage, neardup, packing, pii, quality, runs, secrets, toxicity, warc
from colloquy.llm.common import table


def op7_warc(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    """All conversations, and one whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_chats(turns.unionByName(own))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op10_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_mainpage(spark, sf_dir):
    return mainpage.extract(table(spark, sf_dir, "pages"))


def op12_crosstoken(spark, sf_dir):
    return crosstoken.align_tokens(table(spark, sf_dir, "documents"))


def op13_runs(spark, sf_dir):
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_neardup, op4_packing, op5_chat, op6_toxicity, op7_warc, op8_secrets, op9_pii, op10_langid,
                                op11_mainpage, op12_crosstoken, op13_runs)}

_OP7 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     f as (select payload_digest, max(page_id) as first_id from p where payload_bytes >= 1000 group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when first_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from p left join f using (payload_digest)
"""
_OP1 = r"""
with lower_case as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lower_case),
     i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     i_at as (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0),
     i_win as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as win from i_at),
     sizes as (select distinct n from i_win),
     d_at as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d join sizes on len(w) >= n),
     hit as (select doc_id, p, n, item_id from (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win from d_at) join i_win using (n, win)),
     covered as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
     listed as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join listed using (doc_id)
"""
ORACLES: dict[str, str] = {"op1_decontaminate": _OP1, "op7_warc": _OP7}
