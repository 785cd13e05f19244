"""Packing, chats, archives and the pipeline: exact round trips and brute force."""
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import chat, packing, warc
from colloquy.llm import common as C


def reference_encoder():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_file(odd_texts, writer):
    ids, mine = reference_encoder(), packing.Encoder()
    rng = random.Random(9)
    spaces = ["a  b", " a", "a \n b", "a\n\n  b ", "\t x\u00a0 y  ", "it's 'll  don't", "   ", "x\u3000 y \u2003z", "<|endoftext|> <|endoftext|>", "a <|endoftext|>", "1 234  5.6"]
    mixed = ["".join(rng.choice(" \n\tab'1.é\u00a0") for _ in range(60)) for _ in range(200)]
    for t in [x for x in odd_texts if x] + spaces + mixed + [writer(rng, 300)]:
        assert mine.encode(t).tolist() == ids(t)
        assert "".join(packing.pieces(t)) == t


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 2047) for _ in range(400)]
    k = -(-sum(sizes) // 2048)
    windows = packing.differencing(sizes, k)
    assert sorted(i for w in windows for i in w) == list(range(400)) and len(windows) == k
    load = [sum(sizes[i] for i in w) for w in windows]
    assert max(load) - min(load) < 700
    small = [rng.randint(1, 256) for _ in range(2000)]
    windows = packing.windows_of(small, 2048)
    load = [sum(small[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(2000))
    assert max(load) <= 2048 and max(load) - min(load) < 32 and len(load) <= -(-sum(small) // 2048) + 2
    # capacity is met by raising the count: three of 1500 don't fit two windows of 2250
    assert len(packing.windows_of([1500] * 3, 2250)) == 3
    for sizes in ([], [5], [2047], [2048, 2048], [1] * 3000, [2047] * 7):
        assert sorted(i for w in packing.windows_of(sizes, 2048) for i in w) == list(range(len(sizes)))


def test_windows_of_a_group_are_near_equal_and_no_later_step_moves_pieces():
    rng = np.random.default_rng(4)
    packer = packing.Packer(0, packing.CAPACITY, with_ids=True)
    for d in range(1000):
        packer.add(d, rng.integers(2, 50_000, rng.integers(1, 3000)).astype("<u4"))
    packer.flush()
    load = defaultdict(int)
    for r in packer.rows:
        load[r[5]] += r[2]
    groups = [n for n in load.values() if n < packing.CAPACITY]
    assert all(n <= packing.CAPACITY for n in load.values()) and sum(load.values()) > 0.97 * packing.CAPACITY * len(load)
    assert np.percentile(groups, 5) > 0.95 * packing.CAPACITY


def test_pack_round_trip(make, odd_texts, writer):
    rng = random.Random(2)
    texts = list(odd_texts) + [writer(rng, rng.choice([3, 50, 400, 3000])) for _ in range(120)]
    rows = packing.pack(make(texts, extra=True), with_ids=True).collect()
    ids = reference_encoder()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        got = [x for r in sorted(by_doc[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert got == ids(t or "") + [1] and all(r["doc_tokens"] == len(got) for r in by_doc[i])
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= tokens / packing.CAPACITY * 1.02 + 2 * 3  # two windows a task beside
    assert packing.pack(make([])).count() == 0


def test_chats_read_back(spark, odd_texts):
    said = "</s>[INST] ok [/INST]"
    rng = random.Random(3)
    noise = ["".join(rng.choice(["\\", "</s>", "[INST]", "<s>", "a", " ", "<<SYS>>", "[/INST]", "é"]) for _ in range(12)) for _ in range(40)]
    assert all(chat.unescape(chat.escape(t)) == t for t in noise)
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (None, 0, "user", "x"), (None, 1, None, None), (5, None, "assistant", "b"), (5, 0, "<s>", "c")]
    rows += [(1, i, rng.choice(["user", "assistant", "system"]), t) for i, t in enumerate([*odd_texts, *noise])]
    rows += [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).selectExpr("*", "1 as ids", "'m' as mask")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((-1 if n is None else n, role or "", "" if text is None else text))
    assert set(got) == set(turns)
    for c, t in turns.items():
        if c != 2:
            t.sort(key=lambda x: x[0])
        else:
            t.sort(key=lambda x: hashlib.sha256(x[2].encode()).hexdigest())
        loss = "".join(x[2] for x in t if x[1] == "assistant")
        assert got[c]["n_turns"] == len(t) and got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest()
    assert got[-1]["formatted_chars"] > 2 * len(said)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_mask_covers_assistant_texts_only():
    codec = chat.Codec()
    ids, mask = codec.turn("assistant", "hello </s> there")
    assert codec.text(ids[mask == 1]) == "hello \\</s> there" and mask[0] == mask[-1] == 0
    assert not codec.turn("user", "hello")[1].any() and codec.read(ids) == ("assistant", "hello </s> there")


def page_rows():
    rng = random.Random(4)
    big, same = "é" * 600, "".join(rng.choice("abc<>/ ") for _ in range(5000))
    noise = ["".join(chr(rng.randint(32, 0x2FFF)) for _ in range(rng.choice([0, 10, 3000, 60_000]))) for _ in range(40)]
    return [(1, "http://a/ä b", same), (9, None, same), (4, "u", same), (2, "u", big), (3, "u", big), (5, "u", "short"), (6, "u", "short"),
            (7, "u", None), (8, "u\nv", ""), (None, "u", same), (10, "u", "x"), (10, "u", "x"), *((100 + i, "n", t) for i, t in enumerate(noise))]


def expected_records(rows):
    best = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        first = best.get(p)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if first is None or first == i else "revisit", None if first in (None, i) else first))
    return sorted(out, key=str)


def test_archives_round_trip_in_tiny_ranges(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "'x' as digest", "1 as same")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "700"):  # whole files; ranges that cut most records
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = C.shared_dir(spark, "test-warc")
            warc.write(pages, path)
            got = [tuple(r)[:5] for r in warc.read(spark, path).collect()]
            assert sorted(got, key=str) == expected_records(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # what was written are ordinary gzip members
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content").collect()
    text = b"".join(gzip.decompress(bytes(r[0])) for r in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_false_magic_and_large_members():
    data = warc.record(1, "u", warc.MAGIC * 5 + b"x" * 100, "0", None).replace(b"sha1:0", b"sha1:" + hashlib.sha1(warc.MAGIC * 5 + b"x" * 100).hexdigest().encode())
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magic stands in the compressed bytes
    stored = pack.compress(data) + pack.flush()
    stretches = stored.split(warc.MAGIC)[1:]
    assert len(stretches) == 6
    joiner, found = warc.Joiner(), []
    for i, s in enumerate([*stretches, *stretches]):
        member, lost = joiner.feed(i, s)
        assert not lost
        found += [member] if member else []
    assert found == [data, data] and warc.parse(data)[0] == 1
    assert warc.Joiner().feed(0, stretches[1]) == (None, [(0, stretches[1])])
    large = warc.member(b"a" * (1 << 24))
    assert large[-1] == 0 and gzip.decompress(large) == b"a" * (1 << 24)


def test_pipeline_stages(spark, tmp_path, writer):
    rng = random.Random(5)
    insults = ["blockhead", "numskull", "dimwit"]
    texts, toxic = [], []
    for i in range(400):
        words = writer(rng, 60).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo"
    clean = [i for i in range(400) if not toxic[i]]
    copy_of, leak, secret = clean[3], clean[10], clean[20]
    texts[leak] += " " + item.upper()
    texts[secret] += " token = 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    texts += [texts[copy_of], texts[copy_of] + " tail", None, ""]
    toxic += [0, 0, 0, 0]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic[:400])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = C.stored(stage(spark, step, str(tmp_path)), name.replace(" ", "-"))
        assert out.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in out.collect()})
        step = out
    everyone = set(range(len(texts)))
    assert everyone - set(seen[0]) == {i for i in range(400) if toxic[i]}
    assert set(seen[0]) - set(seen[1]) == {400, 401}
    assert set(seen[1]) - set(seen[2]) == {leak}
    assert set(seen[2]) == set(seen[3]) and "4d44c79e" not in seen[3][secret]
    assert all(seen[3][i] == texts[i] for i in seen[3] if i != secret)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(seen[3])
    assert packed.agg(F.sum("length")).first()[0] == sum(len(packing.Encoder().encode(t or "")) + 1 for t in seen[3].values())
