"""The live session as Structured Streaming.

Input stream: phrases ``(conv_id, phrase, turn, ts, text)``. Stateless steps (annotation,
lexicon look-ups) run as ordinary streaming transformations; the keyed state per session
is a ``transformWithStateInPandas`` processor holding

* a ValueState with the running counters, the start time (T1) and the last levels (T5);
* a ListState of words at their first and second occurrence (only what the hapax count needs, never the text
  itself), read and appended once a batch.

Each phrase emits one row with the levels and first differences; the result equals the
batch :func:`colloquy.operators.running.running_levels`. State of idle
sessions can be expired with a TTL. T7 is a watermarked windowed aggregation.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators import arrays
from colloquy.operators import lexicon as X
from colloquy.operators.running import RUNNING_SERIES, phrase_statistics
from colloquy.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMO_ORDER = ("anger", "disgust", "fear", "joy", "sadness", "surprise")
TOTALS = ["n_doc", "total", "n_adv", "n_verb", "n_vconj", "n_units", "hapax", *EMO_ORDER]
PHRASE_SCHEMA = "conv_id long, phrase long, turn long, ts timestamp, text string"
OUTPUT_SCHEMA = ("conv_id long, phrase long, turn long, elapsed long, "
                 + ", ".join(f"{s} double" for s in RUNNING_SERIES) + ", "
                 + ", ".join(f"delta_{s} double" for s in RUNNING_SERIES))


def phrase_events(phrases: DataFrame, emotions: DataFrame, units: DataFrame) -> DataFrame:
    """Stateless part: one row per phrase with its own counters and distinct words, and one row per distinct word of it
    that a lexicon knows, with the sums that this word adds."""
    keys = ["conv_id", "phrase", "turn", "start_us"]
    st = phrase_statistics(phrases.select("conv_id", "phrase", "turn", F.unix_micros("ts").alias("start_us"),
                                          F.coalesce("text", F.lit("")).alias("text")))
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, words, times, **given) -> DataFrame:
        return df.select(*keys, *[F.coalesce(given.get(c, zero), zero).cast("bigint").alias(c) for c in TOTALS if c != "hapax"],
                         words.cast("array<string>").alias("words"), times.cast("array<bigint>").alias("times"))

    own = part(st, F.transform("words", lambda x: x["word"]), F.transform("words", lambda x: x["n"]),
               **{c: F.col(c) for c in ("n_doc", "total", "n_adv", "n_verb", "n_vconj")})
    asked = st.select(*keys, F.explode(F.concat(
        F.transform("words", lambda x: F.struct(F.lit("emotion").alias("kind"), F.lower(x["word"]).alias("word"), x["n"].alias("n"))),
        arrays.repeated_words("lemmas", "unit"))).alias("w")).select(*keys, "w.*")
    found = asked.join(X.lookup_table(None, emotions, units=units), ["kind", "word"])
    none = F.lit(None)
    return own.unionByName(part(found, none, none, n_units=F.when(F.col("kind") == "unit", F.col("n")),
                                **{e: F.col("n") * F.col(e) for e in EMO_ORDER}))


class SessionIndicators(StatefulProcessor):
    """T1 + T2 + T5: running indicators of one session, updated phrase by phrase."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ("start_us long, " + ", ".join(f"{c} long" for c in TOTALS) + ", "
                  + ", ".join(f"last_{s} double" for s in RUNNING_SERIES) + ", has_last boolean")
        self.totals = handle.getValueState("totals", schema, self.ttl_ms)
        # a word is listed at its first and at its second occurrence: (word, 1), (word, 2)
        self.words = handle.getListState("words", "word string, n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf.empty:
            return
        st = self.totals.get() if self.totals.exists() else None
        seen: dict[str, int] = {}
        if st is None:
            start = int(pdf["start_us"].min())
            tot = dict.fromkeys(TOTALS, 0)
            last, has_last = {s: 0.0 for s in RUNNING_SERIES}, False
        else:
            start = st[0]
            tot = dict(zip(TOTALS, st[1:1 + len(TOTALS)]))
            last = dict(zip(RUNNING_SERIES, st[1 + len(TOTALS):1 + len(TOTALS) + len(RUNNING_SERIES)]))
            has_last = st[-1]
            if self.words.exists():
                for w, n in self.words.get():
                    seen[w] = max(n, seen.get(w, 0))
        sums = [c for c in TOTALS if c != "hapax"]
        added = pdf.groupby("phrase", sort=True)[sums].sum()
        of_phrase: dict = {}
        for p, turn, at, words, times in pdf.loc[pdf["words"].notna(), ["phrase", "turn", "start_us", "words", "times"]].itertuples(
                index=False, name=None):
            of_phrase.setdefault(p, (turn, at, []))[2].extend(zip(words, times))
        before = dict(seen)
        out = []
        for phrase, *more in added.itertuples(name=None):
            for c, x in zip(sums, more):
                tot[c] += int(x)
            turn, at, words = of_phrase[phrase]
            for w, c in words:
                p = seen.get(w, 0)
                seen[w] = n = min(p + int(c), 2)            # once, or more often
                tot["hapax"] += int(n == 1) - int(p == 1)
            lv = _levels(tot)
            row = {"conv_id": key[0], "phrase": int(phrase), "turn": int(turn), "elapsed": (int(at) - start) // 1_000_000}
            for s in RUNNING_SERIES:
                row[s] = lv[s]
                if not has_last or last[s] is None:
                    row[f"delta_{s}"] = lv[s]
                elif lv[s] is None:
                    row[f"delta_{s}"] = None
                else:
                    row[f"delta_{s}"] = lv[s] - last[s]
            last, has_last = lv, True
            out.append(row)
        new = [(w, n) for w, n in seen.items() if n != before.get(w, 0)]
        if new:
            self.words.appendList(new)
        self.totals.update((start, *[int(tot[c]) for c in TOTALS],
                            *[(float(last[s]) if last[s] is not None else None) for s in RUNNING_SERIES], has_last))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _levels(t: dict) -> dict:
    total = t["total"]
    lv = {
        "TTR": (t["hapax"] / t["n_doc"]) if t["n_doc"] else None,
        "adv_rates": (t["n_adv"] / total) if total else None,
        "verb_conj_rate": (t["n_vconj"] / t["n_verb"]) if t["n_verb"] else 0.0,
        "total_concept_density": (t["n_units"] / total) if total else 0.0,
    }
    for e in EMO_ORDER:
        lv[f"{e}_rate"] = (t[e] / total) if total else None
    return lv


def session_stream(phrases: DataFrame, emotions: DataFrame, units: DataFrame,
                   ttl_ms: int | None = None) -> DataFrame:
    """T2 over a streaming (or batch) phrase DataFrame."""
    ev = phrase_events(phrases, emotions, units)
    return ev.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=SessionIndicators(ttl_ms), outputStructType=OUTPUT_SCHEMA,
        outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one streaming run."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def state_partitions(spark: SparkSession) -> int:
    """State partitions of a new stream (fixed for its lifetime by its checkpoint): the
    ``colloquy.stream.partitions`` setting, else the cluster's default parallelism."""
    conf = spark.conf.get("colloquy.stream.partitions", None)
    return int(conf) if conf else spark.sparkContext.defaultParallelism


def run_to_end(stream_df: DataFrame, sink: str, ckpt: str, mode: str = "append",
               batch_fn=None) -> None:
    """Runs a streaming DataFrame over all available input (``availableNow``) into parquet.

    The state store is RocksDB; the stream's shuffle/state partition count is set from
    :func:`state_partitions` while the query starts and the session value is restored."""
    spark = stream_df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions(spark)))
    try:
        w = stream_df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
        if batch_fn is None:
            q = w.format("parquet").option("path", sink).start()
        else:
            q = w.foreachBatch(batch_fn).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    q.awaitTermination()


def snapshot_writer(path: str):
    """K6/T4: each micro-batch writes its emitted rows into the folder of its batch id; a replayed
    batch overwrites what it wrote before."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return fn


def latest_per_session(snapshots: DataFrame, key: str = "conv_id", order: str = "phrase") -> DataFrame:
    """Last emitted row of every session."""
    cols = [c for c in snapshots.columns if c not in (key,)]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_s")).select(key, "_s.*")


def windowed_activity(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event counts and value sums per tumbling window and type, with a watermark so
    that state of closed windows is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (e.withWatermark("ts", delay)
             .groupBy(F.window("ts", window).alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
             .select(F.col("w.start").alias("window_start"), "event_type", "n", "total_value"))
