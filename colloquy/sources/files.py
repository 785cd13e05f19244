"""Readers for the reference's file layouts.

Each reader declares its schema (no inference) and returns a DataFrame; entity keys that
the layouts keep in file or folder names are taken from the file path. Where a layout's
meaning depends on the line order inside a file, the order key is (file path, position),
with the position from ``monotonically_increasing_id`` — increasing inside a file because
a file's splits are read in offset order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_TSV_SCHEMA = "speaker INT, original STRING, traduit STRING"
TRANSCRIPT_SCHEMA = "speaker INT, dialogue ARRAY<STRING>"           # one array element of D1
CASENOTE_SCHEMA = "categoryId STRING, formalText STRING, sourceId STRING"
UTTERANCE_SCHEMA = "Utterance STRING, Sub_topic STRING, ID STRING, Type STRING, Dialogue_Act STRING, Emotion STRING"
EXPORT_SCHEMA = "start STRING, stop STRING, speaker STRING, value STRING"
VALENCE_SCHEMA = "word STRING, value INT"
EMOTION_FILE_SCHEMA = "id STRING, word STRING, polarity STRING, joy INT, fear INT, sadness INT, anger INT, surprise INT, disgust INT"
SPLIT_OF_FILE = {"test": 1, "validation": 2, "train": 3}          # fixed value: file → split id


def path_key(pattern: str, group: int = 1, cast: str | None = "long") -> Column:
    """Entity key from the file path (``input_file_name``) by regex."""
    c = F.regexp_extract(F.input_file_name(), pattern, group)
    return c.cast(cast) if cast else c


def file_order() -> list[Column]:
    """Order key of the lines of multi-file inputs: (path, position in the path)."""
    return [F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_pos")]


def read_turn_tsv(spark: SparkSession, path: str, key_pattern: str = r"conv_id=(\d+)") -> DataFrame:
    """S1 + S11: tab-separated turn files with header; the file key becomes ``conv_id`` and
    the line order inside each file becomes ``turn`` (0-based)."""
    from colloquy.operators.sequence import dense_ordinal
    df = (spark.read.option("sep", "\t").option("header", True).option("multiLine", True)
          .schema(TURN_TSV_SCHEMA).csv(path))
    df = df.select(path_key(key_pattern).alias("conv_id"), *file_order(),
                   *[c for c in df.columns if c != "conv_id"])
    return dense_ordinal(df, ["_file"], ["_pos"], out="turn").drop("_file", "_pos")


def read_valence_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``word<TAB>value`` lexicon."""
    return spark.read.option("sep", "\t").option("header", False).schema(VALENCE_SCHEMA).csv(path)


def read_keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``key<TAB>int`` text lines with their file order (for last-wins resolution)."""
    lines = spark.read.text(path).select(*file_order(), F.col("value").alias("line"))
    parts = F.split(F.trim(F.col("line")), "\t")
    return lines.select(parts[0].alias("word"), parts[1].cast("int").alias("value"),
                        F.struct("_file", "_pos").alias("line_no"))


def read_emotion_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: semicolon CSV with header; ``id`` and ``polarity`` dropped."""
    df = spark.read.option("sep", ";").option("header", True).option("encoding", "utf-8") \
        .schema(EMOTION_FILE_SCHEMA).csv(path)
    return df.drop("id", "polarity")


def read_renamed_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon with a header, columns renamed positionally, the word column kept."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.toDF("word", "number").select("word")


def read_unit_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Classified units with header ``mot, <categories…>, provenance``."""
    return spark.read.option("header", True).csv(path)


def read_utterance_csv(spark: SparkSession, path: str, note_pattern: str = r"note=(\d+)",
                       split_pattern: str = r"split=(\w+)") -> DataFrame:
    """Quoted comma CSV, header skipped, six fields; the note id from the file path, the
    split from the folder, ``row`` = position of the line in its file (0-based)."""
    from colloquy.operators.sequence import dense_ordinal
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", True).schema(UTTERANCE_SCHEMA).csv(path))
    df = df.select(path_key(note_pattern).alias("note"), path_key(split_pattern, cast=None).alias("split"),
                   *file_order(), *[c for c in df.columns if c not in ("note", "split")])
    return dense_ordinal(df, ["_file"], ["_pos"], out="row").drop("_file", "_pos")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Interview export: tab-joined ``start, stop, speaker, value``; the whole value
    is kept (the reference lost anything after a comma)."""
    from colloquy.operators.sequence import dense_ordinal
    df = (spark.read.option("sep", "\t").option("header", False).option("multiLine", True)
          .schema(EXPORT_SCHEMA).csv(path))
    df = df.select(path_key(r"conv_id=(\d+)").alias("conv_id"), *file_order(),
                   *[c for c in df.columns if c != "conv_id"])
    return dense_ordinal(df, ["_file"], ["_pos"], out="turn").drop("_file", "_pos")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON-array transcript files (D1); one row per array element with the file key and
    the element position."""
    schema = T.StructType([T.StructField("speaker", T.IntegerType()),
                           T.StructField("dialogue", T.ArrayType(T.StringType()))])
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    return df.select(path_key(r"conv_id=(\d+)").alias("conv_id"), *file_order(), "speaker", "dialogue")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType,
                    corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """JSON Lines; ``(good, bad)`` — malformed lines are reported, not raised."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    schema = T.StructType(list(schema.fields) + [T.StructField(corrupt, T.StringType())])
    df = (spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
          .schema(schema).json(path)).cache()
    good = df.filter(F.col(corrupt).isNull()).drop(corrupt)
    bad = df.filter(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("line"))
    return good, bad


def first_files(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first ``n`` entity keys (sorted) of a directory scan."""
    keep = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(keep, key, "left_semi")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist (a missing file is skipped with a warning)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        jp = jvm.org.apache.hadoop.fs.Path(p)
        if jp.getFileSystem(conf).exists(jp):
            out.append(p)
    return out


def split_from_file(name: Column) -> Column:
    """Split id from the file name through a literal map."""
    m = F.create_map(*[x for k, v in SPLIT_OF_FILE.items() for x in (F.lit(k), F.lit(v))])
    return m[name]


def participant_column(participants: DataFrame, split: int, column: str) -> DataFrame:
    """One column of the participants of a split (the filter reaches the scan)."""
    if split not in (1, 2, 3):
        raise ValueError("split id must be 1 (test), 2 (validation) or 3 (train)")
    return participants.filter(F.col("partof") == split).select("participant_id", column)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state/snapshot table, or an empty frame of its schema when absent."""
    if existing(spark, [path]):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)
