"""Scores derived from ``lineitem``: one order is a song, its lines are notes, and a damaged copy is the prediction.

One shuffle gathers a song's lines; all else stays in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.functions.vocab import CONTINUED, NOTE_BEATS
from scoreforge.operators import encode, features
from scoreforge.schemas import SYLLABLES

NOTES = list(NOTE_BEATS)
CHARS = ["感", "受", "停", "在", "AP", "我", "发", "SP", "端", "指"]
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (no + 1).cast("int"))


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, bpm, pred_bpm, gt and pred (arrays of notes: k, pitch, note, ch)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sid")).agg(F.array_sort(F.collect_list(F.struct(*LINE))).alias("lines"))

    def note(x, k):
        ch = F.when(k % 2 == 1, F.lit(CONTINUED)).otherwise(_pick(CHARS, (F.col("sid") + k * 3) % 10))
        return F.struct(k.alias("k"), (F.lit(60) + x["l_suppkey"] % 3).cast("int").alias("pitch"), _pick(NOTES, x["l_partkey"] % 12).alias("note"), ch.alias("ch"), x["l_partkey"].alias("part"), x["l_suppkey"].alias("supp"))

    def damaged(n):
        ch = F.when((n["k"] == 0) & (F.col("sid") % 4 == 0), F.lit("端")).otherwise(n["ch"])
        no = (n["part"] % 12 + (n["supp"] % 4 == 0).cast("int")) % 12
        return F.struct(n["k"].alias("k"), (n["pitch"] + (n["supp"] % 5 == 0).cast("int")).alias("pitch"), _pick(NOTES, no).alias("note"), ch.alias("ch"))

    rows = lines.select("sid", (F.col("sid") % 300).cast("int").alias("bpm"), F.transform("lines", note).alias("_n"))
    kept = F.filter("_n", lambda n: (n["part"] % 11 != 0) & (F.col("sid") % 97 != 0))
    return rows.select(
        "sid", "bpm", (F.col("bpm") + F.when(F.col("sid") % 6 == 0, 5).otherwise(0)).alias("pred_bpm"),
        F.transform("_n", lambda n: F.struct(*[n[c].alias(c) for c in ("k", "pitch", "note", "ch")])).alias("gt"), F.transform(kept, damaged).alias("pred"),
    )


def sylls(notes: str) -> Column:
    """Each note as a syllable of its own."""
    return F.transform(notes, lambda n: F.struct(n["ch"].alias("char"), F.array(n["pitch"]).alias("pitch"), F.array(n["note"]).alias("note")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, gt_text, pred_text."""
    rows = songs(spark, sf_dir)
    return rows.select("sid", encode.text(sylls("gt"), F.col("bpm")).alias("gt_text"), encode.text(sylls("pred"), F.col("pred_bpm")).alias("pred_text"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, text: reference texts with bad tokens, a lost end, orphan notes, and several tempos."""
    t = F.col("gt_text")
    bad = F.when(F.col("sid") % 5 == 0, F.replace(t, F.lit("<P_61>"), F.lit("<P_x>"))).when(F.col("sid") % 5 == 1, F.substring(t, F.lit(1), (F.length(t) * 2 / 3).cast("int")))
    bad = bad.when(F.col("sid") % 5 == 2, F.concat(F.lit("<NOTE_4> <BPM_7> language "), F.replace(t, F.lit("<NOTE_4>"), F.lit("<NOTE_5>")), F.lit(" </s>")))
    bad = bad.when(F.col("sid") % 5 == 3, F.concat(F.lit("感受<|file_sep|>"), F.replace(t, F.lit(" "), F.lit("　")))).otherwise(F.replace(t, F.lit("> <"), F.lit("><")))
    return texts(spark, sf_dir).select("sid", bad.alias("text"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, bpm, word, pitch, note, pitch2word: parallel arrays, some short, some pointing outside."""
    n = F.size("gt")
    word = F.transform(F.filter("gt", lambda x: x["k"] % 2 == 0), lambda x: x["ch"])
    pitch = F.slice(F.transform("gt", lambda x: x["pitch"]), F.lit(1), F.when(F.col("sid") % 7 == 0, n - 1).otherwise(n))
    note = F.slice(F.transform("gt", lambda x: x["note"]), F.lit(1), F.when(F.col("sid") % 5 == 0, n - 1).otherwise(n))
    link = F.transform("gt", lambda x: F.when((F.col("sid") % 11 == 0) & (x["k"] == n - 1), F.floor(x["k"] / 2) + 1).otherwise(F.floor(x["k"] / 2)).cast("int"))
    return songs(spark, sf_dir).select("sid", "bpm", word.alias("word"), pitch.alias("pitch"), note.alias("note"), link.alias("pitch2word"))


def stub_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio: a tenth missing, a tenth broken, the others of 0 to 4 frames."""
    n = (F.col("event_id") % 5 * 320).cast("int")
    content = F.when(F.col("event_id") % 10 == 0, None).when(F.col("event_id") % 10 == 1, F.lit("odd")).otherwise(F.repeat(F.lit("\x01"), n))
    events = table(spark, sf_dir, "events").select("event_id", "event_type").repartition(spark.sparkContext.defaultParallelism, "event_id")  # one small file, but work for all
    rows = events.select(F.col("event_type").alias("dataset_name"), content.cast("binary").alias("content"), F.lit(None).cast(SYLLABLES).alias("syllables"), F.lit(120).alias("bpm"))
    return features.extract(rows, features.energy_bins())
