"""Schemas of the engine's tables."""

from pyspark.sql import types as T

NOTE_PAIR = T.StructType([T.StructField("pitch", T.IntegerType()), T.StructField("note", T.StringType())])
SYLLABLE = T.StructType([T.StructField("char", T.StringType()), T.StructField("pitch", T.ArrayType(T.IntegerType())), T.StructField("note", T.ArrayType(T.StringType()))])
SYLLABLES = T.ArrayType(SYLLABLE)
ENTRY = T.StructType([T.StructField("word", T.StringType()), *NOTE_PAIR.fields])
WORD = T.StructType([T.StructField("char", T.StringType()), T.StructField("pairs", T.ArrayType(NOTE_PAIR))])
ALIGNED = T.ArrayType(T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("p", T.IntegerType())])))

#: Annotation files are read as strings: a float or quoted number must not null its whole array.
ANNOTATION = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("word", "pitch", "note", "pitch2word", "pitch_dur", "word_dur")]
    + [T.StructField("wav_fn", T.StringType()), T.StructField("bpm", T.StringType())]
)
SAMPLE = T.StructType(
    [T.StructField("dataset_name", T.StringType()), T.StructField("audio_path", T.StringType()), T.StructField("bpm", T.IntegerType()), T.StructField("syllables", SYLLABLES)]
)
FEATURE = "dataset_name string, input_features binary, mel_frames int, mel_bins int, syllables array<struct<char:string,pitch:array<int>,note:array<string>>>, bpm int, status string"
