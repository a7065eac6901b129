"""Language identification (operator 8) by rank-order profiles.

N-grams of one to three letters are taken inside words (a word's edges count as one blank). The counts of all training
documents give each language a profile: its ``profile`` most frequent n-grams by rank. A document's most frequent n-grams
are ranked likewise and compared to each profile by the out-of-place distance: the sum of the differences of rank, the
profile's length for an n-gram that it lacks. The nearest language wins, ties to the name that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

PROFILE = 400
#: Languages whose profiles are broadcast together (16 bytes an n-gram); more are taken in as many passes as they need.
MOST_LANGS = 500
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case form of each letter's code point, 0 for all else."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint64)
        for c in range(len(table)):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def grams(cps: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text: 20 bits a letter, and the length above them."""
    x = _letters()[cps]
    if not x.any():
        return x[:0]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    x = np.concatenate([[0], x[keep], [0]]).astype(np.uint64)
    b20, b40 = np.uint64(20), np.uint64(40)
    one = x[x != 0] | np.uint64(1 << 60)
    two = (x[:-1] << b20) | x[1:]
    two = two[(x[:-1] != 0) | (x[1:] != 0)] | np.uint64(2 << 60)
    three = (x[:-2] << b40) | (x[1:-1] << b20) | x[2:]
    three = three[x[1:-1] != 0] | np.uint64(3 << 60)
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    uniq, n = np.unique(codes, return_counts=True)
    return uniq[np.argsort(-n, kind="stable")[:most]]


def train(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """lang, code, rank: the profiles, from the counts of all rows of ``docs`` (text, lang) with a language and text."""

    def count(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            col, langs = C.texts_of(batch), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = col.filter(pc.equal(langs, lang))
                for a, b in C.chunks(own):
                    cps, offs = C.utf32_flat(own.slice(a, b - a))
                    gap = np.zeros(len(cps) + len(offs), np.uint32)  # texts stay apart by a blank
                    mask = np.ones(len(gap), bool)
                    mask[offs + np.arange(len(offs))] = False
                    gap[mask] = cps
                    u, n = np.unique(grams(gap), return_counts=True)
                    if lang in sums:
                        u, inv = np.unique(np.concatenate([sums[lang][0], u]), return_inverse=True)
                        n = np.bincount(inv, weights=np.concatenate([sums[lang][1], n]), minlength=len(u)).astype(np.int64)
                    sums[lang] = [u, n]
        for lang, (u, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    return sums.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= profile).select("lang", "code", (F.col("_no") - 1).alias("rank"))


class Profiles:
    """Profiles by n-gram: for each code the languages that have it, and its rank there."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs, lang = np.unique(np.array([r[0] for r in rows], object), return_inverse=True)
        self.size = size
        codes = np.array([r[1] for r in rows], np.uint64)
        order = np.argsort(codes, kind="stable")
        self.lang, self.rank = lang[order].astype(np.int64), np.array([r[2] for r in rows], np.int64)[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.start = np.append(first, len(codes))

    def nearest(self, cps: np.ndarray) -> tuple[str | None, float]:
        """The language of the least distance (the first by name of several) and 1 less its share of the greatest possible."""
        codes = grams(cps)
        if not len(codes):
            return None, 0.0
        top = ranked(codes, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        mine = np.flatnonzero(self.codes[at] == top)
        a, n = self.start[at[mine]], self.start[at[mine] + 1] - self.start[at[mine]]
        entry = C.gather(np.arange(len(self.rank)), a, n)
        saved = np.zeros(len(self.langs), np.int64)  # an n-gram that a profile lacks counts ``size``
        np.add.at(saved, self.lang[entry], self.size - np.abs(self.rank[entry] - np.repeat(mine, n)))
        best = int(np.argmax(saved))
        return self.langs[best], float(saved[best]) / (len(top) * self.size)


def identify(docs: DataFrame, training: DataFrame, profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs`` (doc_id, text), whole texts, by profiles of ``training`` (text, lang).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned. Repeated
    rows and ids give a row each, null ids too; further columns are ignored; an empty table gives no rows. Languages equally
    near go by name. Over ``MOST_LANGS`` languages are compared block after block, the best so far handed on.
    """
    profiles = C.checkpointed(train(training, profile))
    langs = profiles.select("lang").distinct()
    n = langs.count()
    numbered = langs.select(F.col("lang").alias("_lang"), F.floor((F.row_number().over(W.orderBy("lang")) - 1) / MOST_LANGS).alias("_block"))  # of languages only
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    for block in range(-(-n // MOST_LANGS)):
        own = profiles.join(F.broadcast(numbered.where(F.col("_block") == block)), F.col("lang") == F.col("_lang")) if n > MOST_LANGS else profiles
        model = docs.sparkSession.sparkContext.broadcast(Profiles([(r["lang"], r["code"], r["rank"]) for r in own.select("lang", "code", "rank").collect()], profile))  # of a block
        if block:
            rows = C.checkpointed(rows)  # one block's profiles in memory at a time
        rows = rows.mapInArrow(_compare(model), rows.schema)
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score")


def _compare(model):
    def run(batches):
        m = model.value
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col):
                cps, offs = C.utf32_flat(col.slice(a, b - a))
                got = [m.nearest(cps[s:e]) for s, e in zip(offs.tolist(), offs[1:].tolist())]
                had = list(zip(batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist()))
                best = [new if new[0] is not None and (old[0] is None or new[1] > old[1]) else old for new, old in zip(got, had)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())], ["doc_id", "text", "lang_pred", "score"])

    return run


def predict(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: learned from the rows that are not held out (null ids are not)."""
    own = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), F.col("`lang`").alias("lang"))
    found = identify(own, own.where(~C.held_out(F.col("doc_id"))))
    return found.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
