"""Quality classifier (operator 10): nearest-neighbour voting over latent-semantic vectors.

A text's terms are of two families: its words (lower case, hashed to ``WORDS`` bins); and trigrams of character classes (what
kinds of characters follow each other: case, digits, spaces, marks) with how much of the text repeats its own words.
Document frequencies are counted over all documents. The term weights (1 + log count) * idf, each family brought to its share
of the length, of at most ``PER_LABEL`` labelled rows of either label, those of the smallest hash of doc_id, give by a
truncated singular value decomposition the latent space; their vectors in it are broadcast (at most 2 * ``PER_LABEL`` of
``DIMS`` numbers). Every document's vector is compared with all of them by blocked cosine products, and the labels of the
``NEIGHBOURS`` nearest, and of any as near as the last of them, vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C

#: Bound of the labelled sample: rows of either label.
PER_LABEL = 2000
DIMS, NEIGHBOURS, POWER, CLASSES, REPEATS, WORDS = 48, 25, 12, 16, 16, 4096
KINDS = CLASSES**3 + REPEATS
TERMS = KINDS + WORDS
#: The part of a vector's squared length that words have, if it has both families.
WORD_SHARE = 0.25
THRESHOLD = 0.7
#: Texts whose terms are counted together, and similarities that count as equal.
ROWS, NEAR = 256, 1e-5  # ROWS: under 4096


def _classes() -> np.ndarray:
    """The class of each byte: single marks that prose rarely has stand alone, the rest by kind."""
    out = np.full(256, 15, np.uint8)  # control characters and what is left
    out[128:] = 2  # parts of other letters
    for lo, hi, no in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 3)):
        out[ord(lo) : ord(hi) + 1] = no
    for no, chars in ((4, " "), (5, "\n\r\t"), (6, ",;:"), (7, "."), (8, "?'\"()-"), (9, "!"), (10, "|"), (11, "#"), (12, "$%&*"), (13, "@/\\_=+~^"), (14, "<>[]{}")):
        out[[ord(c) for c in chars]] = no
    return out


_CLASS = _classes()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the terms of each text (``ROWS`` at most): row, term and count of each that is not 0, in that order."""
    raw, offs = C.utf8_flat(col)
    n = len(offs) - 1
    kind = _CLASS[raw].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offs))
    keys = []
    if len(raw) > 2:
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        whole = row[2:] == row[:-2]
        keys.append((row[2:] * TERMS + code)[whole])
    blank = (kind == 4) | (kind == 5)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
    heads = offs[:-1][np.diff(offs) > 0]
    starts = np.union1d(starts, heads[~blank[heads]]).astype(np.int64)
    stop = np.sort(np.concatenate([np.flatnonzero(blank), offs[1:]]))
    stop = stop[np.searchsorted(stop, starts, side="right")] if len(starts) else starts
    word, owner = C.segment_hashes(_LOWER[raw], starts, stop), np.searchsorted(offs, starts, side="right") - 1
    keys.append(owner * TERMS + KINDS + (word % np.uint64(WORDS)).astype(np.int64))
    own = np.sort(owner.astype(np.uint64) << np.uint64(52) | word >> np.uint64(12))  # a text's words side by side
    fresh = np.append(True, own[1:] != own[:-1])[: len(own)]
    many, new = np.bincount(owner, minlength=n), np.bincount((own[fresh] >> np.uint64(52)).astype(np.int64), minlength=n)
    has = np.flatnonzero(many)
    repeats = np.minimum(REPEATS - 1, (-np.log2(new[has] / many[has]) * 3).astype(np.int64))  # the fewer of its words are new, the longer it may be
    count = np.bincount(np.concatenate(keys), minlength=n * TERMS)
    count[has * TERMS + CLASSES**3 + repeats] = many[has]
    at = np.flatnonzero(count)
    return at // TERMS, at % TERMS, count[at]


def _blocks(col: pa.Array):
    """(first, last) rows whose terms are counted together."""
    for a, b in C.chunks(col, 1_500_000):
        for s in range(a, b, ROWS):
            yield s, min(b, s + ROWS)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray):
        """``rows``: terms and counts of each labelled text."""
        self.idf = idf.astype(np.float32)
        self.labels = labels.astype(np.float32)
        rng = np.random.default_rng(7)
        blocks = []
        for a in range(0, len(rows), ROWS):
            part = rows[a : a + ROWS]
            row = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            blocks.append((row, np.concatenate([t for t, _ in part]), np.concatenate([c for _, c in part]), len(part)))
        matrices = lambda: (self.weigh(*x) for x in blocks)  # noqa: E731  one block at a time in memory
        k = min(DIMS, len(rows), TERMS)
        g = rng.standard_normal((TERMS, min(k + 16, TERMS)), dtype=np.float32)
        for _ in range(5):
            q = np.linalg.qr(np.concatenate([x @ g for x in matrices()]))[0]
            g = np.zeros((TERMS, q.shape[1]), np.float32)
            at = 0
            for x in matrices():
                g += x.T @ q[at : at + len(x)]
                at += len(x)
        self.axes = np.ascontiguousarray(np.linalg.svd(g.T, full_matrices=False)[2][:k].T, dtype=np.float32)
        self.vectors = np.concatenate([self.place(x) for x in matrices()])

    def weigh(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """The vectors of ``n`` texts by their terms: each family has its share of the squared length."""
        w = (1 + np.log(count)) * self.idf[term]
        family = (term >= KINDS).astype(np.int64)
        square = np.bincount(row * 2 + family, weights=w * w, minlength=2 * n).reshape(n, 2)
        share = np.where(square > 0, [1 - WORD_SHARE, WORD_SHARE], 0)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-12)
        scale = np.sqrt(share / np.where(square > 0, square, 1))
        x = np.zeros((n, TERMS), np.float32)
        x[row, term] = w * scale[row, family]
        return x

    def place(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(norm > 1e-9, norm, 1)).astype(np.float32)

    def score(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled rows; that of all of them for a text without terms."""
        cos = self.place(self.weigh(row, term, count, n)) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        text, near = np.nonzero(cos >= last[:, None] - NEAR)
        w = np.maximum(cos[text, near], 0).astype(np.float64) ** POWER
        total = np.bincount(text, weights=w, minlength=n)
        votes = np.bincount(text, weights=w * self.labels[near], minlength=n)
        return np.where(total > 1e-12, votes / np.where(total > 1e-12, total, 1), float(self.labels.mean()))


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Learns from the labelled rows that are not held out; None if there are none. Null labels take no part, nor do null ids; a
    document with several labels counts as the larger half of them says. Rows that repeat a labelled id all may teach, up to
    ``per_label`` rows a label; null texts count as empty."""
    held = C.held_out(F.col("`doc_id`"))
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").cast("double").alias("quality")).where("doc_id is not null and quality is not null").where(~held)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * per_label rows of two numbers
    own = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))

    def frequencies(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            col = C.texts_of(batch, "text")
            for a, b in _blocks(col):
                total += np.bincount(terms(col.slice(a, b - a))[1], minlength=TERMS)
                n += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    df = {r["term"]: r["n"] for r in own.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most TERMS + 1 rows
    n_docs = max(1, df.pop(-1, 0))
    idf = np.zeros(TERMS)
    for t, n in df.items():
        idf[t] = np.log((1 + n_docs) / (1 + n)) + 0.1

    def sparse(batches):
        for batch in batches:
            col = C.texts_of(batch, "text")
            for a, b in _blocks(col):
                row, term, count = terms(col.slice(a, b - a))
                cuts = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                parts = [(term[s:e].astype("<u2").tobytes(), count[s:e].astype("<f4").tobytes()) for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["doc_id", "quality", "at", "n"])

    sample = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(sparse, "doc_id long, quality int, at binary, n binary").distinct()
    order = W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "at", "n")
    got = sample.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= per_label).collect()  # rows of one id too
    got.sort(key=lambda r: (r["quality"], r["_no"]))
    if not got:
        return None
    return Model([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<f4")) for r in got], np.array([r["quality"] for r in got]), idf)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``, its columns renamed c0, c1 and so on, and a column ``_score``. Without a model nothing speaks against a
    text: 1. Null texts count as empty."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    if model is None:
        return docs.toDF(*names).withColumn("_score", F.lit(1.0))
    text = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema)] + [StructField("_score", DoubleType())])

    def run(batches):
        m = held.value
        for batch in batches:
            col = C.texts_of(batch, names[text])
            for a, b in _blocks(col):
                got = m.score(*terms(col.slice(a, b - a)), b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got)], [*names, "_score"])

    return docs.toDF(*names).mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; empty tables give none, repeated rows and null ids a row each. Null
    texts count as empty ones, which score as all labelled rows do on average; further columns are ignored."""
    own = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    found = scored(own, fit(own, labels)).select(F.col("c0").alias("doc_id"), F.col("_score").alias("score"))
    return found.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are, whatever their names; null texts count
    as empty. Repeated rows stay or go together; without a model, as without labels, all stay."""
    return scored(docs, model).where(F.col("_score") >= threshold).drop("_score").toDF(*docs.columns)
