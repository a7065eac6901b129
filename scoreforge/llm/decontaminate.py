"""Benchmark decontamination (operator 1), DataFrame functions only: spaced-seed hashing.

Texts are words: runs of letters and digits, in lower case. A fixed mask lays over some words and ignores others; the
hash of the rest is the same wherever only ignored words differ. The hashes of all places of the benchmark under its
masks are joined with those of all places of the documents. A hit fixes a diagonal (place in the document less place in
the item); on each such diagonal the words of the item are compared with those of the document, and the pair counts if
some ``WINDOW`` neighbouring words (all words of a shorter item) agree in ``SHARE`` percent at least.

The masks lose no pair: however the words that may differ lie among those compared, some mask has a place that ignores
them all (``COVERS``, proven by enumeration in the tests; elsewhere a run of words as long as one must stay unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpointed, together

# By words compared and words of them that may differ, masks (1: the word counts) of which one always hits.
COVERS = {
    (5, 1): ("1111", "11011", "11101", "10111"),
    (6, 1): ("10111", "111001"),
    (8, 1): ("110111", "11011001"),
    (10, 2): ("110111", "111000101", "101111"),
    (13, 2): ("11101111", "11110010011", "10111111"),
}
WINDOW, SHARE = 13, 80
#: What is broadcast: so many hashes of the benchmark's (24 bytes each), words of its items (8 bytes), hits (40 bytes) or documents to drop (16 bytes); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Beyond it, bits for a seed and, as a power of two, at most (128 MB) in a bitmap of the benchmark's seeds that is broadcast, so that
#: only a share of the documents' is shuffled.
BITS_A_SEED, MOST_BITS = 32, 30
#: A list of hits of a document holds those of about so many items.
ITEMS_A_LIST = 1000
SPLIT = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    """64-bit hashes of a text's words; null and empty texts have none."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def masks_for(n: int, share: int = SHARE) -> tuple[str, ...]:
    """Masks that hit ``n`` words of which ``share`` percent agree, whichever differ."""
    differ = n - -(-n * share // 100)
    fit = [k for k in COVERS if k[0] <= n and k[1] >= differ]
    return COVERS[max(fit)] if fit else ("1" * max(1, n // (differ + 1)),)


def _seeds(rows: DataFrame, masks: list[str], own: Column) -> DataFrame:
    """Of rows (w and others): the others, place, seed for each place of each mask in ``own``, which are of ``masks``."""
    used = sorted({i for mask in masks for i, c in enumerate(mask) if c == "1"})
    others = [c for c in rows.columns if c != "w"]
    shifted = [F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in used]  # shorter ones end in nulls
    opened = rows.select(*others, own.alias("own"), F.posexplode(F.arrays_zip(*shifted)).alias("place", "v"))
    fits = lambda mask: F.array_contains("own", mask) & F.col(f"v.w{len(mask) - 1}").isNotNull()
    seeds = F.array(*[F.when(fits(mask), F.xxhash64(F.lit(mask), *[F.col(f"v.w{i}") for i, c in enumerate(mask) if c == "1"])) for mask in masks])
    return opened.select(*others, "place", F.explode(seeds).alias("seed")).where("seed is not null")


def _possible(seeds: DataFrame, asked: DataFrame) -> DataFrame:
    """``seeds`` (seed and others) without most of those that are not in ``asked``: a bitmap of ``asked``, of ``BITS_A_SEED`` bits a seed
    and ``MOST_BITS`` at most, is broadcast in pieces of 4 KB; a seed is kept if the bit of its hash is set."""
    bits = 1 << min(MOST_BITS, max(20, (BITS_A_SEED * asked.count()).bit_length()))
    place = F.pmod(F.xxhash64("seed", F.lit(5)), F.lit(bits)) + 1
    known = asked.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bitmap"))
    at = F.bitmap_bit_position("_p").cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = seeds.withColumn("_p", place).withColumn("_b", F.bitmap_bucket_number("_p")).join(F.broadcast(known), F.col("_b") == F.col("_bucket"))
    return met.where(F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1).select(*seeds.columns)


def _overlaps(documents: DataFrame, benchmark: DataFrame, window: int, share: int, broadcast_rows: int) -> DataFrame:
    """doc_id, key (a hash of the text), item_id, n_words, n_compared and best (n_equal, back: less the place) for each pair that overlaps."""
    text, key = F.col("`text`"), F.xxhash64(F.col("`text`"))
    docs = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), key.alias("key"), words(text).alias("w"))
    items = benchmark.select(F.col("`item_id`").cast("long").alias("item_id"), words(F.col("`text`")).alias("w")).where(F.size("w") > 0).distinct()
    items = items.withColumn("version", F.xxhash64("w"))  # of items that repeat an id
    wide = F.least(F.size("w"), F.lit(window))
    sizes = items.select(wide.alias("wide"), F.size("w").alias("n")).groupBy("wide").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).collect()  # at most ``window`` rows
    sets = {r["wide"]: masks_for(r["wide"], share) for r in sizes} or {window: masks_for(window, share)}
    masks = sorted({m for own in sets.values() for m in own})
    listed = lambda own: F.array(*[F.lit(m) for m in own])
    whole = F.col("n_words") < 100 / (100 - share) if share < 100 else F.col("n_words") <= window  # no word may differ: a hit is the item
    asked = _seeds(items.withColumn("n_words", F.size("w")), masks, F.coalesce(*[F.when(wide == n, listed(own)) for n, own in sets.items()])).distinct()  # all places of a seed
    asked = asked.select("seed", "item_id", "version", "n_words", whole.alias("whole"), F.col("place").alias("at"))
    few = asked.limit(broadcast_rows + 1).count() <= broadcast_rows
    seeds = _seeds(docs, masks, listed(masks))
    hits = (seeds.join(F.broadcast(asked), "seed") if few else _possible(seeds, asked).join(asked, "seed")).withColumn("diagonal", F.col("place") - F.col("at"))
    lists = max(1, sum(r["items"] for r in sizes) // ITEMS_A_LIST)
    found = hits.groupBy("doc_id", "key", "item_id", "version", F.when(~F.col("whole"), F.col("diagonal")).alias("_d")).agg(F.min("diagonal").alias("diagonal"), F.max("n_words").alias("n_words"))  # of a whole item's only the first
    found = found.groupBy("doc_id", "key", F.pmod(F.col("version"), F.lit(lists)).alias("_l")).agg(F.collect_list(F.struct("item_id", "version", "n_words", "diagonal")).alias("hits"))
    found = checkpointed(found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "hits"))
    n_hits = found.agg(F.sum(F.size("hits"))).first()[0] or 0
    back = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    back = back.join(F.broadcast(found) if n_hits <= broadcast_rows else found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    lined = back.select("doc_id", "key", words(F.col("text")).alias("w"), "hits").select("doc_id", "key", "w", F.explode("hits").alias("hit")).select("doc_id", "key", "w", "hit.*")
    start = F.greatest(F.lit(0), F.col("diagonal"))
    skip = F.greatest(F.lit(0), -F.col("diagonal"))
    n = F.greatest(F.lit(0), F.least(F.size("w") - start, F.col("n_words") - skip))
    wide = F.least(F.lit(window), F.col("n_words"))
    lined = lined.select("doc_id", "key", "item_id", "version", "n_words", wide.alias("n_compared"), start.alias("start"), skip.alias("skip"), n.alias("n"), F.slice("w", start + 1, n).alias("dw"))
    lined = lined.where(F.col("n") >= F.col("n_compared"))  # of the document, what lies beside the item
    texts = items.select(F.col("item_id").alias("_i"), F.col("version").alias("_v"), F.col("w").alias("iw"))
    texts = F.broadcast(texts) if sum(r["n"] for r in sizes) <= broadcast_rows else texts
    lined = lined.join(texts, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("version") == F.col("_v")))
    lined = lined.withColumn("same", F.zip_with("dw", F.slice("iw", F.col("skip") + 1, F.col("n")), lambda a, b: (a == b).cast("int")))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("n_compared")), lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("n_compared")), F.lit(0), lambda s, x: s + x).alias("n_equal"), (-(F.col("start") + i)).alias("back")))
    return lined.select("doc_id", "key", "item_id", "n_words", "n_compared", F.array_max(sums).alias("best")).where(F.col("best.n_equal") * 100 >= F.col("n_compared") * share)


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_equal and n_compared (of the best window) and place (its first word in the
    document, from 0) for each pair of a document and an item that overlap.

    Null, empty and wordless texts overlap with nothing; an item of any number of words counts, be it one. Items that
    repeat an id count as that id's. Rows with one doc_id give one row an item, the best; null ids take part. Of windows
    equally good the first in the document counts. Further columns are ignored; empty tables give no rows.
    """
    best = _overlaps(documents, benchmark, window, share, broadcast_rows)
    top = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("best.n_equal", "best.back", "n_words", "n_compared")).alias("b"))
    return top.select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"), F.col("b.n_compared").alias("n_compared"), (-F.col("b.back")).alias("place"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text overlaps with an item; others stay, also those that share an id (or null) with
    such a row. Null, empty and wordless texts stay, repeated rows go or stay together; further columns, whatever their
    names, stay as they are; without items all rows stay."""
    plain, names = apart(documents)
    bad = _overlaps(plain, benchmark, WINDOW, SHARE, BROADCAST_ROWS).select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key")).distinct()
    bad = checkpointed(bad)
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = plain.withColumn("_hash", F.xxhash64("text"))
    kept = rows.join(F.broadcast(bad) if few else bad, rows["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (rows["_hash"] == bad["_key"]), "left_anti")
    return together(kept, names)
