"""SentencePiece encoding and decoding (operator 7): byte-pair pieces by vectorised merge rounds.

All texts of a chunk are one flat array of code points. No piece of the model spans certain pairs of neighbouring
characters; the text is cut at every such pair, so the segments ("words") encode independently of each other. Each
distinct segment is encoded once: its characters become a flat array of symbols, and in each round every segment merges
the leftmost pair of its best score (a segmented minimum), all segments at once; merged symbols are compacted away and
finished segments leave, until no pair remains. Long segments merge all occurrences of their best pair in one round
where no new pair could have come before them. Characters that are no piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

SPACE = 0x2581
BIG = np.int32(2**31 - 1)
#: Segments over so many symbols merge all safe occurrences of their best pair in a round.
LONG = 64
#: Entries of a worker's segment cache.
CACHE = 700_000


class PieceModel:
    """A BPE model with byte fallback: pair table, bytes and texts of pieces, and where segments may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {t: i for i, t in enumerate(texts) if normal[i]}
        ranks = np.unique(np.array([-sp.get_score(i) for i in range(n)]), return_inverse=True)[1]
        self.n, self.byte0 = n, next(i for i in range(n) if sp.is_byte(i))
        pairs = {}
        spans = set()
        for t, i in ids.items():
            for k in range(1, len(t)):
                spans.add((ord(t[k - 1]), ord(t[k])))
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (ranks[i], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        chars = sorted({c for s in spans for c in s})
        self.char_no = np.zeros(0x110000, dtype=np.int32)
        self.char_no[chars] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for a, b in spans:
            self.joins[self.char_no[a], self.char_no[b]] = True
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        raw = [bytes([i - self.byte0]) if sp.is_byte(i) else (t.replace("▁", " ").encode() if normal[i] else b"") for i, t in enumerate(texts)]
        dec = [b"%d," % i for i in range(n)]
        self.raw, self.raw_len = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.dec, self.dec_len = np.frombuffer(b"".join(dec), np.uint8), np.array([len(x) for x in dec], np.int64)
        self.raw_at, self.dec_at = np.cumsum(self.raw_len) - self.raw_len, np.cumsum(self.dec_len) - self.dec_len

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; BIG where there is none."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], BIG), self.made[at]

    def encode(self, cps: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each segment: flat ids and their number per segment."""
        ids = self.char_id[cps]
        width = np.ones(len(cps), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            enc = [chr(c).encode("utf-8") for c in cps[odd].tolist()]
            width[odd] = [len(e) for e in enc]
            at = np.cumsum(width) - width
            flat = np.empty(int(width.sum()), np.int32)
            flat[at] = ids
            fill = np.repeat(at[odd], width[odd]) + C.gather(np.arange(4), np.zeros(len(odd), np.int64), width[odd])
            flat[fill] = np.frombuffer(b"".join(enc), np.uint8).astype(np.int32) + self.byte0
            ends = np.cumsum(lens)
            sizes = np.concatenate([np.cumsum(width), [0]])[ends - 1] - (at[ends - lens])
            ids, lens = flat, sizes
        n_words = len(lens)
        out_len = np.zeros(n_words, np.int64)
        done_ids, done_word = [], []
        sym, word = ids.astype(np.int32), np.repeat(np.arange(n_words), lens)
        rank, made = self._ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(sym)]]))
            open_ = best < BIG
            if not open_.all():
                keep = np.repeat(open_, size)
                done_ids.append(sym[~keep])
                done_word.append(word[~keep])
                out_len[word[first[~open_]]] = size[~open_]
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                best, size = best[open_], size[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            w = word[at]
            lead = np.concatenate([[True], w[1:] != w[:-1]])
            if size.max() > LONG:
                lead |= self._safe(sym, word, made, at, np.repeat(size, size)[at] > LONG, rank)
            at = at[lead]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            for p in (at, at[at > 0] - 1):
                nxt = np.minimum(p + 1, len(sym) - 1)
                r, m = self.pair(sym[p], sym[nxt])
                rank[p] = np.where((nxt > p) & (word[nxt] == word[p]), r, BIG)
                made[p] = m
        order = np.argsort(np.concatenate(done_word), kind="stable") if done_word else np.zeros(0, np.int64)
        return (np.concatenate(done_ids)[order] if done_ids else np.zeros(0, np.int32)), out_len

    def _ranks(self, sym, word):
        rank, made = np.full(len(sym), BIG, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            r, m = self.pair(sym[:-1], sym[1:])
            rank[:-1] = np.where(word[1:] == word[:-1], r, BIG)
            made[:-1] = m
        return rank, made

    def _safe(self, sym, word, made, at, long_, rank):
        """Which occurrences of the best pair may merge in this round too: those of long segments that do not overlap
        an earlier one, if none of the pairs that merging them one by one would make ranks as high as the pair itself."""
        take = np.zeros(len(at), bool)
        if not long_.any():
            return take
        run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        cand = np.flatnonzero(long_ & (place % 2 == 0))
        p = at[cand]
        new = made[p]
        n = len(sym)
        after = sym.copy()
        gone = np.zeros(n, bool)
        after[p] = new
        gone[p + 1] = True
        left = np.maximum(p - 1, 0)
        left = np.where(gone[left], np.maximum(left - 1, 0), left)
        right = np.minimum(p + 2, n - 1)
        rl, _ = self.pair(after[left], new)
        rr, _ = self.pair(new, sym[right])
        bad = ((left < p) & (word[left] == word[p]) & (rl <= rank[p])) | ((right > p + 1) & (word[right] == word[p]) & (rr <= rank[p]))
        spoiled = np.unique(word[p[bad]])
        take[cand] = ~np.isin(word[p], spoiled)
        return take


_MODELS: dict[str, tuple] = {}


def _model(path: str) -> tuple[PieceModel, C.SegmentTable, C.Ragged]:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path), C.SegmentTable(CACHE), C.Ragged(np.int32)
    return _MODELS[path]


def encode_flat(col: pa.Array, path: str) -> tuple[PieceModel, np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number per text."""
    model, known, made = _model(path)
    cps, offs = C.utf32_flat(col)
    lens = np.diff(offs)
    full = np.flatnonzero(lens > 0)
    if not len(full):
        return model, np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
    flat = np.empty(len(cps) + len(full), np.uint32)  # a space before each text that is not empty
    mask = np.ones(len(flat), bool)
    heads = offs[full] + np.arange(len(full))
    mask[heads] = False
    flat[mask] = np.where(cps == 32, SPACE, cps)
    flat[heads] = SPACE
    no = model.char_no[flat]
    cut = np.ones(len(flat), bool)
    cut[1:] = ~model.joins[no[:-1], no[1:]]
    cut[heads] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate([starts[1:], [len(flat)]])
    uniq, first, inv = C.distinct(C.segment_digests(flat, starts, ends))
    if known.n > known.most:
        known.clear()
        made.clear()
    rows = known.find(uniq)
    new = np.flatnonzero(rows < 0)
    if len(new):
        s, e = starts[first[new]], ends[first[new]]
        made.extend(*model.encode(C.gather(flat, s, e - s), e - s))
        rows[new] = known.add((uniq[0][new], uniq[1][new]))
    rows = rows[inv]
    n = made.lens[rows]
    ids = C.gather(made.flat, made.starts[rows], n)
    counts = np.zeros(len(lens), np.int64)
    counts[full] = np.add.reduceat(n, np.searchsorted(starts, heads))
    return model, ids, counts


def decode_flat(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all decoded texts and the n+1 offsets; the space that encoding put before a text is dropped."""
    n = model.raw_len[ids]
    flat = C.gather(model.raw, model.raw_at[ids], n)
    run = np.concatenate([[0], np.cumsum(n)])
    offs = run[np.concatenate([[0], np.cumsum(counts)])]
    return flat, offs


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids and the decoded text.

    Null and empty texts have no ids; the hashes are then those of an empty string. Repeated rows and repeated ids give a
    row each; further columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches):
        for batch in batches:
            col, doc = C.texts_of(batch), batch.column(0)
            for a, b in C.chunks(col):
                model, ids, counts = encode_flat(col.slice(a, b - a), model_path)
                digits = C.gather(model.dec, model.dec_at[ids], model.dec_len[ids]).tobytes()
                ends = np.concatenate([[0], np.cumsum(model.dec_len[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                raw, offs = decode_flat(model, ids, counts)
                raw, offs = raw.tobytes(), offs.tolist()
                one = [hashlib.sha256(memoryview(digits)[s : max(s, e - 1)]).hexdigest() for s, e in zip(ends, ends[1:])]
                texts = [memoryview(raw)[s + (raw[s : s + 1] == b" ") if e > s else s : e] for s, e in zip(offs, offs[1:])]
                two = [hashlib.sha256(t).hexdigest() for t in texts]
                cols = [doc.slice(a, b - a), pa.array(counts), pa.array(one, pa.string()), pa.array(two, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids)), pa.array([bytes(t).decode("utf-8", "replace") for t in texts], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = C.pick(docs, "doc_id", "text")
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
