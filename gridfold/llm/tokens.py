"""Token counts of a SentencePiece BPE model by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens where no piece of the vocabulary can reach across: before a space
mark that follows another sign, and between signs that stand side by side in no piece.  The
distinct pre-tokens of a batch lie in one ragged array; every round merges the lowest-ranked pair
of each sequence at once, and the symbols that are left are the tokens.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import row_chunks, texts_of

CHUNK = 4 << 20    # bytes of text worked on at once (a longer text stands alone)
LONG = 2048        # a longer sequence has its pairs in a heap: rounds over it would cost its square
SPACE_MARK = "▁"
NONE = np.iinfo(np.int32).max


class Merges:
    """Pieces of a BPE vocabulary as arrays: signs, pairs that merge, their ranks."""

    def __init__(self, pieces: list[str], scores: list[float], byte_fallback: bool = True):
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece holds a space mark behind another sign")
        ids = {p: i for i, p in enumerate(pieces)}
        ranks = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64)
        signs = sorted({c for p in pieces for c in p})
        if any(c not in ids for c in signs):
            raise ValueError("a sign of a piece is no piece itself")
        self.signs = np.array([ord(c) for c in signs], np.int64)
        self.sign_ids = np.array([ids[c] for c in signs], np.int64)
        self.byte_fallback = byte_fallback
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.ranks = ranks[self.merged]
        beside = {(ids[a], ids[b]) for p in pieces for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(a << 32 | b for a, b in beside), np.int64)
        # tame: no merge of the piece with a neighbour comes before or with its own
        self.tame = np.ones(len(ranks), bool)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.tame[part[self.ranks <= ranks[part]]] = False

    @classmethod
    def of_model(cls, path: str) -> "Merges":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  Å") != f"{SPACE_MARK}a{SPACE_MARK * 2}Å":
            raise ValueError("the model normalises texts beyond marking spaces")
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in plain], [model.get_score(i) for i in plain], any(model.is_byte(i) for i in range(model.vocab_size())))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it does not merge."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int64), np.zeros(len(left), np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def count(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; ``code`` holds all code points, ``starts`` (ascending, from 0)
        where each non-empty sequence begins."""
        at = np.minimum(np.searchsorted(self.signs, code), len(self.signs) - 1)
        known = self.signs[at] == code
        sym = np.where(known, self.sign_ids[at], -1)
        extra = (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF) if self.byte_fallback else np.zeros(len(code), np.int64)
        extra[known] = 0
        key = sym[:-1] << 32 | sym[1:]
        cut = np.ones(len(sym), bool)      # a finer cut: between signs that no piece has side by side
        if len(self.beside):
            near = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            cut[1:] = (self.beside[near] != key) | ~known[:-1] | ~known[1:]
        cut[starts] = True
        fine = np.flatnonzero(cut)
        left = self.survivors(sym, fine)
        left += np.add.reduceat(extra, fine)
        return np.add.reduceat(left, np.searchsorted(fine, starts))

    def survivors(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence when no pair merges any more."""
        sizes = np.diff(starts, append=len(sym))
        out = sizes.copy()
        for s in np.flatnonzero(sizes > LONG).tolist():
            out[s] = self.survivors_of_long(sym[starts[s]:starts[s] + sizes[s]])
        which = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        take = np.repeat(np.isin(np.arange(len(sizes)), which), sizes)
        sym, sizes = sym[take], sizes[which]
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(sym), NONE, np.int64)
        into = np.zeros(len(sym), np.int64)
        inside = np.ones(len(sym), bool)
        inside[starts + sizes - 1] = False     # the last symbol of a sequence leads no pair
        where = np.flatnonzero(inside)
        rank[where], into[where] = self.find(sym[where], sym[where + 1])
        while len(which):
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():                  # sequences without pairs are done
                out[which[~live]] = sizes[~live]
                stay = np.repeat(live, sizes)
                sym, rank, into = sym[stay], rank[stay], into[stay]
                which, sizes, low = which[live], sizes[live], low[live]
                starts = np.cumsum(sizes) - sizes
                if not len(which):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            new_run = np.ones(len(hits), bool)
            new_run[1:] = hits[1:] != hits[:-1] + 1
            place = np.arange(len(hits))
            in_run = place - np.maximum.accumulate(np.where(new_run, place, 0))
            seq = np.searchsorted(starts, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = seq[1:] != seq[:-1]
            wild = np.zeros(len(which), bool)   # a wild result may pair at once: then only the leftmost merges
            wild[seq[~self.tame[into[hits]]]] = True
            go = hits[np.where(wild[seq], first, in_run % 2 == 0)]
            sym[go] = into[go]
            keep = np.ones(len(sym), bool)
            keep[go + 1] = False
            gone = np.bincount(np.searchsorted(starts, go, side="right") - 1, minlength=len(which))
            rank[go] = NONE
            ends = np.zeros(len(sym), bool)
            ends[starts + sizes - 1] = True
            ends[go] = ends[go + 1]
            at = np.cumsum(keep) - 1
            changed = at[go]
            sym, rank, into, ends = sym[keep], rank[keep], into[keep], ends[keep]
            sizes = sizes - gone
            starts = np.cumsum(sizes) - sizes
            rank[changed] = NONE
            touched = np.zeros(len(sym) + 1, bool)
            touched[changed] = touched[changed - 1] = True  # the pair before the first symbol is the spare last place
            again = np.flatnonzero(touched[:-1] & ~ends)
            rank[again], into[again] = self.find(sym[again], sym[again + 1])
        return out

    def survivors_of_long(self, sym: np.ndarray) -> int:
        """As ``survivors``, for one long sequence: its pairs in a heap by (rank, place)."""
        n = len(sym)
        rank, into = self.find(sym[:-1], sym[1:])
        heap = [(r, i, s, t, m) for i, (r, s, t, m) in enumerate(zip(rank.tolist(), sym[:-1].tolist(), sym[1:].tolist(), into.tolist())) if r < NONE]
        heapq.heapify(heap)
        table: dict[tuple[int, int], tuple[int, int]] = {}
        sym, back, ahead = sym.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        left = n
        while heap:
            _, i, s, t, m = heapq.heappop(heap)
            j = ahead[i]
            if sym[i] != s or j >= n or sym[j] != t:
                continue
            sym[i], sym[j] = m, -2
            ahead[i] = ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
            left -= 1
            for a, b in ((back[i], i), (i, ahead[i])):
                if a >= 0 and b < n:
                    pair = sym[a], sym[b]
                    if pair not in table:
                        r, into = self.find(np.array([pair[0]]), np.array([pair[1]]))
                        table[pair] = int(r[0]), int(into[0])
                    r, into = table[pair]
                    if r < NONE:
                        heapq.heappush(heap, (r, a, *pair, into))
        return left


def count_batch(merges: Merges, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text.  A text that is not empty begins with a space mark of its own."""
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    rows = np.flatnonzero(np.diff(offsets))
    if not len(rows):
        return out
    mark = np.frombuffer(SPACE_MARK.encode(), np.uint8)
    data = pa.py_buffer(raw.tobytes())
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64).tobytes()), data).take(pa.array(rows))
    texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(texts, mark.tobytes().decode(), " "), pa.scalar(" ", pa.large_string()))
    raw, offsets = texts_of(texts)
    space = raw == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    coded = words.dictionary_encode()
    joined, at = texts_of(coded.dictionary)
    code = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    code[code == 0x20] = ord(SPACE_MARK)
    leads = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
    per_word = merges.count(code, leads[at[:-1]])[coded.indices.to_numpy()]
    total = np.concatenate([[0], np.cumsum(per_word)])
    bound = np.searchsorted(starts, offsets)
    out[rows] = total[bound[1:]] - total[bound[:-1]]
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the library of ``model`` counts.

    ``model`` is the path of a SentencePiece BPE model; it is read on the driver, and its merge
    table (bounded by the vocabulary) is broadcast.  A null or empty text has no tokens.  Strings
    that look like special tokens are ordinary text.  Repeated rows and null ids are counted as
    they come; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges.of_model(model))

    def work(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                tokens = count_batch(shared.value, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a:b + 1])), pa.array(tokens), pa.array(tokens > limit)],
                                                 ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
