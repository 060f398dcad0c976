"""Fill-in-the-middle: documents cut at unit borders, by arithmetic on words of eight bytes.

A unit is a run of ASCII letters or one other character.  Texts are laid out as uint64 words; a
few operations mark in each byte's high bit whether it ends a unit, ``bitwise_count`` counts the
marks of a word, a search in the running counts finds the word of the k-th end, and a
multiplication finds the byte within it.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import row_chunks, texts_of

CHUNK = 8 << 20  # bytes of text worked on at once (a longer text stands alone)
MARKS = ("<P>", "<S>", "<M>")


def _every(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


HIGH, ONES, EIGHT = _every(0x80), _every(0x01), np.uint64(8)


def lay_out(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes as little-endian uint64 words, each row followed by at least one zero
    byte, and the first word of each row (with the end of the last)."""
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(sizes // 8 + 1)])
    out = np.zeros(int(first[-1]) * 8, np.uint8)
    for at, a, b in zip((first[:-1] * 8).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        out[at:at + b - a] = raw[a:b]
    return out.view("<u8").astype(np.uint64, copy=False), first


def mark(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High bits of the bytes that end a unit, and of those that begin a character."""
    low = (words | _every(0x20)) & _every(0x7F)
    letter = (low + _every(0x80 - ord("a"))) & ~(low + _every(0x7F - ord("z"))) & ~words & HIGH
    inner = words & ~(words << np.uint64(1)) & HIGH  # 10xxxxxx continues a character
    before = letter << EIGHT
    before[1:] |= letter[:-1] >> np.uint64(56)
    begins = HIGH & ~inner & ~(letter & before)
    ends = begins >> EIGHT                            # a unit ends where the next byte begins one
    ends[:-1] |= begins[1:] << np.uint64(56)
    keep = (np.uint64(1) << (EIGHT * (sizes % 8).astype(np.uint64))) - np.uint64(1)
    ends[first[1:] - 1] &= keep
    leads = ~inner & HIGH
    leads[first[1:] - 1] &= keep
    return ends, leads


class Units:
    """Unit ends of many texts: how many there are, where the k-th lies, and characters before it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words, self.first = lay_out(raw, offsets)
        self.ends, self.leads = mark(words, self.first, np.diff(offsets))
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        self.chars = np.concatenate([[0], np.cumsum(np.bitwise_count(self.leads), dtype=np.int64)])
        self.n = self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def byte_after(self, k: np.ndarray) -> np.ndarray:
        """Per row, the number of bytes in its first k units (0 <= k <= n)."""
        out = np.zeros(len(k), np.int64)
        some = np.flatnonzero(k > 0)
        wanted = self.upto[self.first[some]] + k[some]
        word = np.searchsorted(self.upto[1:], wanted, side="left")
        rank = (wanted - self.upto[word]).astype(np.uint64)
        marks = (self.ends[word] >> np.uint64(7)) * ONES     # byte i: marks in bytes 0 to i
        reached = ((marks | HIGH) - rank * ONES) & HIGH
        out[some] = (word - self.first[some]) * 8 + 8 - np.bitwise_count(reached) + 1
        return out

    def chars_before(self, byte: np.ndarray) -> np.ndarray:
        word = self.first[:-1] + byte // 8
        part = self.leads[word] & ((np.uint64(1) << (EIGHT * (byte % 8).astype(np.uint64))) - np.uint64(1))
        return self.chars[word] - self.chars[self.first[:-1]] + np.bitwise_count(part)


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four 32-bit numbers from the id: the leading groups of sha256 of ``seed:id`` (null: ``seed:``)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def fill_in_middle(docs: DataFrame, seed: str = "1", whole: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs``.

    ``whole`` per cent of the documents, empty and null texts, and texts that hold one of MARKS
    stay ``plain``; of the others ``spm`` per cent take the form suffix-prefix-middle and the rest
    prefix-suffix-middle.  Cuts depend on doc_id and text alone, so repeated rows give repeated
    results; a null id draws like the id ``''``.  Further columns are not looked at.
    """
    marks = [m.encode() for m in MARKS]

    def work(batches):
        for batch in batches:
            raw, offsets = texts_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in row_chunks(offsets, CHUNK):
                own = raw[offsets[a]:offsets[b]]
                at = offsets[a:b + 1] - offsets[a]
                units, drawn = Units(own, at), np.array([draws(i, seed) for i in ids[a:b]], np.int64).reshape(-1, 4)
                one, two = drawn[:, 0] % (units.n + 1), drawn[:, 1] % (units.n + 1)
                cuts = [units.byte_after(np.minimum(one, two)), units.byte_after(np.maximum(one, two))]
                chars = [units.chars_before(c) for c in cuts]
                data, form, out = own.tobytes(), [], []
                for i, (s, e, p, m) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), cuts[0].tolist(), cuts[1].tolist())):
                    text = data[s:e]
                    if not text or drawn[i, 2] % 100 >= 100 - whole or any(x in text for x in marks):
                        form.append("plain")
                        out.append(text)
                        continue
                    prefix, middle, suffix = text[:p], text[p:m], text[m:]
                    form.append("spm" if drawn[i, 3] % 100 < spm else "psm")
                    head = marks[0] + prefix
                    tail = marks[1] + suffix
                    out.append((head + tail if form[-1] == "psm" else tail + head) + marks[2] + middle)
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(units.n, pa.int64()), pa.array(form, pa.string()), pa.array(chars[0], pa.int64(), mask=plain),
                     pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The original text from an output and its form."""
    p, s, m = (F.instr(output, x) for x in MARKS)
    end = F.length(output) + 1
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
