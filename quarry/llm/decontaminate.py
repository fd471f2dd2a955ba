"""Benchmark decontamination by the q-gram lemma and banded alignment.

Both sides are normalised (A-Z lower-cased, white space collapsed).  Each
benchmark item becomes one pattern, or several overlapping windows of
``WINDOW`` bytes at a stride of ``STRIDE`` if it is longer, so a passage is
found from any WINDOW + STRIDE - 1 bytes of it on, however it is clipped.  A
region of a document that matches a
pattern of length m with at most e = m * ``EDITS`` edits shares at least
m + 1 - q (1 + e) q-grams with it, all on diagonals within e of each other.
Shared q-grams are counted in overlapping diagonal bands; bands that reach the
bound are verified by a banded edit-distance alignment of the whole pattern.

The pattern index is shipped to the tasks in blocks of at most ``BLOCK`` bytes
of benchmark text, one scan of the documents per block, so a large benchmark
needs more scans but never a larger broadcast.  There is no shuffle of texts.

Null or empty documents and items match nothing; items with fewer than ``LEAST``
normalised bytes identify nothing and are not searched; repeated items and rows
give repeated results; a document row is kept whatever its id; extra columns
are ignored.  Texts of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, U64, _SEPARATOR, mix, read, slices, utf8_column

Q, SHORT = 9, 4
EDITS = 0.09
WINDOW, STRIDE = 80, 20
LEAST = 24
BLOCK = 4 << 20
BITMAP = 22
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str | None) -> bytes:
    return _SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass")).strip(b" ").translate(bytes(LOWER))


def patterns_of(text: bytes) -> list[bytes]:
    if len(text) < LEAST:
        return []
    if len(text) <= WINDOW:
        return [text]
    starts = [*range(0, len(text) - WINDOW, STRIDE), len(text) - WINDOW]
    return [text[s: s + WINDOW] for s in starts]


def budget(m: int) -> int:
    """Edits allowed for a pattern of m bytes: the share, as far as the lemma's bound stays positive."""
    return max(0, min(int(m * EDITS), (m + 1) // Q - 2))


def _grams(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes from each position."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    data = np.ascontiguousarray(buf)
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, Q - 4, (1,)).astype(U64)
    return mix(eight * U64(0x9E3779B97F4A7C15) + four * U64(0xC2B2AE3D27D4EB4F))


class Index:
    """q-grams of a block of patterns."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [i for i, t in items for _ in patterns_of(t)]
        self.patterns = [p for _, t in items for p in patterns_of(t)]
        grams = [_grams(np.frombuffer(p, np.uint8)) for p in self.patterns]
        code = np.concatenate(grams) if grams else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.place = code[order], owner[order], place[order]
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[self.code >> U64(64 - BITMAP)] = True
        sizes = np.array([len(p) for p in self.patterns] or [0])
        self.edits = np.array([budget(m) for m in sizes])
        self.bound = np.maximum(1, sizes + 1 - Q * (1 + self.edits))
        self.band = max(1, int(self.edits.max()) + 1)
        self.reach = int(sizes.max()) + self.band

    def search(self, text: np.ndarray) -> set[int]:
        """Patterns that some region of one normalised text matches."""
        codes = _grams(text)
        at = np.flatnonzero(self.bitmap[codes >> U64(64 - BITMAP)])
        return self.match(text, at, codes[at])

    def match(self, text: np.ndarray, at: np.ndarray, codes: np.ndarray) -> set[int]:
        """The same from the places ``at`` (ascending) whose q-grams pass the bitmap."""
        first = np.searchsorted(self.code, codes)
        some = first < len(self.code)
        some[some] = self.code[first[some]] == codes[some]
        at, codes, first = at[some], codes[some], first[some]
        if not len(at):
            return set()
        # enough q-grams of any pattern within a pattern's reach, before looking at single patterns
        least = int(self.bound.min())
        near = np.searchsorted(at, at + self.reach, "right") - np.arange(len(at))
        change = np.zeros(len(at) + 1, np.int64)
        heads = np.flatnonzero(near >= least)
        np.add.at(change, heads, 1)
        np.add.at(change, heads + near[heads], -1)
        use = np.cumsum(change)[:-1] > 0
        at, codes, first = at[use], codes[use], first[use]
        if not len(at):
            return set()
        fan = np.searchsorted(self.code, codes, "right") - first
        skip = np.repeat(np.cumsum(fan) - fan, fan)
        post = np.repeat(first, fan) + np.arange(int(fan.sum())) - skip
        owner, diagonal = self.owner[post].astype(np.int64), np.repeat(at, fan) - self.place[post]
        # overlapping bands: [k, k + 2) * band, so every run of `band` diagonals lies in one
        k = diagonal // self.band + self.reach
        key = np.concatenate([owner * (1 << 40) + k, owner * (1 << 40) + k - 1])
        bands, counts = np.unique(key, return_counts=True)
        found: set[int] = set()
        for b in bands[counts >= self.bound[bands >> 40]]:
            p = int(b) >> 40
            if p not in found:
                low = ((int(b) & ((1 << 40) - 1)) - self.reach) * self.band
                if aligned(self.patterns[p], text, low, low + 2 * self.band, int(self.edits[p])):
                    found.add(p)
        return found


def aligned(pattern: bytes, text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether the whole pattern aligns with a stretch of ``text`` within ``edits`` on diagonals low - edits .. high + edits."""
    a, b = max(0, low - edits), min(len(text), high + len(pattern) + edits)
    part = text[a:b].tobytes()
    if pattern in part:
        return True
    if not edits or not part:
        return False
    # the lemma again with short q-grams, over the stretch: an edit spoils at most SHORT of the pattern's
    short = {part[k: k + SHORT] for k in range(len(part) - SHORT + 1)}
    if sum(pattern[k: k + SHORT] in short for k in range(len(pattern) - SHORT + 1)) < len(pattern) + 1 - SHORT * (1 + edits):
        return False
    low, width = low - edits - a, high - low + 2 * edits + 1
    # row[j]: least edits of pattern[:i] ending on diagonal low + j; starting anywhere is free
    row = [0 if 0 <= low + j <= len(part) else edits + 1 for j in range(width)]
    for i, c in enumerate(pattern, 1):
        new = []
        left = edits + 1
        for j in range(width):
            x = i + low + j  # end in part
            if x < 0 or x > len(part):
                best = edits + 1
            else:
                best = row[j] + (x < 1 or part[x - 1] != c) if x >= 1 else edits + 1
                if j + 1 < width and row[j + 1] + 1 < best:
                    best = row[j + 1] + 1
                if left + 1 < best:
                    best = left + 1
                if best > edits + 1:
                    best = edits + 1
            new.append(best)
            left = best
        row = new
        if min(row) > edits:
            return False
    return min(row) <= edits


def _normal_piece(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of some texts, and their offsets."""
    space = _SEPARATOR[buf]
    head = np.zeros(len(buf) + 1, bool)
    head[offsets] = True
    before = np.concatenate([[True], space[:-1]]) if len(buf) else space
    keep = ~space | (~before & ~head[:-1])
    out = np.where(space, np.uint8(32), LOWER[buf])[keep]
    kept = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out, kept[offsets]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, bytes]]]:
    """Benchmark items, normalised, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.where(F.col(text_column).isNotNull() & F.col(id_column).isNotNull()).select(id_column, text_column)
    for r in rows.toLocalIterator():
        text = normalise(r[1])
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((int(r[0]), text))
        size += len(text)
    if block:
        yield block


_LIVE: dict[tuple, Index] = {}


def contaminated_items(docs: DataFrame, benchmark: DataFrame, text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """All input columns and ``_items``: sorted ids of the benchmark items found in the text."""
    spark = docs.sparkSession
    # an input column of that name is replaced; the new one stands last, where the tasks look for it
    out = docs.drop("_items").withColumn("_items", F.array().cast("array<bigint>"))
    for number, block in enumerate(_blocks(benchmark, item_column, item_text)):
        shared = spark.sparkContext.broadcast(block)
        key = (number, hash(tuple(block)))
        at = out.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key, at=at) -> Iterator[pa.RecordBatch]:
            if key not in _LIVE:
                _LIVE.clear()
                _LIVE[key] = Index(shared.value)
            index = _LIVE[key]
            for batch in batches:
                found: list[list[int]] = []
                buf, offsets = utf8_column(batch.column(at))
                for a, b in slices(offsets):
                    text, off = _normal_piece(buf[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                    codes = _grams(text)
                    hit = np.flatnonzero(index.bitmap[codes >> U64(64 - BITMAP)]) if len(index.code) else np.zeros(0, np.int64)
                    bounds = np.searchsorted(hit, off)
                    for k in range(b - a):
                        mine = hit[bounds[k]: bounds[k + 1]]
                        mine = mine[mine + Q <= off[k + 1]]
                        got = index.match(text[off[k]: off[k + 1]], mine - off[k], codes[mine]) if len(mine) else ()
                        found.append([index.items[p] for p in got])
                old = batch.column(batch.num_columns - 1).to_pylist()
                items = [sorted({*x, *y}) for x, y in zip(old, found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, pa.list_(pa.int64()))], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"),
                        F.array_join(F.col("_items").cast("array<string>"), ",").alias("items"))
