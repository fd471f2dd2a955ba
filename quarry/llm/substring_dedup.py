"""Substring dedup with difference-cover anchors.

A window is ``width`` consecutive words.  For a difference cover D modulo v,
any two positions i, j have a shift k < v with (i+k) mod v and (j+k) mod v both
in D.  So if the windows at i and j are equal, they share an equal *anchor*
(``width - v + 1`` words) that starts at a cover position of either text.
Anchors are hashed at cover positions only (5 of 21 positions for 35 words);
a position whose anchor occurs once cannot lie in a repeated window at that
anchor.  Around every repeated anchor the windows that contain it are extended
to full windows and compared by 128-bit hashes, and words covered by a window
that occurs twice are removed.

Jobs: (1) equal texts are merged, keeping their number; (2) anchors go to
buckets by hash and come back as (text, positions) where repeated; (3) the same
with the candidate windows; (4) removal.  Each Arrow batch sends a distinct
hash to its bucket once and settles repetitions inside the batch itself, so a
hot passage costs one entry a batch.  The number of buckets follows the
measured text size.

A text that occurs more than once has all words removed if it has ``width`` or
more.  Null texts are empty; texts shorter than a window keep all words; equal
rows get equal results; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Hasher, U64, buckets_for, cut, pieces, read, text_bytes, utf8_column

WIDTH = 35
BUCKET_BYTES = 24 << 20  # text whose anchors or windows share a bucket
KEY = 16  # bytes of a text's key
# Perfect difference sets (every difference modulo the period occurs).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
FIRST, SECOND = Hasher(1101), Hasher(2203)
BLOB = "bucket int, keys binary, counts binary, pos binary, h1 binary, h2 binary"
HITS = "key binary, pos binary"


def cover_for(width: int) -> tuple[int, np.ndarray, int]:
    """Period, member table and anchor length: the longest period leaving anchors of 2/5 of the window."""
    period = max(v for v in COVERS if v == 1 or (width - v + 1) * 5 >= width * 2)
    member = np.zeros(period, bool)
    member[list(COVERS[period])] = True
    return period, member, width - period + 1


def _pack(doc: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys, counts and position steps of entries ordered by (doc, pos)."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.flatnonzero(new)
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    return keys[doc[first]].tobytes(), np.diff(np.append(first, len(doc))).astype("<u4").tobytes(), step.astype("<u4").tobytes()


def _unpack(counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Text number and position of each entry."""
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    step = np.frombuffer(steps, "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    return doc, total - np.repeat(total[first] - step[first], n) if len(n) else total


def _repeated(h1: np.ndarray, h2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: it has an equal one; it is the first of its equals."""
    n = len(h1)
    order = np.argsort(h1, kind="stable") if h2 is None else np.lexsort((np.arange(n), h2, h1))
    s = h1[order]
    same = s[1:] == s[:-1]
    if h2 is not None:
        t = h2[order]
        same &= t[1:] == t[:-1]
    again, first = np.zeros(n, bool), np.ones(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return again, first


def _blobs(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray | None, n: int) -> pa.RecordBatch:
    """Rows for the buckets: each distinct hash once; entries repeated in this batch go without hashes, as hits."""
    again, first = _repeated(h1, h2)
    rows: dict[str, list] = {c: [] for c in ("bucket", "keys", "counts", "pos", "h1", "h2")}

    def add(at: np.ndarray, bucket: int, hashes: bool):
        at = at[np.lexsort((pos[at], doc[at]))]
        for c, v in zip(("keys", "counts", "pos"), _pack(doc[at], pos[at], keys)):
            rows[c].append(v)
        rows["bucket"].append(bucket)
        rows["h1"].append(h1[at].astype("<u8").tobytes() if hashes else b"")
        rows["h2"].append(h2[at].astype("<u8").tobytes() if hashes and h2 is not None else b"")

    hits = np.flatnonzero(again)
    if len(hits):
        for k, part in enumerate(np.array_split(hits, max(1, len(hits) >> 17))):
            add(part, int(h1[hits[0]] + U64(k)) % n, False)
    send = np.flatnonzero(first)
    bucket = ((h1[send] >> U64(32)) % U64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    send, bucket = send[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(send)]):
        add(send[a:b], int(bucket[a]), True)
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: (key, positions) of the entries whose hash occurs in another batch, and of the hits."""
    h1 = [np.frombuffer(b, "<u8") for b in rows["h1"]]
    all1 = np.concatenate(h1)
    two = [np.frombuffer(b, "<u8") for b in rows["h2"]]
    all2 = np.concatenate(two)
    again, _ = _repeated(all1, all2 if len(all2) else None)
    out_keys, out_pos, at = [], [], 0
    for k, counts, steps, own in zip(rows["keys"], rows["counts"], rows["pos"], h1):
        doc, pos = _unpack(counts, steps)
        if len(own):
            keep = again[at: at + len(own)]
            at += len(own)
            doc, pos = doc[keep], pos[keep]
        if len(doc):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(first, [*first[1:], len(doc)]):
                out_keys.append(k[doc[a] * KEY: (doc[a] + 1) * KEY])
                out_pos.append(pos[a:b].astype("<u4").tobytes())
    return pd.DataFrame({"key": out_keys, "pos": out_pos})


def _rows(column: pa.Array) -> np.ndarray:
    """The fixed-size keys of a batch."""
    return np.frombuffer(b"".join(column.to_pylist()), f"V{KEY}")


def _marks(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(v), "<u4").astype(np.int64) if v else np.zeros(0, np.int64) for v in column.to_pylist()]


def _anchors(width: int, n: int):
    period, member, size = cover_for(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, hashes = [], [], []
            for a, _, p in pieces(*utf8_column(batch.column(1))):
                inside = p.windows_inside(size)
                if not len(inside):
                    continue
                doc = np.repeat(np.arange(len(p.counts)), p.counts)[: len(inside)]
                pos = np.arange(len(inside)) - p.first[doc]
                use = np.flatnonzero(inside & member[pos % period] & (p.counts[doc] >= width))
                h = FIRST.windows(FIRST.words(p.buf, p.starts, p.ends), size)
                docs.append(doc[use] + a)
                places.append(pos[use])
                hashes.append(h[use])
            if docs and sum(map(len, docs)):
                yield _blobs(_rows(batch.column(0)), np.concatenate(docs), np.concatenate(places), np.concatenate(hashes), None, n)
    return run


def _candidates(width: int, n: int):
    period, _, _ = cover_for(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch.column(3))
            docs, places, one, two = [], [], [], []
            for a, b, p in pieces(*utf8_column(batch.column(1))):
                change = np.zeros(len(p.starts) + 1, np.int64)
                for k in range(b - a):
                    m, last = marks[a + k], p.counts[k] - width
                    lo, hi = np.maximum(m - (period - 1), 0), np.minimum(m, last) + 1
                    ok = lo < hi
                    np.add.at(change, p.first[k] + lo[ok], 1)
                    np.add.at(change, p.first[k] + hi[ok], -1)
                use = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                if not len(use):
                    continue
                doc = np.searchsorted(p.first, use, "right") - 1
                docs.append(doc + a)
                places.append(use - p.first[doc])
                for to, hasher in ((one, FIRST), (two, SECOND)):
                    to.append(hasher.windows(hasher.words(p.buf, p.starts, p.ends), width)[use])
            if docs:
                yield _blobs(_rows(batch.column(0)), np.concatenate(docs), np.concatenate(places), np.concatenate(one), np.concatenate(two), n)
    return run


def _removal(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed, texts = [], [], []
            for text, copies, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _marks(batch.column(3))):
                words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
                n = len(words)
                gone = np.zeros(n, bool)
                if copies > 1 and n >= width:
                    gone[:] = True
                elif len(marks):
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, marks, 1)
                    np.add.at(change, marks + width, -1)
                    gone = np.cumsum(change)[:-1] > 0
                cut_words = int(gone.sum())
                kept = words if not cut_words else [w for w, g in zip(words, gone) if not g]
                words_n.append(n)
                removed.append(cut_words)
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                ["key", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text",
                   keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the text that is left) of each row."""
    d = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # never null, and known not to be, so that inner joins add no filter below the shared exchange
    key = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 2 * KEY))
    d = d.withColumn("key", F.coalesce(key, F.lit(bytes(KEY))))
    n = buckets_for(text_bytes(d), BUCKET_BYTES)
    texts = d.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def hits(blobs: DataFrame) -> DataFrame:
        return (blobs.groupBy("bucket").applyInPandas(_settle, HITS)
                .groupBy("key").agg(F.collect_list("pos").alias("pos")))  # at most a text's own positions

    # every branch takes all three columns, so that they share one exchange of the texts
    found = hits(texts.mapInArrow(_anchors(width, n), BLOB))
    windows = hits(texts.join(found, "key").select("key", "text", "copies", "pos").mapInArrow(_candidates(width, n), BLOB))
    result = (texts.join(windows, "key", "left").select("key", "text", "copies", "pos")
              .mapInArrow(_removal(width), "key binary, n_words long, n_removed long, kept_sha256 string, kept string"))
    if not keep_text:
        result = result.drop("kept")
    result = cut(result)
    return d.select("doc_id", "key").join(result, "key").drop("key").withColumnRenamed("doc_id", id_column)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
