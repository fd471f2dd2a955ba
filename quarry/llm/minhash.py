"""MinHash near-dedup: universal hash minima, banding, verification, components.

A text's set is its distinct ``width``-word shingles (lower-cased A-Z); with
fewer words the whole sequence is one shingle, without words the set is empty
and linked with nothing.  Texts with equal sets form a class at once (a key
per set); one member stands for the class.

Representatives get ``BANDS * ROWS`` minima of 2-universal hash functions.
Two sets of similarity 0.8 share no band with a chance below 1e-5, of 0.85
below 1e-7.  Candidate pairs are screened by signature (a link would have to be
five standard deviations off to be missed) and confirmed on the full sets, in
three rounds with components after each: every member of a bucket with the
bucket's smallest id; then, in buckets whose other members are in several
components, the members of smaller components with the most similar one of
another in a block; last, all members outside the bucket's largest component
with all of other components, block by block, each pair in the first band that
both share.  The last round ships the sets of members that have
such a pair, confirms inside the task and returns at most one link a member (a
spanning forest), so groups just under the threshold make no rows.  So no link
between different texts that share a band is lost, and pairs inside a component
are never emitted.

Null texts are empty; texts of any length are used whole; rows with a null id
are never linked and kept; rows with the same id count as one document;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SMALL_PIECE, Hasher, U64, cut, mix, pieces, read, release, tasks_for, utf8_column
from quarry.llm.components import connected_components

BANDS, ROWS = 30, 5
SIGMAS = 5  # standard deviations of the signature's estimate that a link may fall short of the threshold
BLOCK = 512  # bucket members compared at once in the exhaustive step
TASK_TEXTS, TASK_SHINGLES = 8192, 2_000_000  # texts and shingles that a task of the steps after the signatures stands for
HASH = Hasher(1010)
_RNG = np.random.Generator(np.random.PCG64(77))
A = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | U64(1)
B = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by text, and the bounds of each text's part."""
    words = HASH.words(piece.buf, piece.starts, piece.ends)
    inside = piece.windows_inside(width)
    at = np.flatnonzero(inside)
    texts = len(piece.counts)
    doc = np.repeat(np.arange(texts), piece.counts)[at]
    hashes = HASH.windows(words, width)[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((piece.counts > 0) & (piece.counts < width))
    if len(short):
        extra = np.concatenate([HASH.windows(words[piece.first[k]: piece.first[k + 1]], int(piece.counts[k])) for k in short])
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, mix(extra + U64(width))])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(texts + 1))


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, a row per text with a set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint16)
    if len(full):
        starts, work = bounds[full], np.empty_like(hashes)
        for k in range(BANDS * ROWS):
            np.multiply(hashes, A[k], out=work)
            np.add(work, B[k], out=work)
            out[full, k] = (mix(np.minimum.reduceat(work, starts)) & U64(0xFFFF)).astype(np.uint16)
    return out


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, piece in pieces(*utf8_column(batch.column(1)), lower=True, limit=SMALL_PIECE):
                hashes, bounds = shingle_sets(piece, width)
                n = np.diff(bounds)
                keys = np.zeros((b - a, 2), U64)
                full = np.flatnonzero(n)
                if len(full):
                    keys[full, 0] = np.add.reduceat(mix(hashes), bounds[full])
                    keys[full, 1] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), bounds[full])
                sig = _signatures(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()),
                     pa.array([k.tobytes() if c else None for k, c in zip(keys, n)], pa.binary()),
                     pa.array([s.tobytes() if c else None for s, c in zip(sig, n)], pa.binary())],
                    ["doc_id", "n_shingles", "key", "sig"])
    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
        with np.errstate(over="ignore"):
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), sig.shape[:2])
            for k in range(ROWS):
                h = mix(h * U64(0x100000001B3) + sig[:, :, k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)),
             pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "nth", "rep"])


def _least(threshold: float) -> float:
    return threshold - SIGMAS * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def _screen(threshold: float):
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
                ok = (one == two).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])
    return run


def _confirm(width: int, percent: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, piece in pieces(*utf8_column(column), lower=True, limit=SMALL_PIECE):
            hashes, bounds = shingle_sets(piece, width)
            out += [hashes[x:y] for x, y in zip(bounds, bounds[1:])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ok = []
                for x, y in zip(sets(part.column(2)), sets(part.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in part.columns[:2]], ["u", "v"])
    return run


def _set_rows(width: int):
    """(rep, set) with the sorted shingle hashes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, piece in pieces(*utf8_column(batch.column(1)), lower=True, limit=SMALL_PIECE):
                hashes, bounds = shingle_sets(piece, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([hashes[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())], ["rep", "set"])
    return run


def _members(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rep = table["rep"].to_numpy()
    return rep, table["comp"].to_numpy().copy(), np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(rep), -1)


def _nearest(threshold: float):
    """For each member outside the largest component of a task, the most similar one of another component."""
    least = _least(threshold)

    def run(key, table):
        rep, comp, sig = _members(table)
        kinds, n = np.unique(comp, return_counts=True)
        one, two = [], []
        for m in np.flatnonzero(comp != kinds[np.argmax(n)]):
            other = np.flatnonzero(comp != comp[m])
            near = (sig[other] == sig[m]).mean(axis=1)
            k = int(np.argmax(near))
            if near[k] >= least:
                one.append(min(rep[m], rep[other[k]]))
                two.append(max(rep[m], rep[other[k]]))
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
    return run


def _pairs_across(table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(member, those of other components that pass the screen and share no earlier band), each pair once.

    ``side`` 0 holds members outside the bucket's largest component, ``side`` 1
    any members; of two members that are both outside, the smaller id asks.
    """
    rep, comp, sig = _members(table)
    side, small, nth = table["side"].to_numpy(), table["small"].to_numpy().astype(bool), table["nth"][0].as_py()
    right = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        other = right[(comp[right] != comp[x]) & (~small[right] | (rep[right] > rep[x]))]
        if len(other):
            same = sig[other] == sig[x]
            ok = np.flatnonzero(same.mean(axis=1) >= least)
            ok = ok[np.argmax(same[ok].reshape(-1, BANDS, ROWS).all(axis=2), axis=1) == nth]
            if len(ok):
                yield x, other[ok]


def _worth_confirming(threshold: float):
    """The rows of a task that are in any pair across components which has to be confirmed."""
    least = _least(threshold)

    def run(key, table):
        wanted = np.zeros(table.num_rows, bool)
        for x, other in _pairs_across(table, least):
            wanted[x] = wanted[other] = True
        return table.select([f.split()[0] for f in ROW.split(", ")]).filter(pa.array(wanted))
    return run


def _across(threshold: float, percent: int):
    """Links across components within a task, confirmed on the full sets.

    A pair is looked at in the first band that both share.  Members that
    links of this task have joined are not joined again, so a task returns
    fewer links than it has members, however many pairs are similar.
    """
    least = _least(threshold)

    def run(key, table):
        rep, comp, _ = _members(table)
        sets = [np.frombuffer(x, U64) for x in table["set"].to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        one, two = [], []
        for x, other in _pairs_across(table, least):
            other = other[comp[other] != comp[x]]
            if not len(other):
                continue
            theirs = np.concatenate([sets[y] for y in other])
            at = np.minimum(np.searchsorted(sets[x], theirs), size[x] - 1)
            both = np.add.reduceat((sets[x][at] == theirs).astype(np.int64), np.cumsum(size[other]) - size[other])
            for y in other[(both > 0) & (100 * both >= percent * (size[x] + size[other] - both))]:
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    one.append(rep[x])
                    two.append(rep[y])
        return pa.table({"u": pa.array(one, pa.int64()), "v": pa.array(two, pa.int64())})
    return run


ROW = "band long, i int, j int, nth int, side int, small int, rep long, comp long"


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: sets linked when 100*|A&B| >= percent*|A|B|."""
    threshold, spark = percent / 100, docs.sparkSession
    d = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    described = cut(d.mapInArrow(_describe(width), "doc_id long, n_shingles long, key binary, sig binary"))
    amount = described.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    tasks = tasks_for(spark, max(amount["n"] / TASK_TEXTS, amount["shingles"] / TASK_SHINGLES))

    def few(df: DataFrame) -> DataFrame:
        """The steps after the signatures are many and small: as many tasks as the amount of text asks for."""
        return df.coalesce(tasks)

    d, described = few(d), few(described)
    reps = cut(few(described.where("key is not null and doc_id is not null")
                   .groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))))
    sigs = reps.select("rep", "sig")
    bands = sigs.select("rep", "sig").mapInArrow(_band_rows, "band long, nth int, rep long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Screened pairs (a, b) that are links on the full sets."""
        wanted = cut(few(pairs))
        ids = few(wanted.select(F.col("a").alias("doc_id")).union(wanted.select("b")).distinct())
        texts = cut(few(d.where("doc_id is not null").join(ids, "doc_id")))
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return cut(few(few(few(wanted.join(left, "a")).join(right, "b").select("a", "b", "text_a", "text_b"))
                       .mapInArrow(_confirm(width, percent), "u long, v long").distinct()))

    # every member of a bucket with the bucket's smallest id
    centres = cut(few(bands.groupBy("band").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")))
    star = cut(few(few(bands.join(centres, "band").where("rep <> a").select("a", F.col("rep").alias("b"))).distinct()))
    screened = few(few(star.join(sigs.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a"))
                   .join(sigs.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b").select("a", "b", "sig_a", "sig_b")).mapInArrow(
                       _screen(threshold), "a long, b long")
    known = cut(few(connected_components(confirmed(screened), tasks)))

    def joined(links: DataFrame) -> DataFrame:
        """Components with some more links; those so far stand for the links that made them."""
        return cut(few(connected_components(
            known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), tasks)))

    def open_buckets() -> DataFrame | None:
        """Members of buckets in which pairs across components are left; the centre's pairs are done."""
        named = few(sigs.join(known, sigs["rep"] == known["node"], "left").select("rep", F.coalesce("component", "rep").alias("comp")))
        members = few(few(bands.join(centres, "band").where("rep <> a").select("band", "nth", "rep")).join(named, "rep"))
        still = cut(few(few(members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))).groupBy("band")
                        .agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")))
        return None if still.isEmpty() else few(members.join(still, "band"))

    def share(members: str) -> Column:
        """Number of blocks of ``BLOCK`` members."""
        return F.ceil(F.expr(members) / BLOCK).cast("int")

    left = open_buckets()
    if left is not None:
        own = F.pmod(F.xxhash64("rep"), share("n")).cast("int").alias("i")  # each member meets those of its own block only
        near = few(few(left.select("band", own, "rep", "comp").join(sigs, "rep")).groupBy("band", "i").applyInArrow(_nearest(threshold), "a long, b long"))
        known = joined(confirmed(few(near.distinct()).join(star, ["a", "b"], "left_anti")))
        release(spark)
        left = open_buckets()
    if left is not None:
        # members outside the largest component meet all members; those inside it do not meet each other
        left = left.withColumn("small", (F.col("comp") != F.col("largest")).cast("int"))
        asking = left.where("small = 1").select(
            "band", F.pmod(F.xxhash64("rep"), share("n - most")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), share("n") - 1)).alias("j"),
            "nth", F.lit(0).alias("side"), "small", "rep", "comp")
        asked = left.select("band", F.explode(F.sequence(F.lit(0), share("n - most") - 1)).alias("i"),
                            F.pmod(F.xxhash64("rep"), share("n")).cast("int").alias("j"), "nth", F.lit(1).alias("side"), "small", "rep", "comp")
        rows = cut(few(few(asking.union(asked).join(sigs, "rep")).groupBy("band", "i", "j").applyInArrow(_worth_confirming(threshold), ROW)))
        texts = few(d.where("doc_id is not null").join(few(rows.select(F.col("rep").alias("doc_id")).distinct()), "doc_id"))
        sets = cut(few(texts.mapInArrow(_set_rows(width), "rep long, set binary").where("octet_length(set) > 0").distinct()))
        links = cut(few(few(few(few(rows.join(sigs, "rep")).join(sets, "rep")).groupBy("band", "i", "j").applyInArrow(_across(threshold, percent), "u long, v long"))
                        .distinct()))
        release(spark)
        if not links.isEmpty():
            known = joined(links)
    final = known
    by_key = cut(few(reps.select("key", "rep").join(final, F.col("rep") == F.col("node"), "left")
                     .select("key", F.coalesce("component", "rep").alias("least"))))
    out = few(described.select("doc_id", "n_shingles", "key").join(by_key, "key", "left"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    return out.select(F.col("doc_id").alias(id_column), "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
