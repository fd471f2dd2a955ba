"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Both tokenizers cut a space and the text into tokens; the ascending byte
offsets at which tokens end are two sorted lists.  Their merge (equal ends: A
first) is a path through a grid, and diagonals at equal distances cut it into
pieces of equal work: a binary search on each diagonal says how many ends of A
and of B lie before it.  All pieces then walk at the same time, one step of
every piece per array operation, and number the groups that they see: a group
closes when an end of B equals the last end of A.  A prefix sum over the
pieces' closed groups stitches groups that cross a border.  Texts of a piece
of work follow each other in the two lists; all end a group, so none spans two.

Per piece of text a map task writes one row: the documents, the groups of each
by number, the pairs of ids in each distinct group, and in how many of its
documents each pair is linked.  These counts are summed over the corpus by
pair, an id's highest count is a maximum over at most the other vocabulary,
and a piece gets the sums back for the pairs it holds, not for every link.

Links are never listed: a group of m and n tokens counts m * n, and its pairs
are kept as distinct ids with multiplicities.  Equal groups of a piece of text
are told by a 64-bit hash of their tokens.  Null and empty texts, and texts
that a tokenizer does not give back byte for byte, have no tokens: zeros and
an empty digest.  Each row counts as a document, also with a null or repeated
id.  Texts of any length are aligned whole; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import SPLIT, byte_symbols, vocabulary_path
from quarry.llm.common import U64, mix, ranges, read, slices, utf8_column
from quarry.session import ensure_checkpoint_dir

PIECE = 3 << 20  # bytes of text in a row of the written table
BLOCK = 256 << 10  # bytes of it tokenized and merged at once
ROWS = 8  # rows of that table in a file: readers and writers hold a file's rows at once
CALL = 256 << 10  # bytes of text per tokenizer call
WIDTH = 128  # steps of a merge piece
LARGE = 4096  # links of a group above which its distinct ids are paired
SPACE = "▁"
RESULT = "n_a n_b n_groups n_links n_best count_sum".split()

_UNBROKEN = re.compile(r"\S{2000}|\s{2000}")


class Vocabulary:
    """Bytes of each token id in one buffer."""

    def __init__(self, tokens: dict[int, bytes]):
        size = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            size[i] = len(t)
        self.size, self.at = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(size))), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = int(size.sum())
        small = np.int32 if total < 1 << 31 else np.int64  # half the memory traffic
        at = np.repeat((self.at[ids] - np.cumsum(size) + size).astype(small), size)
        at += np.arange(total, dtype=small)
        return self.data[at]


class ByteLevel:
    """Byte-level BPE of a JSON file; long unbroken texts go through the library that merges by a heap."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(spec)
        back = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in model.get("added_tokens") or []}
        ranks = {bytes(back[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.safe = Tokenizer.from_str(spec)
        self.safe.encode_special_tokens = True
        self.vocabulary = Vocabulary({i: t for t, i in ranks.items()})

    def encode(self, texts: list[str], unbroken: bool = True) -> list[list[int]]:
        """``unbroken``: some text may have a long run of one kind of character."""
        if not unbroken:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [self.safe.encode(" " + t, add_special_tokens=False).ids if _UNBROKEN.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Sentence-piece model that puts a space before the text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

        def token(i: int) -> bytes:
            p = self.model.id_to_piece(i)
            return bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
        self.vocabulary = Vocabulary({i: token(i) for i in range(self.model.get_piece_size())})

    def encode(self, texts: list[str], unbroken: bool = True) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LIVE: dict[int, tuple[ByteLevel, Pieces]] = {}  # one pair of tokenizers per Python worker


def merge_path(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each token, from the ascending ends of both tokenizers (their last ends are equal)."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, width), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        k = np.flatnonzero(open_)
        middle = (low[k] + high[k]) >> 1
        before = a[middle] <= b[diagonal[k] - 1 - middle]
        low[k], high[k] = np.where(before, middle + 1, low[k]), np.where(before, high[k], middle)
    i, j = low[:-1].copy(), (diagonal - low)[:-1].copy()
    never = np.full(width + 1, np.iinfo(np.int64).max)
    ends_a, ends_b = np.concatenate([[-1], a, never]), np.concatenate([b, never])  # ends_a[i] is the end before token i
    group_a, group_b = np.zeros(len(a) + width + 1, np.int64), np.zeros(len(b) + width + 1, np.int64)
    closed = np.zeros(len(i), np.int64)
    for _ in range(width):  # one step of every piece; the last piece walks on into the padding
        end_b = ends_b[j]
        takes_a = ends_a[i + 1] <= end_b
        takes_b = ~takes_a
        group_a[i[takes_a]] = closed[takes_a]
        group_b[j[takes_b]] = closed[takes_b]
        closed += takes_b & (end_b == ends_a[i])
        i += takes_a
        j += takes_b
    stitched = np.cumsum(closed) - closed
    return (group_a[: len(a)] + np.repeat(stitched, np.diff(low)),
            group_b[: len(b)] + np.repeat(stitched, np.diff(diagonal - low)))


def _firsts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(group, prepend=-1))


def _hashes(ids_a, first_a, count_a, ids_b, first_b, count_b) -> np.ndarray:
    """Hash of each group's tokens."""
    def side(ids, first, count, salt):
        place = np.arange(len(ids)) - np.repeat(first, count)
        return np.add.reduceat(mix(ids.astype(U64) + (place.astype(U64) << U64(20)) + U64(salt)), first)
    return mix(side(ids_a, first_a, count_a, 1 << 60) + mix(side(ids_b, first_b, count_b, 1 << 61)))


def _pairs(ids_a, first_a, count_a, ids_b, first_b, count_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, multiplicity) of the given groups, ascending, and the distinct pairs as a << 32 | b."""
    many = count_a * count_b
    small = np.flatnonzero(many <= LARGE)
    group = np.repeat(small, many[small])
    k = ranges(np.zeros(len(small), np.int64), many[small])
    a, b = first_a[group] + k // count_b[group], first_b[group] + k % count_b[group]
    codes, groups, times = [ids_a[a] << 32 | ids_b[b]], [group], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(many > LARGE):
        x, nx = np.unique(ids_a[first_a[g]: first_a[g] + count_a[g]], return_counts=True)
        y, ny = np.unique(ids_b[first_b[g]: first_b[g] + count_b[g]], return_counts=True)
        codes.append((x[:, None] << 32 | y).ravel())
        groups.append(np.full(len(x) * len(y), g))
        times.append((nx[:, None] * ny).ravel())
    distinct, pair = np.unique(np.concatenate(codes), return_inverse=True)
    key = np.concatenate(groups) * max(1, len(distinct)) + pair
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.concatenate(times)[order]
    at = _firsts(key)
    return key[at] // max(1, len(distinct)), key[at] % max(1, len(distinct)), np.add.reduceat(times, at) if len(at) else times, distinct


def _encode(tokenizer, texts: list[str], bounds: np.ndarray, unbroken: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the number of each text."""
    ids, counts = [], []
    for a, b in slices(bounds, CALL):
        got = tokenizer.encode(texts[a:b], unbroken)
        counts += map(len, got)
        ids.append(np.fromiter(itertools.chain.from_iterable(got), np.int64, sum(map(len, got))))
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(counts, np.int64)


# decimal text of each id and the sign behind it, in rows of six bytes, and how many of them count
_DIGITS = np.array([list(f"{i},".encode().ljust(6, b"\0")) for i in range(1 << 16)], np.uint8)
_USED = _DIGITS != 0


def _digests(out: dict, group_at, ids_a, ids_b, group_a, group_b, first_a, first_b, count_a) -> None:
    """sha256 of each document's groups: every token is its decimal id and one of , | ; behind it."""
    place_a = np.arange(len(ids_a)) + first_b[group_a]  # behind the B tokens of the groups before
    place_b = np.arange(len(ids_b)) + (first_a + count_a)[group_b]
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    if ids.max() >= 1 << 16:
        raise ValueError("token ids above 65535")
    used = _USED[ids]
    text = _DIGITS[ids][used]
    ends = np.cumsum(used.sum(axis=1))
    text[ends[place_a[first_a + count_a - 1]] - 1] = ord("|")
    text[ends[place_b[np.append(first_b[1:], len(ids_b)) - 1]] - 1] = ord(";")
    starts = np.concatenate([[0], ends])[np.append(first_a + first_b, len(ids))]  # where each group's text begins
    for k in np.flatnonzero(out["n_groups"]):
        out["groups_sha256"][k] = hashlib.sha256(text[starts[group_at[k]]: starts[group_at[k + 1]] - 1]).hexdigest()


def _groups(byte_level: ByteLevel, pieces: Pieces, buf: np.ndarray, bounds: np.ndarray) -> tuple[dict, tuple]:
    """Columns of some texts (given by bytes and bounds); ids of both sides, tokens of each group, group hashes and documents."""
    texts = [buf[x:y].tobytes().decode() for x, y in zip(bounds, bounds[1:])]
    full = np.diff(bounds) > 0
    want = np.insert(buf, bounds[:-1][full], 32)  # a space before each text
    want_at = np.concatenate([[0], np.cumsum(np.diff(bounds) + full)])
    white = np.flatnonzero(np.diff((buf <= 32) | (buf >= 128)))  # a run of 2000 of either kind is at least a stretch without such edges
    unbroken = bool(np.diff(np.concatenate([[0], white, [len(buf)]])).max() >= 1000)
    ids, n, good = [], [], full.copy()
    for tokenizer in (byte_level, pieces):
        x, count = _encode(tokenizer, texts, bounds, unbroken)
        count = np.where(full, count, 0)  # tokens of an empty text are dropped
        if len(x) != count.sum():
            x, count = _encode(tokenizer, [t for t in texts if t], np.concatenate([[0], np.cumsum(np.diff(bounds)[full])]), unbroken)
            count = np.bincount(np.flatnonzero(full), weights=count, minlength=len(full)).astype(np.int64)
        have = tokenizer.vocabulary.joined(x)
        sums = np.concatenate([[0], np.cumsum(tokenizer.vocabulary.size[x])])
        have_at = sums[np.concatenate([[0], np.cumsum(count)])]
        same = np.diff(have_at) == np.diff(want_at)
        for k in np.flatnonzero(same & full) if not (np.array_equal(have_at, want_at) and np.array_equal(have, want)) else ():
            same[k] = np.array_equal(have[have_at[k]: have_at[k + 1]], want[want_at[k]: want_at[k + 1]])
        good &= same
        ids.append(x)
        n.append(count)
    for s in (0, 1):
        ids[s] = ids[s][np.repeat(good, n[s])]
        n[s] = np.where(good, n[s], 0)
    docs = len(texts)
    out = {"n_a": n[0], "n_b": n[1], "n_groups": np.zeros(docs, np.int64), "n_links": np.zeros(docs, np.int64), "groups_sha256": [""] * docs}
    none = np.zeros(0, np.int32)
    if not len(ids[0]):
        return out, (none, none, none, none, np.zeros(0, U64), none)
    group_a, group_b = merge_path(np.cumsum(byte_level.vocabulary.size[ids[0]]), np.cumsum(pieces.vocabulary.size[ids[1]]))
    first_a, first_b = _firsts(group_a), _firsts(group_b)
    count_a, count_b = np.diff(np.append(first_a, len(group_a))), np.diff(np.append(first_b, len(group_b)))
    doc = np.repeat(np.arange(docs), n[0])[first_a]  # document of each group
    out["n_groups"] = np.bincount(doc, minlength=docs)
    group_at = np.concatenate([[0], np.cumsum(out["n_groups"])])
    out["n_links"] = np.diff(np.concatenate([[0], np.cumsum(count_a * count_b)])[group_at])
    _digests(out, group_at, ids[0], ids[1], group_a, group_b, first_a, first_b, count_a)
    return out, (*(x.astype(np.int32) for x in (*ids, count_a, count_b)), _hashes(ids[0], first_a, count_a, ids[1], first_b, count_b), doc.astype(np.int32))


def _align(byte_level: ByteLevel, pieces: Pieces, buf: np.ndarray, bounds: np.ndarray) -> dict:
    """What one row of the written table holds about some texts (given by bytes and bounds).

    Texts are tokenized and merged ``BLOCK`` by ``BLOCK``; what stays of a block are its ids and a few numbers a group.
    """
    out: dict = {c: [] for c in _LISTS[1:]}
    blocks = []
    for x, y in slices(bounds, BLOCK):
        r, block = _groups(byte_level, pieces, buf[bounds[x]: bounds[y]], bounds[x: y + 1] - bounds[x])
        for c in out:
            out[c].append(r[c])
        blocks.append(block)
    out = {c: list(itertools.chain.from_iterable(v)) if c == "groups_sha256" else np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
    out |= dict.fromkeys(("kinds", "link_kind", "link_pair", "link_times"), np.zeros(0, np.int32)) | dict.fromkeys(("a", "b", "n"), np.zeros(0, np.int32))
    if not any(len(x[0]) for x in blocks):
        return out
    docs = [x[5] for x in blocks]
    sides, hashes = [(0, 2), (1, 3)], np.concatenate([x[4] for x in blocks])
    _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)  # one group of each kind, kind of each group
    kind = kind.astype(np.int32)
    of_kinds = []
    for ids, count in sides:
        held, counts = np.concatenate([x[ids] for x in blocks]), np.concatenate([x[count] for x in blocks]).astype(np.int64)
        first = np.cumsum(counts) - counts
        of_kinds += [held[ranges(first[one], counts[one])].astype(np.int64), np.cumsum(counts[one]) - counts[one], counts[one]]
    del hashes, held, counts, first, blocks
    link_kind, pair, times, distinct = _pairs(*of_kinds)
    # documents of each pair, block by block: distinct (document, kind), then distinct (document, pair)
    at = np.searchsorted(link_kind, np.arange(len(one) + 1))
    number, k = np.zeros(len(distinct), np.int64), 0
    for doc in docs:
        in_doc = np.sort(doc.astype(np.int64) * len(one) + kind[k: k + len(doc)])
        k += len(doc)
        in_doc = in_doc[_firsts(in_doc)]
        d, u = in_doc // len(one), in_doc % len(one)
        many = np.diff(at)[u]
        held = np.sort(np.repeat(d, many) * len(distinct) + pair[ranges(at[u], many)])
        held = held[_firsts(held)]
        number += np.bincount(held % len(distinct), minlength=len(distinct))
    out |= {"kinds": kind, "link_kind": link_kind.astype(np.int32), "link_pair": pair.astype(np.int32),
            "link_times": times.astype(np.int32), "a": (distinct >> 32).astype(np.int32), "b": (distinct & 0xFFFFFFFF).astype(np.int32),
            "n": number.astype(np.int32)}
    return out


_LISTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BINARY = ["kinds", "link_kind", "link_pair", "link_times"]
_TABLE = ("piece string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, kinds binary, link_kind binary, link_pair binary, link_times binary, a array<int>, b array<int>, n array<int>")
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(docs, counts):
    """Rows of the documents of one piece, from its table row and the corpus counts of its pairs."""
    parts = []
    for r in docs.select([*_LISTS, *_BINARY]).to_pylist():
        kinds, link_kind, link_pair, times = (np.frombuffer(r[c], np.int32) for c in _BINARY)
        groups = np.array(r["n_groups"], np.int64)
        best = total = np.zeros(len(groups), np.int64)
        if len(link_kind):
            n, top = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
            k = counts["k"].to_numpy()
            n[k], top[k] = counts["count"].to_numpy(), counts["best"].to_numpy()
            at, bounds = _firsts(link_kind), np.concatenate([[0], np.cumsum(groups)])

            def per_document(value, at=at, bounds=bounds, kinds=kinds, link_pair=link_pair, times=times):
                of_kind = np.add.reduceat(value[link_pair] * times, at)
                return np.diff(np.concatenate([[0], np.cumsum(of_kind[kinds])])[bounds])
            best, total = per_document(top), per_document(n)
        parts.append(pa.table([pa.array(r["doc_id"], pa.int64()), *[pa.array(r[c], pa.int64()) for c in RESULT[:4]],
                               pa.array(best), pa.array(total), pa.array(r["groups_sha256"], pa.string())], [*_LISTS[:1], *RESULT, "groups_sha256"]))
    return pa.concat_tables(parts) if parts else pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in RESULT], ("groups_sha256", pa.string())]).empty_table()


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Results per document, and the corpus table of pairs (a, b, count, best).

    ``byte_level`` is the path of a byte-level BPE (JSON), ``pieces`` that of a
    sentence-piece model; both are read on the driver and shipped once.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = (f.read(), g.read())
    shared, key = spark.sparkContext.broadcast(files), zlib.crc32(files[0].encode(), zlib.crc32(files[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LIVE:
            _LIVE.clear()
            _LIVE[key] = ByteLevel(shared.value[0]), Pieces(shared.value[1])
        for batch in batches:
            whole, bounds = utf8_column(batch.column(1))
            for a, b in slices(bounds, PIECE):
                r = _align(*_LIVE[key], whole[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
                r["doc_id"] = batch.column(0).slice(a, b - a).to_pylist()
                columns = [pa.array([uuid.uuid4().hex]), *[pa.array([r[c]], pa.list_(pa.string() if c == "groups_sha256" else pa.int64())) for c in _LISTS],
                           *[pa.array([r[c].tobytes()], pa.binary()) for c in _BINARY], *[pa.array([r[c]], pa.list_(pa.int32())) for c in "abn"]]
                yield pa.RecordBatch.from_arrays(columns, ["piece", *_LISTS, *_BINARY, "a", "b", "n"])

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    (docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).mapInArrow(run, _TABLE)
     .write.option("compression", "zstd").option("maxRecordsPerFile", ROWS).parquet(f"{path}/pieces"))
    table = spark.read.schema(_TABLE).parquet(f"{path}/pieces")
    held = table.select("piece", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "p")).select("piece", "k", "p.a", "p.b", "p.n")
    summed = held.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy("a"))  # at most the other vocabulary
    summed.withColumn("best", (F.col("count") == top).cast("long")).write.parquet(f"{path}/pairs")
    pairs = spark.read.schema("a int, b int, count long, best long").parquet(f"{path}/pairs")
    counts = held.select(F.col("piece").alias("of"), "k", "a", "b").join(pairs, ["a", "b"]).select("of", "k", "count", "best")
    again = spark.read.schema(_TABLE).parquet(f"{path}/pieces").select("piece", *_LISTS, *_BINARY)
    out = again.groupBy("piece").cogroup(counts.groupBy("of")).applyInArrow(_score, _OUT)
    return out, pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))[0]
