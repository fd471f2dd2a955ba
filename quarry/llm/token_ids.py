"""Token ids as binary shards with Elias-Fano document boundaries.

Documents are range-partitioned by id, sorted, encoded with the public
``tokenizers`` library and written as shards of about ``SHARD_IDS`` ids.  A
shard's payload is, little-endian:

    "QTOK" | u8 bytes per id (2 or 4) | 3 zero bytes | u64 number of ids |
    Elias-Fano code of the document ends | the concatenated ids

so the offsets of a document are two ``select`` calls, without a table of
64-bit offsets.  Shards are rows of a Parquet table (partition, sequence,
offset of the first id within the partition, document ids, payload), because
Spark's committed writes work on any store that the cluster mounts and
survive lost executors.  The start of each range partition is a sum over the
partitions' totals, one number a partition.

Texts: null is empty (only the end id), any length is encoded whole and never
split over shards.  Rows with equal ids are ordered by a hash of their text;
null ids come first.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import elias_fano
from quarry.llm.bpe import byte_symbols, vocabulary_path
from quarry.llm.common import buckets_for, read, text_bytes
from quarry.session import ensure_checkpoint_dir

SHARD_IDS = 1 << 20
PARTITION_BYTES = 16 << 20  # text in one range partition
CACHE = 400_000  # chunks, and as many parts of chunks, in each of the two generations that a worker remembers
SPACER = "\x01"
_HEAD = struct.Struct("<4sBxxxQ")
# What the vocabulary's normalizer and pre-tokenizer do, and the same for lower-cased text of ASCII, Latin-1 letters and common marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ¡¿«»–—‘’“”…]*").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+|\n").findall
SHARD_SCHEMA = "part int, seq int, first long, n_ids long, doc_ids array<long>, payload binary"


class Remembered:
    """Values by key in two generations of bounded size."""

    def __init__(self):
        self.recent: dict = {}
        self.older: dict = {}

    def unknown(self, keys: set) -> list:
        """Those of ``keys`` that are in neither generation; the others are in the recent one afterwards."""
        missing = keys.difference(self.recent)
        if len(self.recent) + len(missing) > CACHE and len(self.recent) > 0:
            self.older, self.recent = self.recent, {}
            missing = keys
        todo, get = [], self.older.get
        for k in missing:
            got = get(k)
            if got is None:
                todo.append(k)
            else:
                self.recent[k] = got
        return todo


class ChunkEncoder:
    """Ids of a text, chunk by chunk.

    The tokenizer drops white space and none of its rules looks across it, so
    a text's ids are those of its chunks between ASCII white space
    (``bytes.split`` of the UTF-8 text).  The ids of recent chunks are
    remembered.  A new chunk of plain characters without special tokens is
    lower-cased and cut into the pre-tokens that the tokenizer itself would
    take one by one; these are remembered too, and a new one goes through the
    library's BPE model once while it is.  Other new chunks, and all chunks
    of a vocabulary with other rules, go through the whole tokenizer.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.spacer,) = self.tokenizer.encode(SPACER, add_special_tokens=False).ids
        rules = json.loads(spec)
        split = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
                 {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.gap = np.array([np.iinfo(self.kind).max], self.kind).tobytes()  # between the ids of chunks
        self.cuts = self.tokenizer.get_vocab_size() < 1 << 16 and rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": split}
        self.symbols = dict(enumerate(byte_symbols()))
        self.chunks, self.parts = Remembered(), Remembered()

    def _sliced(self, ids: list[int], bounds: list[int]) -> Iterator[bytes]:
        width, data = self.kind.itemsize, np.array(ids, self.kind).tobytes()
        return (data[x * width: y * width] for x, y in zip(bounds, bounds[1:]))

    def _of_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each pre-token."""
        ids, bounds, tokenize, symbols = [], [0], self.model.tokenize, self.symbols
        for p in parts:
            if not (p.isascii() and p.isprintable()):
                p = p.encode().decode("latin-1").translate(symbols)
            ids += [t.id for t in tokenize(p)]
            bounds.append(len(ids))
        return self._sliced(ids, bounds)

    def _of_chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each chunk with its ids, by the whole tokenizer."""
        # many chunks a call, kept apart by a character that stands for itself
        alone = [c for c in chunks if SPACER in c or "<|" in c]
        todo = [c for c in chunks if not (SPACER in c or "<|" in c)]
        groups = [todo[k: k + 256] for k in range(0, len(todo), 256)]
        joined = [f" {SPACER} ".join(g) for g in groups] + alone
        for g, e in zip([*groups, *([c] for c in alone)], self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(ids == self.spacer).tolist() if len(g) > 1 else []
            for c, x, y in zip(g, [0, *(k + 1 for k in at)], [*at, len(ids)]):
                yield c, ids[x:y].tobytes()

    def learn(self, chunks: list[bytes]) -> None:
        """Remember the ids of these chunks."""
        recent, plain, others = self.chunks.recent, chunks if self.cuts else [], [] if self.cuts else chunks
        text = b"\n".join(plain).decode()
        if "<|" in text or not _PLAIN(text):
            fits = [b"<|" not in c and bool(_PLAIN(c.decode())) for c in plain]
            plain, others = [c for c, f in zip(plain, fits) if f], [c for c, f in zip(plain, fits) if not f]
            text = b"\n".join(plain).decode()
        if plain:
            parts = _PARTS(text.lower())
            new = self.parts.unknown(set(parts).difference("\n"))
            known = self.parts.recent
            known.update(zip(new, self._of_parts(new)))
            ids = b"".join([known[x] if x != "\n" else self.gap for x in parts])
            at = np.flatnonzero(np.frombuffer(ids, self.kind) == np.frombuffer(self.gap, self.kind)) * len(self.gap)
            recent.update((c, ids[x:y]) for c, x, y in zip(plain, [0, *(at + len(self.gap)).tolist()], [*at.tolist(), len(ids)]))
        for s, ids in self._of_chunks([c.decode() for c in others]):
            recent[s.encode()] = ids

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids of each text (UTF-8) with ``end`` appended, as bytes."""
        split = [t.split() for t in texts]
        self.learn(self.chunks.unknown(set().union(*split)))
        get, tail = self.chunks.recent.__getitem__, np.array([end], self.kind).tobytes()
        return [b"".join(map(get, s)) + tail for s in split]


def write_payload(docs: list[bytes], width: int) -> bytes:
    ends = np.cumsum([len(d) // width for d in docs])
    return b"".join([_HEAD.pack(b"QTOK", width, int(ends[-1])), elias_fano.encode(ends), *docs])


class Shard:
    """Reader of a payload."""

    def __init__(self, payload: bytes):
        magic, width, n = _HEAD.unpack_from(payload, 0)
        if magic != b"QTOK":
            raise ValueError("not a token shard")
        self.ends = elias_fano.EliasFano(payload, _HEAD.size)
        self.ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, self.ends.end)

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


_LIVE: dict[int, ChunkEncoder] = {}  # one encoder per Python worker


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end: int, id_column: str = "doc_id",
                    text_column: str = "text") -> None:
    """Encode ``docs`` and write the shards to ``path`` in ascending id order."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shared, key = spark.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    d = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    n = buckets_for(text_bytes(d), PARTITION_BYTES)
    d = d.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    d = d.repartitionByRange(n, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LIVE:
            _LIVE.clear()
            _LIVE[key] = ChunkEncoder(shared.value)
        encoder = _LIVE[key]
        width, part = encoder.kind.itemsize, TaskContext.get().partitionId()
        first = seq = held = 0
        ids: list[int | None] = []
        data: list[bytes] = []

        def flush():
            nonlocal first, seq, held
            row = [[part], [seq], [first], [held], [ids.copy()], [write_payload(data, width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            first, seq, held = first + held, seq + 1, 0
            ids.clear()
            data.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)],
                                              ["part", "seq", "first", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = [t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()]
                for i, b in zip(piece.column(0).to_pylist(), encoder.encode(texts, end)):
                    ids.append(i)
                    data.append(b)
                    held += len(b) // width
                    if held >= SHARD_IDS:
                        yield flush()
        if ids:
            yield flush()

    d.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written shards: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a number a partition
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["payload"])
                ends = shard.ends.values()
                begins = np.concatenate([[0], ends[:-1]])
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + (starts[r["part"]] + r["first"]), pa.int64()),
                     pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), path, end=2)
    return read_token_ids(spark, path)
