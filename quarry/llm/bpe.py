"""BPE encoding and decoding by a priority queue of merge ranks.

The symbols of a pre-token form a doubly linked list; a heap holds (rank,
position) of every adjacent pair that the merge table knows.  Popping an entry
whose pair has changed since it was pushed is skipped (stale), otherwise the
right symbol is absorbed and the two new neighbours are pushed.  Decoding
concatenates the vocabulary strings.  The vocabulary file (a byte-level BPE in
the JSON format of the public ``tokenizers`` library) is a parameter; it is
read on the driver and shipped to the tasks once.

Texts: null counts as empty, any length is encoded whole.  Rows are treated
one by one, so repeated rows give repeated results, and other columns of the
input are kept as they are unless their name is one of the result columns,
which then replaces it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 150_000  # pre-tokens in each of the two generations that a worker remembers


def byte_symbols() -> list[str]:
    """Printable stand-in of every byte: itself if printable in Latin-1, else 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return table


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, spec: dict):
        model = spec["model"]
        symbols = byte_symbols()
        vocab = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_id = [vocab[s] for s in symbols]
        # left id -> {right id: rank}, and the id that each rank makes
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.made = []
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a]].setdefault(vocab[b], r)
            self.made.append(vocab[a + b])
        back = {s: b for b, s in enumerate(symbols)}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self.bytes_of_text = {str(i): b for i, b in self.token_bytes.items()}
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(SPLIT).findall
        self.recent: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        byte_id, rank_of, made = self.byte_id, self.rank, self.made
        ids = [byte_id[b] for b in word]
        n = len(ids)
        queue = []
        for i in range(n - 1):
            r = rank_of[ids[i]].get(ids[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        if not queue:
            return ids
        heapify(queue)
        right = [*range(1, n), -1]
        left = [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            a, j = ids[i], right[i]
            if a < 0 or j < 0 or rank_of[a].get(ids[j]) != entry >> 32:
                continue  # stale: one side has been merged since
            new = made[entry >> 32]
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                r = rank_of[new].get(ids[k])
                if r is not None:
                    heappush(queue, r << 32 | i)
            k = left[i]
            if k >= 0:
                r = rank_of[ids[k]].get(new)
                if r is not None:
                    heappush(queue, r << 32 | k)
        return [x for x in ids if x >= 0]

    def entry(self, token: str) -> str:
        """Ids of a pre-token as text, remembered in two generations of bounded size."""
        got = self.older.get(token)
        if got is None:
            got = ",".join(map(str, self.merge_word(token.encode("utf-8", "surrogatepass"))))
        if len(token) <= 64:
            if len(self.recent) >= CACHE:
                self.older, self.recent = self.recent, {}
            self.recent[token] = got
        return got

    def encode_text(self, text: str) -> str:
        """Ids of a whole text, in decimal, joined by commas."""
        out: list[str] = []
        for k, part in enumerate(self.added_split.split(text) if self.added_split else [text]):
            if k % 2:
                out.append(str(self.added[part]))
            else:
                get, entry = self.recent.get, self.entry
                out += [get(t) or entry(t) for t in self.find(part)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")

    def decode_text(self, ids: str) -> str:
        """The same from decimal ids joined by commas."""
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def load_codec(path: str) -> dict:
    """The parts of a vocabulary file that the codec needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is expected")
    return {"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec.get("added_tokens")}


_LIVE: dict[int, BytePairCodec] = {}  # one codec per Python worker


def _codec(shared, key: int) -> BytePairCodec:
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = BytePairCodec(shared.value)
    return _LIVE[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
                     ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (and token_ids, decoded if ``ids``).

    One map over the rows; no shuffle.  The vocabulary (a fixed 50k entries)
    is broadcast.
    """
    spark = docs.sparkSession
    spec = load_codec(vocabulary)
    shared, key = spark.sparkContext.broadcast(spec), zlib.crc32(repr(spec["model"]["merges"]).encode())
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", token_ids array<int>, decoded string"

    def run(batches):
        codec = _codec(shared, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield piece(codec, batch.slice(at, 512))

    def piece(codec, batch):
        n, hashes, backs, all_ids, texts = [], [], [], [], []
        for t in batch.column(1):
            encoded = codec.encode_text(t.as_py() or "")
            decoded = codec.decode_text(encoded)
            n.append(encoded.count(",") + 1 if encoded else 0)
            hashes.append(hashlib.sha256(encoded.encode()).hexdigest())
            backs.append(hashlib.sha256(decoded.encode()).hexdigest())
            if ids:
                all_ids.append(np.array(encoded.split(",") if encoded else [], np.int32))
                texts.append(decoded)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())]
        names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(ends, np.concatenate(all_ids or [np.zeros(0, np.int32)])), pa.array(texts, pa.string())]
            names += ["token_ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_column), F.col(text_column).alias("text")).mapInArrow(run, schema)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (the caller's default parameter)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return encode_documents(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
