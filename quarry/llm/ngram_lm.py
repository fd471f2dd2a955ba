"""Scores of an interpolated n-gram model held in Elias-Fano tries.

p(w | h v) = c(h v w) / (c(h v) + ALPHA) + ALPHA / (c(h v) + ALPHA) * p(w | v), down to
p(w | v) = c(v w) / (c(v) + ALPHA) + ALPHA / (c(v) + ALPHA) * p1(w), with
p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); before a text's first word there are
end tokens.  Each distribution sums to one over the vocabulary and one unknown
word.  ``order`` is the length of the longest sequence: 3 for the query.

Texts are grouped by a hash of the row, about ``GROUP_BYTES`` a group.  Words
and then word sequences are asked for group by group: a group sends each
distinct word (sequence) once, with its training count, to the bucket of the
hash of the word (of the last word but one); the bucket adds the counts of all
groups and answers each group.  So every count covers all training texts, the
traffic grows with the input, and nothing is gathered on the driver but N and
V.  Only the longest sequences are sent with counts: shorter ones are their
sums.  What follows a sequence c(h v) times is that sequence, which the group
has asked for as that of the token before.  Words that occur more than ``HOT``
times are spread over several buckets.

A bucket of sequences is a trie over integer word ids: the sorted words before
the last; for each, the last words; for each pair, the words before it; and so
on.  A level is the monotone pointers to the successors and the successors
themselves, made monotone by adding a multiple of the id range per place above;
these are Elias-Fano sequences in one buffer, with a byte per successor for its
count.  A lookup is a search for the successor between two pointers, on the
packed bits.

Words are compared by 64-bit hashes.  Null texts are empty and have the end
token only; equal rows get equal results; null ids are in fold 0's complement
(never held out) and learned from; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import elias_fano
from quarry.llm.common import SMALL_PIECE, Hasher, U64, buckets_for, cut, mix, pieces, ranges, read, release, text_bytes, utf8_column
from quarry.llm.toxicity import fold

GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # text whose words or pairs share a bucket
HOT = 1 << 20
ALPHA = 20.0
ORDER = 3  # words of the longest sequence of the query
EXACT = 16  # counts up to this are stored as they are
_LEVEL = struct.Struct("<Qd")  # range of ids, step of the codes
HASH = Hasher(909)
END = U64(0xE17D0CAFE0000001)
ASK1 = "bucket int, g int, words binary, counts binary"
ASK2 = "bucket int, g int, width int, ctx binary, fan array<binary>, succ array<binary>, counts binary"
ANSWER = "g int, kind int, bucket int, width int, a binary, b binary, n long, v long"


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a group's texts (each with its end token), text of each token, training flag of each text."""
    hashes, docs = [], []
    for a, b, p in pieces(*utf8_column(table["text"]), lower=True, limit=SMALL_PIECE):
        words = HASH.words(p.buf, p.starts, p.ends)
        ends = p.first[1:]
        hashes.append(np.insert(words, ends, END))
        docs.append(np.repeat(np.arange(a, b), p.counts + 1))
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(hashes), np.concatenate(docs), ~table["held_out"].to_numpy().astype(bool)


def _width(largest: int) -> str:
    return "<u4" if largest < 1 << 32 else "<u8"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Integers as bytes, one place value after another, compressed: small values leave empty planes."""
    raw = np.ascontiguousarray(values, np.dtype(kind)).view(np.uint8).reshape(len(values), -1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _integers(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(np.dtype(kind)).ravel()


def _word_bucket(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> U64(20)) % U64(n)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in it, ascending) of each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _ask_words(n: int):
    def run(table):
        g = table["g"][0].as_py()
        hashes, doc, train = _tokens(table)
        words, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, weights=train[doc], minlength=len(words)).astype("<u4")
        rows = [(b, g, words[i].astype("<u8").tobytes(), _planes(counts[i], "<u4")) for b, i in _split(_word_bucket(words, n))]
        return pa.table(dict(zip(("bucket", "g", "words", "counts"), map(list, zip(*rows)))),
                        schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
    return run


def _answer_table(rows: list[tuple]) -> pa.Table:
    names = ("g", "kind", "bucket", "width", "a", "b", "n", "v")
    kinds = (pa.int32(),) * 4 + (pa.binary(),) * 2 + (pa.int64(),) * 2
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _answer_words(n: int):
    def run(table):
        b = table["bucket"][0].as_py()
        asked = [np.frombuffer(x, "<u8") for x in table["words"].to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([_integers(x, "<u4") for x in table["counts"].to_pylist()]),
                             minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))  # common words get small ids, which pack well
        ids = rank[at] * n + b
        kind = _width(max(int(counts.max()), (len(words) + 1) * n))
        rows, k = [], 0
        for i, (g, w) in enumerate(zip(table["g"].to_pylist(), asked)):
            part = slice(k, k + len(w))
            k += len(w)
            rows.append((g, 1, b, int(kind[2]), _planes(counts[at[part]], kind), _planes(ids[part], kind),
                         int(counts.sum()) if not i else 0, int((counts > 0).sum()) if not i else 0))
        return _answer_table(rows)
    return run


def _numbered(table: pa.Table, answers: pa.Table, n: int):
    """Per token: index of its distinct word; per distinct word, by rising id: training count and id; text of each token; train flags."""
    hashes, doc, train = _tokens(table)
    words, at = np.unique(hashes, return_inverse=True)
    told = {r["bucket"]: r for r in answers.filter(pc.equal(answers["kind"], 1)).to_pylist()}
    counts, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for b, i in _split(_word_bucket(words, n)):
        kind = f"<u{told[b]['width']}"
        counts[i], ids[i] = _integers(told[b]["a"], kind), _integers(told[b]["b"], kind)
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank[at], counts[order], ids[order], doc, train


class Grams:
    """Distinct word sequences of a group: pairs, and each longer length up to ``order``.

    Level 0 are the pairs by (word before, word), each further level the
    sequences of the one above by (sequence, word before it).  Per level:
    ``of`` is the sequence of each token, ``up`` what a sequence extends (of a
    pair, its first word) and ``word`` what it adds.  Words are indexes in
    order of their ids.  Before its first word a text has end tokens.
    """

    def __init__(self, table: pa.Table, answers: pa.Table, n: int, m: int, order: int):
        self.at, self.counts, self.ids, self.doc, self.train = at, counts, ids, doc, _ = _numbered(table, answers, n)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        self.place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))  # in its text
        self.end = at[-1:]  # the group's last token is an end token, as is every text's
        self.of, self.up, self.word = [], [], []
        one, two = np.roll(at, 1), at
        for k in range(2, order + 1):
            key = one * len(ids) + two
            by = np.argsort(key)
            key = key[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            one = np.empty(len(key), np.int64)
            one[by] = np.cumsum(new) - 1
            up, word = np.divmod(key[new], len(ids)) if len(ids) else (key, key)
            self.of.append(one)
            self.up.append(up)
            self.word.append(word)
            two = np.where(self.place >= k, np.roll(at, k), self.end) if k < order else two
        self.fan = [np.bincount(up, minlength=len(above)) for above, up in zip(self.up, self.up[1:])]
        self.start = [np.cumsum(f) - f for f in self.fan]
        c, w = self.up[0], self.word[0]
        with np.errstate(over="ignore"):
            part = mix(ids[w].astype(U64)) % (1 + counts[c] // HOT).astype(U64)
            self.bucket = (mix(ids[c].astype(U64) * U64(0x9E3779B97F4A7C15) + part) % U64(m)).astype(np.int64)

    def below(self, pairs: np.ndarray) -> list[np.ndarray]:
        """Sequences of each level that end in the given pairs."""
        out = [pairs]
        for fan, start in zip(self.fan, self.start):
            out.append(ranges(start[out[-1]], fan[out[-1]]))
        return out


def _ask_grams(n: int, m: int, order: int):
    def run(key, table, answers):
        g = Grams(table, answers, n, m, order)
        seen = np.bincount(g.of[-1], weights=g.train[g.doc], minlength=len(g.up[-1])).astype(np.int64)
        kind = _width(int(g.ids.max()) if len(g.ids) else 0)
        rows = []
        for b, i in _split(g.bucket):
            held = g.below(i)
            ctx = g.up[0][i]
            first = np.flatnonzero(np.diff(ctx, prepend=-1))
            fans = [np.diff(np.append(first, len(i))), *[f[x] for f, x in zip(g.fan, held)]]
            rows.append((b, key[0].as_py(), int(kind[2]), _planes(np.diff(g.ids[ctx[first]], prepend=0), kind), [_planes(f, "<u4") for f in fans],
                         [_planes(g.ids[word[x]], kind) for word, x in zip(g.word, held)], _planes(seen[held[-1]], "<u4")))
        columns = list(zip(*rows)) or [()] * 7
        kinds = (*(pa.int32(),) * 3, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)],
                        names=["bucket", "g", "width", "ctx", "fan", "succ", "counts"])
    return run


def _coded(count: np.ndarray) -> tuple[np.ndarray, float]:
    """Counts as bytes: up to ``EXACT`` as they are, above in equal steps of the logarithm up to the largest; the step."""
    step = math.log(max(float(count.max()) / EXACT, 1.0)) / (255 - EXACT) if len(count) else 0.0
    code = np.where(count <= EXACT, count, EXACT + np.round(np.log(np.maximum(count, 1) / EXACT) / (step or 1.0)))
    return code.astype(np.uint8), step


def _counts(step: float) -> np.ndarray:
    """Count of each code."""
    k = np.arange(256.0)
    return np.where(k <= EXACT, k, EXACT * np.exp((k - EXACT) * step))


class Trie:
    """Levels of Elias-Fano sequences over one buffer: the contexts, then for each level pointers to the successors of
    the level above, the successors, and a byte with the count of each."""

    def __init__(self, buffer: bytes):
        self.contexts = elias_fano.EliasFano(buffer)
        self.levels, at = [], self.contexts.end
        while at < len(buffer):
            pointers = elias_fano.EliasFano(buffer, at)
            successors = elias_fano.EliasFano(buffer, pointers.end)
            span, step = _LEVEL.unpack_from(buffer, successors.end)
            at = successors.end + _LEVEL.size
            self.levels.append((pointers, successors, span, step, np.frombuffer(buffer, np.uint8, len(successors), at)))
            at += len(successors)

    @staticmethod
    def build(contexts: np.ndarray, up: list[np.ndarray], word: list[np.ndarray], seen: np.ndarray) -> bytes:
        """From distinct sequences: contexts, per level the place above and the word, both ascending, and the counts of
        the last level; sequences without a count are left out."""
        counts = [seen]
        for k in range(len(up) - 1, 0, -1):
            counts.insert(0, np.bincount(up[k], weights=counts[0], minlength=len(up[k - 1])))
        keep = np.bincount(up[0], weights=counts[0], minlength=len(contexts)) > 0
        out = [elias_fano.encode(contexts[keep])]
        for u, w, count in zip(up, word, counts):
            rank = np.cumsum(keep) - 1
            many, keep = int(rank[-1]) + 1 if len(rank) else 0, count > 0
            u, w = rank[u[keep]], w[keep]
            span = int(w.max()) + 1 if len(w) else 1
            codes, step = _coded(count[keep])
            out += [elias_fano.encode(np.searchsorted(u, np.arange(many + 1))), elias_fano.encode(u * span + w), _LEVEL.pack(span, step), codes.tobytes()]
        return b"".join(out)

    def lookup(self, contexts: np.ndarray, up: list[np.ndarray], word: list[np.ndarray]) -> list[np.ndarray]:
        """Code of each sequence of each level; 0 if it is not stored.  Searched between two pointers on the coded successors."""
        at, out = self.contexts.find(contexts), []
        for (pointers, successors, span, _, codes), u, w in zip(self.levels, up, word):
            above = at[u]
            k = np.flatnonzero((above >= 0) & (w < span))
            above = above[k]
            at = np.full(len(u), -1)
            at[k] = successors.find(above * span + w[k], pointers.at(above), pointers.at(above + 1))
            out.append(np.where(at >= 0, codes[at], 0).astype(np.uint8) if len(codes) else np.zeros(len(u), np.uint8))
        return out


def _answer_grams(order: int):
    def run(table):
        rows = table.to_pylist()
        kinds = [f"<u{r['width']}" for r in rows]
        contexts, at = np.unique(np.concatenate([np.cumsum(_integers(r["ctx"], k).astype(np.int64)) for r, k in zip(rows, kinds)]), return_inverse=True)
        up, word, asked, ends = [], [], [], []
        for level in range(order - 1):
            fan = np.concatenate([_integers(r["fan"][level], "<u4") for r in rows])
            parts = [_integers(r["succ"][level], k) for r, k in zip(rows, kinds)]
            ends.append(np.cumsum([0, *map(len, parts)]))
            parts = np.concatenate(parts).astype(np.int64)
            span = int(parts.max()) + 1
            key, at = np.unique(np.repeat(at, fan) * span + parts, return_inverse=True)
            asked.append(at.astype(np.uint32))
            up.append(key // span)
            word.append(key % span)
        seen = np.bincount(at, weights=np.concatenate([_integers(r["counts"], "<u4") for r in rows]), minlength=len(key))
        del at, parts, key, fan
        trie = Trie(Trie.build(contexts, up, word, seen))
        steps = np.array([x[3] for x in trie.levels]).tobytes()
        codes = [code[x] for code, x in zip(trie.lookup(contexts, up, word), asked)]
        out = []
        for i, r in enumerate(rows):
            mine = b"".join([steps, *[c[e[i]: e[i + 1]].tobytes() for c, e in zip(codes, ends)]])
            out.append((r["g"], 2, r["bucket"], 1, zstandard.ZstdCompressor(level=1).compress(mine), None, 0, 0))
        return _answer_table(out)
    return run


def _score(n: int, m: int, order: int, tokens: int, words: int):
    def run(key, table, answers):
        g = Grams(table, answers, n, m, order)
        told = {r["bucket"]: r["a"] for r in answers.filter(pc.equal(answers["kind"], 2)).to_pylist()}
        times = [np.zeros(len(up)) for up in g.up]
        for b, i in _split(g.bucket):
            raw = zstandard.ZstdDecompressor().decompress(told[b])
            steps, codes, k = np.frombuffer(raw, np.float64, order - 1), np.frombuffer(raw, np.uint8, offset=8 * (order - 1)), 0
            for level, x in enumerate(g.below(i)):
                times[level][x] = _counts(steps[level])[codes[k: k + len(x)]]
                k += len(x)
        at, counts, doc = g.at, g.counts, g.doc
        p1 = (counts + 0.1) / (tokens + 0.1 * (words + 1))
        total, p = counts[g.up[0]], p1[g.word[0]]
        for level in range(order - 1):
            if level:  # the context is the sequence that ends one token earlier; at a text's start, as many as there are texts
                before = np.where(g.place > 0, times[level - 1][np.roll(g.of[level - 1], 1)], counts[g.end])
                total, p = np.empty(len(g.up[level])), p[g.up[level]]
                total[g.of[level]] = before
            p = times[level] / (total + ALPHA) + ALPHA / (total + ALPHA) * p
        texts = table.num_rows
        per = lambda x: np.bincount(doc, weights=x, minlength=texts)
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"],
                         "n_tokens": np.bincount(doc, minlength=texts).astype(np.int64),
                         "n_known": per(counts[at] > 0).astype(np.int64),
                         "train_tokens": np.full(texts, tokens, np.int64),
                         "base_score": per(np.log10(p1)[at]), "score": per(np.log10(np.minimum(p, 1.0))[g.of[-1]])})
    return run


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 10, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; ``order``: words of the longest sequence."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    d = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = text_bytes(d)
    groups, n = buckets_for(size, GROUP_BYTES), buckets_for(size, BUCKET_BYTES)
    d = (d.withColumn("held_out", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)))
         .withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")))
    words = cut(d.groupBy("g").applyInArrow(_ask_words(n), ASK1).groupBy("bucket").applyInArrow(_answer_words(n), ANSWER))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    release(docs.sparkSession)  # the first job's shuffle of the texts is not needed any more
    grams = d.groupBy("g").cogroup(words.groupBy("g")).applyInArrow(_ask_grams(n, n, order), ASK2)
    answers = words.union(grams.groupBy("bucket").applyInArrow(_answer_grams(order), ANSWER))
    kind = docs.schema[id_column].dataType.simpleString()
    out = d.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        _score(n, n, order, int(total[0]), int(total[1])),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_column)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"), order=ORDER)
