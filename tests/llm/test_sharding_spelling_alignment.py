"""Sharding, spelling groups and tokenizer alignment against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, word string, piece string, n int, `SHARD` int, slot string, n_a int"


def frame(spark, rows):
    """Rows of (doc_id, text), with clashing extra columns."""
    return spark.createDataFrame([(i, t, "k", "p", 1, 7, None, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    words = base + [w[:k] + rng.choice("abcÉ") + w[k + rng.randint(0, 1):] for w in base for k in (0, 2, len(w) - 1)]
    weights = [10] * 30 + [2] * 90
    out = [(i, " ".join(rng.choices(words, weights, k=60))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n"), (103, "Zürich 𝒳 é́ 日本 <|endoftext|> </s> ▁"), (104, "longer " * 5000 + "end"), (105, "x" * 3000),
            (106, "ABCDEF×÷" * 9), (None, out[0][1]), (None, None), out[3], out[3]]
    return out


def test_hypergeometric_law(spark):
    from quarry.llm.sharding import hypergeometric

    for good, rest, sample in ((5, 7, 4), (60, 100, 30), (1000, 3000, 800), (3, 100000, 50000), (40, 50, 70), (0, 9, 3), (9, 0, 4), (6, 6, 12)):
        draws = spark.range(4000).select(hypergeometric(*(F.lit(x).cast("bigint") for x in (good, rest, sample)), F.col("id"), F.lit(3)).alias("k"))
        seen = {r["k"]: r["count"] for r in draws.groupBy("k").count().collect()}
        chance = {k: math.comb(good, k) * math.comb(rest, sample - k) / math.comb(good + rest, sample) if good + rest < 5000 else None
                  for k in range(max(0, sample - rest), min(good, sample) + 1)}
        assert set(seen) <= set(chance)
        if None not in chance.values():
            big = [k for k in chance if 4000 * chance[k] >= 8]
            off = sum((seen.get(k, 0) - 4000 * chance[k]) ** 2 / (4000 * chance[k]) for k in big)
            assert off < len(big) + 5 * math.sqrt(2 * len(big)) + 6


def test_matrix_sums(spark):
    from quarry.llm.sharding import communication_matrix

    pieces = [(k, n) for k, n in enumerate([5, 1, 90, 17, 4000, 33, 2])]
    total = sum(n for _, n in pieces)
    sizes = [total // 6 + (k < total % 6) for k in range(6)]
    got = {r["piece"]: r["counts"] for r in communication_matrix(spark.createDataFrame(pieces, "piece int, rows long"), sizes, 9).collect()}
    assert {p: sum(c) for p, c in got.items()} == dict(pieces)
    assert np.array(list(got.values())).sum(axis=0).tolist() == sizes


def test_sharding(spark, rows, tmp_folder):
    from quarry.llm.sharding import shuffle_into_shards, write_shards

    df = frame(spark, rows).repartition(5)
    for shards, chunk_rows in ((4, 1000), (3, 4)):
        got = shuffle_into_shards(df, shards, chunk_rows=chunk_rows)
        assert got.columns == ["doc_id", "text", "word", "piece", "n", "n_a", "shard", "slot"]
        got = got.collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
        places = collections.defaultdict(list)
        for r in got:
            places[r["shard"]].append(r["slot"])
        sizes = [len(places[s]) for s in range(shards)]
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert shuffle_into_shards(frame(spark, []), 4).count() == 0
    one = shuffle_into_shards(frame(spark, rows[:1]), 4).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]
    path = f"{tmp_folder}/shards"
    write_shards(shuffle_into_shards(df, 4), path)
    assert spark.read.parquet(path).count() == len(rows)


def test_sharding_moves_rows_evenly(spark):
    """Every piece sends rows to every shard, and neighbours in the input do not stay neighbours."""
    from quarry.llm.sharding import shuffle_into_shards

    df = spark.range(0, 4000, 1, 4).select("id", F.spark_partition_id().alias("source"))
    got = shuffle_into_shards(df, 8).toPandas()
    table = got.groupby(["source", "shard"]).size().to_numpy()
    assert len(table) == 32 and ((table - 125) ** 2 / 125).sum() < 21 + 5 * math.sqrt(42)  # 21 degrees of freedom
    order = got.sort_values(["shard", "slot"])["id"].to_numpy()
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.1 and abs(np.corrcoef(got["id"], got["slot"])[0, 1]) < 0.1


def variants(rows):
    counts = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(beside[w]), counts[form[w]] if form[w] else None))
    return out


def test_spelling(spark, rows, monkeypatch):
    from quarry.llm import spelling

    want = variants(rows)
    assert sum(r[1] is not None for r in want) > 3 and sum(r[4] > 1 for r in want) > 10
    assert {tuple(r) for r in spelling.spelling_groups(frame(spark, rows)).collect()} == want
    # blocks in several parts, against several shares of the words beside them
    words = spark.createDataFrame([(r[0], r[3]) for r in want], "word string, n long")
    monkeypatch.setattr(spelling, "OWN", 4)
    monkeypatch.setattr(spelling, "OTHERS", 6)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 50)
    got = {(r["word"], r["n_near"]) for r in spelling.near_words(words).collect()}
    assert got == {(r[0], r[4]) for r in want if r[4]}
    assert spelling.spelling_groups(frame(spark, [])).count() == 0


def test_spelling_chains_ties_and_long_words(spark):
    from quarry.llm.spelling import near_words, roots

    long = "ab" * 400
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaaaac", 25), (long, 9), (long + "c", 8), (long[:-1] + "c", 7), ("zzzzzz", 5)]
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaa"] == (2, "aaaaab", 25) and got["aaaaab"] == (3, "aaaabb", 125)
    assert got[long] == (2, long + "c", 8) and got[long + "c"] == (2, long, 9) and "zzzzzz" not in got
    chain = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(20)]
    assert {tuple(r) for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {(a, "w20") for a, _ in chain}


def test_run_checksums():
    from quarry.llm.common import LOWER
    from quarry.llm.spelling import checksums, runs

    text = "Abc déÉf×x 1abĀcd " + "y" * 500 + "\U0001F600z"
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, doc, points = runs(buf, np.array([0, len(buf)]))
    lower = [r.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [buf[s:e].tobytes().decode() for s, e in zip(starts, ends)] == lower and points.tolist() == list(map(len, lower))
    got = checksums(buf, starts, ends, np.full(len(starts), zlib.crc32(b"12:"), np.uint32))
    assert got.tolist() == [zlib.crc32(b"12:" + w.encode()) for w in lower]


def aligned(rows, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    from quarry.llm.bpe import byte_symbols

    one = Tokenizer.from_file(a_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=b_path)
    back = {s: b for b, s in enumerate(byte_symbols())}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in one.get_vocab().items() if t != "<|endoftext|>"}

    def bytes_b(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
    docs, held = [], collections.Counter()
    for i, t in rows:
        groups = []
        if t:
            a, b, want = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t), (" " + t).encode()
            if b"".join(bytes_a[x] for x in a) == want == b"".join(map(bytes_b, b)):
                ends_a = np.cumsum([len(bytes_a[x]) for x in a])
                ends_b = np.cumsum([len(bytes_b(x)) for x in b])
                both = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
                for lo, hi in zip([0, *both], both):
                    groups.append(([x for x, e in zip(a, ends_a) if lo < e <= hi], [x for x, e in zip(b, ends_b) if lo < e <= hi]) if len(t) < 3000 else None)
                if len(t) >= 3000:  # the same by index
                    ia, ib = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
                    groups = [(a[x:y], b[u:v]) for x, y, u, v in zip([0, *ia], ia, [0, *ib], ib)]
        docs.append((i, groups))
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[k] == top[k[0]] for k in links),
                    sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held


def test_alignment(spark, rows, monkeypatch):
    from quarry.llm import alignment
    from quarry.llm.bpe import vocabulary_path

    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    want, held = aligned(rows, *paths)
    assert any(r[1] == 0 for r in want if r[0] == 103) and max(r[4] for r in want) > 3000
    for large in (alignment.LARGE, 1):  # 1: distinct ids with multiplicities in every group
        monkeypatch.setattr(alignment, "LARGE", large)
        out, pairs = alignment.align_tokenizers(frame(spark, rows), *paths)
        assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)
        assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == held
    assert alignment.align_tokenizers(frame(spark, []), *paths)[0].count() == 0


def test_alignment_block_by_block(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from quarry.llm import alignment
    from quarry.llm.bpe import vocabulary_path
    from quarry.llm.common import utf8_column

    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(vocabulary_path("piece_bpe_32k.model"), "rb") as g:
        tokenizers = alignment.ByteLevel(f.read()), alignment.Pieces(g.read())
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstué") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    texts = ["", None, "x" * 5000, *(" ".join(rng.choice(words) for _ in range(rng.randrange(800))) for _ in range(600)), ""]
    buf, bounds = utf8_column(pa.array(texts))
    alignment._align(*tokenizers, buf[: bounds[10]], bounds[:11])
    tracemalloc.start()
    want = alignment._align(*tokenizers, buf, bounds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * len(buf)  # about 100 bytes for each byte of text if all is held at once
    for block in (1 << 30, 5000):
        monkeypatch.setattr(alignment, "BLOCK", block)
        got = alignment._align(*tokenizers, buf, bounds)
        assert got.keys() == want.keys() and all(np.array_equal(got[c], want[c]) for c in want)
    assert not len(alignment._align(*tokenizers, *utf8_column(pa.array(["", None])))["a"])


def test_merge_path_pieces():
    from quarry.llm.alignment import merge_path

    rng = np.random.default_rng(3)
    for _ in range(30):
        size = int(rng.integers(1, 400))
        a, b = (np.append(np.flatnonzero(rng.random(size) < p) + 1, size + 1) for p in rng.random(2))
        both = np.intersect1d(a, b)
        for width in (1, 2, 7, 128):
            x, y = merge_path(a, b, width)
            assert x.tolist() == np.searchsorted(both, a).tolist() and y.tolist() == np.searchsorted(both, b).tolist()
