"""Groups of spelling variants, by blocked Gram matrices of letter counts.

A word is a vector of letter counts.  One inserted or deleted letter changes
it by a squared distance of one, one replaced letter by two, so words that are
one edit apart lie at a squared distance of at most two, and their lengths
differ by at most one.  Words are blocked by length, and within a length by
how many of their letters fall into each of ``classes`` letter classes (the
code point modulo that number).  An edit changes one class count by one, or
moves one count to another class, so a block is compared with itself and with
the blocks that differ from it in that way only.  For two blocks, one matrix
product gives all squared distances; pairs at one or two are verified letter
by letter.  The number of classes grows with the logarithm of the vocabulary,
which keeps blocks of natural vocabularies small at any size.

A task holds some blocks: ``OWN`` words of a block at most, against at most
about ``OTHERS`` words of the blocks beside it; larger blocks are split and
every part meets every other part, so no pair is lost and no cap is set.  Per
word a task returns the number of near words and the best of them, not the
pairs.

Texts become words inside the map tasks: runs of letters, of which a rule on
the check sum of id and run damages one in 199.  Runs are counted per piece of
text before they are shuffled, and compared there by 64-bit hash.

Null and empty texts have no words.  A null id counts as empty in the check
sum.  Repeated rows count as often as they occur.  Texts and words of any
length are used whole.  Ties between best words go to the smallest in
code-point order.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, Hasher, buckets_for, cut, ranges, read, slices, utf8_column

LEAST_LETTERS, LEAST_COUNT, FACTOR, DAMAGE = 6, 5, 5, 199
OWN, OTHERS, BUCKET_ROWS = 4096, 32768, 40_000
BLOCK_WORDS = 64  # words a block that the number of classes aims at
SHORT = 48  # longer words are verified one by one
PIECE = 8 << 20
LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF
HASH = Hasher(1212)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and code points of each maximal run of letters."""
    lead = buf == _LEAD
    letter = _LETTER[buf] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter])[:-1]
    after = np.concatenate([letter, [False]])[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    wide = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=wide[1:])
    points = ends - starts - (wide[ends] - wide[starts])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, points


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from the check sum of what stands before it."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    size, at, reg = size[order], starts[order], state[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -64, "left"))  # runs above 64 bytes
    for k in range(long):
        reg[k] = np.uint32(zlib.crc32(buf[at[k]: at[k] + size[k]].tobytes(), int(state[order[k]]))) ^ np.uint32(0xFFFFFFFF)
    live = len(size)
    for step in range(int(size[long]) if long < len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))  # runs longer than step
        part = reg[long:live]
        reg[long:live] = CRC[(part ^ buf[at[long:live] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _count_runs(least: int, damage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            whole, bounds = utf8_column(batch.column(1))
            for a, b in slices(bounds, PIECE):
                buf, offsets = LOWER[whole[bounds[a]: bounds[b]]], bounds[a: b + 1] - bounds[a]
                starts, ends, text, points = runs(buf, offsets)
                fit = points >= least
                starts, ends, text, points = starts[fit], ends[fit], text[fit], points[fit]
                if not len(starts):
                    continue
                crc = checksums(buf, starts, ends, heads[a:b][text])
                hit = crc % np.uint32(damage) == 0
                words, counts = [], []
                for s, e, h in zip(starts[hit], ends[hit], crc[hit]):  # one run in ``damage``
                    word = buf[s:e].tobytes().decode()
                    cut_at = int(h) % len(word)
                    if len(word) > least:
                        words.append((word[:cut_at] + word[cut_at + 1:]).encode())
                        counts.append(1)
                starts, ends = starts[~hit], ends[~hit]
                _, one, n = np.unique(HASH.words(buf, starts, ends), return_index=True, return_counts=True)
                size = ends[one] - starts[one]
                ends_of = np.concatenate([[0], np.cumsum(size)])
                kept = buf[ranges(starts[one], size)].tobytes()
                words += [kept[x:y] for x, y in zip(ends_of, ends_of[1:])]
                counts += n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
    return run


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the vocabulary with its counts over all texts."""
    rows = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"))
    return (rows.mapInArrow(_count_runs(least_letters, damage), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def classes_for(words: int) -> int:
    """Letter classes so that blocks hold about ``BLOCK_WORDS`` words (a class splits a block about 5.4 ways)."""
    return max(2, 1 + round(math.log(max(words, 1) / (10 * BLOCK_WORDS) + 1, 5.4)))


def _block(word: Column, classes: int) -> Column:
    """Letters of the word per class, as an array; its sum is the length."""
    codes = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    members = ["".join(chr(c) for c in codes if c % classes == k) for k in range(classes)]
    return F.array(*[(F.length(word) - F.length(F.translate(word, m, ""))).cast("int") for m in members])


def _beside(block: Column, classes: int) -> Column:
    """The blocks that one edit can lead to: itself, one count more or less, one moved."""
    moves = [[0] * classes]
    for i in range(classes):
        for d in (1, -1):
            moves.append([d if k == i else 0 for k in range(classes)])
        moves += [[1 if k == i else -1 if k == j else 0 for k in range(classes)] for j in range(classes) if j != i]
    return F.array(*[F.zip_with(block, F.array(*map(F.lit, m)), lambda a, b: a + b) for m in moves])


def _letter_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words in a row, and the bounds of each word."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    lead = buf == _LEAD
    keep = np.concatenate([[0], np.cumsum(~lead)])
    after = np.concatenate([[False], lead])[:-1] if len(buf) else lead
    number = np.where(after, buf.astype(np.int16) - 0x80 + 26, buf.astype(np.int16) - 97)[~lead]
    return number, keep[np.concatenate([[0], np.cumsum(size)])]


def one_edit(number: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """True where words ``one[k]`` and ``two[k]`` differ by exactly one inserted, deleted or replaced letter."""
    size = np.diff(bounds)
    out = np.zeros(len(one), bool)
    small = (size[one] <= SHORT) & (size[two] <= SHORT)
    used = np.unique(np.concatenate([one[small], two[small]]))
    place = np.zeros(len(size), np.int64)
    place[used] = np.arange(len(used))
    forth = np.full((len(used), SHORT + 2), -1, np.int16)
    back = np.full((len(used), SHORT + 2), -1, np.int16)
    row, col = np.repeat(np.arange(len(used)), size[used]), ranges(np.zeros(len(used), np.int64), size[used])
    forth[row, col] = number[ranges(bounds[used], size[used])]
    back[row, size[used][row] - 1 - col] = forth[row, col]
    forth[:, -1], back[:, -1] = -1, -1
    for at in range(0, len(one), 1 << 16):
        pick = np.flatnonzero(small[at: at + (1 << 16)]) + at
        x, y = place[one[pick]], place[two[pick]]
        differ = forth[x] != forth[y]
        same = ~differ.any(axis=1)
        alike = np.argmax(differ, axis=1) + np.argmax(back[x] != back[y], axis=1)
        a, b = size[one[pick]], size[two[pick]]
        out[pick] = ~same & np.where(a == b, alike == a - 1, (np.abs(a - b) == 1) & (alike >= np.minimum(a, b)))
    for k in np.flatnonzero(~small):
        x, y = (number[bounds[i]: bounds[i + 1]] for i in (one[k], two[k]))
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if len(y) - len(x) <= 1:
            differ = np.flatnonzero(x != y[: len(x)])
            p = int(differ[0]) if len(differ) else len(x)
            out[k] = np.array_equal(x[p + 1:], y[p + 1:]) and p < len(x) if len(x) == len(y) else np.array_equal(x[p:], y[p + 1:])
    return out


def _candidates(counts: np.ndarray, own: np.ndarray, other: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at a squared distance of at most two: own x other, and own x own (each once) if ``inside``."""
    kind = counts.dtype
    one, two = [], []
    left = np.concatenate([counts[own], np.ones((len(own), 1), kind), -0.5 * (counts[own] ** 2).sum(axis=1, keepdims=True)], axis=1)
    for members, once in ((own, True), (other, False)):
        if once and not inside:
            continue
        for at in range(0, len(members), OWN):
            part = members[at: at + OWN]
            right = np.concatenate([counts[part], -0.5 * (counts[part] ** 2).sum(axis=1, keepdims=True), np.ones((len(part), 1), kind)], axis=1)
            x, y = np.divmod(np.flatnonzero(left @ right.T >= -1), len(part))
            if once:
                x, y = x[x < y + at], y[x < y + at]
            one.append(own[x])
            two.append(part[y])
    return np.concatenate(one) if one else np.zeros(0, np.int64), np.concatenate(two) if two else np.zeros(0, np.int64)


def _compare(key, table):
    group, part = table["g"].to_numpy(), table["part"].to_numpy()
    words = table["word"].cast(pa.binary()).to_pylist()
    n = table["n"].to_numpy()
    number, bounds = _letter_numbers(words)
    size = np.diff(bounds)
    kind = np.float32 if size.max() <= 1000 else np.float64  # products stay exact integers
    order = np.lexsort((part, group))
    cuts = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1 if len(order) else 0))
    one, two = [], []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        members = order[a:b]
        own, other = members[part[members] <= 1], members[part[members] == 2]
        if not len(own):
            continue
        rows = np.concatenate([own, other])
        line = np.repeat(np.arange(len(rows)), size[rows])
        counts = np.bincount(line * LETTERS + number[ranges(bounds[rows], size[rows])], minlength=len(rows) * LETTERS)
        x, y = _candidates(counts.reshape(-1, LETTERS).astype(kind), np.arange(len(own)), np.arange(len(own), len(rows)), bool(part[own[0]] == 0))
        one.append(rows[x])
        two.append(rows[y])
    one, two = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (one, two))
    ok = one_edit(number, bounds, one, two)
    x, y = np.concatenate([one[ok], two[ok]]), np.concatenate([two[ok], one[ok]])
    rank = np.zeros(len(words), np.int64)
    used = np.unique(y)
    rank[used[sorted(range(len(used)), key=lambda k: words[used[k]])]] = np.arange(len(used))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    near = np.diff(np.append(first, len(x)))
    column = table["word"].combine_chunks()
    return pa.table({"word": column.take(pa.array(x[first])), "n_near": pa.array(near, pa.int64()),
                     "best_n": pa.array(n[y[first]], pa.int64()), "best": column.take(pa.array(y[first]))})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``vocabulary(word, n)`` that have a near word."""
    number = vocabulary.count()
    classes = classes_for(number)
    words = vocabulary.select("word", "n", _block(F.col("word"), classes).alias("b"), F.xxhash64("word").alias("h"))
    size = cut(words.groupBy("b").agg(F.count(F.lit(1)).alias("size")))
    # a block meets the blocks beside it that are larger in array order, and its own other parts
    meets = (size.select(F.col("b").alias("from"), F.explode(_beside(F.col("b"), classes)).alias("b"), F.col("size").alias("more"))
             .where("b <= from").join(size, "b"))
    parts = F.ceil(F.col("size") / OWN).cast("int")
    more = F.sum(F.when(F.col("b") < F.col("from"), F.col("more")).when(parts > 1, F.col("more")).otherwise(F.lit(0)))
    plan = cut(meets.groupBy("b").agg(F.first(parts).alias("parts"), F.greatest(F.ceil(more / OTHERS), F.lit(1)).cast("int").alias("turns")))
    links = cut(meets.select("from", "b").join(plan, "b"))

    part_of = F.pmod(F.col("h"), F.col("parts")).cast("int")
    turn_of = F.pmod(F.xxhash64("h"), F.col("turns")).cast("int")
    own = (words.join(plan, "b").select("word", "n", "b", part_of.alias("i"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("j"))
           .select("word", "n", "b", "i", "j", F.when(F.col("j") == 0, 0).otherwise(1).alias("part")))
    other = (words.withColumnRenamed("b", "from").join(links, "from")
             .withColumn("to", F.when(F.col("from") == F.col("b"), part_of).otherwise(F.col("parts")))
             .where("to > 0").select("word", "n", "b", F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("i"),
                                     turn_of.alias("j"), F.lit(2).alias("part")))
    tasks = buckets_for(number * (classes * (classes + 1) // 2 + 1), BUCKET_ROWS)
    rows = own.union(other).select("word", "n", F.xxhash64("b", "i", "j").alias("g"), "part")
    found = (rows.groupBy(F.pmod(F.xxhash64("g"), F.lit(tasks)).alias("task"))
             .applyInArrow(_compare, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
            .select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms(word, form)``, by pointer doubling.

    Counts grow by a factor along a chain, so it has no cycle and a length
    logarithmic in the counts.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocabulary = cut(count_words(docs, id_column, text_column))
    near = near_words(vocabulary)
    strong = F.col("best_n") >= factor * F.col("n")
    named = cut(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    return (named.join(roots(named.where("form is not null")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("bigint").alias("n_near"), "form_n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))
