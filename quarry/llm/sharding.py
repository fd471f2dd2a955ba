"""Uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

A *piece* is one partition of the input.  In a uniform random permutation of
all rows, cut into shards of fixed sizes, the number of rows that go from each
piece to each shard is a matrix with fixed row and column sums and a known
law: a multivariate hypergeometric draw for one piece after the other.  The
steps are

1. permute locally: each piece is ordered by random numbers and written with
   the place of every row (committed files, so lost executors change nothing);
2. draw the matrix: the list of pieces is halved again and again, and for each
   half the rows that it sends to each shard are drawn from those of the whole
   (one hypergeometric number a shard, exact up to double precision: inversion
   of the distribution function where at most ``FEW`` outcomes are possible,
   ratio of uniforms with rejection else);
3. exchange: the first rows of a piece go to shard 0, the next ones to shard 1
   and so on, as many as the matrix says.  This is the only move of whole rows;
4. permute again: a second random number orders each shard.  A shard is cut
   into chunks of equal ranges of that number, each numbered by one task, with
   the rows of the chunks before it added; no task holds a whole shard.

Shard sizes differ by at most one row, the larger ones first.  Every step is
an expression or DataFrame operation; no Python runs on the executors, and the
driver gets the number of rows and pieces only.  The matrix is joined by
broadcast while its written size is below Spark's own limit, else by a shuffle.

Equal seeds give equal results for equal partitions of the input.  Null and
empty texts, nulls in any column and repeated rows are rows like any other;
equal rows go their own ways.  An empty table gives no rows.  Input columns
named like the two new ones, in any case, are replaced; all others are kept,
whatever their names.  The staged copy stays in the shared folder, because the
returned rows are read from it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, read
from quarry.session import ensure_checkpoint_dir

SHARDS = 24
CHUNK_ROWS = 1 << 14  # rows numbered by one task, about
FEW = 10  # at most so many outcomes beside zero: inversion
TRIES = 64  # each fails with a chance below 0.4
SPREAD_LEVEL = 6  # the halving goes on in this many tasks, as a power of two


def uniform(*seeds: Column) -> Column:
    """A number in (0, 1) made from the seeds."""
    return (F.shiftrightunsigned(F.xxhash64(*seeds), 11).cast("double") + 0.5) * (2.0 ** -53)


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _with(fields: dict[str, Column], use) -> Column:
    """``use`` applied to a struct of values, each of them computed once."""
    made = F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return F.get(F.transform(made, use), F.lit(0))


def hypergeometric(good: Column, rest: Column, sample: Column, *seeds: Column) -> Column:
    """How many of ``sample`` rows, taken from ``good + rest`` without return, are good.

    Both the good rows and the sample are replaced by their complement where
    that is smaller, so at most half of the total is either.
    """
    def weight(p: Column, k: Column) -> Column:  # -log of the probability of k, but for a constant
        return _log_factorial(k) + _log_factorial(p["g"] - k) + _log_factorial(p["m"] - k) + _log_factorial(p["b"] - p["m"] + k)

    def inverted(q: Column) -> Column:
        total = q["g"] + q["b"]
        whole = _log_factorial(q["g"]) + _log_factorial(q["b"]) + _log_factorial(q["m"]) + _log_factorial(total - q["m"]) - _log_factorial(total)
        return _with({**{f: q[f] for f in ("g", "b", "m", "most")}, "whole": whole, "u": uniform(*seeds, F.lit(-1))}, from_zero)

    def from_zero(p: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            upto = acc["upto"] + F.exp(p["whole"] - weight(p, k))
            return _with({"upto": upto, "k": acc["k"]}, lambda x: F.struct(
                x["upto"].alias("upto"), (x["k"] + F.when(p["u"] >= x["upto"], F.lit(1)).otherwise(F.lit(0))).alias("k")))
        start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).cast("bigint").alias("k"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), p["most"] - 1), start, step, lambda acc: acc["k"])

    def rejected(p: Column) -> Column:
        share = p["g"] / (p["g"] + p["b"])
        total = (p["g"] + p["b"]).cast("double")
        hat = {
            "mean": p["m"] * share + 0.5,
            "width": 2 * math.sqrt(2 / math.e) * F.sqrt(p["m"] * share * (1 - share) * (total - p["m"]) / (total - 1) + 0.5) + 3 - 2 * math.sqrt(3 / math.e),
            "top": weight(p, F.floor((p["m"] + 1.0) * (p["g"] + 1.0) / (total + 2)).cast("bigint")),
        }

        def attempt(h: Column, t: Column) -> Column:
            u, v = uniform(*seeds, t, F.lit(0)), uniform(*seeds, t, F.lit(1))
            return _with({"u": u, "v": v}, lambda x: _with(
                {"u": x["u"], "k": F.floor(h["mean"] + h["width"] * (x["v"] - 0.5) / x["u"]).cast("bigint")},
                lambda y: F.when((y["k"] >= 0) & (y["k"] <= p["most"]) & (2 * F.log(y["u"]) <= h["top"] - weight(p, y["k"])), y["k"])))

        def tries(h: Column) -> Column:
            none = F.lit(None).cast("bigint")
            found = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), none, lambda acc, t: F.when(acc.isNotNull(), acc).otherwise(attempt(h, t)))
            return F.coalesce(found, F.floor(h["mean"]).cast("bigint"))
        return _with(hat, tries)

    def draw(p: Column) -> Column:
        return F.when(p["most"] == 0, F.lit(0).cast("bigint")).when(p["most"] <= FEW, inverted(p)).otherwise(rejected(p))

    total = good + rest
    g, m = F.least(good, rest), F.least(sample, total - sample)
    return _with({"g": g, "b": F.greatest(good, rest), "m": m, "most": F.least(g, m)}, lambda p: _with(
        {"k": draw(p), "m": p["m"]}, lambda x: _with({"k": F.when(good <= rest, x["k"]).otherwise(x["m"] - x["k"])}, lambda y: F.when(
            sample <= total - sample, y["k"]).otherwise(good - y["k"]))))


def _share_out(counts: Column, sample: Column, *seeds: Column) -> Column:
    """Rows of each shard among ``sample`` rows drawn from ``counts`` rows a shard."""
    def step(acc: Column, c: Column) -> Column:
        k = hypergeometric(c, acc["rest"] - c, acc["need"], *seeds, F.size(acc["out"]))
        return _with({"k": k, "acc": acc}, lambda x: F.struct(
            (x["acc"]["rest"] - c).alias("rest"), (x["acc"]["need"] - x["k"]).alias("need"), F.array_append(x["acc"]["out"], x["k"]).alias("out")))
    start = F.struct(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c).alias("rest"),
                     sample.alias("need"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(counts, start, step, lambda acc: acc["out"])


def communication_matrix(pieces: DataFrame, shard_rows: list[int], seed: int) -> DataFrame:
    """(piece, counts): rows of each piece ``(piece, rows)`` that go to each shard.

    The piece sizes start as one array (eight bytes a partition) and are
    halved with it; from level ``SPREAD_LEVEL`` on the halves are spread over
    the tasks.
    """
    number = pieces.count()
    rows = (pieces.agg(F.array_sort(F.collect_list(F.struct("piece", F.col("rows").cast("bigint").alias("rows")))).alias("sizes"))
            .select(F.lit(1).cast("bigint").alias("node"), "sizes", F.array(*[F.lit(n).cast("bigint") for n in shard_rows]).alias("counts")))
    half = F.floor(F.size("sizes") / 2).cast("int")
    parts = ["node", "counts", F.slice("sizes", F.lit(1), half).alias("left"), F.slice("sizes", half + 1, F.size("sizes") - half).alias("right")]
    need = F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
    taken = _share_out(F.col("counts"), need, F.lit(seed), F.col("node")).alias("taken")
    halves = F.explode(F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("sizes"), F.col("taken").alias("counts")),
        F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("sizes"), F.zip_with("counts", "taken", lambda a, b: a - b).alias("counts"))))
    for level in range(max(0, number - 1).bit_length()):
        rows = rows.select(*parts).select("*", taken).select(halves.alias("h")).select("h.*").where(F.size("sizes") > 0)
        if level == SPREAD_LEVEL:
            rows = rows.repartition(1 << SPREAD_LEVEL, "node")
        rows = cut(rows)  # one small job a level: the same code each time, compiled once
    return rows.select(F.get("sizes", F.lit(0))["piece"].alias("piece"), "counts").where("piece is not null")


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 11, shard_column: str = "shard",
                        slot_column: str = "slot", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All input columns, the shard and the row's place (from 0) in its shard."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shuffle-{own}"
    first, piece, place, second, ends, chunk, before, rank = (f"_{own}_{k}" for k in range(8))
    df = df.drop(shard_column, slot_column)
    local = (df.withColumn(first, F.rand(seed)).sortWithinPartitions(first).drop(first)
             .withColumns({piece: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
                           second: F.rand(seed + 1)}))
    local.write.option("compression", "zstd").parquet(f"{folder}/local")
    rows = spark.read.schema(local.schema).parquet(f"{folder}/local")

    rows.groupBy(F.col(piece).alias("piece")).agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema("piece int, rows long").parquet(f"{folder}/pieces")
    total = pieces.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    chunks = max(1, -(-total // (shards * chunk_rows)))

    def running(counts: Column) -> Column:
        return F.aggregate(counts, F.array().cast("array<bigint>"),
                           lambda acc, c: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + c))

    (communication_matrix(pieces, sizes, seed).select(F.col("piece").alias(piece), running(F.col("counts")).alias(ends))
     .write.parquet(f"{folder}/matrix"))
    matrix = spark.read.schema(f"`{piece}` int, `{ends}` array<bigint>").parquet(f"{folder}/matrix")

    def sent(part: DataFrame) -> DataFrame:
        return (part.join(matrix, piece)
                .withColumn(shard_column, F.size(F.filter(ends, lambda e: e <= F.col(place))))
                .withColumn(chunk, F.floor(F.col(second) * chunks).cast("int")))

    counted = sent(rows.select(piece, place, second)).groupBy(shard_column, chunk).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(shard_column).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    (counted.select(F.col(shard_column), F.col(chunk), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
     .write.parquet(f"{folder}/chunks"))
    starts = spark.read.schema(f"`{shard_column}` int, `{chunk}` int, `{before}` long").parquet(f"{folder}/chunks")

    inside = Window.partitionBy(shard_column, chunk).orderBy(second, piece, place)
    return (sent(rows).withColumn(rank, F.row_number().over(inside)).join(starts, [shard_column, chunk])
            .select(*[F.col(f"`{c}`") for c in df.columns], F.col(shard_column),
                    (F.col(before) + F.col(rank) - 1).cast("bigint").alias(slot_column)))


def write_shards(sharded: DataFrame, path: str, shard_column: str = "shard") -> None:
    """One folder of Parquet files a shard; rows keep their slot column."""
    sharded.write.partitionBy(shard_column).parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
