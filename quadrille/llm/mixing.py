"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import written

#: Bits of a draw and of a place, from an md5 digest.
BITS = 52
#: Up to so many values of all sources' distribution functions (8 MB), their table is broadcast; beyond, it is joined under this many salts.
BROADCAST_VALUES, SALTS = 1_000_000, 64
#: A larger mean is drawn as the sum of so many equal, independent parts that none is larger, which bounds a distribution's table.
LARGEST = 4096
#: Copies of one part are numbered within this many, far more than its distribution has.
STRIDE = 2 * LARGEST


def draw(*parts: Column | str | int) -> Column:
    """A long below 2**52, the same in every run: the first 13 hex digits of the md5 of the parts."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def free_name(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """Rows (source, size, rate): the mean number of copies of a source's documents.

    A document's size is its characters and one for its end. The output has ``epochs``
    times the input's size in expectation, and each source its weight's share of it.
    A null source is one of its own. A weight of zero drops its source. The sources'
    sums are written once; the driver takes two totals of them.
    """
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1)
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    groups, _ = written(docs.groupBy("source").agg(size.alias("size")).withColumn("weight", weight), "sources")
    total = groups.agg(F.sum("weight").alias("weight"), F.sum("size").alias("size")).first()
    all_weight, all_size = float(total["weight"] or 0), float(total["size"] or 0)
    rate = F.col("weight") / F.lit(all_weight) * F.lit(all_size * epochs) / F.col("size") if all_weight else F.lit(0.0)
    return groups.select("source", "size", rate.alias("rate"))


def distributions(table: DataFrame) -> DataFrame:
    """(source, rate) with parts, cdf: the Poisson distribution function of one part at 0, 1, 2, ... up to where a double can't tell it from 1.

    A rate up to ``LARGEST`` has one part, itself. Each source's values are rows first,
    summed by windows in logarithms, so that large rates don't underflow.
    """
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("long")
    table = table.select("source", "rate", parts.alias("parts")).withColumn("mean", F.col("rate") / F.col("parts"))
    top = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24)
    k = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("k"))
    by = W.Window.partitionBy("source", "rate").orderBy("k")
    log = F.when(F.col("mean") > 0, -F.col("mean") + F.col("k") * F.log("mean") - F.sum(F.log(F.greatest("k", F.lit(1)))).over(by))
    p = F.when(F.col("mean") > 0, F.exp(log)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = k.withColumn("p", p).withColumn("c", F.sum("p").over(by))
    listed = summed.groupBy("source", "rate", "parts").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("x"))
    return listed.select("source", "rate", "parts", F.col("x.c").alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in one global random order.

    Each document draws from a hash of the seed and its doc_id; its copies are how often
    the distribution function of its source's rate is at or below the draw. (A rate above
    ``LARGEST`` is a sum of parts, with a draw each.) Every copy then has a place, another
    hash; rows are dealt to partitions by equal ranges of places, which needs no sample,
    and sorted. Two columns are added, copy (long, from 1; those of a further part from
    the next multiple of ``STRIDE``) and place, with an underscore behind where a name is
    taken; docs' columns may have any names. Null and empty texts have the size of their
    end alone. Rows with equal ids draw alike, repeated rows too; null ids draw as one id.
    An empty table gives none.
    """
    spark = docs.sparkSession
    copy, place = free_name("copy", docs.columns), free_name("place", docs.columns)
    table, _ = written(distributions(rates(docs.select("source", "text"), weights or {}, default, epochs)), "rates")
    values = table.agg(F.sum(F.size("cdf").cast("long"))).first()[0] or 0
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", F.col("doc_id").alias("own"), doc_id.alias("id"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    table = table.select(F.col("source").alias("of"), "parts", "cdf")
    same = F.col("source").eqNullSafe(F.col("of"))
    if values <= BROADCAST_VALUES:
        joined = rows.join(F.broadcast(table), same)
    else:
        salted = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part_salt"))
        joined = rows.join(salted, same & (F.col("salt") == F.col("part_salt")))
    first = joined.select("row", "own", "id", "cdf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    u = F.when(F.col("part") == 0, draw(seed, F.col("id"))).otherwise(draw(seed, F.lit("part"), F.col("id"), F.col("part").cast("string"))) / F.lit(float(1 << BITS))
    times = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = first.withColumn("u", u).select("row", "own", "id", "part", times.cast("long").alias("times")).where("times > 0")
    copies = counted.select("row", "own", "id", F.explode(F.sequence(F.col("part") * STRIDE + 1, F.col("part") * STRIDE + F.col("times"))).alias("copy"))
    copies = copies.withColumn("place", draw(seed, F.lit("place"), F.col("id"), F.col("copy").cast("string")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = (F.col("place") / F.lit(float(1 << BITS)) * n).cast("int")
    dealt = copies.select("row", "own", "copy", "place").repartitionById(n, part).sortWithinPartitions("place", "own", "copy")
    return dealt.select("row.*", F.col("copy").alias(copy), F.col("place").alias(place))
