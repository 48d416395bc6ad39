"""Mixing sources to target weights by systematic sampling.

A source's documents are expected rate = target / size times each.  In the order
of falling size, the prefix sums of these expectations are set on a line, one
random offset a source is added, and a document is emitted once for each whole
number that its piece of the line crosses.  So a document is taken floor(rate)
or ceil(rate) times, and neighbours on the line, which have like sizes, make up
for each other: what a source takes differs from its target by about half of its
longest document at most.

The place of a document in its source comes from one range sort of (source,
size) without texts, so that a source with a third of all rows fills as many
partitions as it needs; each partition's rows by source are counted, and the
counts before it are added to the places within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavegrid.llm.common import column, discard, materialize, shuffle_width, unused

WORD = r"[^\x20\x09-\x0D]+"


def range_dealt(rows: DataFrame, part: str, name: str, *order: Column) -> DataFrame:
    """``rows`` range-sorted into partitions and written with their partition's
    number, so that all that reads them sees the same partitions."""
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession, rows), *order)
    return materialize(dealt.withColumn(part, F.spark_partition_id()), name)


def places(dealt: DataFrame, part: str, place: str, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """``dealt`` (range-sorted by group, then order) with each row's place, from 1,
    among the rows that are equal in the columns ``group`` (null is one value).

    Rows are counted by partition and group, and the counts of earlier partitions
    are added to the places within; no group is in one task."""
    many, before, near = unused([*dealt.columns, place], "many", "before", "near")
    of = [column(g) for g in group or []]
    counts = dealt.groupBy(part, *of).agg(F.count("*").alias(many))  # a row for each partition and group in it
    earlier = Window.partitionBy(*of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = unused([*dealt.columns, many, before, near, place], *[f"g{k}" for k in range(len(of) + 1)])
    counts = counts.withColumn(before, F.coalesce(F.sum(many).over(earlier), F.lit(0)))
    counts = counts.select(*[c.alias(n) for c, n in zip([*of, column(part)], names)], before)
    same = F.lit(True)
    for c, n in zip([column(part), *of], [names[-1], *names]):
        same = same & c.eqNullSafe(column(n))
    inner = Window.partitionBy(part, *of).orderBy(*order)
    out = dealt.withColumn(near, F.row_number().over(inner)).join(counts, same)
    return out.select(*[column(c) for c in dealt.columns if c != part], (column(near) + column(before)).alias(place))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: all sizes shared by weight,
    at most ``most`` times a source's own; what is above that goes to the others
    by weight, until none is above.

    The level, size a unit of weight, only rises, and the driver gets two sums a
    round.  Sources go by code point, null last, and weigh ``weights`` in turn.
    """
    order = [F.col("source").isNull(), F.encode("source", "utf-8")]
    placed = places(range_dealt(sizes, "part", "mixing-order", *order), "part", "place", order)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    shared = materialize(placed.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most), "mixing-sources")
    total = shared.agg(F.sum("source_size")).first()[0] or 0
    capped, level = F.lit(False), None
    while True:
        free = F.when(~capped, F.col("weight"))
        spent, weighs = shared.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(free)).first()
        rest, weighs = total - (spent or 0), weighs or 0
        if not weighs or level == (rest, weighs):
            break
        level = (rest, weighs)
        capped = F.col("cap") * weighs < F.col("weight") * rest
    share = F.col("weight") * F.lit(level[0]).cast("double") / F.lit(level[1]).cast("double") if level else F.lit(None).cast("double")
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share) if weighs else F.col("cap").cast("double")
    return shared.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A source's offset in (0, 1), from the hash of the seed and its name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return (F.conv(F.substring(F.sha2(name, 256), 1, 5), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 20))


def copies(
    docs: DataFrame, carried: list[str], weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 13,
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> tuple[DataFrame, list[str]]:
    """Every row of ``docs``, the columns ``carried`` of it, with four columns more
    and their names: size, source_size, target, copies.

    Size is the number of words, none for a null text.  Ties of size go by id
    (null last), then by the text's hash; fully equal rows are alike, whichever
    of them is taken once more.  A null source is one source, the last.  A source
    without words takes nothing.  Columns of any name are kept.  No rows give no
    rows.
    """
    size, whole, target, times, id_, of, hash_, tie, part, place, named = unused(docs.columns, "size", "source_size", "target", "copies", "id", "of", "hash", "tie", "part", "place", "named")
    words = F.coalesce(F.regexp_count(column(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(
        *[column(c) for c in carried], column(key).cast("string").alias(id_), column(source).cast("string").alias(of),
        F.xxhash64(column(text).cast("string")).alias(hash_), words.alias(size), F.monotonically_increasing_id().alias(tie),
    )
    number = F.expr(f"try_cast({id_} AS decimal(38, 0))")  # ids in the order of numbers where they are numbers
    order = [F.col(size).desc(), number.asc_nulls_last(), F.col(id_).asc_nulls_last(), F.col(hash_), F.col(tie)]
    counted = materialize(own, "mixing-sizes")
    dealt = range_dealt(counted, part, "mixing", F.col(of), *order)
    discard(counted)
    sums = materialize(source_targets(dealt.groupBy(F.col(of).alias("source")).agg(F.sum(size).alias("source_size")), weights, most), "mixing-targets")
    sums = sums.select(F.col("source").alias(named), F.col("source_size").alias(whole), F.col("target").alias(target))
    rows = places(dealt, part, place, order, [of]).join(sums, F.col(of).eqNullSafe(F.col(named)), "left")
    rate = F.when(F.col(whole) > 0, F.col(target) / F.col(whole)).otherwise(0.0)
    upto = lambda at: F.floor(offset(F.col(of), seed) + at * rate)
    taken = F.least(upto(F.col(place)) - upto(F.col(place) - 1), F.lit(most)).cast("long")
    return rows.select(*[column(c) for c in carried], size, whole, target, taken.alias(times)), [size, whole, target, times]


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as
    :func:`copies` says, with one column more, ``copy`` (from 1)."""
    rows, (_, _, _, times) = copies(docs, docs.columns, **options)
    copy = unused(rows.columns, "copy")[0]
    repeated = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(copy)
    return rows.where(F.col(times) > 0).select(*[column(c) for c in docs.columns], repeated)
