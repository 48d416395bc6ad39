"""Host-level quality rules, in DataFrame functions only.

Each document gets its counts and rule failures.  Failures are summed by host
(the partial sums run before the shuffle, so a host that holds a third of all
rows costs one row per task), and a host's rate is shrunk towards all hosts'
rates with a beta prior whose parameters are fitted to the hosts by moments.
A host whose shrunk rate passes the limit is rejected as a whole, and its
verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import column, materialize, unused

#: A host is rejected when more than this share of its documents is expected to fail.
HOST_LIMIT = 0.5
#: Hosts up to this count are broadcast (about 16 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 500_000
WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def judged_names(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns that :func:`judge` adds: ``_counts`` and
    ``_kept``, with more underscores where ``docs`` has these itself."""
    return tuple(unused(docs.columns, "_counts", "_kept"))


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_counts`` (see :func:`judged_names`):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words and fails; rows are counted one by one,
    so ties and repeats do not matter.  Words are ``[^\\x20\\x09-\\x0D]+``.
    """
    own = "rules_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    found = judged_names(docs)[0]
    content = F.coalesce(column(text).cast("string"), F.lit(""))
    staged = docs.withColumn(f"{own}t", content).withColumn(f"{own}w", _words(F.col(f"{own}t"))).withColumn(f"{own}n", F.size(f"{own}w").cast("long"))
    many = F.col(f"{own}n") >= WINDOW
    hashes = F.transform(F.sequence(F.lit(0), F.size(f"{own}w") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(f"{own}w"), i + k) for k in range(WINDOW))))
    staged = staged.withColumn(f"{own}h", F.when(many, hashes))
    again = F.when(many & (F.size(F.array_distinct(f"{own}h")) < F.size(f"{own}h")), F.array_sort(F.transform(f"{own}h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = staged.withColumn(f"{own}p", again)
    places = F.array_sort(
        F.transform(
            F.filter(f"{own}p", lambda p, k: F.coalesce(F.get(F.col(f"{own}p"), k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(F.col(f"{own}p"), k + 1)["h"] == p["h"], F.lit(False))),
            lambda p: p["i"],
        )
    )
    staged = staged.withColumn(f"{own}s", places)
    covered = F.aggregate(
        F.transform(f"{own}s", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(f"{own}s"), k + 1) - s, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split(f"{own}t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.translate(f"{own}t", "\x20\x09\x0a\x0b\x0c\x0d", "")
    staged = staged.withColumn(f"{own}l", lines)
    counts = F.struct(
        F.col(f"{own}n").alias("n_words"),
        F.char_length(plain).cast("long").alias("word_chars"),
        (F.char_length(f"{own}t") - F.char_length(F.translate(f"{own}t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(f"{own}l") - F.size(F.array_distinct(f"{own}l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    staged = staged.withColumn(found, counts)
    failed = (F.col(found)["n_words"] < 10) | (100 * F.col(found)["n_repeat_words"] > 20 * F.col(found)["n_words"])
    return staged.withColumn(found, F.col(found).withField("base_failed", failed)).drop(f"{own}t", f"{own}w", f"{own}n", f"{own}h", f"{own}p", f"{own}s", f"{own}l")


def host_verdicts(counted: DataFrame, host: str, counts: str = "_counts", limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failures, rate (posterior mean), rejected, for each host.

    The prior is fitted by moments over hosts with two or more documents; a
    single host, or hosts that differ no more than chance, give the weakest
    prior of the family with their mean.  Null hosts form a host of their own.
    """
    sums = counted.groupBy(column(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(counts)["base_failed"].cast("long")).alias("failures"))
    sums = materialize(sums, "hosts")
    rate = F.col("failures") / F.col("n")
    fit = sums.where("n >= 2").agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n")).alias("inverse"))
    mean = F.coalesce("mean", F.lit(0.0))
    own = F.greatest(F.coalesce("var", F.lit(0.0)) - mean * (1 - mean) * F.coalesce("inverse", F.lit(0.0)), F.lit(0.0))  # less what chance adds
    strength = F.when((own > 0) & (mean * (1 - mean) > own), mean * (1 - mean) / own - 1).otherwise(F.lit(1.0))
    prior = fit.select(F.greatest(mean * strength, F.lit(1e-3)).alias("alpha"), F.greatest((1 - mean) * strength, F.lit(1e-3)).alias("beta"))
    one = prior.first()  # a single row
    posterior = (F.col("failures") + one.alpha) / (F.col("n") + one.alpha + one.beta)
    return sums.select("host", "n", "failures", posterior.alias("rate"), (posterior > limit).alias("rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT, carried: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carried``) with the counts and the verdict, in
    columns of the names of :func:`judged_names`.

    kept: the document passes its own rules and its host is not rejected.
    Null or repeated keys do not matter: rows are judged one by one, and the
    verdict is looked up by host; null hosts are one host.  Counts are computed
    once and written with the carried columns.
    """
    counts, kept = judged_names(docs)
    its, bad = unused([*docs.columns, counts, kept], "its_host", "host_bad")
    rows = document_counts(docs.withColumn(its, column(host)), text)
    counted = materialize(rows.select(*[column(c) for c in (docs.columns if carried is None else carried)], its, counts), "counts")
    verdicts = host_verdicts(counted, its, counts, limit)
    out = verdicts.where("rejected").select(F.col("host").alias(its + "_"), F.lit(True).alias(bad))
    few = verdicts.count() <= BROADCAST_HOSTS
    joined = counted.join(F.broadcast(out) if few else out, F.col(its).eqNullSafe(F.col(its + "_")), "left")
    return joined.withColumn(kept, ~F.col(counts)["base_failed"] & F.col(bad).isNull()).drop(its, its + "_", bad)
