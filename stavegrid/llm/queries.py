"""The registered queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavegrid.llm import automaton, centroids, host_rules, html, jaccard, linededup, mixing, negatives, packing, sharding, simple8b, substring, tokens, topk

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids along the curve.

    A null or empty text is its end id alone; null and repeated ids are rows
    like any other; a very long text is cut over many sequences.  No rows give
    no pieces.
    """
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokens.vocabulary_path(BYTE_BPE), length=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best scores of each query against all other rows.

    Rows with a null id or an unusable vector take no part; ties go to the
    smaller vec_id; a repeated row takes a rank each time.  No rows or no
    queries give no rows.
    """
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes.

    Equal texts stay together, a null text with the empty ones; repeated ids
    and rows take a slot each.  No rows give no rows.
    """
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    A null or empty page has an empty text; a page without a readable host has
    no templates; repeated rows give repeated results.  No rows give no rows.
    """
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of ids read back from Simple-8b files.

    A null or empty text is its end id alone; null ids come first, repeated ids
    in the order of their texts.  No rows give no rows.
    """
    path = tokens.vocabulary_path(WORD_BPE)
    blocks = simple8b.write_ids(_table(spark, sf_dir, "documents"), lambda: tokens.word_end_encoder(path), end=2)
    return simple8b.read_ids(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, own rules and the host's verdict of every document.

    A null or empty text has no words and fails; null hosts are one host;
    repeated rows are judged alike.  No rows give no rows.
    """
    judged = host_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carried=["doc_id"])
    return judged.select("doc_id", "_counts.*", F.col("_kept").alias("kept"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to.

    A null or empty text has no ids; null and repeated ids are rows like any
    other.  No rows give no rows.
    """
    return automaton.encode_decode_digest(_table(spark, sf_dir, "documents"), tokens.vocabulary_path(BYTE_BPE))


def op8_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without words of repeated windows.

    Null, empty and short texts lose nothing; a null id comes last, repeated
    ids go by the hash of their text, equal rows are one document.  No rows
    give no rows.
    """
    return substring.digest(_table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without near duplicates of earlier lines.

    Null and empty texts have no lines, and lines of white space stay; a null
    id comes last, repeated ids go by the hash of their text, equal rows are
    one document.  No rows give no rows.
    """
    return linededup.digest(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component.

    A null or empty text has no shingles and is alone; equal sets and repeated
    rows are linked; a null id names a component only of null ids.  No rows
    give no rows.
    """
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's centroid after ten rounds.

    Vectors null, of another length than 64, or with a component null or not
    finite are left out; ties go to the smaller number; a null id comes last
    among the first centroids; repeated rows count each time.  No rows give no
    rows.
    """
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, d=64, scale=1024.0, seed=3)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of the five positives of each anchor.

    Rows with a null id or label or an unusable vector take no part; ties go to
    the smaller vec_id; a repeated anchor id is one anchor, other repeated rows
    take a place each.  No rows or no anchors give no rows.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)


def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes.

    A null or empty text has no words and gives none; a null source is one
    source, the last; null and repeated ids are rows like any other.  No rows
    give no rows.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows, (size, whole, target, times) = mixing.copies(docs, ["doc_id"], weights=(1, 2, 3), most=3)
    return rows.select("doc_id", F.col(size).alias("size"), F.col(whole).alias("source_size"), F.col(target).alias("target"), (F.col(times) * F.col(size)).alias("taken"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_hilbert_packing,
            op2_segment_topk,
            op3_best_fit_sharding,
            op4_template_removal,
            op5_simple8b,
            op6_host_rules,
            op7_bpe_automaton,
            op8_suffix_trees,
            op9_fuzzy_lines,
            op10_jaccard_join,
            op11_centroids,
            op12_hard_negatives,
            op13_systematic_mix,
        )
    }


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_OP6 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), again AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, content) AS n FROM starts) WHERE n > 1
), repeated AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(following - i, 5))) AS BIGINT) AS n FROM again GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failures FROM f GROUP BY source
), m AS (
  SELECT coalesce(avg(failures / n), 0) AS mean, coalesce(var_samp(failures / n), 0) AS var, coalesce(avg(1 / n), 0) AS inverse FROM h WHERE n >= 2
), o AS (
  SELECT mean, greatest(var - mean * (1 - mean) * inverse, 0) AS own FROM m
), p AS (
  SELECT mean, CASE WHEN own > 0 AND mean * (1 - mean) > own THEN mean * (1 - mean) / own - 1 ELSE 1 END AS strength FROM o
), b AS (
  SELECT greatest(mean * strength, 0.001) AS alpha, greatest((1 - mean) * strength, 0.001) AS beta FROM p
), bad AS (
  SELECT source, (failures + alpha) / (n + alpha + beta) > 0.5 AS rejected FROM h, b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

_OP8 = rf"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), each AS (
  SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM overlap JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least l ON w.doc_id = l.a
"""


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11(rounds: int = 10) -> str:
    """Each round a pair of tables: vectors with their centroid, and the new centroids."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, e FROM v ORDER BY k LIMIT 8)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v.e, k, list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e) AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS e FROM m{r} GROUP BY k) n USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)"""


_OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_OP13 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER w AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    sum(3 * source_size) OVER w AS spent, sum(weight) OVER () - sum(weight) OVER w AS weighs, lead(3 * source_size) OVER w AS next_cap, lead(weight) OVER w AS next_weight
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source)
), starts AS (
  SELECT 0 AS k, 0 AS spent, (SELECT sum(weight) FROM s) AS weighs, (SELECT cap FROM r WHERE k = 1) AS next_cap, (SELECT weight FROM r WHERE k = 1) AS next_weight
  UNION ALL SELECT k, spent, weighs, next_cap, next_weight FROM r
), level AS (
  SELECT k, CAST((SELECT max(total) FROM r) - spent AS DOUBLE) AS rest, CAST(weighs AS DOUBLE) AS weighs FROM starts
  WHERE next_cap IS NULL OR next_cap * weighs >= next_weight * ((SELECT max(total) FROM r) - spent) ORDER BY k LIMIT 1
), t AS (
  SELECT r.source, source_size, CASE WHEN r.k <= level.k THEN CAST(cap AS DOUBLE) ELSE weight * rest / level.weighs END AS target,
    (CAST('0x' || substr(sha256('13:' || coalesce('=' || r.source, '')), 1, 5) AS BIGINT) + 0.5) / 1048576.0 AS start
  FROM r, level
), o AS (
  SELECT doc_id, size, source_size, target, CAST(start AS DOUBLE) AS start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(start + place * rate) - floor(start + (place - 1) * rate)) AS BIGINT) AS taken FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_segment_topk": _OP2,
        "op6_host_rules": _OP6,
        "op8_suffix_trees": _OP8,
        "op10_jaccard_join": _OP10,
        "op11_centroids": _op11(),
        "op12_hard_negatives": _OP12,
        "op13_systematic_mix": _OP13,
    }
