"""Host-level quality rules, in DataFrame expressions only.

Each document is measured once. Failures are counted by domain, each domain's failure rate is shrunk
towards an empirical beta prior fitted over all domains, and a domain whose shrunk rate is too high
takes all of its documents with it. A document also falls by its own failed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut, documents, text_or_empty

#: Fixed values of the rules: share of symbols to words, of repeated lines, of capital letters, mean word
#: length, and the shrunk failure rate from which a domain is rejected.
SYMBOLS, DUP_LINES, CAPITALS, WORD_LENGTH, HOST_RATE = 0.1, 0.3, 0.5, (2.0, 15.0), 0.5
#: Rejected domains up to which they are sent to all executors; more are joined by shuffling.
SENT_HOSTS = 10_000
SYMBOL_SET = "#*$%&|<>"


def _repeated(hashes: Column) -> Column:
    """(hash, position) of all windows, by hash, where some hash occurs twice; else null."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _twice(pairs: Column) -> Column:
    """Positions, ascending, of entries whose hash a neighbour shares."""
    same = F.filter(
        pairs,
        lambda x, i: F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(same, lambda x: x["p"]))


def measure(docs: DataFrame, domain: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, domain and the text's counts, and with whole the row itself. A null text counts as empty."""
    text = text_or_empty()
    letters = F.regexp_replace(text, r"\P{L}+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    own = [F.struct("*").alias("row")] if whole else []
    barrier = F.spark_partition_id().alias("_at")  # a filter above must not be pushed below, where it would repeat these expressions for every word
    words = docs.select(
        *own,
        "doc_id",
        F.col(domain).alias("domain"),
        F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOL_SET, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        lines.alias("lines"),
        F.length(letters).alias("letters"),
        F.length(F.regexp_replace(letters, r"\p{Lu}+", "")).alias("lower"),
    )
    windows = words.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(
            F.size("w") >= 4,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        ).alias("h"),
    ).drop("w", "lines")
    sorted_ = windows.withColumn("pairs", _repeated(F.col("h"))).drop("h")
    at = sorted_.withColumn("at", _twice(F.col("pairs"))).drop("pairs")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + 2).alias("last"), (s["n"] + p + 2 - F.greatest(p - 1, s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return at.select(
        *(["row", barrier] if whole else []), "doc_id", "domain", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "letters", "lower",
    )


def failures(measured: DataFrame) -> DataFrame:
    """base_failed and own_failed (any rule)."""
    n, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    soft = (
        (F.col("n_symbols") > SYMBOLS * n)
        | (F.col("n_dup_lines") > DUP_LINES * F.col("n_lines"))
        | (F.col("letters") - F.col("lower") > CAPITALS * F.col("letters"))
        | (mean < WORD_LENGTH[0])
        | (mean > WORD_LENGTH[1])
    )
    return measured.withColumn("base_failed", base).withColumn("own_failed", base | soft)


def host_rates(failed: DataFrame) -> DataFrame:
    """domain, docs, fails and the failure rate shrunk by a beta prior fitted by moments over the domains."""
    hosts = failed.groupBy("domain").agg(F.count("*").alias("docs"), F.count_if("own_failed").alias("fails"))
    docs, fails, squares, hosts_n, spread = hosts.agg(
        F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("fails"), F.lit(0)), F.sum(F.col("docs").cast("double") * F.col("docs")), F.count("*"),
        F.sum(F.col("fails").cast("double") * F.col("fails") / F.col("docs")),
    ).first()
    p = fails / docs if docs else 0.0
    between = (spread or 0.0) - docs * p * p - p * (1 - p) * (hosts_n - 1)
    room = docs - (squares or 0.0) / docs if docs else 0.0
    strength = 1e6
    if room > 0 and between > 0:
        strength = min(max(p * (1 - p) * room / between - 1, 1.0), 1e6)
    return hosts.withColumn("rate", (F.col("fails") + p * strength) / (F.col("docs") + F.lit(strength)))


def judge(docs: DataFrame, domain: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The counts of every row of docs with base_failed, host_rate and kept.

    Null or empty texts have no words and fail; a null domain is a domain of its own; repeated rows are
    judged each; an empty table gives none. Columns other than doc_id, text and the domain are not read.
    """
    failed = cut(failures(measure(docs, domain)))
    rates = host_rates(failed).select(F.col("domain").alias("host"), F.col("rate").alias("host_rate"))
    out = failed.join(rates, F.col("domain").eqNullSafe(F.col("host")), "left").drop("host")
    return out.withColumn("kept", ~F.col("own_failed") & (F.col("host_rate") < host_rate))


def keep(docs: DataFrame, domain: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, unchanged. The counts are worked out twice, for the domains and for the rows, so that texts need not be moved."""
    rates = host_rates(cut(failures(measure(docs, domain)).select("domain", "own_failed")))
    bad = cut(rates.where(F.col("rate") >= host_rate).select(F.col("domain").alias("host")))
    rows = failures(measure(docs, domain, whole=True)).where(~F.col("own_failed") & (F.col("_at") >= 0))
    found = bad.count()
    if found:
        bad = F.broadcast(bad) if found <= SENT_HOSTS else bad
        rows = rows.join(bad, F.col("domain").eqNullSafe(F.col("host")), "left_anti")
    return rows.select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "own_failed", F.round("host_rate", 9).alias("host_rate")
    )


OP9_SQL = """
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    regexp_replace(coalesce(text, ''), '[^\\p{L}]+', '', 'g') AS letters
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t WHERE len(w) >= 4
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) AS x WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM twice) AS x GROUP BY doc_id
), m AS (
  SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(letters) AS letters, length(letters) - length(regexp_replace(letters, '\\p{Lu}+', '', 'g')) AS capitals
  FROM t LEFT JOIN covered ON covered.doc_id = t.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines OR capitals > 0.5 * letters
      OR word_chars * 1.0 / greatest(n_words, 1) < 2 OR word_chars * 1.0 / greatest(n_words, 1) > 15 AS own_failed
  FROM m
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS d, CAST(count(*) FILTER (WHERE own_failed) AS DOUBLE) AS f FROM f GROUP BY source
), s AS (
  SELECT sum(f) / sum(d) AS p, sum(d) - sum(d * d) / sum(d) AS room, sum(f * f / d) - sum(d) * (sum(f) / sum(d)) * (sum(f) / sum(d)) - (sum(f) / sum(d)) * (1 - sum(f) / sum(d)) * (count(*) - 1) AS between_ FROM h
), r AS (
  SELECT source, (f + p * z) / (d + z) AS rate FROM (
    SELECT h.*, p, CASE WHEN room > 0 AND between_ > 0 THEN least(greatest(p * (1 - p) * room / between_ - 1, 1), 1e6) ELSE 1e6 END AS z FROM h CROSS JOIN s
  ) AS x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT own_failed AND rate < 0.5 AS kept, own_failed, round(rate, 9) AS host_rate
FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source
"""
