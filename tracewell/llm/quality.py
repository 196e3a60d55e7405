"""Quality rules judged per host: a document fails by its own rules, and a host falls when too many of its documents fail.

Everything is DataFrame expressions. The failure rate of a host (the source, where pages of a host are meant) is shrunk
towards all hosts with a beta prior fitted to the hosts by moments, so a host of three documents is not judged by them
alone; a host whose shrunk rate passes ``reject_above`` loses all its documents. Host counts are partial aggregates and
only one row per host is joined back.

Defined results: null and empty texts have no words and fail. Texts of any length are measured whole. Rows that repeat a
doc_id are judged row by row; a null host is a host. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD
from tracewell.session import stage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each text. Words are split once; windows are compared by a 64-bit hash chained over their words."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("_t")).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    has_word = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))
    d = d.select(*keep, F.size("_w").cast("long").alias("n_words"),
                 F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                 F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 F.filter(F.split("_t", "\n"), has_word).alias("_l"),
                 F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).alias("_h"))
    d = d.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 # only texts with some window twice are sorted
                 F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    # positions of windows that equal a neighbour in the sorted list, back in text order
    twice = F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | ((i + 1 < F.size("_s")) & (F.get("_s", i + 1)["h"] == x["h"])))
    d = d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_p"))
    # a window adds the words that the one before does not hold
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judged(d: DataFrame) -> DataFrame:
    """Adds base_failed and failures, the number of rules broken (the base rules, symbols, repeated lines, odd word length)."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    rules = [n < MIN_WORDS, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n, 10 * F.col("n_symbols") > n, 10 * F.col("n_dup_lines") > n,
             (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)]
    return d.withColumn("base_failed", base).withColumn("failures", sum((r.cast("long") for r in rules), F.lit(0).cast("long")))


def hosts(d: DataFrame, host: str, reject_above: float) -> DataFrame:
    """One row per host: documents, failed documents, the shrunk rate and the verdict.

    Moments of the host rates give the prior: mean m, variance v, strength m(1-m)/v - 1 held between 1 and 1000. The
    variance weighs hosts alike; without spread the prior is as strong as it may be.
    """
    per = d.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum((F.col("failures") > 0).cast("long")).alias("n_failed"), F.sum("failures").alias("n_failures"))
    prior = per.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    prior = prior.select("m", strength.alias("strength")).first()
    m, s = (prior["m"] or 0.0), prior["strength"]
    rate = (F.col("n_failed") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s))
    return per.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > reject_above)


def rules(docs: DataFrame, host: str = "source", reject_above: float = 0.6) -> DataFrame:
    """One row per document: the measures, base_failed, failures, its host's rate and verdict, and kept."""
    d = stage(judged(measures(docs, ["doc_id", host])), "quality")
    h = hosts(d, host, reject_above).select(F.col(host).alias("_host"), "rate", "host_rejected")
    return (d.join(h, F.col(host).eqNullSafe(F.col("_host"))).drop("_host")
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")))


SQL = """
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, pos, w[pos:pos + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u) WHERE c > 1),
c AS (SELECT doc_id, sum(least(5, pos - prev)) AS n FROM (SELECT doc_id, pos, lag(pos, 1, -10) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words
          OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS fails FROM m),
h AS (SELECT source, count(*) AS n_docs, count(*) FILTER (fails) AS n_failed FROM b GROUP BY source),
p AS (SELECT sum(n_failed) / sum(n_docs) AS m, var_pop(n_failed / n_docs) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) ELSE 1000 END AS s FROM p),
j AS (SELECT source, (n_failed + m * s) / (n_docs + s) > 0.6 AS host_rejected FROM h, q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source
"""
