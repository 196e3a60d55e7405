"""Mixing sources to target weights: a low-discrepancy schedule of source slots, joined with shuffled equal-token blocks.

The stream of a source is its documents in the order of a hash, end to end, cut into blocks of ``block_words`` words.
Slot n of the mix takes the golden-ratio point frac(n * 0.618...) (in integers, so that any engine gives the same) and
belongs to the source whose piece of the cumulative targets holds that point. The k-th slot of a source takes block
k modulo its number of blocks. Everything is DataFrame expressions; no source is ever one group: running sums and ranks
are taken inside (source, bucket) and (source, chunk of slots) groups and shifted by the sums of the groups before.

Defined results: null and empty texts and words of any length count by the same expression (size 0 for none); a source
without words has target 0; sources are compared by code point and null is a source, the last. Rows that repeat a doc_id are
documents of their own, told apart by their place in the input. Rows with a null doc_id are documents like others, the last of
their source's stream, in the order of a hash of their place. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import ROW, WORD
from tracewell.session import stage

POINTS = 1 << 31
#: odd, nearest to POINTS / golden ratio: n -> n * STEP mod POINTS visits every point once
STEP = 1327217885
#: greater than any hexadecimal digit
LAST = "~"
CELLS = 1024
CHUNK = 4096


@dataclass(frozen=True)
class Mix:
    """sizes: one row per document; sources: one per source; slices: the mix itself (slot, round through the source, uid, first word, words)."""

    sizes: DataFrame
    sources: DataFrame
    slices: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Words due from each source (one row per source).

    A source gets level * weight, at most ``repeats`` times its size; the level is the one at which all get ``share`` of
    all sizes. Sources by source_size * repeats / weight: those up to some place are full, and the level follows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    per = per.withColumn("sid", F.row_number().over(ordered) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * repeats
    per = per.withColumn("ratio", full / F.col("weight"))
    everything = W.partitionBy()
    per = (per.withColumn("due", F.sum("source_size").over(everything) * F.lit(share))
           .withColumn("full_to_here", F.sum(full).over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("weight_after", F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(1, W.unboundedFollowing)), F.lit(0))))
    is_full = F.col("full_to_here") + F.col("ratio") * F.col("weight_after") <= F.col("due")
    per = per.withColumn("is_full", is_full)
    rest = F.col("due") - F.coalesce(F.sum(F.when(F.col("is_full"), full)).over(everything), F.lit(0))
    level = rest / F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything)
    per = per.withColumn("target", F.when(F.col("is_full"), full.cast("double")).otherwise(level * F.col("weight")))
    ahead = F.coalesce(F.sum("target").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("target").over(everything)
    place = lambda x: F.when(total > 0, F.floor(x / total * POINTS)).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("lo", place(ahead)).withColumn("total", total)
    return per.withColumn("hi", F.lead("lo", 1, POINTS).over(ordered)).select("sid", "source", "source_size", "weight", "target", "lo", "hi", "total")


def slots(sources: DataFrame, count: int) -> DataFrame:
    """(slot, sid, k): slot n belongs to sid and is its k-th, k from 0."""
    spark = sources.sparkSession
    width = POINTS // CELLS
    pieces = sources.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    n = spark.range(count).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("point"))
    own = (n.withColumn("cell", F.expr(f"point div {width}")).join(pieces, "cell").where("point >= lo and point < hi")
           .select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk")))
    shift = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = own.groupBy("sid", "chunk").agg(F.count("*").alias("n")).select("sid", "chunk", F.coalesce(F.sum("n").over(shift), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return own.withColumn("inside", inside).join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("inside") + F.col("before")).alias("k"))


def blocks(sizes: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """(sid, block, uid, first, words): which words of which documents a block of a source's shuffled stream holds."""
    hashed = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    # rows without an id come after all others (as nulls do in the SQL), spread by their place
    d = (sizes.where("size > 0").withColumn("h", F.coalesce(hashed("doc_id"), F.concat(F.lit(LAST), hashed("uid"))))
         .withColumn("bucket", F.expr(f"substring(h, 1, if(startswith(h, '{LAST}'), 4, 3))")))
    d = d.join(sources.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    shift = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(shift), F.lit(0)).alias("before"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "uid").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    d = d.withColumn("inside", inside).join(before, ["sid", "bucket"]).withColumn("at", F.col("inside") + F.col("before"))
    d = d.select("sid", "uid", "at", "size", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))).alias("block"))
    first = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))
    return d.select("sid", "block", "uid", first.alias("first"), (last - first).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, block_words: int = 64) -> Mix:
    """Mix ``docs`` (doc_id, text, source, and ROW if its rows are numbered): ``share`` times all words, no document more than
    ``repeats`` times.

    The last block of a source is shorter than the rest, and the schedule gives a source its target to within a few blocks;
    slots past ``repeats`` rounds through a source stay empty.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    uid = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    sizes = stage(docs.select("doc_id", "source", size.alias("size"), uid.alias("uid")), "mix-sizes")
    sources = stage(targets(sizes, weights, share, repeats), "mix-sources")
    total = sources.agg(F.max("total")).first()[0] or 0.0
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    due = slots(sources, -int(-total // block_words)).join(sources.select("sid", n_blocks.alias("n_blocks")), "sid").where(F.col("k") < repeats * F.col("n_blocks"))
    due = due.select("slot", "sid", F.expr("k div n_blocks").alias("round"), (F.col("k") % F.col("n_blocks")).alias("block"))
    slices = due.join(blocks(sizes, sources, block_words), ["sid", "block"]).select("slot", "sid", "round", "uid", "first", "words")
    return Mix(sizes, sources, slices)


def taken(m: Mix) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    per = m.slices.groupBy("uid").agg(F.sum("words").alias("taken"))
    by_source = m.sources.select(F.col("source").alias("s"), "source_size", "target")
    return (m.sizes.join(per, "uid", "left").join(by_source, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source", "uid"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: ``docs`` (with ROW) once for every round in which words of it are taken, the text cut to those words
    where a round ends inside it (then with single blanks between them). n_chars, if there is one, follows the text."""
    part = mix(docs, **how).slices.groupBy("uid", "round").agg(F.min("first").alias("_first"), F.sum("words").alias("_words"))
    rows = docs.join(part.withColumnRenamed("uid", ROW), ROW)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    whole = (F.col("_first") == 0) & (F.col("_words") == F.regexp_count("text", F.lit(WORD)))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, (F.col("_first") + 1).cast("int"), F.col("_words").cast("int")), " "))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.select(*[c for c in docs.columns if c != ROW])


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, source_size * 2 / weight AS ratio, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS due FROM s1),
s3 AS (SELECT *, sum(source_size * 2) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)
         + ratio * coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= due AS is_full FROM s2),
s4 AS (SELECT *, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
         ELSE (due - coalesce(sum(CASE WHEN is_full THEN source_size * 2 END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER () AS total, CAST(floor(coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         / sum(target) OVER () * {POINTS}) AS BIGINT) AS lo FROM s4),
s6 AS (SELECT *, lead(lo, 1, {POINTS}) OVER (ORDER BY sid) AS hi, CAST(ceil(source_size / 64) AS BIGINT) AS n_blocks FROM s5),
n AS (SELECT slot, slot % {POINTS} * {STEP} % {POINTS} AS point FROM (SELECT unnest(range(CAST((SELECT ceil(max(total) / 64) FROM s6) AS BIGINT))) AS slot)),
k AS (SELECT sid, n_blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM n JOIN s6 ON point >= lo AND point < hi),
due AS (SELECT sid, k % n_blocks AS block FROM k WHERE k < 2 * n_blocks),
p AS (SELECT doc_id, size, source_size, target, sid,
        CAST(sum(size) OVER (PARTITION BY sid ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
b AS (SELECT doc_id, sid, block, least((block + 1) * 64 - pos, size) - greatest(block * 64 - pos, 0) AS words
      FROM (SELECT *, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) AS block FROM p WHERE size > 0)),
t AS (SELECT doc_id, sum(words) AS taken FROM due JOIN b USING (sid, block) GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN t ON p.doc_id = t.doc_id
"""
