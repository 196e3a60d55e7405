"""The registered queries of the subpackage and the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, language, mixing, ngram_lm, packing, phrases, pieces, pii, quality, set_join, spelling, token_files, top_k, toxicity
from tracewell.llm.common import numbered, table
from tracewell.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_language_model")
def op1(spark, folder):
    return ngram_lm.language_model(table(spark, folder, "documents"))


@query("op2_toxicity")
def op2(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_personal_data")
def op3(spark, folder):
    return pii.personal_data(table(spark, folder, "documents"))


@query("op4_language")
def op4(spark, folder):
    return language.language(table(spark, folder, "documents"))


@query("op5_set_join")
def op5(spark, folder):
    return set_join.join(numbered(table(spark, folder, "documents").select("doc_id", "text"))).select("doc_id", "class_id", "n_links")


@query("op6_top_k", top_k.SQL)
def op6(spark, folder):
    return top_k.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_token_files")
def op7(spark, folder):
    return token_files.read(token_files.write(table(spark, folder, "documents"), bpe.default_path(), end_id=2))


@query("op8_mix_sources", mixing.SQL)
def op8(spark, folder):
    return mixing.taken(mixing.mix(table(spark, folder, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_pack_sequences")
def op9(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op10_quality_rules", quality.SQL)
def op10(spark, folder):
    return quality.rules(table(spark, folder, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_sentence_pieces")
def op11(spark, folder):
    return pieces.digests(table(spark, folder, "documents"))


@query("op12_spelling_variants")
def op12(spark, folder):
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents")))


@query("op13_collocations")
def op13(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))
