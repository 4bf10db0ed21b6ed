"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clickflow.llm import (decontaminate, html_text, lexical_search, licenses, line_dedup, mixing, near_dedup,
                           personal_data, quality, secrets, token_counts, token_files, vector_codes)
from clickflow.llm.common import table
from clickflow.llm.oracle import ORACLE_SQL  # noqa: F401
from clickflow.session import ensure_checkpoint_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    return token_files.token_blocks_digest(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_dedup(spark, sf_dir):
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed")


def op7_license_scan(spark, sf_dir):
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    f = F.col("found")
    hit = decontaminate.n_hit(f)
    return found.select("doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"),
                        F.size(f["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexical-index-{uuid.uuid4().hex}"
    index = lexical_search.write_index(table(spark, sf_dir, "documents"), path)
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark, sf_dir):
    return personal_data.personal_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_html_text, op3_secret_scan, op4_token_files, op5_near_dedup, op6_line_dedup, op7_license_scan, op8_quality_rules,
              op9_mixing, op10_decontamination, op11_vector_codes, op12_lexical_search, op13_personal_data)
}
