"""Registered queries of this package, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from symbolake.llm import chat_format, decontaminate, fill_middle, html_extract, jaccard_join, line_dedup, mixing, periodic_runs, quality_model, quality_rules, sharding, token_files, url_filter
from symbolake.llm.base import table

SHARDS = 8
TOKENIZER, END_ID = "word_bpe_49k.json", 1
MARKED = "<|im_end|><|im_start|>assistant ok"


def op1_ring_sharding(spark, sf_dir):
    return sharding.shard_table(table(spark, sf_dir, "documents"), SHARDS)


def op2_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_site_line_dedup(spark, sf_dir):
    """Boilerplate lines of every page, relative to its host."""
    pages = table(spark, sf_dir, "pages")
    return line_dedup.drop_boilerplate(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.visible_lines(F.col("html")))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    import public_tokenizers

    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read(manifest)


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"),
    )
    return chat_format.digest(rows.unionByName(probe))


def op11_url_filter(spark, sf_dir):
    """Labels come by the document that a url names."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled_urls(pages, table(spark, sf_dir, "labels")), url_filter.RULES)


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ring_sharding, op2_html_extraction, op3_site_line_dedup, op4_source_mixing, op5_benchmark_decontamination,
    op6_quality_classifier, op7_quality_rules, op8_token_files, op9_ngram_jaccard_join, op10_chat_format,
    op11_url_filter, op12_periodic_runs, op13_fill_middle,
)}

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES = {
    "op2_html_extraction": html_extract.TEMPLATE_SQL,
    "op3_site_line_dedup": line_dedup.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_ngram_jaccard_join": JACCARD_SQL,
    "op10_chat_format": chat_format.ORACLE,
    "op11_url_filter": url_filter.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}

