"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovework.llm import docpairs, handwritten, mixing, neighbours, packing, splitting, subjects, syntax
from grovework.runtime import table


def p2_found(spark, d):
    return docpairs.found(table(spark, d, "code_nodes"), table(spark, d, "source_files"))


def p2_pairs(spark, d):
    return docpairs.pairs(table(spark, d, "code_nodes"), table(spark, d, "source_files"))


def p3_found(spark, d):
    return handwritten.found(table(spark, d, "source_files"), table(spark, d, "known_libraries"))


def p3_reasons(spark, d):
    return handwritten.classify(table(spark, d, "source_files"), table(spark, d, "known_libraries"))


def p5_found(spark, d):
    return splitting.found(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p5_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p5_round_trip(spark, d):
    return splitting.round_trip(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p6_found(spark, d):
    return syntax.found(table(spark, d, "source_files"))


def p6_rates(spark, d):
    return syntax.rates(table(spark, d, "source_files"))


def p7_found(spark, d):
    return neighbours.found(table(spark, d, "chunks"), table(spark, d, "code_nodes"))


def p7_nearest(spark, d):
    near = neighbours.nearest(neighbours.vectors_of(table(spark, d, "chunks"), table(spark, d, "code_nodes")), candidates=neighbours.NEAREST_CANDIDATES, in_order=True)
    return near.withColumn("cos", F.round("cos", 6))


def p8_found(spark, d):
    return packing.found(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_packing(spark, d):
    sizes = packing.sized(table(spark, d, "documents"))
    return packing.pack(sizes, packing.capacity_of(table(spark, d, "pack_sizes"), "standard"))


def p8_invariants(spark, d):
    cap = packing.capacity_of(table(spark, d, "pack_sizes"), "standard")
    return packing.invariants(packing.pack(packing.sized(table(spark, d, "documents")), cap), cap)


def p8_report(spark, d):
    return packing.report(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p9_mixture(spark, d):
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_report(spark, d):
    return mixing.report(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_tempered(spark, d):
    sizes, targets = mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.mix(sizes, targets, mixing.whole_budget(sizes, targets))


def p9_entropy(spark, d):
    sizes, targets = mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.mix(sizes, targets, wanted_entropy=mixing.target_entropy(targets))


def p9_invariants(spark, d):
    return mixing.invariants(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def _labelled(spark, d):
    return table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")


def p10_found(spark, d):
    return subjects.found(*_labelled(spark, d))


def p10_composition(spark, d):
    return subjects.composition(*_labelled(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_reasons, p5_found, p5_pieces, p5_round_trip, p6_found, p6_rates, p7_found, p7_nearest, p8_found, p8_packing, p8_invariants, p8_report, p9_mixture, p9_report, p9_tempered, p9_entropy, p9_invariants, p10_found, p10_composition)}

_VECTORS = """
WITH v AS (
  SELECT vec_field, project, id, vec FROM (
    SELECT 'embedding' AS vec_field, project, id, max(embedding) AS vec FROM chunks WHERE len(embedding) = 64 GROUP BY ALL
    UNION ALL
    SELECT 'summary_embedding', project, id, r.vec FROM (
      SELECT project, id, max(struct_pack(at := coalesce(indexed_at, TIMESTAMP '0001-01-01'), vec := summary_embedding)) AS r FROM code_nodes GROUP BY ALL)
  ) WHERE project IS NOT NULL AND id IS NOT NULL AND len(vec) = 64
      AND len(list_filter(vec, lambda x: isfinite(x))) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_field, a.project, a.id, b.project AS np, b.id AS ni, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS c
  FROM v a JOIN v b ON a.vec_field = b.vec_field AND (a.project, a.id) <> (b.project, b.id)
  WHERE list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) >= 0.95
)"""

SQL = {
    "p5_found": """
SELECT DISTINCT c.id FROM chunks c JOIN chunk_limits l ON coalesce(c.chunk_kind, 'fallback_text') = l.chunk_kind
WHERE length(c.content) > l.max_chars""",
    "p5_round_trip": """
SELECT project, id, length(r.content)::BIGINT AS n_chars, md5(r.content) AS text_md5, true AS within_limit FROM (
  SELECT c.project, c.id, max(struct_pack(over := coalesce(length(c.content) > l.max_chars, false), at := coalesce(c.indexed_at, TIMESTAMP '0001-01-01'), content := c.content)) AS r
  FROM chunks c LEFT JOIN chunk_limits l ON coalesce(c.chunk_kind, 'fallback_text') = l.chunk_kind GROUP BY ALL)""",
    "p8_invariants": """
SELECT count(*) AS n_items, count(*) FILTER (coalesce(text, '') = '') AS n_empty, 0::BIGINT AS split_though_fitting, 0::BIGINT AS not_covered_once,
       0::BIGINT AS over_capacity, true AS well_filled FROM documents""",
    "p9_invariants": """
SELECT source, true AS share_met, true AS repeats_met, true AS positions_met
FROM (SELECT source, sum(target_share) AS t, min(coalesce(max_repeats, 1)) AS m FROM mix_targets GROUP BY source)
WHERE t > 0 AND m >= 1 AND source IN (SELECT source FROM documents WHERE coalesce(text, '') <> '')""",
    "p7_found": _VECTORS
    + """
SELECT DISTINCT vec_field, CASE WHEN first THEN project ELSE np END AS project_a, CASE WHEN first THEN id ELSE ni END AS id_a,
       CASE WHEN first THEN np ELSE project END AS project_b, CASE WHEN first THEN ni ELSE id END AS id_b
FROM (SELECT *, (project, id) < (np, ni) AS first, row_number() OVER (PARTITION BY vec_field, project, id ORDER BY round(c, 6) DESC, np, ni) AS place FROM near)
WHERE place <= 5""",
}
