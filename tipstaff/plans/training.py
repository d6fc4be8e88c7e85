"""Queries of the general operators for training data, with their SQL."""

from __future__ import annotations

from ..operators.orphans import orphan_references, orphan_report
from ..runtime import table

_P5 = r"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_ord ORDER BY loaded_at DESC) AS rn FROM edges) WHERE rn = 1),
refs AS (
  SELECT edge_ord, noted_at, regexp_replace(trim(regexp_replace(lower(target_act), '[\s\x{00a0}]+', ' ', 'g')), '^the ', '') AS act_key,
         nullif(trim(regexp_replace(target_section, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')), '') AS section
  FROM latest WHERE target_act IS NOT NULL AND regexp_replace(target_act, '[\s\x{00a0}]+', '', 'g') <> ''),
acts AS (SELECT act_id, entered_at, removed_at, regexp_replace(trim(regexp_replace(lower(title), '[\s\x{00a0}]+', ' ', 'g')), '^the ', '') AS act_key FROM act_register),
sections AS (SELECT DISTINCT act_key, trim(section) AS section, p.entered_at, p.removed_at FROM provision_register p JOIN acts USING (act_id)),
has_act AS (SELECT DISTINCT edge_ord FROM refs r JOIN acts a ON a.act_key = r.act_key AND a.entered_at <= noted_at AND (a.removed_at IS NULL OR noted_at < a.removed_at)),
has_section AS (SELECT DISTINCT edge_ord FROM refs r JOIN sections s ON s.act_key = r.act_key AND s.section = r.section AND s.entered_at <= noted_at AND (s.removed_at IS NULL OR noted_at < s.removed_at)),
found AS (
  SELECT edge_ord, 'act' AS lacks, strftime(noted_at, '%Y-%m') AS period FROM refs WHERE edge_ord NOT IN (SELECT edge_ord FROM has_act)
  UNION ALL
  SELECT edge_ord, 'section', strftime(noted_at, '%Y-%m') FROM refs
  WHERE section IS NOT NULL AND edge_ord IN (SELECT edge_ord FROM has_act) AND edge_ord NOT IN (SELECT edge_ord FROM has_section))
"""


def _p5(make):
    return lambda spark, d: make(table(spark, d, "edges"), table(spark, d, "act_register"), table(spark, d, "provision_register"))


QUERIES = {"p5_found": _p5(orphan_references), "p5_report": _p5(orphan_report)}
SQL = {
    "p5_found": _P5 + "SELECT edge_ord, lacks, period FROM found",
    "p5_report": _P5 + "SELECT CASE lacks WHEN 'act' THEN 'act_register' ELSE 'provision_register' END AS register, period, count(*) AS orphans FROM found GROUP BY 1, 2",
}
