"""SQL of the diagnosis tables: events, component sums, drill-downs, checks, evidence and text.

Each step is a named block that ``oracle.sql`` puts in front of a query; each is computed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from bizdiag import definitions as defs


def _values(rows: Sequence[tuple], columns: str) -> str:
    """A small fixed table."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    listed = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {listed}) AS t({columns})"


def _amount(c: str) -> str:
    return f"CASE WHEN format = 'integer' THEN CAST(CAST({c} AS DECIMAL(22,0)) AS VARCHAR) ELSE CAST(CAST({c} AS DECIMAL(24,2)) AS VARCHAR) END"


def blocks(
    p: str, scan: str, sentence: str, rules: Sequence[Mapping], filters: Mapping[str, Sequence[str]]
) -> dict[str, str]:
    """Name -> SQL; names begin with ``p``. Every rule's metric has a recipe of two components,
    which are also its contribution metrics, against the same day of the week before.
    """
    recipe = {r["id"]: defs.RECIPES[r["metric_id"]] for r in rules}
    open_dims = {
        r["id"]: [d for d in recipe[r["id"]]["candidate_dimensions"] if d != r["dimension"] and d not in filters]
        for r in rules
    }
    listed = {d: ", ".join(f"'{v}'" for v in values) for d, values in filters.items()}
    conflict = "".join(
        f" WHEN rule_id = '{r['id']}' AND dimension_value NOT IN ({listed[r['dimension']]}) THEN '{r['dimension']}'"
        for r in rules if r["dimension"] in filters
    )
    conflict = f"CASE WHEN FALSE THEN ''{conflict} END"
    kept = "".join(f" AND f.{d} IN ({values})" for d, values in listed.items())
    metric = "CASE rule_id " + " ".join(f"WHEN '{r['id']}' THEN '{r['metric_id']}'" for r in rules) + " END"
    dims = sorted({d for ds in open_dims.values() for d in ds})
    out = {}
    out["ev"] = f"""SELECT *, CASE WHEN m IS NULL OR conflict IS NOT NULL THEN 'insufficient_data' END AS blocked,
  CASE WHEN m IS NULL THEN 'NULL anomaly dimension cannot be represented by the current filter API'
    WHEN conflict IS NOT NULL THEN 'Anomaly scope conflicts with filter ' || conflict END AS blocked_reason
FROM (SELECT rule_id || '|' || CAST(date AS VARCHAR) || '|' || COALESCE(dimension_value, '<NULL>') AS event_id, rule_id, date, dimension_value AS m,
  {metric} AS metric_id, {sentence} AS evidence, {conflict} AS conflict FROM ({scan}) AS s WHERE severity IS NOT NULL) AS e"""
    out["days"] = f"""SELECT event_id, rule_id, m, date AS day, TRUE AS cur FROM {p}ev WHERE blocked IS NULL
UNION ALL SELECT event_id, rule_id, m, CAST(date - INTERVAL 7 DAY AS DATE) AS day, FALSE AS cur FROM {p}ev WHERE blocked IS NULL"""
    out["lines"] = " UNION ALL ".join(
        f"""SELECT e.event_id, e.cur, {', '.join('f.' + d for d in dims)},
  CAST(f.{recipe[r['id']]['components'][0]} AS DECIMAL(24,2)) AS x1, CAST(f.{recipe[r['id']]['components'][1]} AS DECIMAL(24,2)) AS x2
FROM {p}days AS e JOIN f_daily AS f ON f.{r['dimension']} = e.m AND f.date = e.day WHERE e.rule_id = '{r['id']}'{kept}"""
        for r in rules
    )
    out["parts"] = _values(
        [
            (rule, i, m, defs.metric(m)["name"], defs.metric(m)["format"])
            for rule, rec in recipe.items() for i, m in enumerate(rec["components"], 1)
        ],
        "rule_id, part, metric_id, metric_name, format",
    )
    out["sums"] = f"""SELECT event_id, COUNT(x1) FILTER (WHERE cur) AS c1n, COUNT(x1) FILTER (WHERE NOT cur) AS b1n, COUNT(x2) FILTER (WHERE cur) AS c2n, COUNT(x2) FILTER (WHERE NOT cur) AS b2n,
  SUM(x1) FILTER (WHERE cur) AS c1, SUM(x1) FILTER (WHERE NOT cur) AS b1, SUM(x2) FILTER (WHERE cur) AS c2, SUM(x2) FILTER (WHERE NOT cur) AS b2 FROM {p}lines GROUP BY 1"""
    known = lambda c: f"CASE WHEN {c} > 0 THEN 'available' ELSE 'unavailable_no_data' END"
    out["obs"] = f"""SELECT *, {known('cn')} AS current_status, {known('bn')} AS baseline_status, COALESCE(cn > 0 AND bn > 0, FALSE) AS ok
FROM (SELECT e.event_id, e.rule_id, q.part, q.metric_id, q.metric_name, q.format, CASE q.part WHEN 1 THEN c1n ELSE c2n END AS cn, CASE q.part WHEN 1 THEN b1n ELSE b2n END AS bn,
  CASE q.part WHEN 1 THEN c1 ELSE c2 END AS c, CASE q.part WHEN 1 THEN b1 ELSE b2 END AS b
  FROM {p}ev AS e JOIN {p}parts AS q ON q.rule_id = e.rule_id LEFT JOIN {p}sums AS s ON s.event_id = e.event_id WHERE e.blocked IS NULL) AS o"""
    out["dims"] = _values(
        [(rule, d, j) for rule, ds in open_dims.items() for j, d in enumerate(ds, 1)], "rule_id, dimension, nth"
    )
    value = " ".join(f"WHEN '{d}' THEN l.{d}" for d in dims)
    out["cut"] = f"""SELECT e.event_id, d.dimension, CASE d.dimension {value} END AS v,
  COUNT(*) FILTER (WHERE cur) AS cr, COUNT(*) FILTER (WHERE NOT cur) AS br,
  COUNT(x1) FILTER (WHERE cur) AS c1n, COUNT(x1) FILTER (WHERE NOT cur) AS b1n, COUNT(x2) FILTER (WHERE cur) AS c2n, COUNT(x2) FILTER (WHERE NOT cur) AS b2n,
  COALESCE(SUM(x1) FILTER (WHERE cur), 0) - COALESCE(SUM(x1) FILTER (WHERE NOT cur), 0) AS d1, COALESCE(SUM(x2) FILTER (WHERE cur), 0) - COALESCE(SUM(x2) FILTER (WHERE NOT cur), 0) AS d2
FROM {p}lines AS l JOIN {p}ev AS e ON e.event_id = l.event_id JOIN {p}dims AS d ON d.rule_id = e.rule_id GROUP BY 1, 2, 3"""
    out["segments"] = " UNION ALL ".join(
        f"SELECT event_id, {i} AS part, dimension, v, (cr > 0 AND c{i}n = 0) OR (br > 0 AND b{i}n = 0) AS gap, d{i} AS delta FROM {p}cut"
        for i in (1, 2)
    )
    out["states"] = f"""SELECT o.event_id, o.metric_id, o.part, d.dimension, o.part * 100 + d.nth AS finding_no,
  CASE WHEN NOT o.ok THEN 'component current or baseline is unavailable' WHEN s.gap THEN 'a segment is unavailable'
    WHEN s.unnamed THEN 'candidate dimension has no classified values' END AS reason
FROM {p}obs AS o JOIN {p}dims AS d ON d.rule_id = o.rule_id
LEFT JOIN (SELECT event_id, part, dimension, BOOL_OR(gap) AS gap, BOOL_AND(v IS NULL) AS unnamed FROM {p}segments GROUP BY 1, 2, 3) AS s
  ON s.event_id = o.event_id AND s.part = o.part AND s.dimension = d.dimension"""
    top_n = {rec["top_n"] for rec in recipe.values()}
    out["top"] = f"""SELECT * FROM (SELECT t.event_id, t.metric_id, t.dimension, t.finding_no, COALESCE(s.v, 'None') AS shown,
  ROW_NUMBER() OVER (PARTITION BY t.event_id, t.finding_no ORDER BY ABS(s.delta) DESC, s.v ASC NULLS LAST) AS position
  FROM {p}states AS t JOIN {p}segments AS s ON s.event_id = t.event_id AND s.part = t.part AND s.dimension = t.dimension WHERE t.reason IS NULL) AS r WHERE position <= {max(top_n)}"""
    closed = [
        (r["id"], d, "trigger dimension excluded" if d == r["dimension"] else "dimension fixed by scope filter")
        for r in rules for d in recipe[r["id"]]["candidate_dimensions"] if d not in open_dims[r["id"]]
    ]
    shut = _values(closed or [("", "", "")], "rule_id, dimension, reason")
    out["skipped"] = f"""SELECT event_id, metric_id, dimension, reason, TRUE AS failed FROM {p}states WHERE reason IS NOT NULL
UNION ALL SELECT e.event_id, e.metric_id, c.dimension, c.reason, FALSE AS failed FROM {p}ev AS e JOIN ({shut}) AS c ON c.rule_id = e.rule_id WHERE e.blocked IS NULL"""
    out["results"] = f"""SELECT event_id, status, available_observations, finding_count, skipped_count,
  CASE WHEN blocked IS NOT NULL THEN blocked_reason WHEN status = 'partial' THEN 'Some configured observations or drilldowns were unavailable'
    WHEN status = 'insufficient_data' THEN 'No component observation or drilldown had sufficient data' END AS reason
FROM (SELECT e.event_id, e.blocked, e.blocked_reason, COALESCE(n_ok, 0) AS available_observations, COALESCE(n_found, 0) AS finding_count, COALESCE(n_skipped, 0) AS skipped_count,
  CASE WHEN e.blocked IS NOT NULL THEN e.blocked WHEN COALESCE(n_ok, 0) = 0 AND COALESCE(n_found, 0) = 0 THEN 'insufficient_data'
    WHEN n_ok <> n_obs OR COALESCE(failed, FALSE) OR COALESCE(n_found, 0) = 0 THEN 'partial' ELSE 'complete' END AS status
  FROM {p}ev AS e LEFT JOIN (SELECT event_id, COUNT(*) AS n_obs, COUNT(*) FILTER (WHERE ok) AS n_ok FROM {p}obs GROUP BY 1) AS o ON o.event_id = e.event_id
  LEFT JOIN (SELECT event_id, COUNT(*) AS n_found FROM {p}states WHERE reason IS NULL GROUP BY 1) AS f ON f.event_id = e.event_id
  LEFT JOIN (SELECT event_id, COUNT(*) AS n_skipped, BOOL_OR(failed) AS failed FROM {p}skipped GROUP BY 1) AS k ON k.event_id = e.event_id) AS r"""
    advice = _values(
        [(rule, i, t) for rule, rec in recipe.items() for i, t in enumerate(rec["suggested_checks"])],
        "rule_id, position, message",
    )
    out["checks"] = f"""SELECT e.event_id, a.position, a.message AS text FROM {p}ev AS e JOIN ({advice}) AS a ON a.rule_id = e.rule_id WHERE e.blocked IS NULL
UNION ALL SELECT event_id, nth + 1000 AS position, '优先核对 ' || dimension || '=' || shown || ' 的 ' || metric_id || ' 数据记录与口径变化' AS text
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY finding_no) AS nth FROM {p}top WHERE position = 1) AS t WHERE nth <= 3"""
    out["movers"] = f"SELECT event_id, metric_id, dimension, finding_no, STRING_AGG(shown, '、' ORDER BY position) AS movers FROM {p}top GROUP BY 1, 2, 3, 4"
    out["evidence"] = f"""SELECT event_id, 0 AS position, 'FACT' AS kind, '异常事件记录：' || evidence AS message FROM {p}ev
UNION ALL SELECT event_id, part, 'FACT', CASE WHEN NOT ok THEN metric_name || '在诊断基准previous_week下不可用。'
  ELSE '诊断基准previous_week下，' || metric_name || '当前值为' || {_amount('c')} || '，基线值为' || {_amount('b')} || '，变化量为' || {_amount('c - b')} || '。' END FROM {p}obs
UNION ALL SELECT event_id, finding_no + 10000, 'DIAGNOSTIC', '按' || dimension || '观察' || metric_id || '，变化幅度较大的分组包括' || movers || '。' FROM {p}movers
UNION ALL SELECT event_id, position + 100000, 'RECOMMENDATION', text FROM {p}checks"""
    out["text"] = f"""SELECT event_id, STRING_AGG(line, CHR(10) ORDER BY ord, line) AS summary FROM (
SELECT r.event_id, h.ord, h.line || CASE WHEN h.ord = 0 THEN r.status ELSE '' END AS line FROM {p}results AS r CROSS JOIN ({_values([
        (0, '诊断状态：'), (1, '异常基准：rolling_7d_average'), (2, '诊断基准：previous_week'), (3, '组成观察：'),
        (20000, '单层观察：'), (40000, '建议检查：'), (900000, '限制：' + defs.DIAGNOSIS_LIMITATION)], 'ord, line')}) AS h
UNION ALL SELECT event_id, part + 10000, '- ' || metric_name || CASE WHEN NOT ok THEN '：不可用（current=' || current_status || ', baseline=' || baseline_status || '）'
  ELSE '：current=' || {_amount('c')} || '，baseline=' || {_amount('b')} || '，delta=' || {_amount('c - b')} END FROM {p}obs
UNION ALL SELECT event_id, finding_no + 21000, '- ' || metric_id || ' 按 ' || dimension || '：变化幅度较大的分组为 ' || movers FROM {p}movers
UNION ALL SELECT event_id, position + 40001, '- ' || text FROM {p}checks) AS q GROUP BY 1"""
    return {p + name: text for name, text in out.items()}
