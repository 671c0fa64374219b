"""SQL for the queries of the general problems: the same results, found in another way."""

from __future__ import annotations

from ..schema import JOBS

BLOBS = ["v5_processed_job_data_json", "enriched_company_data_json", "job_information_json"]

# --- problem 1: JSON walked step by step ---
#: What stands for a trailing comma, which DuckDB's reader takes and JSON does not, outside of texts.
_STRICT = r"""json_valid({t}) AND NOT regexp_matches(regexp_replace({t}, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}}]|NaN|Infinity')"""
_MARK = "chr(30)"


def _unwrapped(j: str) -> str:
    inner = f"json_extract_string({j}, '$')"
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND regexp_matches({inner}, '^[ \\t\\r\\n]*[\\[{{]') AND {_STRICT.format(t=inner)} THEN CAST({inner} AS JSON) ELSE {j} END"


_NODES = f"""
WITH RECURSIVE b AS ({' UNION ALL '.join(f"SELECT row_id, '{c}' AS blob, {c} AS t FROM jobs" for c in BLOBS)}),
n AS (
    SELECT row_id, blob, '' AS path, '' AS chain, []::VARCHAR[] AS marks, '' AS row_path, [NULL]::VARCHAR[] AS up, {_unwrapped('CAST(t AS JSON)')} AS j, false AS element, true AS is_row FROM (SELECT * FROM b WHERE t IS NOT NULL AND {_STRICT.format(t='t')})
    UNION ALL
    SELECT row_id, blob, path || CASE WHEN lone THEN {_MARK} ELSE '' END, chain, CASE WHEN lone THEN list_append(marks, chain) ELSE marks END, CASE WHEN element OR lone THEN path || CASE WHEN lone THEN {_MARK} ELSE '' END ELSE row_path END, [row_path], j, element, element OR lone FROM (
        SELECT n.row_id, n.blob, json_type(n.j) = 'ARRAY' AS element,
            CASE WHEN json_type(n.j) = 'ARRAY' THEN n.path || '[' || e.key || ']' WHEN n.path = '' THEN e.key ELSE n.path || '.' || e.key END AS path,
            CASE WHEN json_type(n.j) = 'ARRAY' THEN n.chain ELSE n.chain || chr(31) || e.key END AS chain,
            n.marks, n.row_path, {_unwrapped('e.value')} AS j, json_type(n.j) = 'OBJECT' AND json_type({_unwrapped('e.value')}) = 'OBJECT' AS lone
        FROM n, json_each(n.j) e WHERE json_type(n.j) IN ('ARRAY', 'OBJECT')
    )
),
r AS (SELECT blob, list(DISTINCT chain) AS repeated FROM n WHERE element AND json_type(j) = 'OBJECT' GROUP BY blob)
"""
_SETTLED = lambda bits: f"array_to_string(list_transform(range(1, len({bits}) + 1), lambda i: {bits}[i] || CASE WHEN i <= len(marks) AND i < len({bits}) AND list_contains(repeated, marks[i]) THEN '[0]' ELSE '' END), '')"
P1_FOUND = f"""{_NODES}
SELECT row_id, blob, {_SETTLED('bits')} AS path
FROM (SELECT n.row_id, n.blob, string_split(path, {_MARK}) AS bits, marks, element, coalesce(repeated, []) AS repeated, chain FROM n LEFT JOIN r USING (blob) WHERE json_type(j) = 'OBJECT')
WHERE element OR (len(marks) > 0 AND marks[-1] = chain AND list_contains(repeated, chain))"""
P1_LINKS = f"""{_NODES}
SELECT row_id, blob, regexp_replace({_SETTLED('bits')}, '\\[\\d+\\]', '[]', 'g') AS level, {_SETTLED('bits')} AS path, CASE WHEN ups IS NOT NULL THEN {_SETTLED('ups')} END AS parent_path
FROM (SELECT n.row_id, n.blob, string_split(path, {_MARK}) AS bits, string_split(up[1], {_MARK}) AS ups, marks, coalesce(repeated, []) AS repeated FROM n LEFT JOIN r USING (blob) WHERE is_row)"""

# --- problem 4 ---


def _kind(v: str, prefix: str = "") -> str:
    kinds = {"VARCHAR": "string", "BIGINT": "integer", "UBIGINT": "integer", "HUGEINT": "integer", "DOUBLE": "float", "BOOLEAN": "boolean", "OBJECT": "object"}
    return f"CASE json_type({v}) " + " ".join(f"WHEN '{k}' THEN '{prefix}{t}'" for k, t in kinds.items()) + " END"


P4_FOUND = f"""
WITH rec AS (SELECT record_id, feed_id, drop_no, record_json::JSON AS j FROM feed_records WHERE json_valid(record_json) AND json_type(record_json::JSON) = 'OBJECT'),
f AS (
    SELECT record_id, feed_id, drop_no, '' AS lvl, e.key AS path, e.value AS v FROM rec, json_each(j) e
    {' '.join(f"UNION ALL SELECT r.record_id, r.feed_id, r.drop_no, '{p}', '{p}.' || e.key, e.value FROM (SELECT * FROM rec WHERE json_type(j, '$.{p}') = 'OBJECT') r, json_each(json_extract(r.j, '$.{p}')) e" for p in ('job_information', 'v5_processed_job_data'))}
),
kinds AS (
    SELECT record_id, feed_id, drop_no, path, {_kind('v')} AS t FROM f
    UNION ALL SELECT a.record_id, a.feed_id, a.drop_no, a.path, {_kind('e.value', 'array of ')} FROM (SELECT * FROM f WHERE json_type(v) = 'ARRAY') a, json_each(a.v) e
    UNION ALL SELECT a.record_id, a.feed_id, a.drop_no, a.path, {_kind('e.value', 'array of array of ')} FROM (SELECT f.*, e.value AS w FROM (SELECT * FROM f WHERE json_type(v) = 'ARRAY') f, json_each(f.v) e WHERE json_type(e.value) = 'ARRAY') a, json_each(a.w) e
),
s AS (SELECT feed_id, drop_no, path, any_value(lvl) AS lvl FROM f GROUP BY ALL),
k AS (SELECT feed_id, drop_no, path, list_sort(list(DISTINCT t)) AS ts FROM kinds WHERE t IS NOT NULL GROUP BY ALL),
steps AS (SELECT feed_id, drop_no, lag(drop_no) OVER (PARTITION BY feed_id ORDER BY drop_no) AS before FROM (SELECT DISTINCT feed_id, drop_no FROM feed_records) QUALIFY before IS NOT NULL),
gone AS (SELECT t.feed_id, t.drop_no, t.before, s.path, s.lvl FROM steps t JOIN s ON s.feed_id = t.feed_id AND s.drop_no = t.before WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.feed_id = t.feed_id AND x.drop_no = t.drop_no AND x.path = s.path)),
new AS (SELECT t.feed_id, t.drop_no, t.before, s.path, s.lvl FROM steps t JOIN s ON s.feed_id = t.feed_id AND s.drop_no = t.drop_no WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.feed_id = t.feed_id AND x.drop_no = t.before AND x.path = s.path)),
ids AS (SELECT feed_id, drop_no, record_id, json_extract(j, '$.id')::VARCHAR AS id FROM rec WHERE json_extract(j, '$.id') IS NOT NULL AND json_type(j, '$.id') <> 'NULL'),
vals AS (SELECT i.feed_id, i.drop_no, i.id, f.path, json_normalize(f.v)::VARCHAR AS v FROM ids i JOIN f USING (record_id) WHERE json_type(f.v) <> 'NULL'),
common AS (SELECT DISTINCT t.feed_id, t.drop_no, t.before, a.id FROM steps t JOIN ids a ON a.feed_id = t.feed_id AND a.drop_no = t.drop_no JOIN ids b ON b.feed_id = t.feed_id AND b.drop_no = t.before AND b.id = a.id),
old_all AS (SELECT g.feed_id, g.drop_no, g.lvl, g.path, list_sort(list(DISTINCT v.id || chr(30) || v.v)) AS held FROM gone g JOIN common c USING (feed_id, drop_no, before) JOIN vals v ON v.feed_id = g.feed_id AND v.drop_no = g.before AND v.id = c.id AND v.path = g.path GROUP BY ALL),
new_all AS (SELECT g.feed_id, g.drop_no, g.lvl, g.path, list_sort(list(DISTINCT v.id || chr(30) || v.v)) AS held FROM new g JOIN common c USING (feed_id, drop_no, before) JOIN vals v ON v.feed_id = g.feed_id AND v.drop_no = g.drop_no AND v.id = c.id AND v.path = g.path GROUP BY ALL),
ren AS (SELECT o.feed_id, o.drop_no, o.path AS a, n.path AS b FROM old_all o JOIN new_all n ON n.feed_id = o.feed_id AND n.drop_no = o.drop_no AND n.lvl = o.lvl AND n.held = o.held)
SELECT feed_id, drop_no, 'renamed' AS change, a AS field_path, b AS new_path FROM ren
UNION ALL SELECT feed_id, drop_no, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.drop_no = g.drop_no AND r.a = g.path)
UNION ALL SELECT feed_id, drop_no, 'added', path, '' FROM new g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed_id = g.feed_id AND r.drop_no = g.drop_no AND r.b = g.path)
UNION ALL SELECT t.feed_id, t.drop_no, 'type_changed', x.path, '' FROM steps t JOIN s x ON x.feed_id = t.feed_id AND x.drop_no = t.drop_no JOIN s y ON y.feed_id = t.feed_id AND y.drop_no = t.before AND y.path = x.path
    LEFT JOIN k kx ON kx.feed_id = t.feed_id AND kx.drop_no = t.drop_no AND kx.path = x.path LEFT JOIN k ky ON ky.feed_id = t.feed_id AND ky.drop_no = t.before AND ky.path = x.path
    WHERE coalesce(kx.ts, []) <> coalesce(ky.ts, [])"""

# --- problem 6 ---
_KINDS = {"row_id": "bigint", "loaded_at": "timestamp"} | {f.name: f.dataType.simpleString() for f in JOBS}
_NUMERIC = [c for c, k in _KINDS.items() if k in ("bigint", "double")]
_LONG = 128
_COUNTED = lambda t: f"CASE WHEN length({t}) > {_LONG} THEN '#' || length({t}) || ':' || sha256({t}) ELSE {t} END"
_ODD = r"(t = '' OR regexp_matches(t, '^\s|\s$|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFD}]'))"
_NUMBER = lambda c: f"CASE WHEN NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END" if c in _NUMERIC else "NULL::DOUBLE"
_CELLS = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS t, {_NUMBER(c)} AS x FROM jobs" for c in _KINDS)
_NAMES = ", ".join(f"'{c}'" for c in _NUMERIC)
P6_PROFILE = f"""
WITH c AS MATERIALIZED ({_CELLS}),
v AS (SELECT load_id, column_name, {_COUNTED('t')} AS value, count(*) AS n FROM c GROUP BY ALL),
top AS (SELECT load_id, column_name, value AS top_value, n AS top_count FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY load_id, column_name ORDER BY n DESC, value) = 1),
a AS (SELECT load_id, column_name, count(*) AS rows, count(*) - count(t) AS nulls, count(DISTINCT {_COUNTED('t')}) AS distincts, min(t) FILTER (column_name NOT IN ({_NAMES})) AS min_value, max(t) FILTER (column_name NOT IN ({_NAMES})) AS max_value, min(x) AS min_number, max(x) AS max_number,
      count(*) FILTER (column_name NOT IN ({_NAMES}) AND coalesce({_ODD}, false)) AS violations, (count(*) - count(t)) / count(*)::DOUBLE AS null_rate FROM c GROUP BY ALL)
SELECT a.*, top_value, top_count FROM a LEFT JOIN top USING (load_id, column_name)"""
_PAIRS = "SELECT load_id, lag(load_id) OVER (PARTITION BY root_dir ORDER BY load_id) AS previous FROM (SELECT DISTINCT root_dir, load_id FROM ingest_runs) QUALIFY previous IS NOT NULL"
_EDGES = ", ".join(f"min(x) FILTER (upto * 10 >= al * {i})" for i in range(1, 10))
P6_SHIFTS = f"""
WITH c AS MATERIALIZED ({_CELLS}), pairs AS ({_PAIRS}),
nums AS (SELECT load_id, column_name, x, count(*) AS n FROM c WHERE x IS NOT NULL GROUP BY ALL),
cum AS (SELECT load_id, column_name, x, sum(n) OVER (PARTITION BY load_id, column_name ORDER BY x) AS upto, sum(n) OVER (PARTITION BY load_id, column_name) AS al FROM nums),
edges AS (SELECT load_id AS previous, column_name, list_distinct([{_EDGES}]) AS edges FROM cum GROUP BY load_id, column_name),
cells AS (SELECT load_id, column_name, x, coalesce({_COUNTED('t')}, chr(0) || 'null') AS value, count(*) AS n FROM c GROUP BY ALL),
sides AS (
    SELECT p.load_id, p.previous, column_name, x, value, n AS n1, 0::BIGINT AS n0 FROM pairs p JOIN cells USING (load_id)
    UNION ALL SELECT p.load_id, p.previous, column_name, x, value, 0, n FROM pairs p JOIN cells ON cells.load_id = p.previous
),
each AS (
    SELECT s.load_id, s.previous, s.column_name, CASE WHEN x IS NULL THEN value ELSE 'bin ' || len(list_filter(coalesce(edges, []), lambda e: e < x)) END AS bin, sum(n1)::DOUBLE AS n1, sum(n0)::DOUBLE AS n0
    FROM sides s LEFT JOIN edges USING (previous, column_name) GROUP BY ALL
),
w AS (SELECT *, sum(n1) OVER g AS a1, sum(n0) OVER g AS a0 FROM each WINDOW g AS (PARTITION BY load_id, previous, column_name))
SELECT load_id, previous, column_name, round(sum(abs(n1 / a1 - n0 / a0)) / 2, 6) AS half_abs,
    round(sum(pow(n0 - a0 * (n0 + n1) / (a0 + a1), 2) / (a0 * (n0 + n1) / (a0 + a1)) + pow(n1 - a1 * (n0 + n1) / (a0 + a1), 2) / (a1 * (n0 + n1) / (a0 + a1))), 6) AS chi_square,
    round(sum((greatest(n1 / a1, 1e-6) - greatest(n0 / a0, 1e-6)) * ln(greatest(n1 / a1, 1e-6) / greatest(n0 / a0, 1e-6))), 6) AS psi
FROM w WHERE a1 > 0 AND a0 > 0 GROUP BY ALL"""

ORACLE = {"p1_found": P1_FOUND, "p1_links": P1_LINKS, "p4_found": P4_FOUND, "p6_profile": P6_PROFILE, "p6_shifts": P6_SHIFTS}
