"""SQL for queries of this subpackage: the same results, found in another way."""

from __future__ import annotations

#: Characters that are not seen, as in words.py.
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}]"


def _plain(text: str) -> str:
    """Tags as blanks, then the entities that these texts hold as their characters."""
    out = f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"
    for name, char in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("shy", "chr(173)"), ("#8203", "chr(8203)"), ("amp", "'&'")):
        out = f"replace({out}, '&{name};', {char})"
    return out


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


_POSTING = "concat_ws(' ', title, coalesce(company_name, ''), description)"
_PAIRS = f"""
WITH RECURSIVE w AS (SELECT row_id, {_words(_plain(_POSTING))} AS ws FROM jobs),
s AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS t FROM w WHERE len(ws) >= 3),
n AS (SELECT row_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS own FROM s GROUP BY 1),
c AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.row_id < b.row_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-9)"""
_SPANS = """
WITH d AS (SELECT doc_id, {doc} AS ws FROM documents), i AS (SELECT item_id, {item} AS ws FROM eval_items),
dr AS (SELECT doc_id, unnest(range(0, len(ws) - 12)) AS pos, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS run FROM d WHERE len(ws) >= 13),
ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS run FROM i WHERE len(ws) >= 13),
h AS (SELECT DISTINCT doc_id, item_id, pos FROM dr JOIN ir USING (run)),
g AS (SELECT *, pos > coalesce(lag(pos) OVER w + 13, -1) AS first FROM h WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY pos)),
m AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS part FROM g)""".format(
    **{k: _words(f"regexp_replace({_plain(f'regexp_replace(text, {chr(39)}{_INVISIBLE}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '{_INVISIBLE}', '', 'g')") for k in ("doc", "item")}
)

ORACLE = {
    "p2_found": f"{_PAIRS} SELECT a AS row_id_a, b AS row_id_b FROM p",
    "p2_groups": f"""{_PAIRS},
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, low) AS (SELECT row_id, row_id FROM jobs UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id)
SELECT j.row_id, coalesce((SELECT min(y.row_id) FROM n x JOIN n y ON y.own = x.own WHERE x.row_id = j.row_id), j.row_id) AS class_id, min(r.low) AS group_id, (SELECT count(*) FROM e WHERE e.a = j.row_id) AS links
FROM jobs j JOIN r ON r.id = j.row_id GROUP BY j.row_id""",
    "p8_found": f"{_SPANS} SELECT DISTINCT doc_id, item_id FROM h",
    "p8_spans": f"{_SPANS} SELECT doc_id, item_id, min(pos)::INTEGER AS first_word, (max(pos) + 13)::INTEGER AS end_word FROM m GROUP BY doc_id, item_id, part",
}
