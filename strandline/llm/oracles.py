"""The corpus queries as SQL, where SQL can express them and is quick enough on whole tables of small scale factors."""

from __future__ import annotations

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words between ASCII blanks, and words of letters, digits and what isn't ASCII.
_BLANK = "regexp_extract_all(coalesce({t}, ''), '[^\\x20\\x09-\\x0D]+')"
_ALNUM = "regexp_extract_all(coalesce({t}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_GRAM = "array_to_string(list_slice(w, k, k + {n} - 1), ' ')"


def _words(kind: str, lower: bool) -> str:
    return kind.format(t=_LOWER.format(t="text") if lower else "text")


#: op4: sets of three-word shingles, links by their common ones, components by reachability.
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_BLANK, True)} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, {_GRAM.format(n=3)} AS t FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT node, min(other) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""

#: op7: windows of 35 words that start more than once, the words that they cover, and what is left.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_words(_BLANK, False)} AS w FROM documents),
g AS (SELECT doc_id, k, {_GRAM.format(n=35)} AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
o AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM g JOIN o USING (t)),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.p = p.p WHERE h.p IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

#: op8: windows of ten item words (a shorter item is one), the document words inside, and the items.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_words(_ALNUM, True)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_ALNUM, True)} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS n, {_GRAM.format(n="least(len(w), 10)")} AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, {_GRAM.format(n="n")} AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM v) ON len(w) >= n)),
h AS (SELECT doc_id, g.n, k, item FROM g JOIN v ON v.n = g.n AND v.t = g.t),
c AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""
