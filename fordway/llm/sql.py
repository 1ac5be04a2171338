"""SQL of the text queries that SQL can express, for DuckDB over whole tables."""

from __future__ import annotations

from .common import ASCII_LOWER, ASCII_UPPER
from .secrets import BASE, RULES

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

# every window of every text against every window of every item
DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, w[k : k + n - 1] AS x FROM starts),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT len(x) AS n FROM wanted) WHERE len(w) >= n),
hits AS (SELECT r, k, n, item FROM (SELECT r, k, n, w[k : k + n - 1] AS x FROM places) JOIN wanted USING (x)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""


def _rule(rank: int, rule) -> str:
    """Spans of one rule: matches and the parts between them, summed up to positions."""
    pattern = (("(?i)" if rule.fold else "") + rule.pattern).replace("'", "''")
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, ends - n AS start, ends AS stop FROM (
      SELECT r, n, tested, sum(gap + n) OVER (PARTITION BY r ORDER BY k)::BIGINT AS ends FROM (
        SELECT r, unnest(range(len(m))) AS k, length(unnest(m)) AS n, length(unnest(g)) AS tested, length(unnest(s[1 : len(m)])) AS gap FROM (
          SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, regexp_split_to_array(t, '{pattern}') AS s FROM d)))
    WHERE tested >= {rule.least}"""


_COUNTS = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
_SPAN = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
_BASE = ", ".join(f"'{r.kind}'" for r in BASE)

# every rule over every text
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_rule(k, r) for k, r in enumerate(RULES))}),
summed AS (SELECT r, {_COUNTS}, {_SPAN} FILTER (kind IN ({_BASE})) AS base, {_SPAN} AS spans FROM found GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (r)"""
