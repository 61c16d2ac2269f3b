"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

ROUNDS, DAMPING = 10, 0.85


def _url_filter() -> str:
    parts = [
        r"""base AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages)""",
        """ruled AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM base)""",
        """judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule FROM ruled)""",
        r"""edges AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM base WHERE host <> '') t WHERE src <> dst)""",
        """flows AS (SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM (SELECT 'trust' AS kind, src AS a, dst AS b FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges) t)""",
        """hosts AS (SELECT host, CASE WHEN 2 * count_if(by_rule = 'block') > count(*) THEN 'distrust' WHEN count_if(by_rule = 'allow') > 0 THEN 'trust' END AS kind FROM judged WHERE host <> '' GROUP BY host)""",
        f"r0 AS (SELECT kind, host, {1 - DAMPING} / count(*) OVER (PARTITION BY kind) AS rank FROM hosts WHERE kind IS NOT NULL)",
    ]
    for i in range(ROUNDS):
        parts.append(f"r{i + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, rank FROM r0 UNION ALL SELECT f.kind, f.b, {DAMPING} * r.rank / f.degree FROM flows f JOIN r{i} r ON f.kind = r.kind AND f.a = r.host) t GROUP BY kind, host)")
    parts.append(f"share AS (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS rank FROM r{ROUNDS})")
    parts.append("bad AS (SELECT host FROM share GROUP BY host HAVING round(coalesce(sum(rank) FILTER (kind = 'distrust'), 0), 12) > round(coalesce(sum(rank) FILTER (kind = 'trust'), 0), 12))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"


def _positions(kind: str, pattern: str, keep: str) -> str:
    """All matches of a pattern with their places; keep: a condition on m (the match), s and e (its places)."""
    return f"""(SELECT doc_id, rid, text, '{kind}' AS kind, s, s + length(m) AS e, m FROM (
  SELECT doc_id, rid, text, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT doc_id, rid, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, rid, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM docs WHERE regexp_matches(text, '{pattern}')) a) b) c
  WHERE {keep})"""


def _pii() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT
      WHEN reverse({digits})[i]::INT > 4 THEN 2 * reverse({digits})[i]::INT - 9 ELSE 2 * reverse({digits})[i]::INT END)) % 10 = 0"""
    part = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    near = "lower(substring(text, greatest(1, s - 39), least(40, s)))"
    around = lambda chars: f"NOT regexp_matches(CASE WHEN s > 0 THEN substring(text, s, 1) ELSE '' END, '{chars}') AND NOT regexp_matches(substring(text, s + length(m) + 1, 1), '{chars}')"
    plain = "replace(m, ' ', '')"
    turned = f"({plain}[5:] || {plain}[1:4])"
    mod = f"""length({plain}) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN ascii({turned}[i]) >= 65 THEN 1000 + ascii({turned}[i]) - 55 ELSE ascii({turned}[i]) - 48 END)),
      lambda a, b: CASE WHEN b >= 1000 THEN (a * 100 + b - 1000) % 97 ELSE (a * 10 + b) % 97 END) = 1"""
    phone_words = "(^|[^a-z])(phone|telephone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone)([^a-z]|$)"
    ssn_words = "(^|[^a-z])(ssn|social security|social-security)([^a-z]|$)"
    kinds = {
        "email": _positions("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": _positions("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_matches(m, '^{part}(\.{part}){{3}}$')"),
        "card": _positions("card", "[0-9]([ -]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        "phone": _positions("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
        "iban": _positions("iban", "[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", f"{around('[A-Za-z0-9]')} AND {mod}"),
        "ssn": _positions("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{around('[A-Za-z0-9-]')} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND s > 0 AND regexp_matches({near}, '{ssn_words}')"),
        "national": _positions("phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", f"{around('[0-9+]')} AND s > 0 AND regexp_matches({near}, '{phone_words}')"),
    }
    base = ("email", "ip", "card", "phone")
    listed = [f"SELECT doc_id, rid, kind, s, e, {k in base} AS base, {i} AS nth FROM {sql} {k}" for i, (k, sql) in enumerate(x for x in kinds.items() if x[0] != "national")]
    listed.append(f"SELECT n.doc_id, n.rid, n.kind, n.s, n.e, false, 3 FROM {kinds['national']} n WHERE NOT EXISTS (SELECT 1 FROM {kinds['phone']} p WHERE p.rid = n.rid AND p.s < n.e AND n.s < p.e)")
    line = "kind || ':' || s || ':' || e"
    return f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(listed)}),
joined AS (SELECT rid, string_agg({line}, ',' ORDER BY nth, s) AS spans, coalesce(string_agg({line}, ',' ORDER BY nth, s) FILTER (base), '') AS base_spans,
  {', '.join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in base)} FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (rid)"""


LINE_DEDUP = r"""WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, i, ls[i] AS l, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs) t),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
kept AS (SELECT rid, string_agg(l, chr(10) ORDER BY i) AS kept, count(*) AS n FROM lines WHERE k NOT IN (SELECT k FROM often) GROUP BY rid)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)"""

ORACLE_SQL = {"op2_url_filter": _url_filter(), "op4_pii": _pii(), "op6_line_dedup": LINE_DEDUP}
