"""DuckDB SQL for the linkage queries, written independently of the DataFrame code."""

from __future__ import annotations

from kindred.functions import lexicon as L

ENT = "ent AS (SELECT doc_id AS id, source IN ('src0','src1','src2','src3','src4','src5','src6') AS is_s1, CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6') THEN 1 ELSE (2 + doc_id % 2) END::INTEGER AS source, lang AS country, split_part(text, chr(10), 1) AS name, split_part(text, chr(10), -1) AS addr, text FROM documents)"
PLAIN = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
REC = f"{ENT}, rec AS (SELECT id, is_s1, country, {PLAIN.format('text')} AS toks FROM ent)"
GOLD_E = "gold AS (SELECT s1, p.id AS pool FROM (SELECT text, min(id) AS s1 FROM ent WHERE is_s1 GROUP BY text) o JOIN ent p ON p.text = o.text AND NOT p.is_s1)"
P = "p AS (SELECT l_orderkey AS s1, l_partkey AS pool, max(round((l_quantity - 0.5) / 50.0, 6)) AS prob, max(round(1 - l_discount * 5, 6)) AS prob2, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS label FROM lineitem GROUP BY 1, 2)"
S1 = "s AS (SELECT o_orderkey AS s1, o_orderpriority AS country FROM orders)"
TERMS = "terms AS (SELECT country, term, ln(1 + n / df) AS idf FROM (SELECT country, term, count(*) AS df FROM (SELECT DISTINCT id, country, unnest(toks) AS term FROM rec WHERE NOT is_s1) t GROUP BY 1, 2) d JOIN (SELECT country, count(*) AS n FROM rec WHERE NOT is_s1 GROUP BY 1) c USING (country) WHERE df <= 3000)"
POST = "post AS (SELECT id, is_s1, country, term, idf / (sqrt(sum(idf * idf) OVER (PARTITION BY id)) + 1e-6) AS w FROM (SELECT DISTINCT id, is_s1, country, unnest(toks) AS term FROM rec) t JOIN terms USING (country, term))"
TOP = "cand AS (SELECT * FROM (SELECT s1, pool, score, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, pool)::INTEGER AS rank FROM (SELECT a.id AS s1, b.id AS pool, round(sum(a.w * b.w), 9) AS score FROM post a JOIN post b USING (country, term) WHERE a.is_s1 AND NOT b.is_s1 GROUP BY 1, 2) x) y WHERE rank <= 12)"
CAND = f"{REC}, {TERMS}, {POST}, {TOP}"
PART = f"part_rec AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS is_s1, p_brand AS country, lower(p_name) AS name, {PLAIN.format('p_name')} AS toks FROM part)"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _in(words) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _fold(c: str) -> str:
    t = f"translate(lower({c}), '{L.ACCENTED}', '{L.PLAIN}')"
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("&", " and "), ("''", "")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"


def _ocr(t: str) -> str:
    return f"CASE WHEN length(regexp_replace({t}, '[^a-z]', '', 'g')) >= 2 AND regexp_matches({t}, '[0-9]') THEN translate({t}, '0136', 'oieg') ELSE {t} END"


def _skeleton(t: str) -> str:
    for a, b in L.SOUNDS:
        t = f"replace({t}, '{a}', '{b}')"
    v = f"(substr({t}, 1, 1) || regexp_replace(substr({t}, 2), '[aeiouy]', '', 'g'))"
    return f"array_to_string(list_filter(string_split({v}, ''), lambda c, i: i = 1 OR c <> string_split({v}, '')[i - 1]), '')"


def _toks(c: str) -> str:
    return f"list_filter(string_split({_fold(c)}, ' '), lambda x: x <> '')"


SITE = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|in|co\.in|co|fr|us|biz|info|io)\b"


def _site(c: str) -> str:
    return f"regexp_replace({c}, '{SITE}', ' \\1 ', 'g')"


def _pairs(body: str) -> str:
    return f"WITH {P}, {S1} {body}"


F05 = "CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 ELSE 1.25 * tp / (0.25 * n_gold + n_pred) END"
ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) AS rn FROM p) t WHERE rn = 1)"


def _prefix(source: str, alpha: float, name: str) -> str:
    return f"""{name} AS (SELECT s1, pool, prob FROM (SELECT *, min(CASE WHEN e = best THEN k END) OVER (PARTITION BY s1) AS stop FROM (SELECT *, max(e) OVER (PARTITION BY s1) AS best FROM (
  SELECT s1, pool, prob, k, round(1.25 * run / (0.25 * tot + k), 9) AS e, round({alpha} * e0, 9) AS e0 FROM (SELECT s1, pool, prob, row_number() OVER o AS k, sum(prob) OVER (PARTITION BY s1 ORDER BY prob DESC, pool ROWS UNBOUNDED PRECEDING) AS run, sum(prob) OVER (PARTITION BY s1) AS tot, exp(sum(ln(greatest(1 - prob, 1e-300))) OVER (PARTITION BY s1)) AS e0 FROM {source} WINDOW o AS (PARTITION BY s1 ORDER BY prob DESC, pool)) a) b) c) d WHERE best > e0 AND k <= stop)"""


def _per_s1(pred: str, gold: str = "(SELECT s1, pool FROM p WHERE label = 1)", s1: str = "s") -> str:
    return f"""sc AS (SELECT *, {F05} AS f05 FROM (SELECT s.*, coalesce(n_gold, 0)::BIGINT AS n_gold, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(tp, 0)::BIGINT AS tp FROM {s1} s LEFT JOIN (
  SELECT s1, count(g) AS n_gold, count(q) AS n_pred, count(g + q) AS tp FROM (SELECT coalesce(a.s1, b.s1) AS s1, a.one AS g, b.one AS q FROM (SELECT s1, pool, 1 AS one FROM {gold} gg) a FULL JOIN (SELECT s1, pool, 1 AS one FROM {pred} pp) b ON a.s1 = b.s1 AND a.pool = b.pool) x GROUP BY s1) y ON s.s1 = y.s1) z)"""


REPORT = "count(*) AS n, round(avg(f05), 6) AS macro_f05, CASE WHEN sum(n_pred) > 0 THEN round(sum(tp) / sum(n_pred), 6) ELSE 0.0 END AS precision, CASE WHEN sum(n_gold) > 0 THEN round(sum(tp) / sum(n_gold), 6) ELSE 0.0 END AS recall, round(avg(f05) FILTER (n_gold = 0), 6) AS f05_none, round(avg(f05) FILTER (n_gold > 1), 6) AS f05_many"
SCORED = f"{ONE}, {_prefix('one', 1.0, 'pre')}, {_per_s1('pre')}"
GRID = "grid AS (SELECT round(0.01 * i, 2)::DOUBLE AS tau FROM range(5, 96) t(i))"
SWEEP = f"""{ONE}, {GRID}, g AS (SELECT s1, count(*) AS n_gold FROM p WHERE label = 1 GROUP BY s1),
each AS (SELECT s.s1, country, tau, coalesce(n_gold, 0) AS n_gold, count(one.pool) AS n_pred, coalesce(sum(one.label), 0) AS tp FROM s CROSS JOIN grid LEFT JOIN g ON g.s1 = s.s1 LEFT JOIN one ON one.s1 = s.s1 AND one.prob >= tau GROUP BY s.s1, country, tau, n_gold)"""
RATIO = lambda c, n: f"{n} AS (SELECT s1, pool, prob FROM (SELECT *, max({c}) OVER (PARTITION BY s1) AS best FROM p) t WHERE {c} >= 0.5 AND {c} >= 0.6 * best)"
TWO = "base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) AS rn FROM p WHERE prob >= 0.95) t WHERE rn = 1), cands AS (SELECT * FROM p WHERE prob >= 0.4), other AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob2 DESC, s1) AS rn FROM p WHERE prob2 >= 0.8) t WHERE rn = 1)"
LOGIT = lambda c: f"ln(greatest(1e-6, least(1 - 1e-6, {c})) / (1 - greatest(1e-6, least(1 - 1e-6, {c}))))"
SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
BLEND = SIG(f"({LOGIT('prob')} + {LOGIT('prob2')}) / 2")
OCRF = lambda c: f"translate(replace(replace(replace({c}, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), 'gl', 'bi')"
KEYS = f"""{PART}, keys AS (SELECT id, is_s1, country AS part, 0 AS family, array_to_string(list_sort(list_distinct(toks)), ' ') AS key FROM part_rec
 UNION SELECT id, is_s1, country, 1, ws[i] || ' ' || ws[j] FROM (SELECT id, is_s1, country, list_sort(list_distinct(toks)) AS ws, unnest(range(1, len(toks) + 1)) AS i FROM part_rec) a, LATERAL (SELECT unnest(range(a.i + 1, len(a.ws) + 1)) AS j) b
 UNION SELECT id, is_s1, country, 2, substr({OCRF("array_to_string(toks, '')")}, 1, 6) FROM part_rec)"""


def _key_pairs(cap: int, where: str = "true") -> str:
    return f"kp AS (SELECT a.id AS s1, b.id AS pool, bit_or(1 << a.family)::INTEGER AS bits FROM (SELECT * FROM keys WHERE {where}) a JOIN (SELECT * FROM keys WHERE {where}) b ON a.part = b.part AND a.family = b.family AND a.key = b.key AND a.is_s1 AND NOT b.is_s1 JOIN (SELECT part, family, key FROM keys WHERE NOT is_s1 GROUP BY ALL HAVING count(*) <= {cap}) g ON g.part = a.part AND g.family = a.family AND g.key = a.key GROUP BY 1, 2)"


_LEGAL_ALL = {**{k: k for k in L.LEGAL_FAMILY}, **L.LEGAL_ONE}
_clean_toks = f"list_transform(list_filter(string_split(array_to_string(list_transform(ot, lambda t, i: CASE WHEN i = 1 THEN t WHEN regexp_matches(t, '^[a-z]$') AND regexp_matches(ot[i - 1], '^[a-z]$') THEN t ELSE ' ' || t END), ''), ' '), lambda t: t <> ''), lambda t: coalesce({_map(L.NAME_FORMS)}[t], t))"

ORACLE_SQL: dict[str, str] = {
    "q01_source_union": f"WITH {ENT} SELECT source, country, count(*) AS n, min(id) AS first_id FROM ent GROUP BY ALL",
    "q02_gold_pairs": f"WITH {ENT}, {GOLD_E} SELECT s1, pool FROM gold",
    "q03_name_views": f"""WITH {ENT}, a AS (SELECT id, CASE WHEN regexp_matches(name, '\\s\\|\\s') THEN regexp_extract(name, '^(.*?)\\s\\|\\s', 1, 's') ELSE name END AS main, CASE WHEN regexp_matches(name, '\\s\\|\\s') THEN regexp_extract(name, '^.*?\\s\\|\\s(.*)$', 1, 's') ELSE '' END AS bar FROM ent),
b AS (SELECT id, bar, list_transform({_toks(_site('main'))}, lambda t: {_ocr('t')}) AS ot FROM a), c AS (SELECT id, bar, {_clean_toks} AS toks FROM b),
d AS (SELECT id, bar, toks, list_filter(toks, lambda t: t NOT IN {_in(L.LEGAL)} AND {_skeleton('t')} NOT IN {_in(L.LEGAL_SKELETONS)}) AS kept FROM c), e AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE toks END AS core FROM d)
SELECT id, array_to_string(toks, ' ') AS clean, array_to_string(core, ' ') AS core, array_to_string(list_transform(core, lambda t: {_skeleton('t')}), ' ') AS skel, array_to_string(core, '') AS nospace, array_to_string(list_filter({_toks(_site('bar'))}, lambda t: t NOT IN {_in(L.LEGAL)}), ' ') AS alt FROM e""",
    "q04_legal_forms": f"WITH {ENT}, t AS (SELECT id, {PLAIN.format('name')} AS toks FROM ent) SELECT id, coalesce({_map(L.LEGAL_FAMILY)}[list_filter(toks, lambda x: x IN {_in(L.LEGAL_FAMILY)})[-1]], '') AS family, array_to_string(list_sort(list_distinct(list_transform(list_filter(toks, lambda x: x IN {_in(_LEGAL_ALL)}), lambda x: {_map(_LEGAL_ALL)}[x]))), ' ') AS legal FROM t",
    "q05_token_forms": f"WITH {REC}, w AS (SELECT t, count(*) AS n FROM (SELECT unnest(toks) AS t FROM rec) x GROUP BY t) SELECT t, n, {_skeleton('t')} AS skel, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END AS stem, {_ocr('t')} AS ocr, {OCRF('t')} AS folded FROM w",
    "q06_address_views": f"""WITH {ENT}, t AS (SELECT id, addr, list_filter(list_transform({_toks('addr')}, lambda t: coalesce({_map(L.ADDRESS_FORMS)}[t], t)), lambda t: t <> '') AS toks FROM ent)
SELECT id, array_to_string(toks, ' ') AS clean, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(addr, '\\b([0-9]{{3}}[ ]?[0-9]{{3}}|[0-9]{{5}})\\b', 1), lambda x: replace(x, ' ', '')))), ' ') AS postal, array_to_string(list_sort(list_distinct(regexp_extract_all(addr, '[0-9]+'))), ' ') AS nums,
array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(toks, lambda t, i: CASE WHEN t IN {_in(L.LANDMARKS)} THEN toks[i + 1:i + 3] ELSE [] END)), lambda t: t NOT IN {_in(L.LANDMARKS)}))), ' ') AS landmarks FROM t""",
    "q07_site_names": "SELECT page_id, regexp_extract(url, '(?i)([a-z0-9-]+)\\.(?:com|net|org|in|co|fr|us|biz|info|io)(?:[/?#:]|$)', 1) AS site FROM pages",
    "q09_stratified_split": _pairs(", n AS (SELECT s1, count(*) AS n FROM p WHERE label = 1 GROUP BY s1), r AS (SELECT s.s1, country, least(coalesce(n, 0), 4) AS many FROM s LEFT JOIN n ON n.s1 = s.s1), o AS (SELECT *, row_number() OVER (PARTITION BY country, many ORDER BY s1) AS rn, count(*) OVER (PARTITION BY country, many) AS c FROM r) SELECT s1, country, many, CASE WHEN rn <= round(c * 0.7) THEN 'fit' WHEN rn <= round(c * 0.85) THEN 'dev' ELSE 'lockbox' END AS split FROM o"),
    "q10_term_counts": f"WITH {REC} SELECT country, term, count(*) AS df FROM (SELECT DISTINCT id, country, unnest(toks) AS term FROM rec) t GROUP BY ALL",
    "q11_idf_weights": f"WITH {REC}, {TERMS}, {POST} SELECT id, term, round(w, 6) AS w FROM post WHERE NOT is_s1",
    "q12_token_top_k": f"WITH {CAND} SELECT s1, pool, round(score, 6) AS score, rank FROM cand",
    "q13_nearest_vectors": "WITH x AS (SELECT a.vec_id AS s1, b.vec_id AS pool, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0) SELECT s1, pool, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, pool)::INTEGER AS rank FROM x) y WHERE rank <= 5",
    "q14_union_passes": _pairs(", a AS (SELECT * FROM (SELECT s1, pool, prob AS score, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, pool)::INTEGER AS rank FROM p) t WHERE rank <= 12), b AS (SELECT * FROM (SELECT s1, pool, prob2 AS score, row_number() OVER (PARTITION BY s1 ORDER BY prob2 DESC, pool)::INTEGER AS rank FROM p) t WHERE rank <= 20), j AS (SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.pool, b.pool) AS pool, coalesce(a.score, 0.0) AS tok_score, coalesce(a.rank, 999) AS tok_rank, coalesce(b.score, 0.0) AS emb_score, coalesce(b.rank, 999) AS emb_rank, least(coalesce(a.rank, 999), coalesce(b.rank, 999)) AS best_rank FROM a FULL JOIN b ON a.s1 = b.s1 AND a.pool = b.pool) SELECT s1, pool, tok_score, tok_rank, emb_score, emb_rank, best_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY best_rank, pool) AS rn FROM j) t WHERE rn <= 25"),
    "q15_key_pairs": f"WITH {KEYS}, {_key_pairs(200)} SELECT s1, pool, bits FROM kp",
    "q16_digit_deletion_pairs": "WITH n AS (SELECT c_custkey AS id, true AS own, c_nationkey AS part, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT::VARCHAR AS num FROM customer UNION ALL SELECT s_suppkey, false, s_nationkey, regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT::VARCHAR FROM supplier), k AS (SELECT id, own, part, num::BIGINT AS key FROM n UNION SELECT id, own, part, (substr(num, 1, i - 1) || substr(num, i + 1))::BIGINT FROM (SELECT *, unnest(range(1, length(num) + 1)) AS i FROM n WHERE length(num) >= 3) t), g AS (SELECT part, key FROM k WHERE NOT own GROUP BY ALL HAVING count(*) <= 20) SELECT DISTINCT a.id AS s1, b.id AS pool FROM k a JOIN k b ON a.part = b.part AND a.key = b.key AND a.own AND NOT b.own JOIN g ON g.part = a.part AND g.key = a.key",
    "q17_pair_bits": f"WITH {KEYS}, {_key_pairs(200)} SELECT (bits & 1)::INTEGER AS f_set, ((bits >> 1) & 1)::INTEGER AS f_pair, ((bits >> 2) & 1)::INTEGER AS f_glue, count(*) AS n FROM kp GROUP BY ALL",
    "q18_fillers": f"WITH {REC}, t AS (SELECT country, term, count(*) FILTER (is_s1) AS df1, count(*) FILTER (NOT is_s1) AS df2 FROM (SELECT DISTINCT id, is_s1, country, unnest(toks) AS term FROM rec) x GROUP BY ALL), c AS (SELECT country, count(*) FILTER (is_s1) AS n1, count(*) FILTER (NOT is_s1) AS n2 FROM rec GROUP BY country) SELECT country, term, df1, df2 FROM t JOIN c USING (country) WHERE df2 >= greatest(5, 0.00075 * n2) AND df2 / n2 >= 1.2 * (df1 + 1) / n1",
    "q19_partitions": "WITH r AS (SELECT 'c' || c_custkey AS id, true AS own, c_mktsegment AS country, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE '' END AS state, c_acctbal > 0 AS ok FROM customer UNION ALL SELECT 's' || s_suppkey, false, 'BUILDING', CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE '' END, s_acctbal > 0 FROM supplier), b AS (SELECT country, avg((state <> '')::INT) >= 0.5 AS st FROM r WHERE own GROUP BY country) SELECT id, CASE WHEN NOT own AND (NOT ok OR (coalesce(st, false) AND state = '')) THEN r.country || '|POOL' WHEN coalesce(st, false) AND state <> '' THEN r.country || '|' || state ELSE r.country || '|*' END AS part FROM r LEFT JOIN b ON b.country = r.country",
    "q20_same_names": f"WITH {PART} SELECT id, count(*) FILTER (is_s1) OVER (PARTITION BY country, name) AS n_s1_same, count(*) FILTER (NOT is_s1) OVER (PARTITION BY country, name) AS n_pool_same FROM part_rec",
    "q21_set_similarity": f"WITH {CAND} SELECT s1, pool, round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 6) AS jaccard, len(list_intersect(list_distinct(a.toks), list_distinct(b.toks)))::INTEGER AS shared, round(len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(a.toks)), 6) AS inside FROM cand JOIN rec a ON a.id = s1 JOIN rec b ON b.id = pool",
    "q22_edit_distance": f"WITH {CAND} SELECT s1, pool, levenshtein(regexp_replace(lower(a.name), '[^a-z0-9 ]', '', 'g'), regexp_replace(lower(b.name), '[^a-z0-9 ]', '', 'g'))::INTEGER AS distance FROM cand JOIN ent a ON a.id = s1 JOIN ent b ON b.id = pool",
    "q23_jaro_winkler": f"WITH {PART}, n AS (SELECT DISTINCT country, name FROM part_rec) SELECT a.country, a.name, b.name AS other, round(jaro_winkler_similarity(a.name, b.name), 6) AS jw FROM n a JOIN n b ON a.country = b.country AND substr(a.name, 1, 3) = substr(b.name, 1, 3)",
    "q24_idf_overlap": f"WITH {CAND}, x AS (SELECT DISTINCT id, term, idf FROM (SELECT id, country, unnest(toks) AS term FROM rec) t JOIN terms USING (country, term)), e AS (SELECT s1, pool, term, max(idf) AS idf, sum(side) AS sides FROM (SELECT s1, pool, term, idf, 1 AS side FROM cand JOIN x ON x.id = s1 UNION ALL SELECT s1, pool, term, idf, 2 FROM cand JOIN x ON x.id = pool) y GROUP BY 1, 2, 3) SELECT s1, pool, round(coalesce(sum(idf) FILTER (sides = 3), 0) / sum(idf), 6) AS idf_jaccard, round(coalesce(max(idf) FILTER (sides = 3), 0), 6) AS max_shared_idf, round(coalesce(sum(idf) FILTER (sides = 2), 0), 6) AS pool_only_idf FROM e GROUP BY 1, 2",
    "q25_rank_gap": _pairs("SELECT s1, pool, count(*) OVER (PARTITION BY s1) AS n_pool, count(*) OVER (PARTITION BY pool) AS n_s1, rank() OVER (PARTITION BY s1 ORDER BY prob DESC)::INTEGER AS s1_rank, round(max(prob) OVER (PARTITION BY s1) - prob, 6) AS s1_gap, rank() OVER (PARTITION BY pool ORDER BY prob DESC)::INTEGER AS pool_rank, round(max(prob) OVER (PARTITION BY pool) - prob, 6) AS pool_gap FROM p"),
    "q26_s1_context": _pairs("SELECT s1, pool, rn::INTEGER AS rn, max(prob) OVER w AS best, round(max(prob) OVER w - prob, 6) AS gap, round(sum(prob) OVER w, 6) AS total, count(*) FILTER (prob > 0.5) OVER w AS n_half, coalesce(max(prob) FILTER (rn = 2) OVER w, 0.0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, pool) AS rn FROM p) t WINDOW w AS (PARTITION BY s1)"),
    "q27_pool_context": _pairs("SELECT s1, pool, n_rivals, best_other, round(prob - best_other, 6) AS margin, (prob >= best)::INTEGER AS is_top FROM (SELECT *, count(*) OVER w AS n_rivals, max(prob) OVER w AS best, CASE WHEN rn = 1 THEN coalesce(max(prob) FILTER (rn = 2) OVER w, 0.0) ELSE max(prob) OVER w END AS best_other FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) AS rn FROM p WHERE prob >= 0.001) t WINDOW w AS (PARTITION BY pool)) u"),
    "q28_mutual_best": _pairs("SELECT s1, pool, a::INTEGER AS place_s1, b::INTEGER AS place_pool, (a = 0 AND b = 0)::INTEGER AS mutual FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, pool) - 1 AS a, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) - 1 AS b FROM p) t"),
    "q29_siblings": _pairs(", q AS (SELECT * FROM p WHERE prob >= 0.02), x AS (SELECT a.s1, a.pool, count(b.pool) AS n_sure, coalesce(max(b.prob), 0.0) AS sure_best FROM q a LEFT JOIN q b ON a.s1 = b.s1 AND a.pool <> b.pool AND b.prob >= 0.5 GROUP BY 1, 2), y AS (SELECT a.s1, a.pool, coalesce(max(b.prob), 0.0) AS o FROM q a LEFT JOIN q b ON a.pool = b.pool AND a.s1 <> b.s1 GROUP BY 1, 2) SELECT x.s1, x.pool, n_sure, sure_best, (o >= 0.5)::INTEGER AS elsewhere FROM x JOIN y USING (s1, pool)"),
    "q30_one_to_one": _pairs(f", {ONE} SELECT s1, pool, prob FROM one"),
    "q31_threshold_ratio": _pairs(f", {RATIO('prob', 'r')} SELECT s1, pool, prob FROM r"),
    "q32_expected_prefix": _pairs(f", {_prefix('p', 1.5, 'pre')} SELECT s1, pool, prob FROM pre"),
    "q33_expected_keep": _pairs(f", {ONE}, o AS (SELECT s1, pool, prob, pow(prob, 1.25) AS q FROM one WHERE prob >= 0.01), r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY q DESC, pool) AS k, sum(q) OVER (PARTITION BY s1) AS tot, exp(sum(ln(1 - least(q, 1 - 1e-7))) OVER (PARTITION BY s1)) AS e0 FROM o), e AS (SELECT b.s1, b.k, round(1.25 * sum(a.q / (0.25 * (1 + a.tot - a.q + 0.1) + b.k)), 9) AS e, max(a.e0) AS e0 FROM r b JOIN r a ON a.s1 = b.s1 AND a.k <= b.k WHERE b.k <= 40 GROUP BY 1, 2), st AS (SELECT s1, CASE WHEN round(max(e0) + 0.05, 9) >= max(e) THEN 0 ELSE arg_max(k, (e, -k)) END AS stop FROM e GROUP BY s1) SELECT r.s1, pool, prob FROM r JOIN st USING (s1) WHERE k <= stop"),
    "q34_logit_blend": _pairs(f"SELECT s1, pool, round({BLEND}, 6) AS blended, round(CASE WHEN prob BETWEEN 0.2 AND 0.8 THEN {BLEND} ELSE prob END, 6) AS filled FROM p"),
    "q35_logit_shift": _pairs(f"SELECT p.s1, pool, round(CASE WHEN country = '1-URGENT' THEN {SIG(LOGIT('prob') + ' - 1')} ELSE prob END, 6) AS prob FROM p JOIN s USING (s1)"),
    "q36_union_merge": _pairs(f", {TWO} SELECT min(o.s1) AS s1, o.pool FROM other o WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.s1 = o.s1 AND c.pool = o.pool) AND o.pool NOT IN (SELECT pool FROM base) GROUP BY o.pool"),
    "q37_rescue_merge": _pairs(f", {TWO} SELECT min(o.s1) AS s1, o.pool FROM other o WHERE EXISTS (SELECT 1 FROM cands c WHERE c.s1 = o.s1 AND c.pool = o.pool AND c.prob >= 0.45) AND o.pool NOT IN (SELECT pool FROM base) GROUP BY o.pool"),
    "q38_pseudo_labels": _pairs(", r AS (SELECT *, least(prob, prob2) AS lo, greatest(prob, prob2) AS hi FROM p), o AS (SELECT pool, min(s1) AS owner FROM r WHERE lo >= 0.8 GROUP BY pool) SELECT * FROM (SELECT r.s1, r.pool, CASE WHEN lo >= 0.8 THEN 'positive' WHEN coalesce(owner <> r.s1, false) AND hi >= 0.6 THEN 'decoy' WHEN NOT coalesce(owner <> r.s1, false) AND hi <= 0.55 THEN 'easy' END AS kind FROM r LEFT JOIN o USING (pool)) t WHERE kind IS NOT NULL"),
    "q39_macro_f05": _pairs(f", {SCORED} SELECT s1, n_gold, n_pred, tp, round(f05, 6) AS f05 FROM sc"),
    "q40_score_report": _pairs(f", {SCORED} SELECT country, {REPORT} FROM sc GROUP BY country"),
    "q41_threshold_sweep": _pairs(f", {SWEEP} SELECT tau, round(avg({F05}), 6) AS macro_f05 FROM each GROUP BY tau"),
    "q42_best_threshold": _pairs(f", {SWEEP}, m AS (SELECT country, tau, round(avg({F05}), 6) AS macro_f05 FROM each GROUP BY ALL) SELECT country, tau, macro_f05 FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY macro_f05 DESC, tau) AS rn FROM m) t WHERE rn = 1"),
    "q43_error_breakdown": _pairs(f", {RATIO('prob', 'r')}, {_per_s1('r')}, ms AS (SELECT s1, count(*) AS n_missed FROM p WHERE label = 1 AND prob < 0.2 GROUP BY s1), e AS (SELECT CASE WHEN n_gold = 0 THEN 'fp_on_singleton' WHEN n_pred = 0 THEN 'empty_pred_on_match' WHEN n_pred > tp AND n_gold > tp THEN 'fp_and_fn' WHEN n_pred > tp THEN 'fp_only' ELSE 'fn_only' END AS cause, 1 - f05 AS loss, coalesce(n_missed, 0) AS nm, n_gold - tp AS fn FROM sc LEFT JOIN ms ON ms.s1 = sc.s1 WHERE f05 < 1) SELECT cause, count(*) AS n, round(sum(loss), 6) AS loss, round(sum(loss) / sum(sum(loss)) OVER (), 6) AS share, sum(nm)::BIGINT AS fn_blocking, sum(fn - nm)::BIGINT AS fn_filter FROM e GROUP BY cause"),
    "q44_churn": _pairs(f", {RATIO('prob', 'a')}, {RATIO('prob2', 'b')}, j AS (SELECT coalesce(a.s1, b.s1) AS s1, a.s1 IS NULL AS ad, b.s1 IS NULL AS rm FROM a FULL JOIN b ON a.s1 = b.s1 AND a.pool = b.pool) SELECT count(DISTINCT s1) FILTER (ad OR rm) AS changed, count(*) FILTER (ad) AS added, count(*) FILTER (rm) AS removed FROM j"),
    "q45_blocking_recall": f"WITH {CAND}, {GOLD_E} SELECT k::INTEGER AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM gold LEFT JOIN cand USING (s1, pool) CROSS JOIN (SELECT unnest([1, 2, 3, 5, 12]) AS k) g GROUP BY k",
    "q46_oracle_f05": _pairs(f", {_per_s1('(SELECT s1, pool FROM p WHERE label = 1 AND prob >= 0.2)')} SELECT {REPORT} FROM sc"),
    "q47_id_lists": _pairs(f", {RATIO('prob', 'r')} SELECT s.s1, coalesce(string_agg(pool::VARCHAR, ',' ORDER BY pool), '') AS ids FROM s LEFT JOIN r ON r.s1 = s.s1 GROUP BY s.s1"),
    "q48_validator": _pairs(", l AS (SELECT DISTINCT s1 FROM p), i AS (SELECT s1, pool FROM p WHERE prob > 0.5), x AS (SELECT 'self_match' AS rule, s1 || ':' || pool AS what FROM i WHERE s1 = pool UNION ALL SELECT 'unknown_id', s1 || ':' || pool FROM i WHERE pool NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) UNION ALL SELECT 'missing_s1', s1::VARCHAR FROM s WHERE s1 NOT IN (SELECT s1 FROM l) UNION ALL SELECT 'extra_s1', s1::VARCHAR FROM l WHERE s1 NOT IN (SELECT s1 FROM s)) SELECT rule, count(*) AS n, min(what) AS example FROM x GROUP BY rule"),
    "q49_expansion": f"WITH {KEYS}, {_key_pairs(200)}, c AS (SELECT s1, pool, len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(list_concat(a.toks, b.toks))) AS prob FROM kp JOIN part_rec a ON a.id = s1 JOIN part_rec b ON b.id = pool), seeds AS (SELECT id AS s1, id AS seed, 0 AS via FROM part_rec WHERE is_s1 UNION ALL SELECT s1, pool, 1 FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) AS rn FROM c) t WHERE rn = 1 AND prob >= 0.7), k AS (SELECT id, is_s1, 'name' AS kind, country || '|' || array_to_string(list_sort(toks), ' ') AS key FROM part_rec UNION SELECT id, is_s1, 'addr', country || '|' || substr(name, 1, 4) FROM part_rec), g AS (SELECT kind, key FROM k WHERE NOT is_s1 GROUP BY ALL HAVING count(*) <= 20), f AS (SELECT x.s1, b.id AS pool, max(CASE WHEN a.kind = 'addr' THEN 1 ELSE 0 END)::INTEGER AS by_addr, min(via) AS via FROM seeds x JOIN k a ON a.id = x.seed JOIN g USING (kind, key) JOIN k b ON b.kind = a.kind AND b.key = a.key AND NOT b.is_s1 GROUP BY 1, 2), h AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp.s1 = f.s1 AND kp.pool = f.pool)) SELECT * FROM (SELECT s1, pool, by_addr, row_number() OVER (PARTITION BY s1 ORDER BY by_addr DESC, via, pool)::INTEGER AS rank FROM h) t WHERE rank <= 20",
    "q50_cooccurrence": f"WITH {ENT}, w AS (SELECT list_distinct({PLAIN.format('name')}) AS a, list_distinct({PLAIN.format('addr')}) AS b FROM ent), u AS (SELECT unnest(a) AS x, b FROM w), f AS (SELECT x, count(*) AS fx FROM u GROUP BY x), c AS (SELECT x, y, count(*) AS n FROM (SELECT x, unnest(b) AS y FROM u) t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS rn FROM c) SELECT r.x, y, n FROM r JOIN f USING (x) WHERE rn = 1 AND n >= 5 AND n >= 0.5 * fx",
    "q51_field_quality": f"WITH {ENT} SELECT source, country, round(avg(regexp_matches(name, '[0-9]')::INT), 6) AS digits, round(avg(regexp_matches(name, '[|#%&!]')::INT), 6) AS mark, round(avg(regexp_matches(name, '^[A-Z ]+$')::INT), 6) AS upper, round(median(len(string_split(name, ' '))), 6) AS words FROM ent GROUP BY ALL",
    "q52_contested": _pairs(f"SELECT s1, pool FROM p WHERE {BLEND} BETWEEN 0.3 AND 0.8"),
    "q53_orphan_mask": _pairs(", ch AS (SELECT s1 FROM s WHERE country < '3'), o AS (SELECT pool, min(s1) AS owner FROM p WHERE label = 1 GROUP BY pool) SELECT s1, pool FROM p WHERE s1 IN (SELECT s1 FROM ch) AND pool NOT IN (SELECT pool FROM o WHERE owner NOT IN (SELECT s1 FROM ch))"),
    "q54_ranking_quality": _pairs(", g AS (SELECT prob, count(*) AS n, sum(label) AS pos FROM p GROUP BY prob), r AS (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, greatest(1e-6, least(1 - 1e-6, prob)) AS q FROM g) SELECT round(sum(pos * (below + 0.5 * (n - pos))) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc, round(sum(-(pos * ln(q) + (n - pos) * ln(1 - q))) / sum(n), 6) AS log_loss FROM r"),
    "q55_override": _pairs(", a AS (SELECT * FROM p WHERE prob < 0.9), b AS (SELECT * FROM p WHERE prob > 0.7) SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.pool, b.pool) AS pool, coalesce(b.prob2, a.prob) AS prob, a.prob IS NULL AS is_new FROM a FULL JOIN b ON a.s1 = b.s1 AND a.pool = b.pool"),
    "q56_first_score": _pairs("SELECT s1, pool, CASE WHEN prob2 > 0.8 THEN prob2 ELSE prob END AS prob FROM p"),
    "q57_country_threshold": _pairs(f", {ONE} SELECT one.s1, pool, prob FROM one JOIN s USING (s1) WHERE prob >= CASE country WHEN '1-URGENT' THEN 0.6 WHEN '2-HIGH' THEN 0.4 ELSE 0.0 END"),
    "q58_rarest_terms": f"WITH {REC}, t AS (SELECT DISTINCT id, country, unnest(toks) AS term FROM rec), d AS (SELECT country, term, count(*) AS df FROM t GROUP BY ALL) SELECT id, string_agg(term, ' ' ORDER BY df, term) AS rare FROM (SELECT id, term, df, row_number() OVER (PARTITION BY id ORDER BY df, term) AS rn FROM t JOIN d USING (country, term)) x WHERE rn <= 4 GROUP BY id",
    "q59_partition_choice": f"WITH {ENT}, n AS (SELECT country || '|' || source AS part, count(*) AS n FROM ent GROUP BY 1) SELECT part, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM n) x WHERE b < 0.4 * t",
    "linkage": f"WITH {CAND}, {GOLD_E}, p AS (SELECT s1, pool, round({SIG('10 * len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(list_concat(a.toks, b.toks))) + 2 * score - 7')}, 9) AS prob FROM cand JOIN rec a ON a.id = s1 JOIN rec b ON b.id = pool), s AS (SELECT id AS s1, country FROM ent WHERE is_s1), {ONE}, {_prefix('one', 1.0, 'pre')}, {_per_s1('pre', 'gold')} SELECT country, {REPORT} FROM sc GROUP BY country",
}
