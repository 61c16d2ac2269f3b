"""DuckDB SQL for the queries of measures.py, written independently of the DataFrame code."""

from __future__ import annotations

from kindred.functions import lexicon as L
from kindred.plans.oracle import BLEND, ENT, F05, GOLD_E, LOGIT, ONE, PART, PLAIN, RATIO, REC, S1, _in, _map, _ocr, _pairs, _per_s1, _skeleton, _toks
from kindred.plans.oracle import OCRF as _glue

EMPTY = "[]::VARCHAR[]"
PREP = f"""prep AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS is_s1, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 + p_partkey % 2 END::INTEGER AS source, p_brand AS country, lower(p_name) AS name,
  CASE WHEN p_partkey % 11 = 0 THEN [replace(lower(p_name), ' ', '')] ELSE {PLAIN.format('p_name')} END AS toks, CASE WHEN p_partkey % 11 = 0 THEN [replace(lower(p_name), ' ', '')] ELSE {PLAIN.format('p_name')} END || [lower(p_type)] AS ftoks,
  CASE WHEN p_size % 5 <> 0 THEN [lower(p_type), 'w' || (p_size % 7)] ELSE {EMPTY} END AS words, CASE WHEN p_size % 5 <> 0 THEN [p_size::VARCHAR, (p_partkey % 120)::VARCHAR] ELSE {EMPTY} END AS nums,
  CASE WHEN p_size % 5 <> 0 AND p_partkey % 2 = 0 THEN [(p_size % 6)::VARCHAR] ELSE {EMPTY} END AS units, p_size % 5 <> 0 AS has_addr, CASE p_partkey % 7 WHEN 1 THEN 'corp' WHEN 2 THEN 'ltd' WHEN 3 THEN 'inc' ELSE '' END AS family,
  CASE p_partkey % 5 WHEN 1 THEN ['limited', 'private'] WHEN 2 THEN ['limited'] WHEN 3 THEN ['limited', 'public'] ELSE {EMPTY} END AS legal FROM part)"""
PAIRS = f"""{PREP}, pkeys AS (SELECT id, is_s1, country, 0 AS family, array_to_string(list_sort(toks), ' ') AS key FROM prep UNION SELECT id, is_s1, country, 1, toks[1] FROM prep),
pgood AS (SELECT country, family, key FROM pkeys WHERE NOT is_s1 GROUP BY ALL HAVING count(*) <= 200),
pp AS (SELECT a.id AS s1, b.id AS pool, bit_or(1 << a.family)::INTEGER AS bits, max(round(((a.id * 7 + b.id * 13) % 100) / 100.0, 2)) AS prob FROM pkeys a JOIN pkeys b USING (country, family, key) JOIN pgood USING (country, family, key) WHERE a.is_s1 AND NOT b.is_s1 GROUP BY 1, 2)"""
SIDES = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("name", "source", "country", "toks", "ftoks", "words", "nums", "units", "has_addr", "family", "legal"))
BESIDE = f"{PAIRS}, bs AS (SELECT s1, pool, bits, prob, {SIDES} FROM pp JOIN prep a ON a.id = s1 JOIN prep b ON b.id = pool)"
TRUE = f"{BESIDE}, tr AS (SELECT * FROM bs WHERE a_ftoks[-1] = b_ftoks[-1])"
_set = lambda c: f"list_sort(list_distinct({c}))"
_flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_joined = lambda c: _glue(f"array_to_string({c}, '')")
_inter = lambda a, b: f"len(list_filter(list_distinct({a}), lambda x: list_contains({b}, x)))"
_union = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
_but = lambda a, b: f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"
_jac = lambda a, b, none="0.0": f"CASE WHEN {_union(a, b)} > 0 THEN {_inter(a, b)} / {_union(a, b)} ELSE {none} END"
_uniform = lambda k, seed=42: f"(('0x' || substr(md5({k} || '-{seed}'), 1, 8))::BIGINT / 4294967296.0)"
G = "g AS (SELECT s1, pool FROM p WHERE label = 1)"


def _less(n: str) -> str:
    cut = f"list_transform(range(1, length({n}) + 1), lambda i: CASE WHEN ltrim(substr({n}, 1, i - 1) || substr({n}, i + 1), '0') = '' THEN right(substr({n}, 1, i - 1) || substr({n}, i + 1), 1) ELSE ltrim(substr({n}, 1, i - 1) || substr({n}, i + 1), '0') END)"
    return f"CASE WHEN length({n}) >= 2 THEN list_distinct([{n}] || {cut}) ELSE [{n}] END"


def _sound(w: str, voiced: bool) -> str:
    t = f"regexp_replace(regexp_replace({w}, '[^a-z]', '', 'g'), '[ts]ion', 'sn', 'g')"
    t = f"regexp_replace(regexp_replace(replace({t}, 'tur', 'cur'), 'c([eiy])', 's\\1', 'g'), 'g([eiy])', 'j\\1', 'g')"
    for a, b in L.SOUNDS_2:
        t = f"replace({t}, '{a}', '{b}')"
    if voiced:
        t = f"translate({t}, 'dbg', 'tpk')"
    t = f"regexp_replace({t}, '^[aeiou]', '_')"
    t = f"(substr({t}, 1, 1) || regexp_replace(substr({t}, 2), '[aeiou]', '', 'g'))"
    t = f"array_to_string(list_filter(string_split({t}, ''), lambda c, i: i = 1 OR c <> string_split({t}, '')[i - 1]), '')"
    return f"regexp_replace({t}, '^(..+)s$', '\\1')"


def _tfidf(name: str, terms: str) -> str:
    return f"""{name}_tf AS (SELECT country, id, term, count(*) AS tf FROM (SELECT country, id, unnest({terms}) AS term FROM prep) t GROUP BY ALL),
{name}_df AS (SELECT country, term, count(*) AS df FROM {name}_tf GROUP BY ALL), {name}_most AS (SELECT country, max(df) AS most FROM {name}_df GROUP BY 1),
{name}_idf AS (SELECT country, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {name}_df JOIN {name}_most USING (country) JOIN (SELECT country, count(*) AS n FROM prep GROUP BY 1) c USING (country) WHERE df >= 2 OR most < 2),
{name} AS (SELECT country, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT country, id, term, (1 + ln(tf)) * idf AS w FROM {name}_tf JOIN {name}_idf USING (country, term)) t)"""


GRAMS = "flatten(list_transform(toks, lambda w: list_transform(range(1, greatest(length(w) + 2 - 2, 1) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"
VECTORS = f"{PAIRS}, {_tfidf('lt', GRAMS)}, {_tfidf('pl', 'words || nums')}, comb AS (SELECT country, id, 'n:' || term AS term, w / sqrt(2.0) AS w FROM lt UNION ALL SELECT country, id, 'a:' || term, w / sqrt(2.0) FROM pl)"
NEAR = """near AS (SELECT * FROM (SELECT s1, pool, score, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, pool)::INTEGER AS rank FROM (SELECT a.id AS s1, b.id AS pool, round(sum(a.w * b.w), 9) AS score FROM comb a JOIN comb b USING (country, term) WHERE a.id % 3 = 0 AND b.id % 3 <> 0 GROUP BY 1, 2) x WHERE score > 0.05) y WHERE rank <= 20)"""
_dot = lambda v, alias: f"{alias} AS (SELECT s1, pool, round(sum(a.w * b.w), 9) AS w FROM cand JOIN {v} a ON a.id = s1 JOIN {v} b ON b.id = pool AND a.term = b.term GROUP BY 1, 2)"
SIMS = f"{_dot('lt', 'sn')}, {_dot('pl', 'sa')}, sims AS (SELECT cand.*, coalesce(sn.w, 0.0) AS sn, coalesce(sa.w, 0.0) AS sa FROM cand LEFT JOIN sn USING (s1, pool) LEFT JOIN sa USING (s1, pool))"
GRID = "grid AS (SELECT tau, ratio FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS tau) t CROSS JOIN (SELECT unnest([0.0, 0.5, 0.8])::DOUBLE AS ratio) r)"
CHOSEN = f"{ONE}, {GRID}, ng AS (SELECT s1, count(*) AS n_gold FROM p WHERE label = 1 GROUP BY s1), ob AS (SELECT *, max(prob) OVER (PARTITION BY s1) AS best FROM one)"
EACH = f"each AS (SELECT s.s1, s1half, tau, ratio, coalesce(n_gold, 0) AS n_gold, count(ob.pool) AS n_pred, coalesce(sum(ob.label), 0) AS tp FROM (SELECT *, (s1 % 2)::INTEGER AS s1half FROM s) s CROSS JOIN grid LEFT JOIN ng ON ng.s1 = s.s1 LEFT JOIN ob ON ob.s1 = s.s1 AND ob.prob >= tau AND ob.prob >= ratio * best GROUP BY 1, 2, 3, 4, n_gold)"
RESCUE = f"{RATIO('prob', 'r')}, {G}"


def _ceiling(name: str, condition: str, i: int) -> str:
    return f"sub{i} AS (SELECT p.s1, p.pool FROM p WHERE label = 1 AND {condition}), set{i} AS (SELECT s1, pool FROM r UNION SELECT s1, pool FROM sub{i}), {_per_s1(f'set{i}').replace('sc AS', f'sc{i} AS')}"


def _ctx(c: str) -> str:
    return f"row_number() OVER (PARTITION BY s1 ORDER BY {c} DESC, pool)::INTEGER AS {c}_rank, max({c}) OVER (PARTITION BY s1) AS {c}_max"


ORACLE_SQL: dict[str, str] = {
    "q61_pair_equality": f"WITH {BESIDE} SELECT s1, pool, {_flag('a_name = b_name')} AS n_exact, {_flag(f'{_joined("a_toks")} <> {chr(39)}{chr(39)} AND {_joined("a_toks")} = {_joined("b_toks")}')} AS glue_equal, {_flag(f'len(a_toks) + len(b_toks) > 0 AND {_set("a_toks")} = {_set("b_toks")}')} AS set_equal, {_flag(f'{_set("a_ftoks")} = {_set("b_ftoks")}')} AS full_equal, {_flag('len(a_nums) > 0 AND a_nums = b_nums')} AS num_seq_equal, {_flag(f'len(a_words) > 0 AND {_set("a_words")} = {_set("b_words")}')} AS addr_words_equal, {_flag(f'len(a_words) > 0 AND {_set("a_words")} = {_set("b_words")} AND len(a_nums) > 0 AND a_nums = b_nums')} AS addr_exact, length(a_name)::INTEGER AS len_name_a, length(b_name)::INTEGER AS len_name_b, b_source AS source FROM bs",
    "q62_pair_overlap": f"""WITH {BESIDE}, gl AS (SELECT *, {_joined('a_toks')} AS ga, {_joined('b_toks')} AS gb, {_but('a_ftoks', 'b_ftoks')} AS la, {_but('b_ftoks', 'a_ftoks')} AS lb FROM bs)
SELECT s1, pool, round({_inter('a_toks', 'b_toks')} / len(list_distinct(a_toks)), 6) AS cont_a, round({_inter('a_toks', 'b_toks')} / len(list_distinct(b_toks)), 6) AS cont_b, {_flag('least(length(ga), length(gb)) >= 4 AND (contains(ga, gb) OR contains(gb, ga))')} AS glue_contain,
round(len(list_filter(range(1, least(length(ga), length(gb)) + 1), lambda i: substr(ga, 1, i) = substr(gb, 1, i))) / least(length(ga), length(gb)), 6) AS glue_prefix, round({_jac('a_ftoks', 'b_ftoks')}, 6) AS full_jacc, len(la)::INTEGER AS extra_a_full, len(lb)::INTEGER AS extra_b_full, len(list_filter(lb, lambda t: t IN ('economy', 'standard')))::INTEGER AS b_filler_extra,
round(coalesce(list_min(flatten(list_transform(la, lambda x: list_transform(lb, lambda y: levenshtein(x, y) / greatest(length(x), length(y)))))), 0.0), 6) AS min_char_dist, round({_jac('a_words', 'b_words')}, 6) AS w_jacc FROM gl""",
    "q63_pair_numbers": f"""WITH {BESIDE}, n AS (SELECT *, len(a_nums) > 0 AND len(b_nums) > 0 AS nb, len(a_units) > 0 AND len(b_units) > 0 AS ub, list_has_any(a_nums, b_nums) AS ex, list_has_any(flatten(list_transform(a_nums, lambda n: {_less('n')})), flatten(list_transform(b_nums, lambda n: {_less('n')}))) AS d1, list_has_any(a_units, b_units) AS us, a_nums[1] AS x, b_nums[1] AS y FROM bs)
SELECT s1, pool, len(a_nums)::INTEGER AS a_nnum, len(b_nums)::INTEGER AS b_nnum, {_flag('nb AND ex')} AS num_exact, {_flag('nb AND NOT ex AND d1')} AS num_del1, {_flag('nb AND x = y')} AS num_first_eq, {_flag('nb AND NOT ex AND NOT d1')} AS num_conflict, CASE WHEN nb THEN round(ln(1 + abs(x::DOUBLE - y::DOUBLE)), 6) ELSE -1.0 END AS num_first_absdiff,
{_flag('nb AND x <> y AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x))')} AS num_first_trunc, CASE WHEN nb THEN abs(length(x) - length(y)) ELSE -1 END::INTEGER AS num_first_lendiff, CASE WHEN nb AND length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) ELSE -1 END::INTEGER AS num_first_diffpos,
{_flag(f'nb AND len({_but("b_nums", "a_nums")}) = 0')} AS num_b_subset_a, round(CASE WHEN nb THEN {_jac('a_nums', 'b_nums')} ELSE -1.0 END, 6) AS num_set_jacc, CASE WHEN nb THEN len({_but('b_nums', 'a_nums')}) ELSE -1 END::INTEGER AS num_b_unmatched, {_flag('ub')} AS unit_both, {_flag('ub AND us')} AS unit_share, {_flag('ub AND NOT us')} AS unit_conflict FROM n""",
    "q64_pair_designators": f"""WITH {BESIDE}, f AS (SELECT *, a_family <> '' AS fa, b_family <> '' AS fb, len(list_filter(a_legal, lambda x: x <> 'public')) > 0 AND len(list_filter(b_legal, lambda x: x <> 'public')) > 0 AS lb FROM bs)
SELECT s1, pool, {_flag('fa')} AS legal_a_present, {_flag('fb')} AS legal_b_present, {_flag('fa AND fb AND a_family <> b_family')} AS legal_changed, {_flag('fa AND fb AND a_family <> b_family AND NOT b_has_addr')} AS legal_changed_no_addr, {_flag('fa <> fb AND NOT b_has_addr')} AS legal_asym_no_addr, {_flag("list_contains(a_legal, 'private')")} AS priv_a, {_flag("list_contains(b_legal, 'private')")} AS priv_b,
{_flag("lb AND list_contains(a_legal, 'private') <> list_contains(b_legal, 'private')")} AS priv_conflict, {_flag("lb AND list_contains(a_legal, 'public') <> list_contains(b_legal, 'public')")} AS pub_conflict, {_flag('lb AND a_legal <> b_legal')} AS lseq_diff, {_flag('lb AND a_legal <> b_legal AND NOT b_has_addr')} AS lseq_diff_no_addr FROM f""",
    "q65_pair_decoys": f"""WITH {BESIDE}, k AS (SELECT *, list_distinct(list_transform(a_toks, lambda t: {_skeleton('t')})) AS ta, list_distinct(list_transform(b_toks, lambda t: {_skeleton('t')})) AS tb, list_distinct(list_transform(a_words, lambda t: {_skeleton('t')})) AS wa, list_distinct(list_transform(b_words, lambda t: {_skeleton('t')})) AS wb, len(a_words) > 0 AND len(b_words) > 0 AS aw, len(a_legal) > 0 AND len(b_legal) > 0 AS lg, coalesce(a_nums[1], '') AS x, coalesce(b_nums[1], '') AS y FROM bs), h AS (SELECT *, x <> '' AND y <> '' AS hn FROM k)
SELECT s1, pool, len({_but('tb', 'ta')})::INTEGER AS n_extra_b, len({_but('ta', 'tb')})::INTEGER AS n_extra_a, coalesce(list_max(list_transform({_but('tb', 'ta')}, lambda t: length(t))), 0)::INTEGER AS n_extra_b_len, CASE WHEN aw THEN len({_but('wb', 'wa')}) ELSE -1 END::INTEGER AS a_extra_b, CASE WHEN aw THEN len({_but('wa', 'wb')}) ELSE -1 END::INTEGER AS a_extra_a, round(CASE WHEN aw THEN len({_but('wb', 'wa')}) / len(wb) ELSE -1.0 END, 6) AS a_extra_b_frac,
{_flag('lg')} AS legal_both, CASE WHEN lg THEN {_flag('NOT list_has_any(a_legal, b_legal)')} ELSE -1.0 END AS legal_conflict, CASE WHEN hn THEN {_flag('x <> y AND (starts_with(x, y) OR starts_with(y, x))')} ELSE -1.0 END AS house_prefix, round(CASE WHEN hn THEN ln(1 + abs(x::BIGINT - y::BIGINT)) ELSE -1.0 END, 6) AS house_absdiff, CASE WHEN hn THEN levenshtein(x, y)::DOUBLE ELSE -1.0 END AS house_lev, CASE WHEN hn THEN {_flag('length(x) = length(y)')} ELSE -1.0 END AS house_samelen FROM h""",
    "q66_pair_name_counts": f"WITH {PAIRS}, nc AS (SELECT id, count(*) FILTER (is_s1) OVER (PARTITION BY country, name) AS n1, count(*) FILTER (NOT is_s1) OVER (PARTITION BY country, name) AS n23 FROM prep) SELECT s1, pool, round(ln(1 + a.n1), 6) AS a_name_n1, round(ln(1 + b.n1), 6) AS b_name_n1, round(ln(1 + b.n23), 6) AS b_name_n23, (bits & 1)::DOUBLE AS f_set, ((bits >> 1) & 1)::DOUBLE AS f_pair, ((bits >> 2) & 1)::DOUBLE AS f_glue FROM pp JOIN nc a ON a.id = s1 JOIN nc b ON b.id = pool",
    "q67_invented_names": f"WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN [{_in(L.SYLLABLES).replace('(', '[').replace(')', ']')}[p_partkey % {len(L.SYLLABLES)} + 1] || {_in(L.SYLLABLES).replace('(', '[').replace(')', ']')}[p_partkey * 7 % {len(L.SYLLABLES)} + 1], 'bolt'] ELSE {PLAIN.format('p_name')} END AS w FROM part) SELECT id, round(len(list_filter(w, lambda x: length(x) >= 5 AND regexp_full_match(x, '(?:{'|'.join(L.SYLLABLES)}){{2,}}'))) / len(w), 6) AS share FROM t",
    "q68_token_documents": f"WITH {PREP} SELECT id, array_to_string(list_transform(toks, lambda t: 'n:' || {_skeleton('t')}) || CASE WHEN length(array_to_string(toks, '')) >= 6 THEN ['s:' || array_to_string(toks, '')] ELSE {EMPTY} END || list_transform(words, lambda t: 'a:' || t), ' ') AS terms FROM prep",
    "q69_words_by_sound": f"WITH {REC}, w AS (SELECT CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END AS word FROM (SELECT unnest(toks) AS t FROM rec WHERE is_s1) x), v AS (SELECT word, count(*) AS n FROM w GROUP BY word), k AS (SELECT {_sound('word', False)} AS sound, word, n, false AS voiced FROM v WHERE regexp_full_match(word, '[a-z]+') UNION ALL SELECT {_sound('word', True)}, word, n, true FROM v WHERE regexp_full_match(word, '[a-z]+')) SELECT sound, word, n, voiced FROM (SELECT *, row_number() OVER (PARTITION BY voiced, sound ORDER BY n DESC, word) AS rn FROM k) t WHERE rn <= 8",
    "q71_without_fillers": f"WITH {PART}, t AS (SELECT country, term, count(*) FILTER (is_s1) AS df1, count(*) FILTER (NOT is_s1) AS df2 FROM (SELECT DISTINCT id, is_s1, country, unnest(toks) AS term FROM part_rec) x GROUP BY ALL), c AS (SELECT country, count(*) FILTER (is_s1) AS n1, count(*) FILTER (NOT is_s1) AS n2 FROM part_rec GROUP BY country), f AS (SELECT country, list(term) AS bad FROM t JOIN c USING (country) WHERE df2 >= greatest(5, 0.00075 * n2) AND df2 / n2 >= 1.2 * (df1 + 1) / n1 GROUP BY country) SELECT id, array_to_string(list_filter(toks, lambda x: NOT list_contains(coalesce(bad, {EMPTY}), x)), ' ') AS toks, array_to_string(toks, ' ') AS ftoks FROM part_rec LEFT JOIN f USING (country)",
    "q74_tfidf_vectors": f"WITH {VECTORS} SELECT id, term, round(w, 6) AS w FROM lt",
    "q75_combined_neighbours": f"WITH {VECTORS}, {NEAR} SELECT s1, pool, round(score, 5) AS score, rank FROM near",
    "q76_block_job": f"WITH {VECTORS}, {NEAR}, cand AS (SELECT s1, pool, max(bits) AS bits, bool_or(knn) AS knn FROM (SELECT s1, pool, bits, false AS knn FROM pp UNION ALL SELECT s1, pool, 0, true FROM near) t GROUP BY 1, 2), {SIMS} SELECT s1, pool, bits::INTEGER AS bits, knn, round(sn, 6) AS sn, round(sa, 6) AS sa, false AS no_addr FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(sn + sa, 9) DESC, pool) AS rn FROM sims) t WHERE rn <= 30",
    "q78_pair_similarities": f"WITH {VECTORS}, cand AS (SELECT s1, pool FROM pp), {SIMS} SELECT s1, pool, round(sn, 6) AS sn, round(sa, 6) AS sa FROM sims",
    "q79_candidates_together": f"WITH {PAIRS} SELECT s1, pool, bits, 0 AS exp_sib, 0::BIGINT AS exp_kaddr FROM pp WHERE bits < 3 UNION ALL SELECT s1, pool, 32, 1, s1 % 2 FROM pp WHERE bits = 3",
    "q80_restored_candidates": _pairs(f", {RATIO('prob', 'r')} SELECT r.s1, pool FROM r JOIN s USING (s1) WHERE pool IN (SELECT p_partkey FROM part WHERE p_size <= 45)"),
    "q81_decision_grid": _pairs(f", {CHOSEN}, {EACH} SELECT tau, ratio, round(avg({F05}), 6) AS macro_f05 FROM each GROUP BY ALL"),
    "q82_cross_fit": _pairs(f", {CHOSEN}, {EACH}, m AS (SELECT s1half AS half, tau, ratio, round(avg({F05}), 6) AS f FROM each GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY half ORDER BY f DESC, tau, ratio) AS rn FROM m) t WHERE rn = 1) SELECT m.half, m.tau, m.ratio, b.f AS fitted, m.f AS held_out FROM b JOIN m ON m.half = 1 - b.half AND m.tau = b.tau AND m.ratio = b.ratio"),
    "q84_error_histogram": _pairs(f", {RATIO('prob', 'r')} SELECT kind, CASE WHEN prob <= 0.01 THEN 1 WHEN prob <= 0.05 THEN 2 WHEN prob <= 0.1 THEN 3 WHEN prob <= 0.2 THEN 4 WHEN prob <= 0.3 THEN 5 WHEN prob <= 0.5 THEN 6 WHEN prob <= 0.7 THEN 7 WHEN prob <= 0.9 THEN 8 ELSE 9 END AS bin, count(*) AS n FROM (SELECT p.prob, CASE WHEN label = 1 AND r.s1 IS NULL THEN 'missed' WHEN label = 0 AND r.s1 IS NOT NULL THEN 'wrong' END AS kind FROM p LEFT JOIN r ON r.s1 = p.s1 AND r.pool = p.pool) t WHERE kind IS NOT NULL GROUP BY ALL"),
    "q85_rescue_ceiling": _pairs(f", {RATIO('prob', 'r')}, {_per_s1('r')}, {_ceiling('all', 'true', 1)}, {_ceiling('over 0.3', 'prob >= 0.3', 2)}, {_ceiling('other over 0.8', 'prob2 >= 0.8', 3)} " + " UNION ALL ".join(f"SELECT '{n}' AS subset, (SELECT count(*) FROM sub{i})::BIGINT AS n, round(avg(f05), 6) AS macro_f05, round(avg(f05) - (SELECT avg(f05) FROM sc), 6) AS gain FROM sc{i}" for i, n in ((1, "all"), (2, "over 0.3"), (3, "other over 0.8")))),
    "q86_added_stats": _pairs(", base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) AS rn FROM p WHERE prob >= 0.95) t WHERE rn = 1), other AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY prob2 DESC, s1) AS rn FROM p WHERE prob2 >= 0.8) t WHERE rn = 1), ad AS (SELECT min(s1) AS s1, pool FROM other WHERE prob >= 0.45 AND pool NOT IN (SELECT pool FROM base) GROUP BY pool) SELECT country, count(*) AS n, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0 AND ad.s1 NOT IN (SELECT s1 FROM p WHERE label = 1)) AS fp_single FROM ad JOIN p USING (s1, pool) JOIN s USING (s1) GROUP BY country"),
    "q87_token_changes": f"WITH {TRUE}, x AS (SELECT {_but('a_toks', 'b_toks')} AS l, {_but('b_toks', 'a_toks')} AS r FROM tr) SELECT kind, old, new, count(*) AS n FROM (SELECT 'swapped' AS kind, l[1] AS old, r[1] AS new FROM x WHERE len(l) = 1 AND len(r) = 1 UNION ALL SELECT 'added', '', unnest(r) FROM x WHERE len(l) = 0 UNION ALL SELECT 'lost', unnest(l), '' FROM x WHERE len(r) = 0) t GROUP BY ALL",
    "q88_word_quality": f"WITH {REC}, d AS (SELECT country, term, count(*) AS df FROM (SELECT DISTINCT id, country, unnest(toks) AS term FROM rec) t GROUP BY ALL) SELECT CASE WHEN df < 2 THEN 'under 2' WHEN df < 10 THEN 'under 10' WHEN df < 100 THEN 'under 100' ELSE '100 or more' END AS class, count(*) AS words, sum(df)::BIGINT AS mentions FROM d GROUP BY 1",
    "q89_candidate_quantiles": _pairs(", n AS (SELECT country, s1, count(*) AS n FROM p JOIN s USING (s1) GROUP BY ALL) SELECT country, count(*) AS records, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most FROM n GROUP BY country"),
    "q90_source_crosstab": f"WITH {ENT} SELECT country, count(*) AS n, count(*) FILTER (source = 1) AS n_1, count(*) FILTER (source = 2) AS n_2, count(*) FILTER (source = 3) AS n_3 FROM ent GROUP BY country",
    "q91_same_code": f"WITH {PREP}, c AS (SELECT *, country || '-' || nums[1] AS code FROM prep WHERE has_addr) SELECT s1, pool, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, pool)::INTEGER AS rank FROM (SELECT a.id AS s1, b.id AS pool, round({_jac('a.toks', 'b.toks')}, 9) AS score FROM c a JOIN c b USING (code) WHERE a.is_s1 AND NOT b.is_s1) x) y WHERE rank <= 6",
    "q92_parser_quality": f"WITH {TRUE}, t AS (SELECT *, len(a_nums) > 0 AND len(b_nums) > 0 AS nb FROM tr) SELECT a_country AS country, count(*) AS n, round(avg((NOT b_has_addr)::INT), 6) AS no_addr, round(avg({_jac('a_words', 'b_words')}) FILTER (len(a_words) > 0 AND len(b_words) > 0), 6) AS word_jacc, round(avg(nb::INT), 6) AS num_both, round(avg(list_has_any(a_nums, b_nums)::INT) FILTER (nb), 6) AS num_share, round(avg((a_nums[1] = b_nums[1])::INT) FILTER (nb), 6) AS num_first FROM t GROUP BY 1",
    "q95_universe": "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'any' WHEN n_name IN ('FRANCE', 'CANADA', 'INDIA', 'CHINA') THEN 'dev' ELSE 'check' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 = 0 OR (contains(c_custkey || ' ' || n_name, 'A') AND n_name IN ('FRANCE', 'CANADA', 'INDIA', 'CHINA', 'JAPAN', 'IRAN', 'IRAQ', 'KENYA'))",
    "q96_sampled_s1": f"WITH {S1} SELECT s1, country FROM s ORDER BY {_uniform('s1')}, s1 LIMIT 200",
    "q97_thinned_pairs": _pairs(f", r AS (SELECT *, least(prob, prob2) AS lo, greatest(prob, prob2) AS hi FROM p), o AS (SELECT pool, min(s1) AS owner FROM r WHERE lo >= 0.8 GROUP BY pool), k AS (SELECT r.s1, r.pool, CASE WHEN lo >= 0.8 THEN 'positive' WHEN coalesce(owner <> r.s1, false) AND hi >= 0.6 THEN 'decoy' WHEN NOT coalesce(owner <> r.s1, false) AND hi <= 0.55 THEN 'easy' END AS kind FROM r LEFT JOIN o USING (pool)) SELECT * FROM k WHERE kind IS NOT NULL AND {_uniform("s1 || '-' || pool")} < CASE kind WHEN 'easy' THEN 0.1 WHEN 'decoy' THEN 0.5 ELSE 1.0 END"),
    "q98_training_set": _pairs(f", k AS (SELECT *, CASE WHEN {BLEND} BETWEEN 0.3 AND 0.7 THEN 'contested' WHEN (prob >= 0.5) <> (label = 1) THEN 'hard' ELSE 'easy' END AS kind, {_uniform("s1 || '-' || pool")} AS u FROM p), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY u) AS rn FROM k) SELECT s1, pool, label, kind, CASE WHEN {_uniform('s1', 5)} < 0.2 THEN 'held out' ELSE 'fit' END AS split FROM c WHERE rn <= CASE kind WHEN 'hard' THEN 500 WHEN 'easy' THEN 300 ELSE 1000000000 END"),
    "q99_common_decisions": _pairs(f", {RATIO('prob', 'a')}, {RATIO('prob2', 'b')} SELECT s1, pool FROM a INTERSECT SELECT s1, pool FROM b"),
    "q100_composed": _pairs(f", {RATIO('prob', 'a')}, {RATIO('prob2', 'b')} SELECT a.s1, pool, country FROM a JOIN s USING (s1) WHERE country NOT IN ('1-URGENT', '5-LOW') UNION ALL SELECT b.s1, pool, country FROM b JOIN s USING (s1) WHERE country IN ('1-URGENT', '5-LOW')"),
    "q101_looked_up": _pairs("SELECT p.s1, pool, CASE WHEN prob2 >= 0.5 THEN prob2 ELSE 0.0001 END AS prob FROM p JOIN s USING (s1) WHERE country < '4'"),
    "q102_logit_context": _pairs(f", l AS (SELECT s1, pool, round({LOGIT('prob')}, 9) AS l1, round({LOGIT('prob2')}, 9) AS l2 FROM p), c AS (SELECT *, {_ctx('l1')}, {_ctx('l2')} FROM l) SELECT s1, pool, " + ", ".join(f"round({c}, 6) AS {c}, {c}_rank, round({c}_max, 6) AS {c}_max, round({c}_max - {c}, 6) AS {c}_gap, count(*) FILTER ({c} > 0) OVER (PARTITION BY s1) AS {c}_npos, round(max({c}) FILTER ({c}_rank = 2) OVER (PARTITION BY s1), 6) AS {c}_second, round(max({c}) OVER (PARTITION BY pool) - {c}, 6) AS {c}_pool_gap" for c in ("l1", "l2")) + " FROM c"),
    "q103_competition": _pairs(", q AS (SELECT s1, pool, round(prob + prob2, 6) AS score FROM p), r AS (SELECT *, (row_number() OVER (PARTITION BY s1 ORDER BY score DESC, pool) - 1)::INTEGER AS r1, (row_number() OVER (PARTITION BY pool ORDER BY score DESC, s1) - 1)::INTEGER AS r2, round(max(score) OVER (PARTITION BY s1) - score, 6) AS gap1, round(max(score) OVER (PARTITION BY pool) - score, 6) AS gap2, count(*) OVER (PARTITION BY s1) AS n_c1, count(*) OVER (PARTITION BY pool) AS n_c2 FROM q) SELECT *, CASE WHEN r1 = 0 AND r2 = 0 THEN 1.0 ELSE 0.0 END AS mutual FROM r"),
    "q104_sibling_features": f"""WITH {PAIRS}, k AS (SELECT s1, pool, prob AS p1, (row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, pool) - 1)::INTEGER AS p1_r1, (row_number() OVER (PARTITION BY pool ORDER BY prob DESC, s1) - 1)::INTEGER AS p1_r2, round(max(prob) OVER (PARTITION BY s1) - prob, 6) AS p1_gap1, round(max(prob) OVER (PARTITION BY pool) - prob, 6) AS p1_gap2 FROM pp),
e AS (SELECT a.s1, a.pool, coalesce(max(b.p1), 0.0) AS p1_other_best, count(*) FILTER (b.p1 >= 0.5) AS b_conf_elsewhere FROM k a LEFT JOIN k b ON a.pool = b.pool AND a.s1 <> b.s1 GROUP BY 1, 2),
f AS (SELECT k.*, toks, words, nums, CASE WHEN len(words) + len(nums) > 0 THEN array_to_string(words, ' ') || '|' || array_to_string(nums, ' ') END AS place FROM k JOIN prep ON id = pool WHERE p1 >= 0.05),
cl AS (SELECT place, s1 AS cs, p1 AS cp FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY p1 DESC, s1) AS rn FROM f WHERE p1 >= 0.5 AND p1_r1 = 0 AND place IS NOT NULL) t WHERE rn = 1),
o AS (SELECT a.s1, a.pool, count(*)::DOUBLE AS sib_n, max(b.p1) AS sib_maxp, max({_jac('a.toks', 'b.toks')}) AS sib_name_jacc, max({_flag(f'{_joined("a.toks")} = {_joined("b.toks")}')}) AS sib_glue_eq, max(CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN {_jac('a.words', 'b.words')} ELSE 0.0 END) AS sib_addr_jacc, max({_flag('len(a.nums) > 0 AND a.nums = b.nums')}) AS sib_num_eq, max({_flag(f'len(a.words) > 0 AND {_set("a.words")} = {_set("b.words")} AND a.nums = b.nums')}) AS sib_addr_exact FROM f a JOIN f b ON a.s1 = b.s1 AND a.pool <> b.pool AND b.p1 >= 0.5 GROUP BY 1, 2)
SELECT f.s1, f.pool, p1, p1_r1, p1_gap1, p1_r2, p1_gap2, p1_other_best, b_conf_elsewhere, CASE WHEN cs <> f.s1 THEN cp ELSE 0.0 END AS sib_addr_conflict, {', '.join(f'round(coalesce({c}, 0.0), 6) AS {c}' for c in ('sib_n', 'sib_maxp', 'sib_name_jacc', 'sib_glue_eq', 'sib_addr_jacc', 'sib_num_eq', 'sib_addr_exact'))} FROM f JOIN e USING (s1, pool) LEFT JOIN cl ON cl.place = f.place LEFT JOIN o ON o.s1 = f.s1 AND o.pool = f.pool""",
    "q105_stage_gain": _pairs(f", {RATIO('prob', 'a')}, {RATIO('prob2', 'b')}, {_per_s1('a').replace('sc AS', 'sa AS')}, {_per_s1('b').replace('sc AS', 'sb AS')}, m AS (SELECT (SELECT avg(f05) FROM sa) AS x, (SELECT avg(f05) FROM sb) AS y) SELECT round(x, 6) AS stage1, round(y, 6) AS stage2, round(y - x, 6) AS gain, y - x > 0.0005 AS keep FROM m"),
    "q106_record_texts": f"WITH {PREP} SELECT id, 'query: ' || name || ' | ' || array_to_string(words || nums, ' ') AS text FROM prep",
    "q107_comparison": _pairs(f", {RESCUE} SELECT s.s1, coalesce((SELECT string_agg(pool::VARCHAR, ',' ORDER BY pool) FROM g WHERE g.s1 = s.s1), '') AS truth, coalesce((SELECT string_agg(pool::VARCHAR, ',' ORDER BY pool) FROM r WHERE r.s1 = s.s1), '') AS chosen FROM s"),
    "q108_error_sample": _pairs(f", {RESCUE}, w AS (SELECT 'wrong' AS kind, s1, pool FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.s1 = r.s1 AND g.pool = r.pool)), m AS (SELECT 'missed' AS kind, s1, pool FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE g.s1 = r.s1 AND g.pool = r.pool)), u AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_uniform("s1 || '-' || pool")}, s1 || '-' || pool) AS rn FROM (SELECT * FROM w UNION ALL SELECT * FROM m) t) SELECT kind, s1, pool, a.p_name AS s1_text, b.p_name AS pool_text FROM u LEFT JOIN part a ON a.p_partkey = s1 LEFT JOIN part b ON b.p_partkey = pool WHERE rn <= 20"),
    "q111_house_numbers": f"SELECT p_partkey AS id, array_to_string(list_sort({_less('(p_partkey * 101)::VARCHAR')}), ' ') AS less FROM part",
}

_SHORT = "list_filter({}, lambda t: t NOT IN ('economy', 'standard'))"
_STEM = "list_transform({}, lambda t: CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN regexp_replace(t, 'ies$', 'y') WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN regexp_replace(t, 's$', '') ELSE t END)"
_VERSIONS = {"raw": ("a_ftoks", "b_ftoks"), "no fillers": (_SHORT.format("a_ftoks"), _SHORT.format("b_ftoks")), "stems": (_STEM.format(_SHORT.format("a_ftoks")), _STEM.format(_SHORT.format("b_ftoks"))), "names": ("a_toks", "b_toks")}
ORACLE_SQL["q93_normalisers"] = f"WITH {TRUE}, j AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS version, {_jac(a, b)} AS j FROM tr' for n, (a, b) in _VERSIONS.items())}) SELECT version, round(avg((j = 1)::INT), 6) AS same_set, round(avg(j), 6) AS jaccard, round(avg((j > 0)::INT), 6) AS some, round(avg((j = 0)::INT), 6) AS none FROM j GROUP BY version"
_TRIPLES = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"
ORACLE_SQL["q94_key_recovery"] = f"WITH {TRUE}, g AS (SELECT *, {_joined('a_toks')} AS ga, {_joined('b_toks')} AS gb FROM tr), k AS (SELECT a_country AS country, list_has_any(a_toks, b_toks) AS c1, ga = gb AS c2, substr(ga, 1, 6) = substr(gb, 1, 6) AS c3, {_jac(_TRIPLES.format('ga'), _TRIPLES.format('gb'))} >= 0.3 AS c4 FROM g) SELECT country, count(*) AS n, round(avg(c1::INT), 6) AS shared, round(avg(c2::INT), 6) AS glued, round(avg(c3::INT), 6) AS head, round(avg(c4::INT), 6) AS triples, round(avg((c1 OR c2 OR c3 OR c4)::INT), 6) AS any FROM k GROUP BY country"
_FRAME = f"SELECT id, name || ' mfg | bros of ' || country AS n, array_to_string(nums || words, ' ') AS a, ' ' || country AS c FROM prep"
ORACLE_SQL["q110_frame_views"] = f"""WITH {PREP}, fr AS ({_FRAME}), b AS (SELECT id, a, c, split_part(n, ' | ', 2) AS bar, list_transform({_toks("split_part(n, ' | ', 1)")}, lambda t: coalesce({_map(L.NAME_FORMS)}[{_ocr('t')}], {_ocr('t')})) AS toks, list_filter(list_transform({_toks('a')}, lambda t: coalesce({_map(L.ADDRESS_FORMS)}[t], t)), lambda t: t <> '') AS aw FROM fr),
d AS (SELECT *, list_filter(toks, lambda t: t NOT IN {_in(L.LEGAL)} AND {_skeleton('t')} NOT IN {_in(L.LEGAL_SKELETONS)}) AS core, list_filter({_toks('bar')}, lambda t: t NOT IN {_in(L.LEGAL)}) AS alt FROM b)
SELECT id, array_to_string(toks, ' ') AS name_clean, array_to_string(core, ' ') AS name_core, array_to_string(list_transform(core, lambda t: {_skeleton('t')}), ' ') AS name_skel, array_to_string(core, '') AS name_ns, array_to_string(alt, ' ') AS name_alt, array_to_string(list_transform(alt, lambda t: {_skeleton('t')}), ' ') AS name_alt_skel,
array_to_string(aw, ' ') AS addr_clean, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\b([0-9]{{3}}\\s?[0-9]{{3}}|[0-9]{{5}})\\b', 1), lambda x: regexp_replace(x, '\\s', '', 'g')))), ' ') AS postal, array_to_string(list_sort(list_distinct(regexp_extract_all(a, '[0-9]+'))), ' ') AS nums, '' AS landmarks, lower(trim(c)) AS country_norm FROM d"""
# DuckDB's word borders know ASCII letters only, so other Latin letters are read as x but where they are looked for
_CHECKS = ", ".join(f"round(100 * avg(regexp_matches({c if 'À' in p else f'regexp_replace({c}, {chr(39)}[À-ÿ]{chr(39)}, {chr(39)}x{chr(39)}, {chr(39)}g{chr(39)})'}, '{p}')::INT), 1) AS {k}" for k, (c, p) in L.FIELD_CHECKS.items())
_WORDS = "quantile_cont(len(list_filter(string_split({}, ' '), lambda w: w <> '')), 0.5)"
ORACLE_SQL["q112_field_profile"] = f"WITH {ENT}, {GOLD_E}, m AS (SELECT s1 AS id FROM gold UNION SELECT pool FROM gold), e AS (SELECT *, id IN (SELECT id FROM m) AS matched FROM ent) SELECT source, country, matched, count(*) AS n, {_CHECKS}, round(100 * avg((name = upper(name) AND regexp_matches(name, '[A-Za-z]'))::INT), 1) AS name_all_upper, {_WORDS.format('name')} AS name_words, {_WORDS.format('addr')} AS addr_words FROM e GROUP BY ALL"
ORACLE_SQL["q113_matches_histogram"] = _pairs("SELECT matches, count(*) AS n FROM (SELECT s.s1, count(p.pool) AS matches FROM s LEFT JOIN p ON p.s1 = s.s1 AND label = 1 GROUP BY 1) t GROUP BY 1")
ORACLE_SQL["q114_gold_facts"] = _pairs("SELECT count(*) AS pairs, (SELECT count(*) FROM (SELECT pool FROM p WHERE label = 1 GROUP BY pool HAVING count(DISTINCT s1) > 1) x) AS shared_pool, round(avg((country = (pool % 5 + 1) || '-URGENT')::INT), 6) AS same_country FROM p JOIN s USING (s1) WHERE label = 1")
