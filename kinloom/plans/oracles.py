"""The queries once more as SQL for DuckDB, written apart from the operators."""

from __future__ import annotations

from .. import policy
from ..functions import text
from ..operators.detail import WARNINGS
from .derive import ACCOUNTS, CALLS, RUNS


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SHARED = "(^|[.])(" + "|".join(d.replace(".", "[.]") for d in policy.SHARED_DOMAINS) + ")$"
DEC = "decimal(6,4)"
HOST = "regexp_replace(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '^www[.]', '')"

#: What is left of a profile URL without its host and what follows the name.
NAMED = "regexp_replace(regexp_replace({c}, '^(https?://)?(www[.])?(github[.]com|dev[.]to)/', '', 'i'), '[/?].*$', '')"
#: Accounts with normalized columns, and pairs.
NORM = f"""{ACCOUNTS},
n1 AS (SELECT *, CASE WHEN website_url LIKE 'http%' THEN website_url WHEN website_url LIKE '%.%' THEN 'https://' || website_url END AS u FROM linked),
n2 AS (SELECT *, {HOST} AS h,
  array_to_string(list_filter(regexp_extract_all(lower(display_name), '[a-z0-9]+'), lambda t: t NOT IN {_list(policy.NAME_TITLES)}), ' ') AS nm,
  regexp_replace(lower(regexp_replace(handle, '^@+', '')), '[^a-z0-9_-]+', '', 'g') AS nh,
  CASE WHEN lower(location) NOT IN {_list(policy.VAGUE_LOCATIONS)} THEN lower(location) END AS n_location,
  list_distinct(string_split(topics_text, '|')) AS n_topics,
  CASE k WHEN 0 THEN 'github:gh' || run_id WHEN 1 THEN 'stackoverflow:' || id WHEN 2 THEN 'devto:dt' || run_id ELSE 'hackernews:hn' || run_id END AS n_print,
  CASE WHEN run_id % 6 = 0 AND k = 0 THEN 'devto:dt' || run_id WHEN run_id % 6 = 0 AND k = 2 THEN 'github:gh' || run_id WHEN run_id % 6 = 1 AND k = 0 THEN 'stackoverflow:' || (id + 1) WHEN run_id % 6 = 2 AND k = 3 THEN 'github:gh' || run_id END AS n_link,
  CASE WHEN run_id % 3 = 0 THEN ['ai', 'fastapi'] WHEN run_id % 3 = 1 THEN ['kubernetes', 'platform'] ELSE [] END AS n_words
  FROM n1),
norm AS (SELECT *, nullif(nm, '') AS n_name, nullif(nh, '') AS n_handle,
  CASE WHEN h <> '' AND h NOT IN {_list(policy.PLATFORM_DOMAINS)} AND NOT regexp_matches(h, '{SHARED}') THEN h END AS n_domain,
  list_distinct(list_filter(regexp_split_to_array(n_location, '[ ,/-]+'), lambda t: t <> '')) AS n_places,
  k = 3 AND (display_name IS NULL OR lower(display_name) = lower(handle)) AS hn_handle, coalesce(lower(display_name) = lower(handle), false) AS handle_name FROM n2),
pairs AS (SELECT l.run_id, l.account_key AS lk, r.account_key AS rk, l.k = 3 OR r.k = 3 AS hn, l.n_domain AS l_domain, r.n_domain AS r_domain,
  coalesce(l.n_link = r.n_print, false) AS to_r, coalesce(r.n_link = l.n_print, false) AS to_l, coalesce(length(l.n_handle) >= 3 AND l.n_handle = r.n_handle, false) AS same_handle,
  l.n_location AS l_loc, r.n_location AS r_loc, list_intersect(l.n_places, r.n_places) AS places, list_sort(list_intersect(l.n_words, r.n_words)) AS words, list_intersect(l.n_topics, r.n_topics) AS topics,
  l.n_name AS l_name, r.n_name AS r_name, l.handle_name OR r.handle_name AS handle_name, l.email_hash AS l_hash, r.email_hash AS r_hash, l.email_domain AS l_mail, r.email_domain AS r_mail,
  list_filter(l.n_topics, lambda t: t NOT IN {_list(policy.GENERIC_TOPICS)}) AS l_top, list_filter(r.n_topics, lambda t: t NOT IN {_list(policy.GENERIC_TOPICS)}) AS r_top
  FROM norm l JOIN norm r ON l.run_id = r.run_id AND l.account_key < r.account_key)"""

#: A name test of two normalized names: shared meaningful tokens.
SHARED_TOKENS = "list_filter(list_intersect(string_split({a}, ' '), string_split({b}, ' ')), lambda t: length(t) > 1 AND t NOT IN " + _list(policy.WEAK_NAMES) + ")"
PARTIAL = "{a} <> {b} AND (len(sh) >= 2 OR (len(sh) = 1 AND length(sh[1]) >= 8 AND (len(list_distinct(string_split({a}, ' '))) = 1 OR len(list_distinct(string_split({b}, ' '))) = 1)))"


def _row(signal: str, rest: str) -> str:
    return f"SELECT run_id, '{signal}' AS signal, '{policy.GROUPS[signal]}' AS signal_group, cast({policy.WEIGHTS[signal]} AS {DEC}) AS weight, {rest}"


#: The names of the derived accounts conflict just where one of them is the odd name.
ODD = "zzyzx qwvkj"
EVIDENCE = f"""{NORM},
asked AS (SELECT a.*, {NAMED.format(c="lower(q.github)")} AS q_github, {NAMED.format(c="lower(q.devto)")} AS q_devto, lower(q.name) AS q_name, q.email_hash AS q_hash, q.email_domain AS q_mail, {SHARED_TOKENS.format(a="lower(q.name)", b="a.n_name")} AS sh FROM norm a JOIN requests q USING (run_id)),
ev AS (
  {_row("input_handle_match", "account_key, cast(NULL AS string) AS other_key FROM asked WHERE (k = 0 AND q_github IN (user_id, lower(handle))) OR (k = 2 AND q_devto IN (user_id, lower(handle)))")}
  UNION ALL {_row("exact_name_match", "account_key, NULL FROM asked WHERE NOT hn_handle AND n_name = q_name")}
  UNION ALL {_row("partial_name_match", f"account_key, NULL FROM asked WHERE NOT hn_handle AND {PARTIAL.format(a='n_name', b='q_name')}")}
  UNION ALL {_row("email_hint_match", "account_key, NULL FROM asked WHERE email_hash = q_hash")}
  UNION ALL {_row("email_domain_match", "account_key, NULL FROM asked WHERE email_domain = q_mail")}
  UNION ALL {_row("same_website", "lk, rk FROM pairs WHERE l_domain = r_domain")}
  UNION ALL {_row("direct_profile_link", "lk, rk FROM pairs WHERE to_r")}
  UNION ALL {_row("direct_profile_link", "rk, lk FROM pairs WHERE to_l")}
  UNION ALL {_row("reciprocal_profile_link", "lk, rk FROM pairs WHERE to_l AND to_r")}
  UNION ALL {_row("similar_handle", "lk, rk FROM pairs WHERE same_handle")}
  UNION ALL {_row("same_location", "lk, rk FROM pairs WHERE l_loc = r_loc")}
  UNION ALL {_row("location_overlap", "lk, rk FROM pairs WHERE l_loc <> r_loc AND len(places) > 0")}
  UNION ALL {_row("bio_keyword_overlap", "lk, rk FROM pairs WHERE len(words) >= 2")}
  UNION ALL {_row("topic_overlap", "lk, rk FROM pairs WHERE len(topics) >= 2")}),
cf AS (
  SELECT run_id, 'name_conflict' AS conflict, 'name_conflict' AS basis, 'high' AS severity, cast(-0.25 AS {DEC}) AS penalty, lk, rk FROM pairs WHERE NOT hn AND NOT handle_name AND l_name <> r_name AND (l_name = '{ODD}' OR r_name = '{ODD}') AND contains(l_name, ' ') AND contains(r_name, ' ')
  UNION ALL SELECT run_id, 'website_conflict', 'website_conflict', 'low', -0.05, lk, rk FROM pairs WHERE l_domain <> r_domain AND NOT to_l AND NOT to_r
  UNION ALL SELECT run_id, 'location_conflict', 'location_conflict', 'low', -0.10, lk, rk FROM pairs WHERE l_loc <> r_loc AND len(places) = 0
  UNION ALL SELECT run_id, 'email_conflict', 'email_hash', 'high', -0.35, lk, rk FROM pairs WHERE l_hash <> r_hash
  UNION ALL SELECT run_id, 'email_conflict', 'email_domain', 'medium', -0.12, lk, rk FROM pairs WHERE (l_hash IS NULL OR r_hash IS NULL) AND l_mail <> r_mail AND l_mail NOT IN {_list(policy.GENERIC_EMAIL_DOMAINS)} AND r_mail NOT IN {_list(policy.GENERIC_EMAIL_DOMAINS)}
  UNION ALL SELECT run_id, 'topic_mismatch', 'topic_mismatch', 'low', -0.05, lk, rk FROM pairs WHERE NOT hn AND len(l_top) >= 6 AND len(r_top) >= 6 AND len(list_intersect(l_top, r_top)) = 0)"""

CAP = "CASE signal_group " + " ".join(f"WHEN '{g}' THEN {v}" for g, v in policy.CAPS.items()) + " END"
SCORES = f"""{EVIDENCE},
ag AS (SELECT run_id, account_key, signal_group, max(least(weight, cast({CAP} AS {DEC}))) AS applied, count(*) AS signals FROM ev WHERE other_key IS NULL GROUP BY ALL),
asum AS (SELECT run_id, account_key, sum(applied) AS positive, list_sort(list(signal_group)) AS groups FROM ag GROUP BY ALL),
ascore AS (SELECT n.run_id, n.account_key, coalesce(positive, 0) AS positive, coalesce(groups, []) AS groups, least(0.97, coalesce(positive, 0)) AS confidence, list_sort(list_intersect(coalesce(groups, []), ['input_identifier', 'email'])) AS strong_groups FROM norm n LEFT JOIN asum USING (run_id, account_key)),
pe AS (SELECT *, least(account_key, other_key) AS lk, greatest(account_key, other_key) AS rk FROM ev WHERE other_key IS NOT NULL),
pg AS (SELECT run_id, lk, rk, signal_group, max(least(weight, cast({CAP} AS {DEC}))) AS applied, count(*) AS signals FROM pe GROUP BY ALL),
psum AS (SELECT run_id, lk, rk, sum(applied) AS positive, list_sort(list(signal_group)) AS groups, sum(signals) AS signals FROM pg GROUP BY ALL),
ct AS (SELECT run_id, lk, rk, conflict, min(penalty) AS penalty, bool_or(severity = 'high') AS blocks, bool_or(basis = 'email_hash') AS hash FROM cf GROUP BY ALL),
csum AS (SELECT run_id, lk, rk, greatest(sum(penalty), -0.95) AS penalty, count(*) AS conflicts, list_sort(list(conflict)) AS conflict_types, list_sort(coalesce(list(conflict) FILTER (blocks), [])) AS blocking_types, bool_or(hash) AS hash_conflict FROM ct GROUP BY ALL),
p1 AS (SELECT p.run_id, p.lk, p.rk, p.hn, coalesce(positive, 0) AS positive, coalesce(penalty, 0) AS penalty, coalesce(groups, []) AS groups, cast(coalesce(signals, 0) AS bigint) AS signals, cast(coalesce(conflicts, 0) AS bigint) AS conflicts, coalesce(conflict_types, []) AS conflict_types, coalesce(blocking_types, []) AS blocking_types, coalesce(hash_conflict, false) AS hash_conflict FROM pairs p LEFT JOIN psum USING (run_id, lk, rk) LEFT JOIN csum USING (run_id, lk, rk)),
p2 AS (SELECT *, least(0.97, greatest(0, positive + penalty)) AS confidence, list_sort(list_intersect(groups, ['website', 'profile_link', 'email'])) AS strong_groups, lk || '|' || rk AS pair_key FROM p1),
ps AS (SELECT *, len(groups) > 0 AND len(strong_groups) = 0 AS weak_only, len(blocking_types) > 0 AS blocking,
  hash_conflict OR (list_contains(conflict_types, 'name_conflict') AND list_contains(conflict_types, 'website_conflict') AND confidence < 0.60) OR (len(list_intersect(conflict_types, ['email_conflict', 'name_conflict', 'website_conflict'])) >= 2 AND confidence < 0.50) AS rejects FROM p2)"""

LIKED = "(confidence, len(strong_groups), len(groups), -conflicts, positive, -abs(penalty), pair_key)"
DECIDED = f"""{SCORES},
anch AS (SELECT DISTINCT run_id, account_key FROM ev WHERE signal IN ('input_handle_match', 'email_hint_match')),
ends AS (SELECT *, lk AS account_key, rk AS other FROM ps UNION ALL SELECT *, rk, lk FROM ps),
e2 AS (SELECT e.*, a.account_key IS NOT NULL AS to_anchor, len(list_intersect(s.groups, ['name', 'email'])) > 0 AS other_identity FROM ends e LEFT JOIN anch a ON a.run_id = e.run_id AND a.account_key = e.other LEFT JOIN ascore s ON s.run_id = e.run_id AND s.account_key = e.other),
r_any AS (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY run_id, account_key ORDER BY confidence DESC, len(strong_groups) DESC, len(groups) DESC, conflicts, positive DESC, abs(penalty), pair_key DESC) = 1),
r_best AS (SELECT * FROM e2 WHERE to_anchor QUALIFY row_number() OVER (PARTITION BY run_id, account_key ORDER BY confidence DESC, len(strong_groups) DESC, len(groups) DESC, conflicts, positive DESC, abs(penalty), pair_key DESC) = 1),
r_block AS (SELECT * FROM e2 WHERE to_anchor AND (blocking OR rejects OR (conflicts > 0 AND confidence < 0.60)) QUALIFY row_number() OVER (PARTITION BY run_id, account_key ORDER BY len(blocking_types) DESC, rejects DESC, conflicts DESC, abs(penalty) DESC, pair_key DESC) = 1),
r_trouble AS (SELECT * FROM e2 WHERE to_anchor AND (blocking OR rejects) QUALIFY row_number() OVER (PARTITION BY run_id, account_key ORDER BY len(blocking_types) DESC, abs(penalty) DESC, pair_key DESC) = 1),
d1 AS (SELECT n.run_id, n.account_key, n.source, s.confidence AS score, s.groups AS a_groups, a.account_key IS NOT NULL AS is_anchor, (SELECT count(*) FROM anch x WHERE x.run_id = n.run_id) AS n_anchors,
  coalesce(n.n_name = '{ODD}', false) AND contains(lower(q.name), ' ') AND NOT list_contains(s.groups, 'email') AS gate, len(list_intersect(s.groups, ['name', 'email'])) > 0 AS identity,
  x.confidence AS x_conf, x.blocking OR x.rejects AS x_bad, x.weak_only OR len(x.strong_groups) = 0 AS x_weak, b.confidence AS b_conf, b.rejects AS b_rejects, b.weak_only AS b_weak, len(b.groups) AS b_groups, len(b.strong_groups) AS b_strong, b.blocking AS b_blocking, b.signals AS b_signals, b.conflicts AS b_conflicts,
  k.confidence AS k_conf, k.rejects AS k_rejects, t.pair_key AS t_key, t.other_identity AS t_identity, x.pair_key AS x_key, b.pair_key AS b_key, k.pair_key AS k_key
  FROM norm n JOIN requests q USING (run_id) JOIN ascore s USING (run_id, account_key) LEFT JOIN anch a USING (run_id, account_key) LEFT JOIN r_any x USING (run_id, account_key) LEFT JOIN r_best b USING (run_id, account_key) LEFT JOIN r_block k USING (run_id, account_key) LEFT JOIN r_trouble t USING (run_id, account_key)),
d2 AS (SELECT *, greatest(score, coalesce(x_conf, 0)) AS any_conf, greatest(score, b_conf) AS top_conf, greatest(b_conf, k_conf) AS both_conf, CASE
  WHEN is_anchor AND gate THEN 1 WHEN is_anchor AND n_anchors > 1 AND t_key IS NOT NULL AND NOT (identity AND NOT coalesce(t_identity, false)) THEN 2 WHEN is_anchor THEN 3 WHEN gate THEN 4
  WHEN n_anchors = 0 AND x_bad THEN 5 WHEN n_anchors = 0 AND x_weak THEN 6 WHEN n_anchors = 0 AND greatest(score, coalesce(x_conf, 0)) >= 0.60 THEN 7 WHEN n_anchors = 0 THEN 8 WHEN b_key IS NULL THEN 9
  WHEN b_rejects THEN 10 WHEN k_rejects THEN 11 WHEN k_key IS NOT NULL THEN 12 WHEN b_conf >= 0.85 AND NOT b_weak AND b_groups >= 2 AND b_strong > 0 AND NOT b_blocking THEN 13
  WHEN b_conf >= 0.60 OR score >= 0.60 OR b_signals > 0 OR b_conflicts > 0 THEN 14 ELSE 15 END AS rule FROM d1),
decided AS (SELECT *, CASE WHEN rule IN (3, 13) THEN 'auto_match' WHEN rule IN (1, 2, 7, 12, 14) THEN 'needs_review' ELSE 'reject' END AS decision,
  CASE WHEN rule IN (1, 2, 12) THEN 'blocking_conflict_review' WHEN rule = 3 THEN 'anchor_input' WHEN rule IN (4, 5, 10, 11) THEN 'rejected_conflict' WHEN rule IN (6, 15) THEN 'rejected_weak_only' WHEN rule = 7 THEN 'no_anchor_review' WHEN rule IN (8, 9) THEN 'rejected_no_support' WHEN rule = 13 THEN 'strong_anchor_pair' ELSE 'ambiguous_anchor_pair' END AS basis,
  CASE WHEN rule IN (3, 13) THEN 'low' WHEN rule IN (7, 14) THEN 'medium' ELSE 'high' END AS risk,
  cast(CASE WHEN rule IN (1, 2, 3, 4, 9) THEN score WHEN rule IN (5, 6, 7, 8) THEN any_conf WHEN rule IN (10, 13) THEN b_conf WHEN rule = 11 THEN k_conf WHEN rule = 12 THEN both_conf ELSE top_conf END AS {DEC}) AS evidence_confidence,
  cast(CASE WHEN rule = 1 THEN greatest(score, 0.60) WHEN rule = 3 THEN greatest(score, 0.85) WHEN rule IN (2, 4) THEN score WHEN rule = 9 THEN 0 WHEN rule IN (5, 6, 7, 8) THEN any_conf WHEN rule IN (10, 13) THEN b_conf WHEN rule = 11 THEN k_conf WHEN rule = 12 THEN both_conf ELSE top_conf END AS {DEC}) AS decision_confidence,
  CASE WHEN gate OR is_anchor THEN NULL WHEN n_anchors = 0 THEN x_key WHEN rule = 12 THEN k_key WHEN b_rejects THEN b_key WHEN k_key IS NOT NULL THEN k_key ELSE b_key END AS shown FROM d2),
links AS (SELECT *, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'needs_review' THEN 'possible_alias' ELSE CASE WHEN is_anchor THEN 'primary' ELSE 'secondary' END END AS relationship,
  CASE decision WHEN 'reject' THEN 'rejected' WHEN 'needs_review' THEN 'needs_review' ELSE CASE WHEN is_anchor THEN 'claimed_by_input' ELSE 'likely_same_person' END END AS verification FROM decided)"""


def _rank(ranks: dict[str, int]) -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"


BUNDLES = f"""{DECIDED},
b0 AS (SELECT l.run_id, l.account_key, l.source, l.relationship, l.decision_confidence AS confidence, l.evidence_confidence, n.handle, n.display_name, n.location, n.website_url, n.bio, n.topics_text, CASE WHEN l.evidence_confidence > 0 THEN l.evidence_confidence ELSE l.decision_confidence END AS fc,
  CASE l.relationship WHEN 'primary' THEN 100 ELSE 80 END AS rel, {_rank(policy.SOURCE_PRIORITY).replace("source", "l.source", 1)} AS sp FROM links l JOIN norm n USING (run_id, account_key) WHERE l.decision = 'auto_match'),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fc DESC, sp DESC, account_key) AS br FROM b0),
nm0 AS (SELECT *, display_name AS value, {_rank(policy.NAME_PRIORITY)} AS prio, regexp_replace(lower(display_name), '[^a-z0-9]', '', 'g') AS nkey, regexp_replace(lower(handle), '[^a-z0-9]', '', 'g') AS hkey FROM b WHERE display_name IS NOT NULL),
nm1 AS (SELECT * FROM nm0 WHERE nkey <> hkey AND NOT (NOT contains(value, ' ') AND length(value) <= 16 AND (regexp_matches(value, '[0-9]') OR (lower(value) = value AND upper(value) <> value)))),
nm2 AS (SELECT run_id, nkey, count(*) AS n, max(fc) AS conf, max(rel) AS relg, max(prio) AS priog, max(length(value)) AS len FROM nm1 GROUP BY ALL),
nm3 AS (SELECT * FROM nm2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, conf DESC, relg DESC, priog DESC, len DESC, nkey) = 1),
nm4 AS (SELECT a.*, g.n, g.conf FROM nm1 a JOIN nm3 g USING (run_id, nkey) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY length(value) DESC, fc DESC, rel DESC, prio DESC, lower(value), br) = 1),
hd AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY run_id, lower(handle)) AS many FROM b) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY many DESC, rel DESC, sp DESC, fc DESC, length(handle) DESC, lower(handle), br) = 1),
c_name AS (SELECT r.run_id, coalesce(n.value, h.handle) AS display_name, CASE WHEN n.value IS NULL THEN 'fallback_best_handle' WHEN n.n > 1 THEN 'repeated_real_name' ELSE 'best_real_name_by_source_priority' END AS name_strategy, cast(CASE WHEN n.value IS NOT NULL THEN least(0.97, n.conf) WHEN h.fc IS NOT NULL THEN least(0.50, h.fc) ELSE 0 END AS {DEC}) AS name_confidence FROM (SELECT DISTINCT run_id FROM b) r LEFT JOIN nm4 n USING (run_id) LEFT JOIN hd h USING (run_id)),
lo1 AS (SELECT *, trim(regexp_replace(replace(replace(lower(location), '.', ''), ',', ' '), ' +', ' ', 'g')) AS lkey FROM b WHERE location IS NOT NULL),
lo2 AS (SELECT run_id, lkey, count(*) AS n, max(fc) AS conf, max(rel) AS relg, max(sp) AS priog, min(br) AS f FROM lo1 GROUP BY run_id, lkey QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, conf DESC, relg DESC, priog DESC, f) = 1),
c_location AS (SELECT run_id, location, cast(least(0.97, fc) AS double) AS location_confidence FROM lo1 JOIN lo2 USING (run_id, lkey) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sp DESC, rel DESC, fc DESC, br) = 1),
we0 AS (SELECT *, CASE WHEN website_url LIKE 'http%' THEN website_url ELSE 'https://' || website_url END AS u FROM b WHERE website_url IS NOT NULL),
we1 AS (SELECT *, {HOST} AS dom FROM we0),
we2 AS (SELECT *, 'https://' || dom || rtrim(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/') AS value, regexp_matches(dom, '{SHARED}') AS generic FROM we1 WHERE NOT regexp_matches(dom, '(^|[.])(github[.]com|dev[.]to|stackoverflow[.]com)$')),
we3 AS (SELECT * FROM we2 QUALIFY generic = bool_and(generic) OVER (PARTITION BY run_id)),
we4 AS (SELECT run_id, dom, count(*) AS n, max(fc) AS conf, max(rel) AS relg, max(sp) AS priog, min(br) AS f FROM we3 GROUP BY run_id, dom QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, conf DESC, relg DESC, priog DESC, f) = 1),
c_website AS (SELECT run_id, value AS website, cast(least(0.97, fc) AS double) AS website_confidence FROM we3 JOIN we4 USING (run_id, dom) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sp DESC, rel DESC, fc DESC, br) = 1),
bi AS (SELECT *, CASE WHEN length(bio) BETWEEN 30 AND 220 THEN 30 WHEN length(bio) > 220 THEN 20 ELSE 10 END + CASE WHEN regexp_matches(lower(bio), 'python|fastapi|ai|backend|data|open source') THEN 20 ELSE 0 END AS q, {_rank(policy.BIO_PRIORITY)} AS prio FROM b WHERE length(bio) >= 18),
c_bio AS (SELECT run_id, bio, cast(least(0.97, fc) AS double) AS bio_confidence FROM bi QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY q DESC, rel DESC, prio DESC, fc DESC, length(bio) DESC, br) = 1),
sk AS (SELECT run_id, term, sum(100 + sp) AS points, count(DISTINCT account_key) AS n_sources FROM (SELECT run_id, account_key, sp, unnest(string_split(topics_text, '|')) AS term FROM b) WHERE length(term) >= 2 GROUP BY ALL),
c_skills AS (SELECT run_id, upper(term[1]) || term[2:] AS skill, points / 100 AS weight, n_sources, row_number() OVER (PARTITION BY run_id ORDER BY points DESC, n_sources DESC, term) AS skill_rank FROM sk QUALIFY skill_rank <= 30),
top_skills AS (SELECT run_id, string_agg(skill, ', ' ORDER BY skill_rank) AS skills FROM c_skills GROUP BY ALL),
per AS (SELECT run_id, count(*) AS n_accounts, max(confidence) AS top_link, max(evidence_confidence) AS top_ev, max(fc) AS top_fc FROM b GROUP BY ALL),
c_profile AS (SELECT r.run_id, display_name, name_strategy, location, website, bio, coalesce(bio, 'Developer focused on ' || array_to_string(string_split(skills, ', ')[1:3], ', ')) AS headline, skills, coalesce(n_accounts, 0) AS n_accounts, CASE WHEN n_accounts IS NULL THEN 'uncertain'
  WHEN n_accounts >= 2 AND top_link >= 0.85 AND top_ev >= 0.60 AND (coalesce(name_confidence >= 0.75, false)::int + coalesce(location_confidence >= 0.75, false)::int + coalesce(website_confidence >= 0.75, false)::int + coalesce(bio_confidence >= 0.75, false)::int + coalesce(skills IS NOT NULL AND top_fc >= 0.75, false)::int + coalesce(CASE WHEN bio IS NOT NULL THEN bio_confidence >= 0.75 ELSE skills IS NOT NULL AND top_fc >= 0.75 END, false)::int) >= 2 THEN 'high' ELSE 'medium' END AS level
  FROM (SELECT DISTINCT run_id FROM links) r LEFT JOIN per USING (run_id) LEFT JOIN c_name USING (run_id) LEFT JOIN c_location USING (run_id) LEFT JOIN c_website USING (run_id) LEFT JOIN c_bio USING (run_id) LEFT JOIN top_skills USING (run_id))"""

FAILED = "(status_code IS NULL OR status_code >= 400 OR error_message IS NOT NULL)"
DBL = lambda *names: ", ".join(f"cast({n} AS double) AS {n}" for n in names)
TXT = lambda *names: ", ".join(f"array_to_string({n}, ',') AS {n}" for n in names)
WORDS = f"list_filter(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), '[a-zA-Z][a-zA-Z0-9+#.-]{{1,30}}'), lambda w: w NOT IN {_list(policy.TOPIC_STOPWORDS)})"
URL_N = """(SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '') AS h, rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS p,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: lower(string_split(x, '=')[1]) || '=' || coalesce(string_split(x, '=')[2], '')), lambda x: regexp_matches(x, '^[^=]*=.+$') AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN """ + _list(policy.TRACKING_PARAMS) + """), '&') AS q FROM pages)"""

#: The entities that pages have.
UNESCAPED = "replace(replace(replace(replace({x}, '&quot;', chr(34)), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&')"
SPACED = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
LISTED = "CASE WHEN len(groups) > 0 THEN 'Counted groups of evidence: ' || array_to_string(groups, ', ') || '.' ELSE '{none}' END"
CAPPED = "CASE WHEN {x} > 0.97 THEN 'The sum was more than may count and is held at 0.97.' END"
WEAK = "(SELECT y = '' OR y IN {w} OR (regexp_matches(y, '^(hi|hello)[ ,]') AND contains(y, ' ') AND (regexp_replace(y, '^[^ ]+ ', '') IN {w} OR regexp_matches(regexp_replace(y, '^[^ ]+ ', ''), '^i(.m| am) a developer'))) OR regexp_matches(y, '^welcome( to|!)') FROM (SELECT trim(lower({x}), ' ,.!?') AS y))"
ORACLES = {
    "health_profile_metrics": f"WITH {RUNS} SELECT count(*) AS total_runs, count(*) FILTER (status = 'resolved') AS resolved_runs, count(*) FILTER (status = 'partial') AS partial_runs, count(*) FILTER (status = 'failed') AS failed_runs, coalesce(avg(duration_ms) FILTER (status IN ('resolved', 'partial')), 0.0) AS avg_duration_ms FROM runs",
    "health_api_calls": f"WITH {CALLS} SELECT s.source, coalesce(count(c.event_id), 0) AS total_calls, count(c.event_id) FILTER {FAILED.replace('(', '(WHERE ', 1)} AS error_calls, coalesce(avg(duration_ms), 0.0) AS avg_ms FROM (VALUES ('github'), ('stackoverflow'), ('devto'), ('hackernews')) s(source) LEFT JOIN calls c ON c.source = s.source GROUP BY s.source",
    "health_latest_rate_limit": f"WITH {CALLS} SELECT event_id, rate_limit_remaining FROM calls WHERE source = 'github' AND rate_limit_remaining IS NOT NULL ORDER BY created_at DESC, event_id DESC LIMIT 1",
    "health_llm_usage": "WITH t AS (SELECT CASE WHEN length(trim(text)) = 0 THEN 0 ELSE greatest(1, cast(floor(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) * 16 / 10) AS int), cast(floor(length(text) / 4) AS int)) END AS n FROM conversations WHERE role = 'assistant') SELECT count(*) AS summaries, cast(coalesce(sum(n), 0) AS bigint) AS output_tokens, cast(max(n) AS int) AS longest FROM t",
    "api_metrics_by_source": f"WITH {CALLS} SELECT source, count(*) AS calls, count(*) FILTER {FAILED.replace('(', '(WHERE ', 1)} AS failures, round(coalesce(avg(duration_ms), 0), 2) AS avg_ms, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_call FROM calls WHERE source <> 'gemini' GROUP BY source",
    "latest_call_per_source": f"WITH {CALLS} SELECT source, event_id, status_code FROM calls QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at DESC, event_id DESC) = 1",
    "llm_metadata_json_sums": f"WITH {CALLS}, k AS (SELECT source, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM calls) SELECT source, cast(sum(coalesce(nullif(k, 0), 1)) AS bigint) AS k_sum, count(*) FILTER (k IS NULL) AS k_missing FROM k GROUP BY source",
    "rolling_rate_window": f"WITH {CALLS} SELECT event_id, source, count(*) OVER (PARTITION BY source ORDER BY created_at RANGE BETWEEN INTERVAL 30 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM calls",
    "call_spacing_violations": f"WITH {CALLS}, g AS (SELECT event_id, source, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY source ORDER BY created_at, event_id) AS gap_us FROM calls) SELECT * FROM g WHERE gap_us < 12000000",
    "tumbling_activity": f"WITH {CALLS} SELECT epoch_us(date_trunc('hour', created_at)) // 1000000 AS start_s, source, count(*) AS calls FROM calls GROUP BY ALL",
    "sliding_activity": f"WITH {CALLS}, w AS (SELECT source, epoch_us(date_trunc('hour', created_at)) // 1000000 - unnest([0, 3600]) AS start_s FROM calls) SELECT start_s, source, count(*) AS calls FROM w GROUP BY ALL",
    "session_activity": f"WITH {CALLS}, g AS (SELECT source, epoch_us(created_at) AS t, CASE WHEN epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY source ORDER BY created_at) < 600000000 THEN 0 ELSE 1 END AS new FROM calls), s AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT min(t) AS start_us, source, count(*) AS calls FROM s GROUP BY source, n",
    "retry_policy": f"WITH {CALLS}, r AS (SELECT event_id, status_code, event_id % 3 + 1 AS a, CASE WHEN status_code IS NOT NULL AND event_id % 5 < 3 THEN event_id % 8 END AS after, coalesce(status_code IS NOT NULL AND rate_limit_remaining % 3 = 0 AND event_id % 2 = 0, false) AS spent FROM calls WHERE {FAILED}), w AS (SELECT event_id, CASE WHEN status_code IS NULL THEN 'timeout' WHEN status_code = 404 THEN 'not_found' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 400 THEN 'api_error' END AS kind, (status_code IS NULL OR status_code IN (408, 429, 500, 502, 503, 504)) AND a < 3 AND NOT spent AND NOT (coalesce(status_code, 0) = 429 AND coalesce(after, 0) > 3) AS again, a, after FROM r) SELECT event_id, kind, again, CASE WHEN again THEN least(3.0::double, coalesce(after::double, 0.5::double * pow(2, a - 1))) END AS wait_s FROM w",
    "stream_watermark_counts": "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start_s, event_type, count(*) AS calls FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "account_keys": f"WITH {ACCOUNTS} SELECT run_id, lower(source || ':' || coalesce(user_id, handle)) AS account_key FROM accounts",
    "upsert_latest_account": f"WITH {ACCOUNTS} SELECT lower(handle) AS handle_key, account_key, id AS version FROM linked QUALIFY row_number() OVER (PARTITION BY lower(handle) ORDER BY id DESC) = 1",
    "raw_record_grouping": f"WITH {ACCOUNTS}, r AS (SELECT source, CASE WHEN id % 3 < 2 THEN user_id END AS uid, CASE WHEN id % 3 > 0 THEN lower(handle) END AS hd, id FROM accounts), al AS (SELECT source, hd, uid AS alias FROM r WHERE uid IS NOT NULL AND hd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, hd ORDER BY id DESC) = 1) SELECT source, coalesce('id:' || coalesce(uid, alias), 'handle:' || hd, 'raw:' || id) AS account_group, count(*) AS n_records FROM r LEFT JOIN al USING (source, hd) GROUP BY ALL",
    "normalize_raw_accounts": f"WITH {ACCOUNTS} SELECT account_key, display_name, array_to_string(list_transform(string_split(topics_text, '|'), lambda t: lower(t)), ',') AS topics, profile_url FROM linked WHERE k = 0",
    "payload_hash_duplicates": "SELECT sha256(text) AS payload_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "url_normalize": f"SELECT page_id, s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_n FROM {URL_N}",
    "website_domain": f"WITH {NORM} SELECT account_key, run_id, n_domain AS domain FROM norm",
    "profile_fingerprint": f"WITH {NORM} SELECT account_key, run_id, n_print AS own, coalesce(n_link, '') AS links FROM norm",
    "html_to_text": f"SELECT page_id, sha256({SPACED.format(x=UNESCAPED.format(x="regexp_replace(" + SPACED.format(x=UNESCAPED.format(x=SPACED.format(x="html"))) + ", '<[^>]+>', ' ', 'g')"))}) AS text_hash FROM pages",
    "outbound_links": "SELECT page_id, cast(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS int) AS n_links, cast(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS int) AS n_distinct FROM pages",
    "keyword_topics_topk": f"WITH w AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations), e AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w), g AS (SELECT conv_id, word, count(*) AS n, min(turn * 1000000 + pos) AS f FROM e GROUP BY ALL) SELECT conv_id, word, n, cast(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS int) AS topic_rank FROM g QUALIFY topic_rank <= 20",
    "bio_keyword_overlap": f"WITH {NORM} SELECT run_id, lk, rk, CASE WHEN len(words) >= 2 THEN array_to_string(words, ',') ELSE '' END AS shared FROM pairs",
    "name_normalize": f"WITH {NORM} SELECT account_key, run_id, n_name FROM norm",
    "name_compare": f"WITH {NORM}, s AS (SELECT *, {SHARED_TOKENS.format(a='l_name', b='r_name')} AS sh FROM pairs) SELECT run_id, lk, rk, coalesce(l_name = r_name, false) AS exact, coalesce({PARTIAL.format(a='l_name', b='r_name')}, false) AS part FROM s",
    "location_normalize": f"WITH {NORM} SELECT account_key, run_id, n_location, array_to_string(list_sort(n_places), ',') AS places FROM norm",
    "candidate_name_variants": f"WITH {ACCOUNTS}, t AS (SELECT run_id, string_split(name, ' ')[1] AS f, string_split(name, ' ')[2] AS l FROM requests), v AS (SELECT run_id, [f || l, f || '-' || l, f || '_' || l, f[1] || l, f || l[1]] AS vs FROM t) SELECT run_id, cast(generate_subscripts(vs, 1) - 1 AS int) AS \"at\", unnest(vs) AS variant FROM v",
    "candidate_caps": f"WITH {ACCOUNTS}, t AS (SELECT run_id, string_split(name, ' ')[1] AS f, string_split(name, ' ')[2] AS l FROM requests WHERE github IS NULL AND devto IS NULL), v AS (SELECT run_id, [f || l, f || '-' || l, f || '_' || l, f[1] || l, f || l[1]] AS vs FROM t), e AS (SELECT run_id, generate_subscripts(vs, 1) - 1 AS pos, unnest(vs) AS identifier FROM v), c AS (SELECT run_id, 'github' AS source, {NAMED.format(c='github')} AS identifier, 100 AS rank FROM requests WHERE github IS NOT NULL UNION ALL SELECT run_id, 'devto', {NAMED.format(c='devto')}, 100 FROM requests WHERE devto IS NOT NULL UNION ALL SELECT run_id, 'github', identifier, greatest(40, 60 - 5 * pos) FROM e UNION ALL SELECT run_id, 'devto', identifier, greatest(35, 55 - 5 * pos) FROM e UNION ALL SELECT run_id, 'hackernews', identifier, greatest(25, 35 - 5 * pos) FROM e WHERE pos < 2), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_id, source ORDER BY rank DESC, identifier) <= 3) SELECT run_id, source, identifier, cast(rank AS int) AS rank, cast(row_number() OVER (PARTITION BY run_id ORDER BY rank DESC, source, identifier) AS int) AS place FROM s QUALIFY place <= 12",
    "account_pairs": f"WITH {NORM} SELECT run_id, lk, rk FROM pairs",
    "evidence_long": f"WITH {EVIDENCE} SELECT run_id, signal, signal_group, cast(weight AS double) AS weight, account_key, other_key, signal IN {_list(policy.WEAK_SIGNALS)} AS weak FROM ev",
    "evidence_by_type": f"WITH {EVIDENCE} SELECT signal, count(*) AS n FROM ev GROUP BY signal",
    "conflicts_long": f"WITH {EVIDENCE} SELECT run_id, conflict, basis, severity, cast(penalty AS double) AS penalty, lk, rk FROM cf",
    "conflict_rollup": f"WITH {EVIDENCE} SELECT conflict, severity, count(*) AS n, cast(sum(penalty) AS double) AS penalty FROM cf GROUP BY ALL",
    "group_capped_scores": f"WITH {SCORES} SELECT run_id, account_key, signal_group, cast(applied AS double) AS applied, signals FROM ag",
    "account_scores": f"WITH {SCORES} SELECT run_id, account_key, {DBL('positive', 'confidence')}, {TXT('groups', 'strong_groups')} FROM ascore",
    "pair_scores": f"WITH {SCORES} SELECT run_id, lk, rk, hn, {DBL('positive', 'penalty', 'confidence')}, {TXT('groups', 'conflict_types', 'blocking_types', 'strong_groups')}, signals, conflicts, hash_conflict, weak_only, blocking, rejects, pair_key FROM ps",
    "score_components": f"WITH {SCORES}, c AS (SELECT run_id, lk, rk, signal, weight AS raw, least(weight, cast({CAP} AS {DEC})) AS applied, CASE WHEN row_number() OVER (PARTITION BY run_id, lk, rk, signal_group ORDER BY least(weight, cast({CAP} AS {DEC})) DESC, signal, account_key) = 1 THEN 'positive_evidence' ELSE 'discarded_evidence' END AS kind FROM pe UNION ALL SELECT run_id, lk, rk, conflict, penalty, penalty, CASE WHEN row_number() OVER (PARTITION BY run_id, lk, rk, conflict ORDER BY penalty, basis) = 1 THEN 'conflict_penalty' ELSE 'discarded_conflict' END FROM cf) SELECT run_id, lk, rk, signal, {DBL('raw', 'applied')}, kind FROM c",
    "anchors": f"WITH {DECIDED} SELECT run_id, account_key FROM anch",
    "blocking_pairs": f"WITH {SCORES} SELECT run_id, pair_key, blocking, rejects, {TXT('blocking_types')} FROM ps WHERE blocking OR rejects",
    "classify_decisions": f"WITH {DECIDED} SELECT run_id, account_key, decision, basis, risk, {DBL('evidence_confidence', 'decision_confidence')}, is_anchor FROM decided",
    "run_outcomes": f"WITH {DECIDED} SELECT run_id, count(*) FILTER (decision = 'auto_match') AS n_auto, count(*) FILTER (decision = 'needs_review') AS n_review, count(*) FILTER (decision = 'reject') AS n_reject, coalesce(string_agg(account_key, ',' ORDER BY account_key) FILTER (decision = 'auto_match'), '') AS auto_keys, coalesce(string_agg(account_key, ',' ORDER BY account_key) FILTER (decision = 'needs_review'), '') AS review_keys, CASE WHEN coalesce(max(decision_confidence) FILTER (decision = 'auto_match'), 0) >= 0.85 THEN 'high' WHEN coalesce(max(decision_confidence) FILTER (decision = 'auto_match'), 0) >= 0.60 THEN 'medium' WHEN coalesce(max(decision_confidence) FILTER (decision = 'auto_match'), 0) > 0 THEN 'low' ELSE 'uncertain' END AS confidence_level, CASE WHEN count(*) FILTER (decision = 'auto_match') > 0 THEN 'resolved' ELSE 'partial' END AS status FROM decided GROUP BY run_id",
    "source_links": f"WITH {DECIDED} SELECT run_id, account_key, decision, relationship, verification, cast(decision_confidence AS double) AS confidence FROM links",
    "link_constraint_violations": f"WITH {DECIDED} SELECT 'auto_low_confidence' AS rule, count(*) AS n FROM links WHERE decision = 'auto_match' AND decision_confidence < 0.85 HAVING count(*) > 0",
    "canonical_display_name": f"WITH {BUNDLES} SELECT run_id, display_name, name_strategy, cast(name_confidence AS double) AS name_confidence FROM c_name",
    "canonical_location": f"WITH {BUNDLES} SELECT * FROM c_location",
    "canonical_website": f"WITH {BUNDLES} SELECT * FROM c_website",
    "canonical_bio": f"WITH {BUNDLES} SELECT * FROM c_bio",
    "canonical_skills": f"WITH {BUNDLES}, t AS (SELECT run_id, account_key, sp, unnest(list_concat(list_filter(string_split(topics_text, '|'), lambda x: length(x) >= 2 AND x NOT IN {_list(policy.GENERIC_SKILLS)}), CASE WHEN run_id % 3 = 0 THEN ['c++'] ELSE [] END, CASE WHEN run_id % 2 = 0 THEN ['rust', 'rust', 'go-on', 'zig'] ELSE [] END)) AS term FROM b), g AS (SELECT run_id, term, sum(100 + sp) AS points, count(DISTINCT account_key) AS n_sources FROM t GROUP BY ALL) SELECT run_id, CASE term WHEN 'go-on' THEN 'Go On' ELSE upper(term[1]) || term[2:] END AS skill, cast(points / 100 AS double) AS weight, n_sources, cast(row_number() OVER (PARTITION BY run_id ORDER BY points DESC, n_sources DESC, term) AS int) AS skill_rank FROM g QUALIFY skill_rank <= 30",
    "canonical_profile": f"WITH {BUNDLES} SELECT * FROM c_profile",
    "fallback_summary": f"WITH {BUNDLES} SELECT run_id, CASE WHEN n_accounts = 0 THEN 'No account could be accepted.' ELSE coalesce(display_name, 'This profile') || ' has ' || n_accounts || ' accepted public accounts' || CASE WHEN skills IS NOT NULL THEN ' with ' || array_to_string(string_split(skills, ', ')[1:3], ', ') ELSE '' END || '.' END AS summary FROM c_profile",
    "profile_read_model": f"WITH {DECIDED}, a AS (SELECT run_id, string_agg(account_key || ':' || decision, ',' ORDER BY decision_confidence DESC, account_key) AS links FROM links GROUP BY 1), e AS (SELECT run_id, count(*) AS n_evidence, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM ev GROUP BY 1), c AS (SELECT run_id, count(*) AS n_conflicts FROM cf GROUP BY 1) SELECT run_id, links, coalesce(n_evidence, 0) AS n_evidence, coalesce(signals, '') AS signals, coalesce(n_conflicts, 0) AS n_conflicts FROM a LEFT JOIN e USING (run_id) LEFT JOIN c USING (run_id)",
    "review_eligibility": f"WITH {DECIDED}, v AS (SELECT d.*, bool_or(is_anchor) OVER (PARTITION BY d.run_id) AS anchored, CASE WHEN d.gate THEN 1 ELSE coalesce(len(p.blocking_types), 0) END AS n_block, coalesce(len(p.strong_groups), 0) AS n_strong, coalesce(p.weak_only, false) AS wk, coalesce(len(p.groups), len(d.a_groups)) AS n_groups FROM decided d LEFT JOIN ps p ON p.run_id = d.run_id AND p.pair_key = d.shown) SELECT run_id, account_key, CASE WHEN NOT anchored THEN 'missing_anchor' WHEN evidence_confidence < 0.55 OR evidence_confidence > 0.84 THEN 'score_outside_review_band' WHEN wk THEN 'weak_signal_only' WHEN source = 'hackernews' AND n_strong = 0 THEN 'hn_handle_only' WHEN n_block > 0 THEN 'blocking_conflict' WHEN n_groups = 0 AND n_strong = 0 THEN 'no_meaningful_evidence' END AS skip_reason FROM v WHERE decision = 'needs_review'",
    "review_policy": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 < 4 AND o_orderkey % 100 >= 72 AND o_orderkey % 4 >= 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'promoted_to_auto_match' WHEN o_orderkey % 3 = 1 AND (o_orderkey % 11 = 0 OR o_orderkey % 2 = 0) THEN 'rejected_after_review' ELSE 'kept_needs_review' END AS action FROM orders",
    "forbidden_claims": "SELECT p_partkey, p_partkey % 4 <> 1 AS claims, p_name || CASE p_partkey % 4 WHEN 0 THEN ' is a accepted public profile match.' WHEN 1 THEN ' is unevidence-matched' ELSE ', the public profile match' END AS softened FROM part",
    "endpoint_redaction": "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=REDACTED&x=1' AS endpoint FROM pages",
    "evaluation_metrics": f"WITH {DECIDED}, j AS (SELECT d.decision, coalesce(n.display_name, '') <> 'Zzyzx Qwvkj' AS same FROM decided d JOIN norm n USING (run_id, account_key)) SELECT count(*) AS n, count(*) FILTER (decision = 'auto_match' AND NOT same) AS false_merges, count(*) FILTER (decision = 'reject' AND same) AS missed_merges, count(*) FILTER (decision = 'needs_review') AS reviews, round(count(*) FILTER (decision = 'needs_review') / count(*), 6) AS review_rate FROM j",
    "identifier_from_url": f"WITH {ACCOUNTS} SELECT account_key, run_id, CASE run_id % 4 WHEN 0 THEN CASE k WHEN 0 THEN 'gh' || run_id WHEN 1 THEN cast(id AS string) WHEN 2 THEN 'dt' || run_id ELSE 'hn' || run_id END WHEN 1 THEN user_id WHEN 2 THEN NULL ELSE CASE WHEN k = 1 THEN user_id ELSE '00' || user_id END END AS identifier FROM linked",
    "canonical_facts": f"WITH {BUNDLES}, f AS (SELECT run_id, account_key, fc, 'display_name' AS fact, display_name AS value FROM b UNION ALL SELECT run_id, account_key, fc, 'location', location FROM b UNION ALL SELECT run_id, account_key, fc, 'website_url', website_url FROM b UNION ALL SELECT run_id, account_key, fc, 'bio', bio FROM b UNION ALL SELECT run_id, account_key, fc, 'topic', unnest(string_split(topics_text, '|')) FROM b) SELECT run_id, account_key, fact, value, cast(max(fc) AS double) AS confidence FROM f WHERE value IS NOT NULL GROUP BY ALL",
    "canonical_avatar": f"WITH {BUNDLES}, v AS (SELECT *, 'https://img.dev/' || account_key AS avatar_url, {_rank(policy.AVATAR_PRIORITY)} AS prio FROM b WHERE right(account_key, 1) <> '8') SELECT run_id, avatar_url, cast(least(0.97, fc) AS double) AS avatar_confidence FROM v QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY prio DESC, rel DESC, fc DESC, br) = 1",
    "purge_finished_runs": "WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'partial' ELSE 'running' END AS status, o_orderdate FROM orders) SELECT status, count(*) AS n, min(o_orderkey) AS first_key FROM r WHERE status = 'running' OR o_orderdate >= '1996-01-01' GROUP BY 1",
    "json_merge_patch": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'priority=' || o_orderpriority || ',status=X' ELSE 'note=n,priority=' || o_orderpriority || ',status=' || o_orderstatus END AS merged FROM orders",
    "schema_drift_union": "SELECT s_suppkey AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "upsert_accounts": "WITH u AS (SELECT s_suppkey AS k, s_name AS name, 1 AS version, cast(NULL AS string) AS segment FROM supplier UNION ALL SELECT c_custkey + 7, c_name, 2, c_mktsegment FROM customer) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1",
    "ingestion_summary": f"WITH {CALLS}, s AS (SELECT event_id % 500 AS batch, source, bool_or(coalesce(status_code < 400, false)) AS ok FROM calls GROUP BY ALL) SELECT batch, string_agg(source, ',' ORDER BY source) AS attempted, coalesce(string_agg(source, ',' ORDER BY source) FILTER (ok), '') AS succeeded, coalesce(string_agg(source, ',' ORDER BY source) FILTER (NOT ok), '') AS failed FROM s GROUP BY batch",
    "rate_limit_headers": "SELECT event_id, cast(5000 AS bigint) AS total, CASE WHEN event_id % 5 = 0 THEN event_id % 300 ELSE user_id END AS remaining, CASE WHEN event_id % 7 = 0 THEN cast(3 AS bigint) END AS retry_after_s FROM events",
    "stored_row_violations": f"WITH {CALLS}, {RUNS} SELECT 'calls' AS tab, 'error_without_cause' AS rule, count(*) AS n FROM calls WHERE status_code IS NULL AND error_message IS NULL HAVING count(*) > 0 UNION ALL SELECT 'runs', 'slow', count(*) FROM runs WHERE duration_ms > 4900 HAVING count(*) > 0",
}

_weak = lambda x: WEAK.format(x=x, w=_list(policy.WEAK_HEADLINES))
ORACLES |= {
    "account_explanations": f"WITH {SCORES} SELECT run_id, account_key, concat_ws(' ', 'Account ' || account_key || ' scored ' || printf('%.2f', confidence::double) || ' for the request.', {LISTED.format(none='The request itself supports nothing.')}, CASE WHEN len(groups) > 0 AND len(strong_groups) = 0 THEN 'All that counts is weak, which is too little for a match by itself.' END, CASE WHEN starts_with(account_key, 'hackernews:') THEN 'Profiles of this platform say little, so their evidence is taken with care.' END, {CAPPED.format(x='positive')}) AS explanation FROM ascore",
    "pair_explanations": f"WITH {SCORES} SELECT run_id, pair_key, hn AND weak_only AS hn_requires_strong, concat_ws(' ', 'Account pair ' || pair_key || ' scored ' || printf('%.2f', confidence::double) || '.', {LISTED.format(none='Nothing links the two accounts.')}, CASE WHEN penalty < 0 THEN 'Conflicts took off ' || printf('%.2f', abs(penalty)::double) || '.' END, CASE WHEN len(strong_groups) > 0 THEN 'Strong groups among them: ' || array_to_string(strong_groups, ', ') || '.' END, CASE WHEN weak_only THEN 'All links are weak, which is too little for a match by themselves.' END, CASE WHEN hn THEN 'One of the two profiles says little, so more support is needed.' END, {CAPPED.format(x='positive + penalty')}) AS explanation FROM ps",
    "evidence_of_links": f"WITH {DECIDED} SELECT e.run_id, e.account_key, e.other_key, l.relationship, e.signal, e.signal_group AS field_name, cast(e.weight AS double) AS weight, l.source AS source_a, split_part(e.other_key, ':', 1) AS source_b FROM ev e JOIN links l USING (run_id, account_key)",
    "conflict_sides": f"WITH {EVIDENCE}, s AS (SELECT *, 'source' AS side, lk AS account_key FROM cf UNION ALL SELECT *, 'target', rk FROM cf) SELECT run_id, conflict, basis, side, source, account_key, CASE basis WHEN 'name_conflict' THEN n_name WHEN 'website_conflict' THEN n_domain WHEN 'location_conflict' THEN n_location WHEN 'email_hash' THEN email_hash WHEN 'email_domain' THEN email_domain ELSE array_to_string(list_sort(n_topics), ',') END AS value FROM s JOIN norm USING (run_id, account_key)",
    "review_final_links": f"WITH {DECIDED}, n AS (SELECT *, cast(split_part(account_key, ':', 2) AS bigint) AS n, decision = 'needs_review' AND n % 7 <> 0 AND n % 5 < 4 AS told FROM links), s AS (SELECT *, CASE WHEN told AND n % 3 > 0 AND evidence_confidence <> 0 THEN evidence_confidence ELSE decision_confidence END AS sure, CASE WHEN told THEN CASE WHEN n % 5 < 2 THEN 'auto_match' ELSE 'reject' END ELSE decision END AS new FROM n) SELECT run_id, account_key, new AS decision, CASE WHEN told THEN CASE new WHEN 'reject' THEN 'rejected' ELSE 'secondary' END ELSE relationship END AS relationship, CASE WHEN told THEN CASE new WHEN 'reject' THEN 'rejected' ELSE 'likely_same_person' END ELSE verification END AS verification, cast(CASE WHEN new = 'auto_match' THEN greatest(sure, 0.85) ELSE sure END AS double) AS confidence FROM s",
    "review_counters": f"WITH e AS ({ORACLES['review_eligibility']}), n AS (SELECT *, cast(split_part(account_key, ':', 2) AS bigint) AS n, skip_reason IS NULL AS fine FROM e), by_reason AS (SELECT run_id, string_agg(x, ',' ORDER BY x) AS skipped FROM (SELECT run_id, skip_reason || ':' || count(*) AS x FROM n WHERE NOT fine GROUP BY run_id, skip_reason) GROUP BY run_id) SELECT run_id, count_if(fine)::bigint AS eligible, count_if(NOT fine)::bigint AS not_eligible, count_if(fine)::bigint AS attempted, count_if(fine AND n % 5 <> 0)::bigint AS succeeded, count_if(fine AND n % 5 = 0)::bigint AS failed, count_if(fine AND n % 5 <> 0 AND n % 3 = 0)::bigint AS promoted, count_if(fine AND n % 5 <> 0 AND n % 3 = 1)::bigint AS rejected, count_if(fine AND (n % 5 = 0 OR n % 3 = 2))::bigint AS kept, coalesce(any_value(skipped), '') AS skipped FROM n LEFT JOIN by_reason USING (run_id) GROUP BY run_id",
    "model_failure_kinds": f"WITH {CALLS} SELECT event_id, CASE WHEN coalesce(status_code, 0) IN (400, 401, 403, 404) OR (event_id % 11 <> 0 AND event_id % 7 = 0) THEN 'non_retryable' WHEN coalesce(status_code, 0) IN (429, 500, 502, 503, 504) OR event_id % 11 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0 THEN 'retryable' ELSE 'failed' END AS kind FROM calls",
    "safe_messages": f"SELECT conv_id, turn, sha256(coalesce(CASE WHEN regexp_matches(text, '{policy.SENSITIVE_MESSAGE}', 'i') THEN 'Message left out: it might hold private data.' ELSE left(trim(text), 300) END, '')) AS message_hash FROM conversations",
    "headlines": f"WITH g AS (SELECT p_partkey, {SPACED.format(x="CASE p_partkey % 7 WHEN 0 THEN 'Welcome to ' || p_name WHEN 1 THEN 'Hello, programmer!' WHEN 2 THEN p_name || '. ' || p_type WHEN 3 THEN repeat(p_name || ' ', 12) WHEN 4 THEN 'Software Developer.' ELSE p_name END")} AS c FROM part), f AS (SELECT *, trim(split_part(c, '.', 1)) AS s, rtrim(left(c, 117)) || '...' AS cut FROM g) SELECT p_partkey, CASE WHEN {_weak('s')} THEN NULL WHEN length(s) BETWEEN 12 AND 120 THEN s WHEN length(c) <= 120 AND NOT {_weak('c')} THEN c WHEN NOT {_weak('cut')} THEN cut END AS headline FROM f",
    "raw_record_warnings": f"""WITH {ACCOUNTS}, a AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'elsewhere' ELSE source END AS source, source AS own, CASE WHEN id % 10 = 0 THEN 'raw:' || id ELSE 'id:' || id END AS grp, id % 6 = 0 AS bad, CASE k WHEN 0 THEN 'profile' ELSE 'user' END AS kind FROM linked)
  SELECT source, 'raw:' || id AS account_group, kind AS record_type, 'Skipped: a record of an unknown platform.' AS message FROM a WHERE source = 'elsewhere'
  UNION ALL SELECT source, grp, kind, 'Neither user id nor handle, so the record stands alone.' FROM a WHERE source <> 'elsewhere' AND id % 10 = 0
  UNION ALL SELECT source, grp, NULL, 'No account: its main record is missing or broken.' FROM a WHERE source <> 'elsewhere' AND bad
  UNION ALL SELECT source, grp, t, 'Made without the record ' || t FROM (SELECT *, unnest(CASE own WHEN 'github' THEN ['repos'] WHEN 'stackoverflow' THEN ['answers', 'questions'] WHEN 'devto' THEN ['articles'] ELSE ['activity'] END) AS t FROM a WHERE source <> 'elsewhere' AND NOT bad) WHERE NOT (id % 5 = 1 AND t <> 'questions')""",
}


def _ratios(pairs: str) -> str:
    """CTEs: with(a, b) of distinct pairs, then ratios(a, b, ratio): 200 * LCS / (|a| + |b|), a row of the table of common subsequences at a time."""
    row = "list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(cells[k], (CASE WHEN k > 1 THEN cells[k - 1] ELSE 0 END) + CASE WHEN substr(a, CAST(i + 1 AS BIGINT), 1) = substr(b, k, 1) THEN 1 ELSE 0 END))))"
    return f"""dp AS ({pairs}), lcs(a, b, i, cells) AS (SELECT a, b, 0, list_transform(range(len(b)), lambda x: 0) FROM dp UNION ALL SELECT a, b, i + 1, {row} FROM lcs WHERE i < length(a)),
  ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 100.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 200.0 * cells[-1] / (length(a) + length(b)) END AS ratio FROM lcs WHERE i = length(a))"""


_rec = lambda ctes: f"WITH RECURSIVE {ctes}"
#: Tokens of a name as a sorted set; the derived names have no initials, so names align just where their tokens are the same.
_set = lambda c: f"list_sort(list_distinct(string_split({c}, ' ')))"
_long = lambda c: f"len(list_filter(string_split({c}, ' '), lambda t: length(t) > 1))"
_json = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
FACTS = "f AS (SELECT run_id, account_key, fact, value, max(fc) AS confidence FROM (SELECT run_id, account_key, fc, 'display_name' AS fact, display_name AS value FROM b UNION ALL SELECT run_id, account_key, fc, 'location', location FROM b UNION ALL SELECT run_id, account_key, fc, 'website_url', website_url FROM b UNION ALL SELECT run_id, account_key, fc, 'bio', bio FROM b UNION ALL SELECT run_id, account_key, fc, 'topic', unnest(string_split(topics_text, '|')) FROM b) WHERE value IS NOT NULL GROUP BY ALL)"
_warning = lambda code, details: "{'code': '%s', 'message': '%s', 'details': %s}" % (code, WARNINGS[code][1].replace("'", "''"), details)
_summary = ORACLES["fallback_summary"].split(" SELECT run_id, CASE WHEN n_accounts = 0")[1]
ORACLES |= {
    "handle_indel_similarity": f"{_rec(NORM)}, h AS (SELECT p.run_id, lk, rk, l.n_handle AS x, r.n_handle AS y FROM pairs p JOIN norm l ON l.run_id = p.run_id AND l.account_key = lk JOIN norm r ON r.run_id = p.run_id AND r.account_key = rk), {_ratios('SELECT DISTINCT x AS a, y AS b FROM h WHERE x IS NOT NULL AND y IS NOT NULL')} SELECT run_id, lk, rk, ratio::double AS ratio FROM h LEFT JOIN ratios ON a = x AND b = y",
    "name_compatibility": f"""{_rec(NORM)}, n AS (SELECT DISTINCT l_name AS x, r_name AS y, array_to_string({_set('l_name')}, ' ') AS sx, array_to_string({_set('r_name')}, ' ') AS sy FROM pairs WHERE l_name IS NOT NULL AND r_name IS NOT NULL),
  {_ratios("SELECT DISTINCT sx AS a, sy AS b FROM n")}, told AS (SELECT x, y, CASE WHEN x = y THEN 'exact' WHEN NOT contains(x, ' ') OR NOT contains(y, ' ') THEN 'inconclusive' WHEN sx = sy THEN 'compatible' WHEN len(list_intersect(string_split(x, ' '), string_split(y, ' '))) > 0 THEN 'inconclusive'
    WHEN ratio >= 82 THEN 'weakly_compatible' WHEN {_long('x')} >= 2 AND {_long('y')} >= 2 AND ratio < 72 THEN 'conflicting' ELSE 'inconclusive' END AS compat FROM n JOIN ratios ON a = sx AND b = sy)
  SELECT run_id, lk, rk, coalesce(compat, 'not_comparable') AS compat FROM pairs LEFT JOIN told ON x = l_name AND y = r_name""",
    "similar_handles": f"""{_rec(NORM)}, v AS (SELECT DISTINCT CASE WHEN run_id % 2 = 0 THEN n_handle || '_dev' END AS value FROM norm),
  {_ratios("SELECT l.value AS a, r.value AS b FROM v l JOIN v r ON (length(l.value) < length(r.value) OR (length(l.value) = length(r.value) AND l.value < r.value)) AND length(l.value) >= 3 AND length(l.value) + length(r.value) >= 10 * CASE WHEN length(l.value) = length(r.value) THEN 2 ELSE length(r.value) - length(l.value) END")} SELECT a, b, ratio::double AS ratio FROM ratios WHERE ratio >= 90""",
    "profile_link_graph": f"WITH {NORM}, e AS (SELECT n_print AS src, n_link AS dst, count(*) AS n FROM norm WHERE n_link IS NOT NULL AND n_link <> n_print AND n_link IN (SELECT n_print FROM norm) GROUP BY ALL) SELECT src, dst, n, EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src) AS reciprocal FROM e",
    "profile_full_read": f"""WITH {BUNDLES}, {FACTS},
  ea AS (SELECT run_id, account_key, list({{'signal': signal, 'signal_group': signal_group, 'weight': weight::double, 'other_key': other_key}} ORDER BY signal, other_key) AS evidence FROM ev GROUP BY ALL),
  la AS (SELECT l.run_id, list({{'account_key': l.account_key, 'source': l.source, 'decision': decision, 'relationship': relationship, 'verification': verification, 'confidence': decision_confidence::double, 'account': {{'handle': handle, 'display_name': display_name, 'location': location, 'website_url': website_url, 'profile_url': profile_url}}, 'evidence': coalesce(evidence, [])}} ORDER BY decision_confidence DESC, l.account_key) AS links
    FROM links l JOIN norm n USING (run_id, account_key) LEFT JOIN ea USING (run_id, account_key) GROUP BY ALL),
  ca AS (SELECT run_id, list({{'conflict': conflict, 'basis': basis, 'severity': severity, 'penalty': penalty::double, 'lk': lk, 'rk': rk}} ORDER BY conflict, basis, severity, penalty, lk, rk) AS conflicts FROM cf GROUP BY ALL),
  fa AS (SELECT run_id, list({{'account_key': account_key, 'fact': fact, 'value': value, 'confidence': confidence::double}} ORDER BY account_key, fact, value) AS facts FROM f GROUP BY ALL), su AS (SELECT run_id, CASE WHEN n_accounts = 0{_summary})
  SELECT run_id, {_json('coalesce(links, [])')} AS links, {_json('coalesce(conflicts, [])')} AS conflicts, {_json('coalesce(facts, [])')} AS facts, summary FROM requests LEFT JOIN la USING (run_id) LEFT JOIN ca USING (run_id) LEFT JOIN fa USING (run_id) LEFT JOIN su USING (run_id)""",
    "profile_detail": f"""WITH {BUNDLES}, {FACTS}, x AS ({ORACLES["account_explanations"].replace(f"WITH {SCORES} ", "").replace("concat_ws(' ',", "list_filter([").replace(" AS explanation", "], lambda t: t IS NOT NULL) AS said").replace(") ], lambda", "], lambda").replace(")], lambda", "], lambda")}),
  s AS (SELECT l.run_id, l.decision, l.decision_confidence, l.evidence_confidence, l.account_key, {{'account_key': l.account_key, 'source': l.source, 'relationship': relationship, 'verification': verification, 'confidence': decision_confidence::double, 'evidence_confidence': l.evidence_confidence::double, 'basis': basis, 'risk': risk, 'is_anchor': is_anchor, 'hn_conservative': l.source = 'hackernews',
    'reason': CASE WHEN is_anchor AND l.source = 'hackernews' THEN 'Named in the request and taken as a claim; sparse profiles of this platform need more support.' WHEN is_anchor THEN 'Named in the request and taken as a claim; ownership isn''t verified.' ELSE array_to_string(said[1:2], ' ') END}} AS told FROM links l JOIN x USING (run_id, account_key)),
  g AS (SELECT run_id, coalesce(list(told ORDER BY decision_confidence DESC, account_key) FILTER (decision = 'auto_match'), []) AS sources, coalesce(list(told ORDER BY decision_confidence DESC, account_key) FILTER (decision = 'needs_review'), []) AS review_candidates, coalesce(list(told ORDER BY decision_confidence DESC, account_key) FILTER (decision = 'reject'), []) AS rejected_candidates,
    count(*) FILTER (decision = 'auto_match') AS n_auto, count(*) FILTER (decision = 'needs_review') AS n_review, count(*) FILTER (decision = 'reject') AS n_reject, count(*) AS n_accounts, max(evidence_confidence)::double AS max_evidence_confidence, max(decision_confidence)::double AS max_decision_confidence FROM s GROUP BY run_id),
  v AS (SELECT run_id, 'display_name' AS fact, display_name AS value FROM c_profile UNION ALL SELECT run_id, 'location', location FROM c_profile UNION ALL SELECT run_id, 'bio', bio FROM c_profile),
  w AS (SELECT run_id, fact, list_sort(list(DISTINCT account_key)) AS accounts FROM f JOIN v USING (run_id, fact, value) GROUP BY ALL), fs AS (SELECT run_id, list({{'fact': fact, 'accounts': accounts}} ORDER BY fact) AS field_sources FROM w GROUP BY ALL)
  SELECT run_id, display_name, headline, location, bio, website, skills, level, {_json('sources')} AS sources, {_json('review_candidates')} AS review_candidates, {_json('rejected_candidates')} AS rejected_candidates, {_json('coalesce(field_sources, [])')} AS field_sources, max_evidence_confidence, max_decision_confidence, n_auto, n_review, n_reject, g.n_accounts,
    CASE WHEN n_auto > 0 THEN 'resolved' WHEN n_review > 0 THEN 'ambiguous_candidates' ELSE 'no_confident_match' END AS outcome, CASE WHEN n_auto > 0 THEN 'deterministic_built' ELSE 'canonical_build_blocked' END AS stage,
    CASE WHEN n_auto = 0 THEN {_json('[' + _warning('profile_needs_review', "{'reason': 'no_auto_match_accounts', 'review_candidates': CAST(n_review AS VARCHAR)}") + ']')} WHEN n_review > 0 THEN {_json('[' + _warning('ambiguous_candidates_present', "{'review_candidates': CAST(n_review AS VARCHAR)}") + ']')} ELSE '[]' END AS warnings
  FROM g JOIN c_profile USING (run_id) LEFT JOIN fs USING (run_id)""",
}

_top = lambda x: f"list_transform(list_sort(list_transform(list_distinct({x}), lambda z: {{'n': -len(list_filter({x}, lambda y: y = z)), 'p': list_position({x}, z), 'z': z}})), lambda s: s.z)"
_less = lambda x: f"regexp_replace(regexp_replace({x}, '\"[a-z_]+\":null,?', '', 'g'), ',}}', '}}', 'g')"  # noqa: E731  nulls aren't written
#: The bundles' parts with their fields in alphabetical order, as a VARIANT has them.
_parts = {
    "profile": "{'bio': bio, 'blog': website_url, 'followers': id % 1000, 'following': id % 7, 'html_url': profile_url, 'id': id, 'location': location, 'login': handle, 'name': display_name, 'public_repos': id % 50}",
    "repos": "list_transform(range(len(t)), lambda i: {'language': t[i + 1], 'name': t[i + 1], 'stargazers_count': id * (i + 3) % 17, 'topics': [t[i + 1]]})",
    "s_user": "{'items': [{'badge_counts': {'bronze': id % 5}, 'display_name': coalesce(display_name, 'n'), 'link': profile_url, 'location': location, 'reputation': id % 3000, 'user_id': id, 'website_url': website_url}]}",
    "answers": "{'items': [{'tags': t[1:2]}]}",
    "questions": "{'items': [{'tags': t}, {'tags': t[2:2]}]}",
    "d_user": "{'github_username': 'gh' || run_id, 'id': id, 'location': location, 'name': display_name, 'summary': bio, 'username': handle, 'website_url': website_url}",
    "listed": "list_transform(t, lambda x: {'comments_count': id % 4, 'tag_list': [x, 'Web'], 'tags': ['dev', x], 'title': 'On ' || x})",
    "joined": "list_transform(t, lambda x: {'comments_count': id % 4, 'tag_list': x || ', Web,', 'tags': ['dev', x], 'title': 'On ' || x})",
    "h_user": "{'about': bio, 'karma': id % 100, 'username': handle}",
    "activity": "{'hits': list_transform(range(len(t)), lambda i: {'_tags': [CASE WHEN (id + i) % 2 = 0 THEN 'story' ELSE 'comment' END], 'objectID': CAST(i AS VARCHAR), 'points': i, 'title': t[i + 1]})}",
}
_raw = lambda k, n, kind, part, url: f"SELECT id * 4 + {n} AS id, run_id, source, '{kind}' AS record_type, {'user_id' if k < 3 else 'handle'} AS user_id, {'coalesce(display_name, $n$n$n$)' if k == 1 else 'handle'} AS handle, {url} AS request_url, profile, sha256({_less(_json(part))}) AS payload, id AS fetched_at FROM a WHERE k = {k}"
_ACTIVITY = {
    0: f"{{'public_repos': id % 50, 'followers': id % 1000, 'following': id % 7, 'top_languages': {_top('t')}, 'repo_count_fetched': len(t), 'top_repositories': list_transform(list_sort(list_transform(range(len(t)), lambda i: {{'o': -(id * (i + 3) % 17), 'i': i, 'row': {{'name': t[i + 1], 'language': t[i + 1], 'stars': id * (i + 3) % 17}}}}))[1:10], lambda s: s.row)}}",
    1: f"{{'reputation': id % 3000, 'badge_counts': {{'bronze': id % 5}}, 'answers_count_fetched': 1, 'questions_count_fetched': 2, 'top_question_tags': {_top('list_concat(t, t[2:2])')}, 'top_answer_tags': {_top('t[1:2]')}}}",
    2: f"{{'articles_count_fetched': len(t), 'top_tags': {_top('d')}[1:10], 'recent_articles': list_transform(t, lambda x: {{'title': 'On ' || x, 'comments_count': id % 4}}), 'linked_usernames': {{'github': 'gh' || run_id}}}}",
    3: "{'karma': id % 100, 'activity_count_fetched': len(t), 'comments_count_fetched': len(list_filter(range(len(t)), lambda i: (id + i) % 2 = 1)), 'stories_count_fetched': len(list_filter(range(len(t)), lambda i: (id + i) % 2 = 0)), 'recent_activity': list_transform(range(len(t)), lambda i: {'object_id': CAST(i AS VARCHAR), 'title': t[i + 1], 'points': i, 'type': CASE WHEN (id + i) % 2 = 0 THEN 'story' ELSE 'comment' END}), 'weak_identity_source': true}",
}
_api, _stack = "'https://api.github.com/users/' || handle", "'https://api.stackexchange.com/2.3/users/' || id || "
_PARTS = f"WITH {ACCOUNTS}, a AS (SELECT *, string_split(topics_text, '|') AS t, CASE k WHEN 2 THEN 'https://dev.to/' || handle WHEN 3 THEN 'https://news.ycombinator.com/user?id=' || handle ELSE profile_url END AS profile FROM linked)"
_distinct = lambda x: f"list_transform(list_sort(list_transform(list_distinct({x}), lambda y: {{'p': list_position({x}, y), 'y': y}})), lambda s: s.y)"
ORACLES |= {
    "bundle_raw_records": f"{_PARTS}, r AS (" + " UNION ALL ".join(
        (
            _raw(0, 0, "profile", _parts["profile"], _api), _raw(0, 1, "repos", _parts["repos"], _api + " || '/repos?per_page=30&sort=updated&direction=desc'"),
            _raw(1, 0, "user", _parts["s_user"], _stack + "'?site=stackoverflow'"), _raw(1, 1, "answers", _parts["answers"], _stack + "'/answers?site=stackoverflow&pagesize=20&sort=votes'"), _raw(1, 2, "questions", _parts["questions"], _stack + "'/questions?site=stackoverflow&pagesize=20&sort=votes'"),
            _raw(2, 0, "user", _parts["d_user"], "'https://dev.to/api/users/by_username?url=' || handle"), _raw(2, 1, "articles", _parts["listed"], "'https://dev.to/api/articles?username=' || handle || '&per_page=30'") + " AND id % 8 = 2", _raw(2, 1, "articles", _parts["joined"], "'https://dev.to/api/articles?username=' || handle || '&per_page=30'") + " AND id % 8 <> 2",
            _raw(3, 0, "user", _parts["h_user"], "'https://hn.algolia.com/api/v1/users/' || handle"), _raw(3, 1, "activity", _parts["activity"], "'https://hn.algolia.com/api/v1/search_by_date?tags=author_' || handle || '&hitsPerPage=30'"),
        )
    ) + ") SELECT * EXCLUDE (profile), profile AS profile_url, 200 AS http_status FROM r",
    "normalize_raw_accounts": f"""{_PARTS}, b AS (SELECT *, list_concat(flatten(list_transform(t, lambda x: [x, 'web', 'dev', x])), []) AS d FROM a)
  SELECT lower(source || ':' || CASE WHEN k = 3 THEN handle ELSE user_id END) AS account_key, CASE WHEN k = 1 THEN coalesce(display_name, 'n') ELSE handle END AS handle, CASE k WHEN 3 THEN handle WHEN 1 THEN coalesce(display_name, 'n') ELSE coalesce(display_name, handle) END AS display_name, CASE WHEN k <> 1 THEN bio END AS bio, CASE WHEN k <> 3 THEN location END AS location,
    array_to_string(CASE k WHEN 2 THEN {_distinct('d')} WHEN 3 THEN {_top('t')} ELSE {_distinct('t')} END, ',') AS topics, CASE k WHEN 2 THEN 'https://dev.to/' || handle WHEN 3 THEN 'https://news.ycombinator.com/user?id=' || handle ELSE profile_url END AS profile_url,
    CASE k WHEN 0 THEN {_json(_ACTIVITY[0])} WHEN 1 THEN {_json(_ACTIVITY[1])} WHEN 2 THEN {_json(_ACTIVITY[2])} ELSE {_json(_ACTIVITY[3])} END AS activity_payload, array_to_string(list_transform(range(CASE k WHEN 1 THEN 3 ELSE 2 END), lambda i: CAST(id * 4 + i AS VARCHAR)), ',') AS raw_record_ids
  FROM (SELECT * REPLACE (list_transform(t, lambda x: lower(x)) AS t) FROM b)""",
}

PACKETS = f"""{SCORES},
pke AS (SELECT run_id, lk, rk, list({{'signal': signal, 'signal_group': signal_group, 'weight': weight::double, 'account_key': account_key}} ORDER BY weight DESC, signal, account_key)[1:20] AS evidence FROM pe GROUP BY ALL),
pkc AS (SELECT run_id, lk, rk, list({{'conflict': conflict, 'basis': basis, 'severity': severity, 'penalty': penalty::double}} ORDER BY penalty, conflict, basis)[1:20] AS conflicts FROM cf GROUP BY ALL),
packets AS (SELECT run_id, lk, rk, ps.confidence::double AS score, weak_only, groups[1:10] AS groups, strong_groups[1:10] AS strong_groups, blocking_types[1:10] AS blocking_types, coalesce(evidence, []) AS evidence, coalesce(pkc.conflicts, []) AS conflicts
  FROM ps LEFT JOIN pke USING (run_id, lk, rk) LEFT JOIN pkc USING (run_id, lk, rk))"""
_used = "list_concat(list_transform(evidence, lambda x: x.signal), list_transform(conflicts, lambda x: x.conflict))"
ORACLES |= {
    "evidence_packets": f"WITH {PACKETS} SELECT run_id, lk, rk, score, weak_only, {', '.join(f'{_json(c)} AS {c}' for c in ('groups', 'strong_groups', 'blocking_types', 'evidence', 'conflicts'))} FROM packets",
    "verdict_breaches": f"""WITH {PACKETS},
  q AS (SELECT run_id, lk, rk, list_distinct({_used}) AS allowed, (run_id * 4 + ascii(lk) + ascii(rk)) % 9 AS n FROM packets),
  t AS (SELECT *, '"used_evidence_types": ' || to_json(allowed)::varchar || '}}' AS used, '{{"recommendation": "uncertain", "confidence": "low", ' AS head FROM q),
  w AS (SELECT *, CASE n WHEN 0 THEN '  ' WHEN 1 THEN 'no verdict {{today' WHEN 2 THEN '[1, 2]' WHEN 3 THEN replace(head, 'uncertain', 'yes') || '"rationale": ["shared site"], ' || used
    WHEN 4 THEN 'Here it is: ' || head || '"rationale": ["shared site"], ' || used || ' Bye.' WHEN 5 THEN head || '"rationale": ["shared site"], ' || replace(used, ']}}', ', "shoe_size"]}}')
    WHEN 6 THEN head || '"rationale": ["A Verified Owner of both"], ' || used WHEN 7 THEN head || '"mood": 1, "rationale": ["shared site"], ' || used ELSE '{{"confidence": "high", "rationale": "one text", "used_evidence_types": ["same_website"]}}' END AS verdict FROM t),
  j AS (SELECT *, CASE WHEN json_valid(verdict) THEN verdict WHEN json_valid(regexp_extract(verdict, '[{{].*[}}]', 0, 's')) THEN regexp_extract(verdict, '[{{].*[}}]', 0, 's') END AS js FROM w),
  o AS (SELECT *, CASE WHEN trim(verdict) = '' THEN 'empty' WHEN js IS NULL THEN 'no_json' WHEN json_type(js) <> 'OBJECT' THEN 'no_object' ELSE 'object' END AS kind FROM j),
  g AS (SELECT *, CASE WHEN kind = 'object' THEN js ELSE '{{}}' END AS obj FROM o),
  f AS (SELECT *, list_filter(['confidence', 'rationale', 'recommendation', 'risk_flags', 'used_evidence_types'], lambda k: CASE k
      WHEN 'recommendation' THEN coalesce(obj->>'$.recommendation', '') NOT IN ('likely_same_person', 'uncertain', 'likely_different_person') WHEN 'confidence' THEN coalesce(obj->>'$.confidence', '') NOT IN ('low', 'medium', 'high')
      WHEN 'rationale' THEN coalesce(json_type(obj, '$.rationale') <> 'ARRAY' OR json_array_length(obj, '$.rationale') > 5, false) WHEN 'risk_flags' THEN coalesce(json_type(obj, '$.risk_flags') <> 'ARRAY' OR json_array_length(obj, '$.risk_flags') > 5, false)
      ELSE coalesce(json_type(obj, '$.used_evidence_types') <> 'ARRAY' OR json_array_length(obj, '$.used_evidence_types') > 10, false) END) AS shape,
    list_sort(list_filter(json_keys(obj), lambda k: k NOT IN ('confidence', 'rationale', 'recommendation', 'risk_flags', 'used_evidence_types'))) AS extra,
    list_sort(list_filter(list_distinct(coalesce(from_json(obj->'$.used_evidence_types', '["VARCHAR"]'), [])), lambda k: NOT list_contains(allowed, k))) AS bad,
    regexp_extract(lower(coalesce((obj->'$.rationale')::varchar, '')), '\\b({'|'.join(sorted(text.CLAIMS, key=len, reverse=True))})\\b', 1) AS claim FROM g)
  SELECT run_id, lk, rk, kind AS breach, '' AS detail FROM f WHERE kind <> 'object' UNION ALL SELECT run_id, lk, rk, 'shape', array_to_string(shape, ',') FROM f WHERE kind = 'object' AND len(shape) > 0
  UNION ALL SELECT run_id, lk, rk, 'unknown_field', array_to_string(extra, ',') FROM f WHERE len(extra) > 0 UNION ALL SELECT run_id, lk, rk, 'claim', claim FROM f WHERE kind = 'object' AND claim <> ''
  UNION ALL SELECT run_id, lk, rk, 'unsupported_type', array_to_string(bad, ',') FROM f WHERE kind = 'object' AND len(bad) > 0""",
}
ORACLES["stream_upsert"] = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
ORACLES["replaced_runs"] = f"WITH {DECIDED} SELECT run_id, account_key, CASE WHEN run_id % 5 = 0 THEN 'again_' || relationship ELSE relationship END AS relationship, decision_confidence::double AS confidence FROM links WHERE run_id % 5 > 0 OR run_id % 3 > 0"
