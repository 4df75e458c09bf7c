"""DuckDB SQL of the registered queries."""

SQL: dict[str, str] = {}

E = """e AS (
  SELECT event_id, user_id, event_type, value, props, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS t FROM events
), ev AS (SELECT *, '10.' || (k % 4) || '.' || (user_id % 256) || '.' || k AS ip FROM e)"""


def chain(name: str, rows: str, seconds: int) -> str:
    """Anchored groups of rows(t): name(g, s), the number and the first time of each."""
    w = seconds * 1_000_000
    return f"""{name} AS (
  SELECT 0::BIGINT AS g, min(t) AS s FROM {rows}
  UNION ALL SELECT g + 1, (SELECT min(x.t) FROM {rows} x WHERE x.t > {name}.s + {w}) FROM {name} WHERE EXISTS (SELECT 1 FROM {rows} y WHERE y.t > {name}.s + {w})
)"""


SQL["decode_envelope"] = f"""WITH {E}
SELECT event_id, 'Zeek' AS telemetry_source, 'conn.log' AS log_type, strftime(make_timestamp((t // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS timestamp,
  '10.0.0.' || (user_id % 256) AS conn__id__orig_h, event_type AS conn__service, k AS conn__orig_bytes, NULL::DOUBLE AS duration FROM ev"""

MATCHES = f"""WITH {E}, z AS (
  SELECT *, CASE WHEN k % 4 = 1 THEN 'vpn_zone' WHEN k % 4 = 2 AND user_id % 256 < 128 THEN 'dmz' ELSE 'internal' END AS zone FROM ev
), m AS (
  SELECT event_id, 0 AS o, 'E-1' AS mapping_id, 'T1021' AS technique_id, 'Lateral Movement' AS tactic, 0.75 AS base, CASE WHEN zone = 'dmz' THEN 0.2 ELSE 0.0 END AS boost,
    concat_ws('; ', 'value > 50', CASE WHEN k < 10 THEN 'k < 10' END, CASE WHEN user_id IN (1, 2, 3, 5, 8) THEN 'user in [1, 2, 3, 5, 8]' END) AS matched,
    'ip.location: ' || CASE WHEN zone = 'dmz' THEN 'matched' ELSE 'not_matched' END || '; ip.owner: context_provider_unavailable' AS said
  FROM z WHERE event_type IN ('purchase', 'view') AND value > 50 AND (k < 10 OR user_id IN (1, 2, 3, 5, 8))
  UNION ALL SELECT event_id, 1, 'E-2', 'T1078', 'Initial Access', 0.68, 0.0, 'kind startswith pur', '' FROM z WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 2, 'E-3', 'T1499', 'Impact', 1.0, 0.0, 'k != 7', '' FROM z WHERE event_type = 'error' AND k IS NOT NULL
)"""
SQL["semantic_map"] = f"""{MATCHES}
SELECT event_id, mapping_id, technique_id, tactic, base::DOUBLE AS base_confidence, boost::DOUBLE AS context_boost, round(least(1.0, base + boost), 4)::DOUBLE AS score, matched AS matched_conditions, said AS context_conditions,
  row_number() OVER (PARTITION BY event_id ORDER BY round(least(1.0, base + boost), 4) DESC, o) AS match_rank FROM m"""

ALERTS = f"""WITH {E}, m AS (
  SELECT event_id, 'A-1' AS mapping_id, 'T1110' AS technique_id, 0.8 AS confidence FROM ev WHERE k_text = '7' AND event_type <> 'view'
  UNION ALL SELECT event_id, 'A-2', 'T1059', 0.5 FROM ev WHERE event_type = 'purchase' OR value > 99.5
)"""
SQL["semantic_index"] = f"""WITH {E}, r AS (SELECT i, i / 20 AS low, i / 20 + 0.25 AS high, CASE WHEN i % 2 = 0 THEN 'view' ELSE 'purchase' END AS kind FROM (SELECT unnest(range(2000)) AS i))
SELECT event_id, 'R-' || i AS mapping_id, 0.5::DOUBLE AS score,
  (k = i % 100)::BIGINT + (user_id IN (i % 150, i % 97))::BIGINT + coalesce(value > low, false)::BIGINT + coalesce(value <= high, false)::BIGINT + (k < 50)::BIGINT AS n_matched
FROM ev JOIN r ON event_type = kind AND ((k = i % 100 AND user_id IN (i % 150, i % 97)) OR (value > low AND value <= high AND k < 50))"""
SQL["alert_map"] = f"""{ALERTS}
SELECT event_id, mapping_id, technique_id, confidence::DOUBLE AS confidence, 'semantic' AS mapping_type, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY event_id ORDER BY mapping_id) AS match_rank FROM m"""

SQL["condition_matrix"] = f"""WITH {E}, x AS (SELECT event_id, nullif(k, 5) AS v, nullif(event_type, 'view') AS s FROM ev)
SELECT event_id, v IS NULL AS z_null, coalesce(v <> 7, false) AS z_ne, v IS NOT NULL AS z_ne_text, coalesce(v < 50, false) AS z_lt, coalesce(s LIKE '%ck', false) AS z_ends, coalesce(s > 'm', false) AS z_text_order,
  v IS NULL AS w_null, coalesce(v = 7, false) AS w_eq, coalesce(v NOT IN (1, 2), false) AS w_not_in, coalesce(lower(s) LIKE '%cli%', false) AS w_contains, false AS w_ge,
  v IS NOT NULL AS c_null, coalesce(v NOT IN (1, 2), false) AS c_not_in, coalesce(v <= 30, false) AS c_le, false AS z_empty, true AS w_empty FROM x"""

SQL["alert_dialect"] = f"""WITH {E}, x AS (SELECT event_id, nullif(event_type, 'view') AS s, event_type AS y, k % 7 <> 0 AS has, k FROM ev)
SELECT event_id, coalesce(lower(s) LIKE 'cl%', false) AS starts, coalesce(lower(s) LIKE '%ase', false) AS ends, false AS starts_number, false AS starts_array,
  has AND y = 'click' AS holds, has AS holds_trimmed, false AS holds_case, k IN (4, 5) AS holds_number, k IN (4, 5) AS holds_text_of_number, false AS array_equals, has AS array_not FROM x"""

SQL["time_groups"] = f"""WITH RECURSIVE {E}, {chain('r', 'e', 3600)}
SELECT event_id, g AS time_group_id FROM ev ASOF JOIN r ON ev.t >= r.s"""

SQL["correlation_metrics"] = f"""WITH RECURSIVE {E}, {chain('r', 'e', 3600)}, x AS (SELECT ev.*, g FROM ev ASOF JOIN r ON ev.t >= r.s)
SELECT g AS time_group_id, event_type AS kind, count(*)::DOUBLE AS n, count(DISTINCT user_id)::DOUBLE AS users, round(avg(value), 6) AS avg_value, round(coalesce(sum(value), 0), 6) AS sum_value,
  min(value) AS min_value, max(value) AS max_value, round(count(*) FILTER (k IN (0, 1, 2, 3, 4)) / count(*), 6) AS low_share, round(coalesce(stddev_samp(value), 0), 6) AS sd,
  round(CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_samp(value) / abs(avg(value)) END, 6) AS cv, round(coalesce(entropy(k), 0), 6) AS h, round(count(*) / 60.0, 6)::DOUBLE AS per_second,
  round(count(DISTINCT CASE WHEN ip LIKE '10.1.2.%' THEN ip END) / 256.0, 6)::DOUBLE AS density, count(*) > 1 AS detected
FROM x GROUP BY g, event_type"""

SQL["merged_metrics"] = f"""WITH {E}
SELECT event_type AS kind, count(*)::DOUBLE AS n, true AS users, round(avg(value), 4) AS avg_value, round(coalesce(sum(value), 0), 4) AS sum_value, min(value) AS min_value, max(value) AS max_value,
  round(count(*) FILTER (k IN (0, 1, 2, 3, 4)) / count(*), 4) AS low_share, round(coalesce(stddev_samp(value), 0), 4) AS sd,
  round(CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_samp(value) / abs(avg(value)) END, 4) AS cv,
  true AS h, round(count(*) / 60.0, 4)::DOUBLE AS per_second, true AS density
FROM ev GROUP BY event_type"""

SQL["correlation_detect"] = f"""WITH RECURSIVE {E}, s AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'error')), u AS (SELECT * FROM ev WHERE event_type = 'purchase'),
{chain('r', 's', 3600)}, {chain('q', 'u', 21600)}, one AS (SELECT s.*, g FROM s ASOF JOIN r ON s.t >= r.s), two AS (SELECT u.*, g FROM u ASOF JOIN q ON u.t >= q.s)
SELECT 'C-1' AS mapping_id, 'T1046' AS technique_id, 0.9::DOUBLE AS confidence, g AS time_group_id, '{{"kind":"' || event_type || '"}}' AS group_key, count(*) AS n_events, '{{"n":' || count(*) || '.0,"users":' || count(DISTINCT user_id) || '.0}}' AS metrics, 0.4::DOUBLE AS score FROM one GROUP BY g, event_type
HAVING count(DISTINCT user_id) >= 5 AND count(*) > 5 AND count(*) FILTER (k BETWEEN 0 AND 9) / count(*) <= 0.25
UNION ALL SELECT 'C-2', 'T1030', 0.6, g, '{{"user":' || user_id || '}}', count(*), '{{"n":' || count(*) || '.0}}', 1.0 FROM two GROUP BY g, user_id HAVING count(*) >= 2"""

SQL["sliding_forward"] = f"""WITH {E}
SELECT a.event_id, count(*) AS n, round(sum(b.value), 4) AS total FROM e a JOIN e b ON b.t BETWEEN a.t AND a.t + 600000000 AND (b.t > a.t OR b.event_id >= a.event_id) GROUP BY a.event_id"""

SQL["burst_frames"] = f"""WITH {E}, m AS (SELECT event_id, t // 60000000 AS i, value FROM e)
SELECT a.event_id, count(*) AS n, min(b.value) AS least, max(b.value) AS most, round(sum(b.value), 4) AS total FROM m a JOIN m b ON b.i BETWEEN a.i AND a.i + 240 AND (b.i > a.i OR b.event_id >= a.event_id) GROUP BY a.event_id"""

SQL["centered_band"] = f"""WITH {E}
SELECT a.event_id, count(*) AS n, min(b.event_id) AS first FROM e a JOIN e b ON b.t BETWEEN a.t - 900000000 AND a.t + 900000000 GROUP BY a.event_id"""

PAIRS = """p AS (
  SELECT a.event_id AS source_uid, b.event_id AS followup_uid, a.user_id, (b.t - a.t) / 1e6 AS gap FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.t BETWEEN a.t AND a.t + 3600000000 WHERE a.event_type = 'signup' AND b.event_type = 'purchase'
)"""
SQL["pair_correlation"] = f"""WITH {E}, {PAIRS}
SELECT 'P-1' AS mapping_id, source_uid, followup_uid, 0.7::DOUBLE AS confidence,
  'context matched: user=' || user_id || '; time sequence matched: follow-up occurred ' || printf('%.3f', gap) || 's after source; relationship matched: follows' AS evidence FROM p"""

SQL["dedup_first"] = f"""WITH {E}, x AS (SELECT CASE WHEN k < 3 THEN '' WHEN k < 5 THEN NULL ELSE concat(user_id, '-', k) END AS id, t, event_id FROM ev)
SELECT id, t, event_id FROM x QUALIFY coalesce(id, '') = '' OR row_number() OVER (PARTITION BY id ORDER BY t, event_id) = 1"""

SQL["context_zone"] = f"""WITH {E}
SELECT event_id, ip, CASE WHEN k % 4 = 1 THEN 'vpn_zone' WHEN k % 4 = 2 AND user_id % 256 < 128 THEN 'dmz' ELSE 'internal' END AS zone, k % 4 = 3 AND user_id % 256 < 128 AS inside FROM ev"""

SQL["zone_table"] = f"""WITH {E}, x AS (SELECT *, coalesce(k, 4) % 5 AS form FROM ev),
c AS (SELECT c_custkey % 4 AS a, c_custkey % 256 AS b, arg_min(c_mktsegment, c_custkey) AS zone FROM customer GROUP BY ALL),
s AS (SELECT s_suppkey % 3 AS a, arg_min('nation ' || s_nationkey, s_suppkey) AS zone FROM supplier GROUP BY ALL),
v AS (SELECT c_custkey % 65536 AS a, arg_min('v6 ' || c_mktsegment, c_custkey) AS zone FROM customer GROUP BY ALL)
SELECT event_id,
  CASE form WHEN 2 THEN '2001:DB8::' || printf('%x', user_id % 65536) || ':0:0:' || printf('%X', k) WHEN 3 THEN '::ffff:' || ip
    WHEN 4 THEN CASE k % 3 WHEN 0 THEN '10.0.0.256' WHEN 1 THEN '1::2::' || k WHEN 2 THEN 'fe80::' || k || '%eth0' END ELSE ip END AS address,
  CASE WHEN form < 2 THEN coalesce(c.zone, s.zone, 'external') WHEN form = 2 THEN coalesce(v.zone, 'external')
    WHEN form = 3 THEN (SELECT arg_min(r_name, r_regionkey) FROM region) WHEN k % 3 = 2 THEN 'external' END AS zone
FROM x LEFT JOIN c ON k % 4 = c.a AND user_id % 256 = c.b LEFT JOIN s ON k % 4 = s.a LEFT JOIN v ON user_id % 65536 = v.a"""

SQL["context_asset"] = """SELECT event_id, user_id::VARCHAR AS host, c_mktsegment AS role, c_nationkey::VARCHAR AS category FROM events LEFT JOIN customer ON user_id = c_custkey"""

SQL["evidence_score"] = """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), d AS (
  SELECT *, count(*) OVER (PARTITION BY b) AS degree, ln(((SELECT count(DISTINCT p_brand) FROM part) + 1) / (count(*) OVER (PARTITION BY b) + 1)) AS itf FROM c
), r AS (SELECT *, itf / (sum(itf * n) OVER (PARTITION BY a) + 1e-9) AS ri FROM d),
s AS (SELECT *, (itf - min(itf) OVER ()) / (max(itf) OVER () - min(itf) OVER () + 1e-9) AS x, (ri - min(ri) OVER ()) / (max(ri) OVER () - min(ri) OVER () + 1e-9) AS y FROM r)
SELECT p_partkey, degree AS evidence_degree, round(0.7 * x + 0.3 * y, 4) AS evidence_score,
  'Evidence score ' || printf('%.2f', round(0.7 * x + 0.3 * y, 4)) || ': this telemetry is ' || CASE WHEN degree <= 1 THEN 'unique to ' || a || ' across the dataset'
    WHEN degree <= 5 THEN 'shared with only ' || (degree - 1) || ' other technique(s), so still fairly specific' WHEN degree <= 20 THEN 'shared with ' || (degree - 1) || ' other techniques, giving it moderate specificity'
    ELSE 'shared with ' || (degree - 1) || ' other techniques, so it has low discriminative power on its own' END
  || CASE WHEN y > 0.66 THEN '; it''s also one of the primary evidence sources available for this technique' WHEN y > 0.33 THEN '; it contributes a moderate share of the available evidence for this technique'
    ELSE '; relative to other evidence for this technique, it''s a comparatively minor source' END || '.' AS reason
FROM part JOIN s ON p_brand = a AND p_type = b"""

SQL["relationship_strength"] = """WITH x AS (
  SELECT *, CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN p_name || ' = ' || p_type WHEN 3 THEN 'a = b' WHEN 4 THEN 'contains x' WHEN 5 THEN 'x | y' ELSE p_name END AS flt FROM part
), s AS (SELECT *, lower(trim(p_type)) || coalesce('|' || lower(trim(flt)), '') AS sig FROM x), n AS (SELECT sig, count(DISTINCT p_brand) AS n FROM s GROUP BY sig), r AS (SELECT p_partkey, 1 / sqrt(n) AS t,
  (CASE p_size % 7 WHEN 0 THEN 0.10 WHEN 1 THEN 0.42 WHEN 2 THEN CASE WHEN length(flt) > 15 THEN 0.90 ELSE 0.85 END WHEN 3 THEN 0.85 WHEN 4 THEN 0.72 WHEN 5 THEN 0.65
    ELSE CASE WHEN len(string_split(flt, ' ')) <= 3 AND length(flt) < 40 THEN 0.42 ELSE 0.52 END END)::DOUBLE AS f,
  (CASE WHEN p_size % 7 IN (0, 1) THEN 2 / 3 ELSE 1 END)::DOUBLE AS c FROM s JOIN n USING (sig))
SELECT p_partkey, round(t, 6) AS telemetry_specificity, f AS filter_specificity, round(c, 6) AS completeness, round(round(0.5 * t + 0.3 * f + 0.2 * c, 4), 3) AS relationship_strength FROM r"""

GRAPH = """WITH g AS (SELECT DISTINCT o_custkey AS c, p_brand AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
o AS (SELECT b, count(*) AS n FROM g GROUP BY b), s AS (SELECT x.b AS t1, y.b AS t2, count(*) AS group_count FROM g x JOIN g y ON x.c = y.c AND x.b <> y.b GROUP BY 1, 2),
p AS (SELECT t1, t2, group_count, group_count / o1.n AS co, ln((SELECT count(DISTINCT c) FROM g) / o2.n) AS ra FROM s JOIN o o1 ON o1.b = t1 JOIN o o2 ON o2.b = t2)"""
SQL["technique_pairs"] = f"""{GRAPH} SELECT t1, t2, group_count, round(co, 6) AS cooccurrence, round(ra, 6) AS global_rarity, round(co * ra, 6) AS combined_score FROM p"""
SQL["related_topk"] = f"""{GRAPH} SELECT t1, t2, group_count, row_number() OVER (PARTITION BY t1 ORDER BY round(co * ra, 6) DESC, round(co, 6) DESC, group_count DESC, t2) AS relation_rank FROM p WHERE round(co * ra, 6) >= 0.02 QUALIFY relation_rank <= 5"""

SQL["anti_missing"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
SQL["semi_filter"] = "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"
SQL["union_results"] = f"""{ALERTS}, {PAIRS}
SELECT event_id, mapping_id, 1.0::DOUBLE AS score, 'semantic' AS result_kind, NULL::BIGINT AS followup_uid FROM m UNION ALL SELECT source_uid, 'P-1', NULL, 'correlation', followup_uid FROM p"""
SQL["last_wins"] = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
SQL["size_sorted"] = "SELECT p_type, p_brand, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, p_type, p_brand) AS place FROM part GROUP BY 1, 2"
SQL["required_fields_by_log"] = "SELECT p_brand AS log_type, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_type, ' '))))), ',') AS required_fields FROM part GROUP BY 1"
SQL["null_counts"] = f"WITH {E} SELECT count(*) FILTER (nullif(k, 5) IS NULL) AS k, count(*) FILTER (event_type = 'view' OR event_type IS NULL) AS event_type, count(*) FILTER (value IS NULL) AS value FROM ev"

SQL["ordered_sequences"] = """WITH f AS (SELECT o_custkey, o_orderpriority AS p, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS o FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(p, ',' ORDER BY o) AS sequence FROM f GROUP BY 1 HAVING count(*) >= 3"""

VISITS = """v AS (SELECT user_id, t // 86400000000 AS day, list(event_type ORDER BY t, event_id) AS s FROM e GROUP BY 1, 2),
x AS (SELECT user_id, day, s, unnest(range(1, len(s))) AS n FROM v)"""
SQL["prefix_examples"] = f"WITH {E}, {VISITS} SELECT user_id, day, n, array_to_string(s[1:n], ' -> ') AS input_str, s[n + 1] AS target FROM x"
SQL["exact_split"] = """WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42/' || o_custkey)) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey, CASE WHEN i <= n * 70 // 100 THEN 'train' WHEN i <= n * 85 // 100 THEN 'validation' ELSE 'test' END AS part FROM orders JOIN k USING (o_custkey)"""
SQL["markov_counts"] = f"WITH {E}, {VISITS} SELECT array_to_string(s[greatest(1, n - 1):n], ',') AS history, s[n + 1] AS target, count(*) AS n FROM x GROUP BY 1, 2"
MARKOV = f"""WITH {E}, {VISITS}, c AS (SELECT array_to_string(s[greatest(1, n - 1):n], ',') AS h, s[n + 1] AS target, count(*) AS c FROM x WHERE user_id % 10 < 7 GROUP BY 1, 2),
tot AS (SELECT h, sum(c)::BIGINT AS total FROM c GROUP BY 1), w AS (SELECT DISTINCT event_type AS item FROM e),
q AS (SELECT user_id || '/' || day || '/' || n AS example_id, s[n + 1] AS target, array_to_string(s[greatest(1, n - 1):n], ',') AS h2, s[n] AS h1 FROM x WHERE user_id % 10 >= 7),
b AS (SELECT q.example_id, q.target, CASE WHEN a.total IS NOT NULL THEN h2 ELSE h1 END AS h, coalesce(a.total, d.total) AS total FROM q LEFT JOIN tot a ON a.h = h2 LEFT JOIN tot d ON d.h = h1),
p AS (SELECT example_id, b.target AS truth, item, CASE WHEN total IS NULL THEN 1.0 / (SELECT count(*) FROM w) ELSE (coalesce(c.c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (SELECT count(*) FROM w)) END AS probability FROM b CROSS JOIN w LEFT JOIN c ON c.h = b.h AND c.target = item),
k AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY probability DESC, item) AS rank FROM p QUALIFY rank <= 3)"""
SQL["markov_predict"] = f"{MARKOV} SELECT example_id, item, round(probability, 6)::DOUBLE AS probability, rank FROM k"
SQL["markov_eval"] = f"""{MARKOV}, h AS (SELECT q.example_id, k.rank FROM q LEFT JOIN k ON k.example_id = q.example_id AND k.item = q.target)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS top5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM h"""

FUSE = """WITH a AS (SELECT l_suppkey AS x, l_linenumber AS i, count(*)::DOUBLE AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey AS x, l_linenumber + 1 AS i, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)"""
SQL["fusion_soft"] = f"""{FUSE}, a2 AS (SELECT x, i, CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS s FROM a WINDOW w AS (PARTITION BY x)),
b2 AS (SELECT x, i, CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS s FROM b WINDOW w AS (PARTITION BY x))
SELECT coalesce(a2.x, b2.x) AS example_id, coalesce(a2.i, b2.i) AS item, round(pow(coalesce(a2.s, 0), 0.6) * pow(coalesce(b2.s, 0), 0.4), 6) AS score,
  row_number() OVER (PARTITION BY coalesce(a2.x, b2.x) ORDER BY pow(coalesce(a2.s, 0), 0.6) * pow(coalesce(b2.s, 0), 0.4) DESC, coalesce(a2.i, b2.i)) AS rank FROM a2 FULL JOIN b2 ON a2.x = b2.x AND a2.i = b2.i"""
SQL["fusion_hard"] = f"""{FUSE} SELECT a.x AS example_id, a.i AS item, a.s AS score, row_number() OVER (PARTITION BY a.x ORDER BY a.s DESC, a.i) AS rank FROM a JOIN b ON a.x = b.x AND a.i = b.i QUALIFY rank <= 3"""

SQL["forward_pairs"] = f"""WITH {E}
SELECT a.event_id, b.event_id AS later, a.user_id = b.user_id AS same_user FROM e a JOIN e b ON b.t BETWEEN a.t AND a.t + 60000000 AND (b.t > a.t OR b.event_id >= a.event_id)"""
SQL["centered_pairs"] = f"""WITH {E} SELECT a.event_id, b.event_id AS near FROM e a JOIN e b ON b.t BETWEEN a.t - 60000000 AND a.t + 60000000"""
SQL["pair_nulls"] = f"""WITH {E}, x AS (SELECT event_id, event_type, CASE WHEN k % 25 = 0 THEN NULL ELSE user_id END AS u, CASE WHEN k % 25 = 1 THEN NULL ELSE t END AS t FROM e)
SELECT 'P-2' AS mapping_id, a.event_id AS source_uid, b.event_id AS followup_uid, (1 + coalesce((a.u = b.u)::INT, 0) + (a.t IS NOT NULL AND b.t IS NOT NULL)::INT)::BIGINT AS n_evidence
FROM x a JOIN x b ON (a.u IS NULL OR b.u IS NULL OR a.u = b.u) AND (a.t IS NULL OR b.t IS NULL OR b.t BETWEEN a.t AND a.t + 3600000000) WHERE a.event_type = 'signup' AND b.event_type = 'purchase'"""

SQL["decode_alerts"] = f"""WITH {E}, x AS (SELECT *, coalesce(k % 5, 4) AS c FROM e)
SELECT event_id AS line, CASE c WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '0' WHEN 3 THEN 'b' || event_id END AS id,
  CASE c WHEN 0 THEN coalesce(nullif(k::VARCHAR, '0'), nullif(event_id::VARCHAR, '0'), 'N/A') WHEN 1 THEN 'e' || event_id WHEN 3 THEN 'b' || event_id ELSE 'N/A' END AS event_id,
  CASE c WHEN 1 THEN 'p' WHEN 4 THEN 'd' ELSE 'N/A' END AS provider, CASE c WHEN 0 THEN t // 1000000 * 1000000 WHEN 1 THEN (1755086400 + k % 60) * 1000000 END AS at,
  CASE c WHEN 0 THEN k::VARCHAR END AS rule_id, c = 2 AS bad, 'Wazuh' AS telemetry_source, 'alerts.json' AS log_type FROM x"""
SQL["alert_counters"] = f"""WITH {E} SELECT count(*) AS lines, count(*) FILTER (coalesce(k % 5, 4) <> 2) AS decoded, count(*) FILTER (coalesce(k % 5, 4) = 2) AS errors FROM e"""

SQL["condition_traps"] = f"""WITH {E}, x AS (SELECT event_id, k, coalesce(k % 6, 5) AS a, coalesce(k % 3, 2) AS b FROM e)
SELECT event_id, a IN (1, 3, 4) AS text_gt, a IN (1, 3) AS text_le, b = 1 AND k > 1 AS nan_gt, b = 1 AS nan_lt, b = 0 AS nan_eq, b = 0 OR (b = 1 AND k <> 7) AS nan_ne, b = 1 AND k > 1 AS metric_gt,
  true AS absent_null, false AS absent_ne, a = 5 AS deep, true AS deeper FROM x"""
SQL["correlation_conditions"] = f"""WITH {E}, c AS (SELECT event_type AS kind, count(*)::DOUBLE AS n FROM e GROUP BY 1)
SELECT kind, NULL::VARCHAR AS absent, n > 2000 AS detected, unnest(['n', 'mean', 'kinds']) AS metric, unnest([n, NULL, 0.0]) AS value, unnest([n > 2000, true, true]) AS holds FROM c"""
SQL["semantic_reasons"] = f"""WITH {E}
SELECT event_id, 'E-1' AS mapping_id, CASE WHEN value IS NULL THEN 'null_required_field:value' WHEN user_id IS NULL THEN 'null_required_field:user' ELSE 'semantic_conditions_failed' END AS reason
FROM e WHERE event_type IN ('purchase', 'view') AND NOT coalesce(value > 50 AND (k < 10 OR user_id IN (1, 2, 3, 5, 8)), false)
UNION ALL SELECT event_id, 'E-3', 'semantic_conditions_failed' FROM e WHERE event_type = 'error' AND k IS NULL
UNION ALL SELECT event_id, 'E-4', 'missing_required_field:absent' FROM e WHERE event_type = 'view' UNION ALL SELECT event_id, 'E-5', 'correlation_required' FROM e WHERE event_type = 'view'"""

# The rubric's score of each filter text, told by hand.
RUBRIC = (
    ("this is a long descriptive text about it", 0.52), ("match abc defghij klm", 0.72), ("start with this thing", 0.72), ("this matches", 0.42), ("foo equals bar baz qux quux", 0.52), ("a = b", 0.85), ("ActionType = CreateRemoteThread", 0.90),
    ("x == 1", 0.85), ("equals: value", 0.85), ('Name is "calc.exe"', 0.90), ("name is calc", 0.42), ("contains x", 0.72), ("contain y z", 0.72), ("likely", 0.42), ("a like b", 0.72), ("regexes", 0.42), ("regex", 0.72), ("end  with z", 0.72),
    ("*.exe", 0.72), ("50%", 0.72), ("a and b", 0.65), ("a && b", 0.65), ("x|y", 0.65), ("band or", 0.42), ("one", 0.42), ("two words here", 0.42), ("four words are here now", 0.52), ("a!=b", 0.42), (" ", 0.10), ("=", 0.42),
)
SQL["filter_rubric"] = f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}', {v})" for i, (t, v) in enumerate(RUBRIC))}) AS v(i, text, score))
SELECT p_partkey, text, score::DOUBLE AS score FROM part JOIN r ON p_partkey % {len(RUBRIC)} = i"""

SQL["group_uses"] = "SELECT DISTINCT 'G' || l_suppkey AS group_id, 'T' || p_brand AS technique_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
SQL["campaign_sequences"] = """WITH x AS (SELECT DISTINCT c_custkey, c_name, c_nationkey, o_orderpriority AS p, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 13 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 99 ELSE 8 END AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_name AS campaign, c_nationkey || '.json' AS source_file, string_agg('T' || p, ',' ORDER BY r) AS sequence, count(*) AS length FROM x GROUP BY c_custkey, c_name, c_nationkey HAVING count(*) >= 3"""
SQL["technique_lookup"] = "SELECT DISTINCT 'T' || p_brand AS technique_id, p_brand AS name, 'technique' AS kind FROM part UNION ALL SELECT 'G' || s_suppkey, s_name, 'group' FROM supplier"
SQL["knowledge_candidates"] = f"""{GRAPH} SELECT t1 AS technique_id, t2 AS next, round(co * ra, 6) AS score FROM p WHERE round(co * ra, 6) > 0"""
SQL["related_twenty"] = f"""{GRAPH} SELECT t1, t2, row_number() OVER (PARTITION BY t1 ORDER BY round(co * ra, 6) DESC, round(co, 6) DESC, group_count DESC, t2) AS relation_rank FROM p QUALIFY relation_rank <= 20"""
SQL["lookup_enriched"] = "SELECT c_custkey, coalesce(string_agg(p, ',' ORDER BY p), '') AS priorities FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) ON o_custkey = c_custkey GROUP BY 1"
SQL["zero_counts"] = "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"
SQL["full_row_dedup"] = "SELECT l_returnflag, l_linestatus, l_quantity, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2, 3"
SQL["clean_cells"] = f"""WITH {E} SELECT event_id, concat_ws(', ', event_type, k_text) AS a, '{{"k":' || k || '}}' AS o, event_type AS s, CASE WHEN k % 2 = 0 THEN 'True' WHEN k % 2 = 1 THEN 'False' END AS b FROM e"""
SQL["flat_columns"] = f"""WITH {E} SELECT event_id, event_type AS event_name, k AS event_at_k, ip AS event_at_ip FROM ev"""
SQL["event_identity"] = f"""WITH {E} SELECT event_id, event_type || '|' || coalesce(nullif(k, 5)::VARCHAR, 'None') || '|' || user_id AS identity FROM e"""
SQL["chained_times"] = f"""WITH {E} SELECT event_id, CASE k % 4 WHEN 0 THEN t // 1000000 * 1000000 WHEN 1 THEN t // 1000000 * 1000000 WHEN 2 THEN 1755086400000000 END AS at FROM e"""
SQL["supported_sequences"] = f"""WITH {E}, {VISITS}, f AS (SELECT user_id, day, [i FOR i IN s IF i IN ('view', 'click', 'purchase')] AS l FROM v) SELECT user_id, day, array_to_string(l, ',') AS sequence FROM f WHERE len(l) >= 3"""
SQL["encoded_prefixes"] = f"""WITH {E}, {VISITS}, w AS (SELECT event_type AS item, row_number() OVER (ORDER BY event_type) + 1 AS i FROM (SELECT DISTINCT event_type FROM e)),
y AS (SELECT user_id, day, n, unnest(range(greatest(1, n - 3), n + 1)) AS p, s FROM x)
SELECT user_id, day, n, repeat('0,', greatest(0, 4 - n)::BIGINT) || string_agg(CASE WHEN item = 'error' THEN 1 ELSE i END, ',' ORDER BY p) AS input FROM y JOIN w ON item = s[p] GROUP BY user_id, day, n"""
SQL["fusion_sequence"] = f"""{FUSE} SELECT x AS example_id, i AS item, s AS score, row_number() OVER (PARTITION BY x ORDER BY s DESC, i) AS rank FROM a QUALIFY rank <= 3"""
SQL["stream_replay"] = f"""WITH RECURSIVE {E}, u AS (SELECT * FROM ev WHERE event_type = 'purchase'), {chain('q', 'u', 21600)}, two AS (SELECT u.*, g FROM u ASOF JOIN q ON u.t >= q.s)
SELECT 'C-2' AS mapping_id, g AS time_group_id, '{{"user":' || user_id || '}}' AS group_key, count(*) AS n_events FROM two GROUP BY g, user_id HAVING count(*) >= 2"""
SQL["stream_detect"] = SQL["correlation_detect"]
SQL["stream_pairs"] = SQL["pair_correlation"]
SQL["stream_pairs_across"] = SQL["pair_correlation"]
SQL["campaign_order"] = """WITH x AS (SELECT c_name AS campaign FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(DISTINCT o_orderpriority) >= 3)
SELECT campaign, row_number() OVER (ORDER BY campaign) AS place FROM x"""
SQL["context_boosts"] = f"""WITH {E}, x AS (
  SELECT event_id, c_mktsegment AS role, CASE WHEN k % 4 = 1 THEN 'vpn_zone' WHEN k % 4 = 2 AND user_id % 256 < 128 THEN 'dmz' ELSE 'internal' END AS zone FROM ev LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey WHERE event_type = 'click'
), y AS (SELECT *, CASE WHEN role = 'BUILDING' THEN 0.3 ELSE 0 END + CASE WHEN zone <> 'internal' THEN 0.05 ELSE 0 END AS b FROM x)
SELECT event_id, round(least(1.0, 0.9 + b), 4)::DOUBLE AS score, round(b, 4)::DOUBLE AS context_boost,
  'host.role: ' || CASE WHEN role IS NULL THEN 'context_unavailable' WHEN role = 'BUILDING' THEN 'matched' ELSE 'not_matched' END || '; ip.location: ' || CASE WHEN zone <> 'internal' THEN 'matched' ELSE 'not_matched' END AS said FROM y"""
SQL["match_report"] = f"""{MATCHES} SELECT printf('%s %s score=%.2f [%s]', mapping_id, technique_id, round(least(1.0, base + boost), 4)::DOUBLE, matched) AS line, count(*) AS n FROM m GROUP BY 1"""
SQL["result_summary"] = f"""{MATCHES} SELECT technique_id, count(*) AS n, max(round(least(1.0, base + boost), 4))::DOUBLE AS best FROM m GROUP BY 1"""
SQL["needed_logs"] = f"""WITH {E}
SELECT a.event_id, coalesce(string_agg(b.event_id::VARCHAR, ',' ORDER BY b.t, b.event_id), '') AS needed
FROM e a LEFT JOIN e b ON b.event_type IN ('purchase', 'error') AND b.t BETWEEN a.t - 120000000 AND a.t + 120000000 WHERE a.event_type = 'click' GROUP BY a.event_id"""
SQL["detection_lines"] = f"""SELECT printf('%s %s group=%s window=%d events=%d score=%.2f %s', mapping_id, technique_id, group_key, time_group_id, n_events, score, metrics) AS line FROM ({SQL["correlation_detect"]})"""
SQL["pair_lines"] = f"""SELECT printf('%s %s -> %s confidence=%.2f [%s]', mapping_id, source_uid::VARCHAR, followup_uid::VARCHAR, confidence, evidence) AS line FROM ({SQL["pair_correlation"]})"""
