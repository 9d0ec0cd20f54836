"""SQL twins of catalogue.py for DuckDB, written from the queries' meaning, not from their plans."""

_MUNI = """muni AS (SELECT lpad(c_custkey::varchar, 9, '0') AS code, c_name AS name, n_name AS prefecture,
  CASE WHEN c_custkey % 7 <> 0 THEN 'https://' || lower(c_mktsegment) || '.example.jp/' || c_custkey::varchar END AS base_url,
  CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::int END AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_MEET = """meet AS (SELECT lpad(o_orderkey::varchar, 12, '0') AS id, lpad(o_custkey::varchar, 9, '0') AS municipality_code,
  'Meeting ' || o_orderpriority || ' of ' || strftime(o_orderdate, '%Y-%m') AS title,
  CASE o_orderstatus WHEN 'P' THEN 'committee' WHEN 'F' THEN 'extraordinary' ELSE 'plenary' END AS meeting_type,
  o_orderdate::date AS held_on, CASE WHEN o_orderkey % 5 <> 0 THEN 'Summary ' || o_orderpriority END AS summary,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'https://example.jp/m/' || o_orderkey::varchar END AS source_url FROM orders)"""
_DIG = """dig AS (SELECT lpad(l_orderkey::varchar, 12, '0') AS meeting_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS price,
  p_name AS topic, CASE WHEN l_quantity >= 25 THEN 'primary' ELSE 'secondary' END AS relevance,
  p_brand || ' ' || p_type || ' Digest of ' || p_name AS digest, 'S' || l_suppkey::varchar AS speakers FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_NUM = """num AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY line, part, supplier, price, topic, relevance, digest, speakers) - 1 AS pos FROM dig)"""
_ALL = f"WITH {_MUNI}, {_MEET}, {_DIG}, {_NUM}"
_STMT = """stmt AS (SELECT conv_id::varchar || '-' || turn::varchar AS id, conv_id AS meeting_id, turn AS position,
  CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE 'remark' END AS kind,
  CASE WHEN role <> 'system' THEN 'Speaker ' || role END AS speaker_name,
  CASE role WHEN 'assistant' THEN '部長' WHEN 'user' THEN '議員' END AS speaker_role, coalesce(text, '') AS content FROM conversations)"""
_LIST = "SELECT m.id, m.title, m.held_on, u.prefecture, u.name AS municipality FROM meet m JOIN muni u ON m.municipality_code = u.code"
_IDX = "idx AS (SELECT municipality_code, m.id AS meeting_id, held_on, row_number() OVER (PARTITION BY municipality_code ORDER BY held_on, m.id, pos) - 1 AS index, topic, relevance, left(digest, 120) AS digest_preview FROM meet m JOIN num d ON m.id = d.meeting_id)"
_MEM = """mem AS (SELECT municipality_code, list_extract(string_split(topic, ' '), -1) AS canonical_name, 0 AS position, index AS member_index FROM idx WHERE relevance = 'primary'
  UNION ALL SELECT municipality_code, 'extra', 1, index FROM idx WHERE topic LIKE 'small%')"""
_ORD = "o AS (SELECT o_orderkey, year(o_orderdate) + 20 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)"
_SQUEEZE = "regexp_replace({}, '[\\s\\x0B\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')"
_ENT = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_STRIP = _ENT.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')")
_HTML_A = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


def _tree(role: str) -> str:
    """The answer roles of the tree-navigated family as alternatives of one pattern."""
    roles = "市長|町長|村長|副市長|副町長|副村長|市長室長|支所長|センター長|部長|課長|室長|局長|係長|主任|補佐|主査"
    return f"regexp_matches({role}, '({roles})$')"


_PLAIN = """CASE WHEN role = '' THEN 'remark' WHEN role LIKE '%議員' OR role LIKE '%委員' OR regexp_matches(role, '^[0-9０-９]+番$') THEN 'question'
  WHEN role = '議長' OR role LIKE '%委員長' THEN 'remark'
  WHEN regexp_matches(role, '(市長|町長|村長|副市長|副町長|副村長|副知事|知事|部長|課長|室長|局長|係長|主任|補佐|主査|事務局長|議会事務局長|書記|参事|次長|理事|総務部長|財政部長)$') THEN 'answer' ELSE '{}' END"""

ORACLE: dict[str, str] = {
    "list_meetings": f"{_ALL} {_LIST} ORDER BY m.held_on DESC, m.id DESC LIMIT 21",
    "list_meetings_filtered": f"{_ALL} {_LIST} WHERE m.held_on BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND u.prefecture = 'NATION_3' AND m.title LIKE '%HIGH%' ORDER BY m.held_on DESC, m.id DESC LIMIT 51",
    "list_meetings_tokens": f"{_ALL} {_LIST} WHERE u.name LIKE '%Customer%' AND u.name LIKE '%00%' AND u.name LIKE '%7%' ORDER BY m.held_on DESC, m.id DESC LIMIT 31",
    "list_meetings_codes": f"{_ALL} {_LIST} WHERE m.municipality_code IN ('000000007', '000000011', '000000013') ORDER BY m.held_on DESC, m.id DESC LIMIT 41",
    "list_meetings_cursor_compat": f"{_ALL} {_LIST} WHERE m.id < '000000000700' ORDER BY m.held_on DESC, m.id DESC LIMIT 21",
    "list_meetings_cursor_keyset": f"{_ALL} {_LIST} WHERE (m.held_on, m.id) < (DATE '1999-06-01', '000000000700') ORDER BY m.held_on DESC, m.id DESC LIMIT 21",
    "list_municipalities_code": f"WITH {_MUNI} SELECT code AS id, code, name, prefecture, NULL::varchar AS base_url, population, 0 AS meeting_count, NULL::varchar AS system_type_description FROM muni ORDER BY prefecture, code LIMIT 50 OFFSET 10",
    "list_municipalities_population": f"WITH {_MUNI} SELECT code AS id, code, name, prefecture, base_url, population, 0 AS meeting_count, NULL::varchar AS system_type_description FROM muni ORDER BY population DESC NULLS LAST, code LIMIT 60 OFFSET 20",
    "list_municipalities_tokens": f"WITH {_MUNI} SELECT code AS id, code, name, prefecture, base_url, population, 0 AS meeting_count, NULL::varchar AS system_type_description FROM muni WHERE (name LIKE '%NATION_1%' OR prefecture LIKE '%NATION_1%' OR base_url LIKE '%NATION_1%') AND (name LIKE '%machinery%' OR prefecture LIKE '%machinery%' OR base_url LIKE '%machinery%') ORDER BY prefecture, code LIMIT 100",
    "list_municipalities_total": f"WITH {_MUNI} SELECT count(*) AS total FROM muni WHERE (name LIKE '%NATION_1%' OR prefecture LIKE '%NATION_1%' OR base_url LIKE '%NATION_1%') AND (name LIKE '%machinery%' OR prefecture LIKE '%machinery%' OR base_url LIKE '%machinery%')",
    "search_topics": f"{_ALL} SELECT m.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, topic AS matched_topic, relevance, left(digest, 200) AS digest_preview FROM meet m JOIN num d ON m.id = d.meeting_id WHERE (topic ILIKE '%gear%' OR digest ILIKE '%gear%' OR summary ILIKE '%gear%') AND held_on >= DATE '1996-01-01' ORDER BY m.held_on DESC, m.id DESC, pos LIMIT 30",
    "search_topics_indexed": f"{_ALL} SELECT m.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, topic AS matched_topic, relevance, left(digest, 200) AS digest_preview FROM meet m JOIN num d ON m.id = d.meeting_id WHERE (topic ILIKE '%large gear%' OR digest ILIKE '%large gear%' OR summary ILIKE '%large gear%') AND held_on >= DATE '1996-01-01' ORDER BY m.held_on DESC, m.id DESC, pos LIMIT 30",
    "documents_with": "SELECT words, doc_id, source FROM documents, (VALUES ('general public license'), ('permission is hereby granted'), ('c'), ('l%cense _y')) v(words) WHERE text ILIKE '%' || words || '%'",
    "search_topics_summary_only": f"{_ALL} SELECT m.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, topic AS matched_topic, relevance, left(digest, 200) AS digest_preview FROM meet m JOIN num d ON m.id = d.meeting_id WHERE (topic ILIKE '%summary 2-high%' OR digest ILIKE '%summary 2-high%' OR summary ILIKE '%summary 2-high%') AND held_on <= DATE '1998-12-31' ORDER BY m.held_on DESC, m.id DESC, pos LIMIT 100",
    "search_topics_wildcard": f"{_ALL} SELECT m.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, topic AS matched_topic, relevance, left(digest, 200) AS digest_preview FROM meet m JOIN num d ON m.id = d.meeting_id WHERE (topic ILIKE '%s_all%bolt%' OR digest ILIKE '%s_all%bolt%' OR summary ILIKE '%s_all%bolt%') ORDER BY m.held_on DESC, m.id DESC, pos LIMIT 50",
    "timeline_topic": f"{_ALL}, top AS (SELECT m.*, u.name AS municipality_name, u.prefecture FROM meet m JOIN muni u ON m.municipality_code = u.code WHERE held_on >= DATE '1996-03-01' AND EXISTS (SELECT 1 FROM num d WHERE d.meeting_id = m.id AND (topic ILIKE '%blue bolt%' OR digest ILIKE '%blue bolt%')) ORDER BY held_on, id LIMIT 100) SELECT t.id AS meeting_id, title, t.held_on::varchar AS held_on, meeting_type, source_url, municipality_code, municipality_name, prefecture, (row_number() OVER (PARTITION BY t.id ORDER BY pos) - 1)::int AS pos, topic, relevance, digest, speakers FROM top t JOIN num d ON d.meeting_id = t.id WHERE contains(lower(topic), 'blue bolt') OR contains(lower(digest), 'blue bolt')",
    "compare_topics": f"{_ALL}, top AS (SELECT m.*, u.name AS municipality_name, u.prefecture FROM meet m JOIN muni u ON m.municipality_code = u.code WHERE EXISTS (SELECT 1 FROM num d WHERE d.meeting_id = m.id AND (topic ILIKE '%gear%' OR digest ILIKE '%gear%')) AND EXISTS (SELECT 1 FROM num d WHERE d.meeting_id = m.id AND (topic ILIKE '%promo%' OR digest ILIKE '%promo%')) ORDER BY held_on DESC, id DESC LIMIT 40) SELECT t.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, municipality_code, municipality_name, prefecture, (SELECT string_agg(topic, ',' ORDER BY pos) FROM num d WHERE d.meeting_id = t.id AND (contains(lower(topic), 'gear') OR contains(lower(digest), 'gear'))) AS topics_gear, (SELECT string_agg(topic, ',' ORDER BY pos) FROM num d WHERE d.meeting_id = t.id AND (contains(lower(topic), 'promo') OR contains(lower(digest), 'promo'))) AS topics_promo FROM top t",
    "compare_topics_bare": f"{_ALL}, has AS (SELECT meeting_id, bool_or(digest ILIKE '%anvil%' OR topic ILIKE '%anvil%') a, bool_or(digest ILIKE '%widget%' OR topic ILIKE '%widget%') b, bool_or(digest ILIKE '%ring%' OR topic ILIKE '%ring%') c, string_agg(topic, ',' ORDER BY pos) FILTER (contains(lower(digest), 'anvil') OR contains(lower(topic), 'anvil')) AS topics_anvil FROM num GROUP BY 1) SELECT id AS meeting_id, held_on::varchar AS held_on, municipality_code, topics_anvil FROM meet JOIN has ON id = meeting_id WHERE a AND b AND c ORDER BY held_on DESC, id DESC LIMIT 40",
    "meeting_digest": f"{_ALL} SELECT m.id AS meeting_id, title, held_on::varchar AS held_on, meeting_type, source_url, summary, count(pos)::int AS n_topics, coalesce(string_agg(topic, ',' ORDER BY pos), '') AS topics FROM meet m LEFT JOIN num d ON m.id = d.meeting_id WHERE m.id = '000000000003' GROUP BY ALL",
    "audit_totals": f"{_ALL} SELECT count(DISTINCT m.id) AS meetings, count(*) AS topics FROM meet m JOIN num d ON m.id = d.meeting_id",
    "audit_patterns": f"{_ALL}, pat(pattern) AS (VALUES ('Small Ring'), ('small'), ('economy'), ('absent')), hit AS (SELECT pattern, row_number() OVER (PARTITION BY pattern ORDER BY held_on DESC, m.id DESC, pos) AS n, m.id AS meeting_id, held_on::varchar AS held_on, topic, left(digest, 160) AS preview FROM meet m JOIN num d ON m.id = d.meeting_id JOIN pat ON contains(lower(topic), lower(pattern)) OR contains(lower(digest), lower(pattern))) SELECT pattern, n::int AS n, meeting_id, held_on, topic, preview FROM hit WHERE n <= 25",
    "audit_report": f"{_ALL}, pat(pattern) AS (VALUES ('Small Ring'), ('small'), ('economy'), ('absent')), hit AS (SELECT pattern, row_number() OVER (PARTITION BY pattern ORDER BY held_on DESC, m.id DESC, pos) AS n, m.id AS meeting_id FROM meet m JOIN num d ON m.id = d.meeting_id JOIN pat ON contains(lower(topic), lower(pattern)) OR contains(lower(digest), lower(pattern))) SELECT pattern, count(*) AS hits, count(DISTINCT meeting_id) AS meetings FROM hit WHERE n <= 100000 GROUP BY 1",
    "topic_index": f"{_ALL}, {_IDX} SELECT * FROM idx",
    "cluster_missing": f"{_ALL}, {_IDX}, {_MEM} SELECT municipality_code, index, topic FROM idx i WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.municipality_code = i.municipality_code AND member_index = index)",
    "cluster_dupes": f"{_ALL}, {_IDX}, {_MEM} SELECT municipality_code, member_index AS index, count(*) AS n FROM mem GROUP BY 1, 2 HAVING count(*) > 1",
    "cluster_topics": f"{_ALL}, {_IDX}, {_MEM}, nm AS (SELECT m.municipality_code, canonical_name, topic, min(index) AS first FROM mem m JOIN idx i ON m.municipality_code = i.municipality_code AND member_index = index GROUP BY 1, 2, 3) SELECT municipality_code, canonical_name, coalesce(string_agg(topic, ',' ORDER BY first, topic) FILTER (topic <> canonical_name), '') AS aliases FROM nm GROUP BY 1, 2",
    "cluster_links": f"{_ALL}, {_IDX}, {_MEM}, r AS (SELECT i.meeting_id, m.municipality_code, canonical_name, relevance, digest_preview AS digest, row_number() OVER (PARTITION BY m.municipality_code, canonical_name, i.meeting_id ORDER BY position, index) AS n FROM mem m JOIN idx i ON m.municipality_code = i.municipality_code AND member_index = index) SELECT meeting_id, municipality_code, canonical_name, relevance, digest FROM r WHERE n = 1",
    "clusterer_rows": f"{_ALL}, {_IDX} SELECT list_extract(string_split(topic, ' '), -1) AS canonical_name, count(*) AS members, count(DISTINCT municipality_code) AS municipalities FROM idx GROUP BY 1",
    "prompt_lines": f"{_ALL}, {_IDX} SELECT municipality_code, index::varchar || chr(9) || topic || chr(9) || digest_preview AS line FROM idx",
    "statement_offsets": f"WITH {_STMT}, s AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY meeting_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_offset FROM stmt) SELECT meeting_id, position, start_offset, (start_offset + length(content))::bigint AS end_offset FROM s",
    "speaker_runs": f"WITH {_STMT}, l AS (SELECT meeting_id, position, CASE WHEN row_number() OVER w > 1 AND lag(speaker_name) OVER w IS DISTINCT FROM speaker_name THEN 1 ELSE 0 END AS c FROM stmt WINDOW w AS (PARTITION BY meeting_id ORDER BY position)) SELECT meeting_id, position, (sum(c) OVER (PARTITION BY meeting_id ORDER BY position))::bigint AS run FROM l",
    "chunk_statements": f"""WITH RECURSIVE {_STMT}, f AS (SELECT * FROM stmt WHERE kind <> 'question' AND length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(12288) || chr(160))) >= 5),
      l AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker_name) OVER w IS DISTINCT FROM speaker_name THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY meeting_id ORDER BY position)),
      r AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY position) AS run FROM l),
      n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, run ORDER BY position) AS k, length(content) AS len FROM r),
      walk AS (SELECT meeting_id, run, k, len AS held, 0 AS chunk FROM n WHERE k = 1 UNION ALL
        SELECT n.meeting_id, n.run, n.k, CASE WHEN w.held + n.len > 900 THEN n.len ELSE w.held + n.len END, CASE WHEN w.held + n.len > 900 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN n ON n.meeting_id = w.meeting_id AND n.run = w.run AND n.k = w.k + 1)
      SELECT n.meeting_id, n.run::bigint AS run, chunk::int AS chunk_index, first(speaker_name ORDER BY n.k) AS speaker_name, first(speaker_role ORDER BY n.k) AS speaker_role, string_agg(id, ',' ORDER BY n.k) AS statement_ids, sha256(string_agg(content, chr(10) ORDER BY n.k)) AS content_hash
      FROM n JOIN walk w ON n.meeting_id = w.meeting_id AND n.run = w.run AND n.k = w.k GROUP BY n.meeting_id, n.run, chunk""",
    "transcript": f"WITH {_STMT} SELECT meeting_id, string_agg('[' || kind || '] ' || coalesce(nullif(concat_ws('/', speaker_name, speaker_role), ''), '不明') || ': ' || content, chr(10) ORDER BY position) AS transcript FROM stmt GROUP BY 1",
    "carry_speaker": "WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'U' || turn::varchar END AS h FROM conversations), b AS (SELECT conv_id, turn, (count(h) OVER w)::bigint AS block, last_value(h IGNORE NULLS) OVER w AS under FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT * FROM b WHERE block > 0",
    "content_order": f"WITH {_STMT} SELECT meeting_id, position, (row_number() OVER (PARTITION BY meeting_id ORDER BY CASE WHEN position % 3 <> 1 THEN length(content) END ASC NULLS LAST, position))::int AS place FROM stmt",
    "noise_flags": f"WITH {_STMT}, c AS (SELECT meeting_id, position, ['○','◆','△','','◎',''][(position % 6 + 1)::int] || content AS content FROM stmt) SELECT meeting_id, position, content LIKE '○%' OR content LIKE '△%' OR ((content LIKE '◆%' OR content LIKE '◎%') AND (length(content) < 20 OR (length(content) < 50 AND regexp_matches(content, '～[^～]{{1,30}}～')))) AS procedural, length(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(12288) || chr(160))) < 12 AS short FROM c",
    "first_wins": "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "last_wins": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "insert_ignore": """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, strftime(ts, '%Y-%m-%d %H') AS hour, CASE WHEN event_type <> 'click' THEN (props->>'k')::int END AS k FROM events),
      t AS (SELECT * FROM e WHERE event_type = 'purchase'), n AS (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e WHERE event_type <> 'purchase'
        AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.hour = e.hour) AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND t.k = e.k)),
      walk AS (SELECT event_id, user_id, i, true AS stays, [hour] AS hours, CASE WHEN k IS NULL THEN []::int[] ELSE [k] END AS ks FROM n WHERE i = 1 UNION ALL
        SELECT n.event_id, n.user_id, n.i, NOT (list_contains(hours, n.hour) OR coalesce(list_contains(ks, n.k), false)),
          CASE WHEN list_contains(hours, n.hour) OR coalesce(list_contains(ks, n.k), false) THEN hours ELSE list_append(hours, n.hour) END,
          CASE WHEN n.k IS NULL OR list_contains(hours, n.hour) OR coalesce(list_contains(ks, n.k), false) THEN ks ELSE list_append(ks, n.k) END FROM walk w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
      SELECT n.event_id, n.user_id, n.hour, n.k FROM n JOIN walk w ON n.event_id = w.event_id WHERE stays""",
    "insert_ignore_exact": """WITH RECURSIVE n AS (SELECT event_id AS id, user_id, event_id % 300 AS a, CASE WHEN event_id % 5 <> 0 THEN floor(event_id / 7)::bigint % 200 END AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      walk AS (SELECT id, user_id, i, true AS stays, [a] AS seen_a, CASE WHEN b IS NULL THEN []::bigint[] ELSE [b] END AS seen_b FROM n WHERE i = 1 UNION ALL
        SELECT n.id, n.user_id, n.i, NOT (list_contains(seen_a, n.a) OR coalesce(list_contains(seen_b, n.b), false)),
          CASE WHEN list_contains(seen_a, n.a) OR coalesce(list_contains(seen_b, n.b), false) THEN seen_a ELSE list_append(seen_a, n.a) END,
          CASE WHEN n.b IS NULL OR list_contains(seen_a, n.a) OR coalesce(list_contains(seen_b, n.b), false) THEN seen_b ELSE list_append(seen_b, n.b) END FROM walk w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
      SELECT n.id, n.user_id, n.a, n.b FROM n JOIN walk w ON n.id = w.id WHERE stays""",
    "upsert_topics": "WITH old AS (SELECT p_brand, p_name, count(*) AS n, max(p_type) AS description FROM part WHERE p_size < 30 GROUP BY 1, 2), new AS (SELECT p_brand, p_name, count(*) * 10 AS n, min(p_type) AS description FROM part WHERE p_size >= 20 GROUP BY 1, 2) SELECT p_brand, p_name, n, description FROM new UNION ALL SELECT p_brand, p_name, n, description FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.p_brand = old.p_brand AND new.p_name = old.p_name)",
    "keyed_update": f"WITH {_MEET} SELECT id, CASE WHEN meeting_type = 'committee' THEN upper(summary) ELSE summary END AS summary, CASE WHEN meeting_type = 'committee' THEN 'x' ELSE meeting_type END AS meeting_type FROM meet",
    "orphans_anti": "SELECT lpad(o_orderkey::varchar, 12, '0') AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey)",
    "dir_validation": "SELECT doc_id, source || '/' || lang AS dir, n_chars FROM documents WHERE source || '/' || lang NOT IN (SELECT source || '/' || lang FROM documents WHERE n_chars >= 12000)",
    "corrected_preferred": "SELECT doc_id, source, lang, n_chars FROM (SELECT *, max(CASE WHEN n_chars > 8000 THEN 1 ELSE 0 END) OVER (PARTITION BY source, lang) AS a FROM documents) WHERE a = 0 OR n_chars > 8000 OR doc_id % 10 = 0",
    "meetings_by_month": f"WITH {_MEET} SELECT meeting_type, strftime(held_on, '%Y-%m') AS month, min(id) AS first, count(*)::int AS n FROM meet GROUP BY 1, 2",
    "calendar_year": f"WITH {_MEET} SELECT id, held_on FROM meet WHERE year(held_on) = 1997",
    "truncated_lists": f"WITH {_MEET} SELECT municipality_code, id, total > 5 AS truncated FROM (SELECT municipality_code, id, row_number() OVER (PARTITION BY municipality_code ORDER BY id) AS n, count(*) OVER (PARTITION BY municipality_code) AS total FROM meet) WHERE n <= 5",
    "failures_by_system": "SELECT CASE WHEN contains(url, 'ssp.kaigiroku.net') OR regexp_matches(url, '/tenant/[^/]+/') THEN 'discussnet_ssp' WHEN contains(url, 'dbsr.jp') THEN 'dbsearch' WHEN contains(url, 'kensakusystem.jp') AND NOT contains(url, '-vod/') THEN 'kensakusystem' WHEN contains(url, 'gijiroku.com') OR regexp_matches(url, '(?i)/VOICES/') OR regexp_matches(url, '(?i)g0[78]v_search\\.asp') THEN 'gijiroku_com' ELSE 'custom' END AS system, count(*) AS pages, count(*) FILTER (page_id % 7 = 0) AS failed FROM pages GROUP BY 1",
    "rate_demand": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "rate_admission": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      walk AS (SELECT event_id, user_id, k, [us] AS log, true AS admitted, 1 AS remaining FROM e WHERE k = 1 UNION ALL
        SELECT e.event_id, e.user_id, e.k, CASE WHEN len(list_filter(log, lambda t: t > us - 86400000000)) < 2 THEN list_append(list_filter(log, lambda t: t > us - 86400000000), us) ELSE list_filter(log, lambda t: t > us - 86400000000) END,
          len(list_filter(log, lambda t: t > us - 86400000000)) < 2, CASE WHEN len(list_filter(log, lambda t: t > us - 86400000000)) < 2 THEN 1 - len(list_filter(log, lambda t: t > us - 86400000000)) ELSE 0 END
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1) SELECT event_id, admitted, remaining::int AS remaining FROM walk""",
    "usage_json": "SELECT event_id, (props->>'k')::int AS k FROM events",
    "token_cost": "SELECT role AS model, sum(length(text))::bigint AS input_tokens, count(*) AS output_tokens, round(sum(length(text)) / 1e6 * CASE role WHEN 'user' THEN 0.3 ELSE 1.25 END::double + count(*) / 1e6 * CASE role WHEN 'user' THEN 2.5 ELSE 10.0 END::double, 6) AS cost FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role",
    "page_anchors": f"WITH a AS (SELECT page_id, regexp_extract_all(html, '{_HTML_A}', 1) AS h, regexp_extract_all(html, '{_HTML_A}', 2) AS l FROM pages), u AS (SELECT page_id, unnest(range(len(h)))::int AS pos, h, l FROM a) SELECT page_id, pos, h[pos + 1] AS href, trim({_SQUEEZE.format(_ENT.format("regexp_replace(l[pos + 1], '<[^>]+>', '', 'g')"))}) AS label FROM u",
    "page_text": f"SELECT page_id, sha256({_STRIP}) AS text_hash FROM pages",
    "page_host": "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host, CASE WHEN len(string_split(host, '.')) > 2 AND array_to_string(string_split(host, '.')[-2:], '.') IN ('dbsr.jp', 'kaigiroku.net', 'kensakusystem.jp', 'gijiroku.com') THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS group_key FROM h",
    "page_route": "WITH u AS (SELECT page_id, url || ['', '/tenant/a/', '/VOICES/x', '?h=dbsr.jp', '?h=kensakusystem.jp', '?h=kensakusystem.jp/a-vod/', '/g08v_search.asp'][(page_id % 7 + 1)::int] AS u FROM pages) SELECT page_id, CASE WHEN contains(u, 'ssp.kaigiroku.net') OR regexp_matches(u, '/tenant/[^/]+/') THEN 'discussnet_ssp' WHEN contains(u, 'dbsr.jp') THEN 'dbsearch' WHEN contains(u, 'kensakusystem.jp') AND NOT contains(u, '-vod/') THEN 'kensakusystem' WHEN contains(u, 'gijiroku.com') OR regexp_matches(u, '(?i)/VOICES/') OR regexp_matches(u, '(?i)g0[78]v_search\\.asp') THEN 'gijiroku_com' ELSE page_id::varchar END AS system FROM u",
    "heading_carry": "WITH b AS (SELECT page_id, regexp_extract_all(html, '(?i)<(?:h1|p)>[^<]*') AS bs FROM pages), u AS (SELECT page_id, unnest(range(len(bs)))::int AS pos, bs FROM b) SELECT page_id, pos, last_value(CASE WHEN lower(bs[pos + 1]) LIKE '<h1>%' THEN substr(bs[pos + 1], 5) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading, length(bs[pos + 1])::int AS n FROM u",
    "content_hash": "SELECT doc_id, sha256(text) AS hash, sha256(doc_id::varchar || text) AS prefixed_hash FROM documents",
    "short_id": "SELECT doc_id, left(md5(text), 12) AS short_id, CASE WHEN doc_id % 3 <> 0 AND source <> '' THEN 'sys_' || source || '_' || doc_id::varchar END AS external_id FROM documents",
    "squeezed": f"SELECT doc_id, sha256(trim({_SQUEEZE.format('text')})) AS hash, len(list_filter(string_split({_SQUEEZE.format('text')}, ' '), lambda x: x <> ''))::int AS tokens FROM documents",
    "previews": "SELECT doc_id, left(text, 200) AS p200, CASE WHEN instr(text, 'the') > 0 THEN substr(text, greatest(1, instr(text, 'the') - 30)::bigint, least(instr(text, 'the') - 1, 30)::bigint) END AS before_the FROM documents",
    "digits_normalise": "SELECT doc_id, translate(n_chars::varchar, '0123456789', '０１２３４５６７８９') AS \"full\", doc_id::varchar || '号' AS half FROM documents",
    "utf16_length": "SELECT item_id, (length(text) + 3)::int AS units, (length(text) + 2)::int AS points FROM benchmark",
    "era_date": f"WITH {_ORD} SELECT o_orderkey, y::varchar || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS iso, try_cast(y::varchar || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS date) AS day, y::int AS year FROM o",
    "sitting_date": f"WITH {_ORD} SELECT o_orderkey, y::varchar || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS iso, d::int AS day FROM o",
    "filename_date": f"WITH {_ORD} SELECT o_orderkey, y::varchar || '-' || CASE WHEN m % 7 = 0 THEN '01' ELSE lpad((m % 7)::varchar, 2, '0') END || '-' || lpad(d::varchar, 2, '0') AS iso FROM o",
    "era_labels": f"WITH {_ORD} SELECT DISTINCT y::int AS y, CASE WHEN y = 2019 THEN '令和元年,令和1年,平成31年' WHEN y > 2019 THEN '令和' || (y - 2018)::varchar || '年' ELSE '平成' || (y - 1988)::varchar || '年' END AS labels FROM o",
    "meeting_type": "WITH t AS (SELECT doc_id, ['総務委員会', '臨時会', '定例会', '臨時委員会', '臨時'][(doc_id % 5 + 1)::int] || lang AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, '委員会') THEN 'committee' WHEN contains(t, '臨時') THEN 'extraordinary' ELSE 'plenary' END AS committee_first, CASE WHEN contains(t, '委員会') THEN 'committee' WHEN contains(t, '臨時会') THEN 'extraordinary' ELSE 'plenary' END AS committee_first_strict, CASE WHEN contains(t, '臨時会') THEN 'extraordinary' WHEN contains(t, '委員会') THEN 'committee' ELSE 'plenary' END AS extraordinary_first, CASE WHEN contains(t, '臨時会') THEN 'extraordinary' ELSE 'plenary' END AS no_committee FROM t",
    "utterance_kind": f"WITH r AS (SELECT doc_id, ['市長', '総務部長', '議長', '予算委員長', '山田議員', '１７番', '調査員', '', '環境センター長'][(doc_id % 9 + 1)::int] AS role, ['◎', '○', '◆'][(doc_id % 3 + 1)::int] AS mark FROM documents) SELECT doc_id, {_PLAIN.format('remark')} AS plain, {_PLAIN.format('question')} AS asks, CASE WHEN role = '' THEN 'remark' WHEN mark = '◎' THEN 'answer' WHEN mark = '◆' THEN 'question' ELSE {_PLAIN.format('remark')} END AS marked, CASE WHEN role = '' THEN 'remark' WHEN role IN ('議長', '委員長') THEN 'remark' WHEN {_tree('role')} THEN 'answer' ELSE 'question' END AS tree, CASE role WHEN '市長' THEN '市長' WHEN '総務部長' THEN '部長' WHEN '議長' THEN '議長' WHEN '予算委員長' THEN '委員長' WHEN '山田議員' THEN '議員' WHEN '１７番' THEN '議員' WHEN '環境センター長' THEN 'センター長' END AS suffix FROM r",
    "speaker_header": "SELECT doc_id, ['総務部長', '17番', '委員', '議長', NULL][(doc_id % 5 + 1)::int] AS role, ['山田', '佐藤花子', '川田', NULL, NULL][(doc_id % 5 + 1)::int] AS name, ['◎', '○', '◆', '○', NULL][(doc_id % 5 + 1)::int] AS marker FROM documents",
    "cosine_topk": "WITH p AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::double[], p.v), 4) AS score FROM embeddings, p WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10",
    "extra_rollup": f"WITH {_MEET} SELECT meeting_type, year(held_on)::int AS year, count(*) AS n, count(DISTINCT municipality_code) AS municipalities FROM meet GROUP BY ROLLUP (meeting_type, year(held_on)::int)",
    "extra_cube": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)",
    "extra_outer_join": f"WITH {_MUNI}, {_MEET} SELECT code, coalesce(n, 0)::bigint AS n FROM muni FULL JOIN (SELECT municipality_code, count(*) AS n FROM meet GROUP BY 1) ON code = municipality_code",
    "extra_set_ops": f"WITH {_MEET}, a AS (SELECT DISTINCT municipality_code FROM meet WHERE meeting_type = 'committee'), b AS (SELECT DISTINCT municipality_code FROM meet WHERE meeting_type = 'plenary') SELECT municipality_code, CASE WHEN municipality_code IN (SELECT * FROM b) THEN 'both' ELSE 'committee' END AS side FROM a",
    "extra_tumbling": "SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
