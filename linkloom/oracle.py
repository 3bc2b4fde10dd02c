"""SQL twins of the named queries, written from the rules that generate the
data rather than from the Spark plans."""

from __future__ import annotations

SHOP = "http://shop.example.com"

# -- stored pages ---------------------------------------------------------------


def _canon(url: str) -> str:
    query = f"regexp_extract({url}, '\\?([^#]*)', 1)"
    pairs = f"list_sort([x FOR x IN string_split({query}, '&') IF regexp_matches(x, '=.')])"
    return (
        f"(regexp_extract({url}, '^([^?#]*)', 1) || "
        f"coalesce('?' || nullif(array_to_string({pairs}, '&'), ''), ''))"
    )


PAGES = f"""
p0 AS (
  SELECT page_id, url, html, {_canon('url')} AS src,
         split_part(url, ':', 1) AS scheme, lower(split_part(url, '/', 3)) AS host,
         regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path,
         page_id % 5 = 0 AS based,
         row_number() OVER (PARTITION BY {_canon('url')} ORDER BY page_id) = 1 AS kept
  FROM pages),
p AS (SELECT * FROM p0 WHERE kept),
h AS (SELECT host, min(page_id) AS first, count(*) AS n FROM p0 GROUP BY host),
word0 AS (
  SELECT page_id, src, scheme, host, path, based, kept, w.pos - 1 AS pos,
         replace(w.href, '&amp;', '&') AS href
  FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM p0) q,
       LATERAL (SELECT unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos) w),
word AS (SELECT * FROM word0 WHERE kept)
"""

NOISE = """
extra AS (
  SELECT page_id, src, scheme, host, path, based, n.k, n.href,
         CASE WHEN based THEN '/based/dir/' ELSE regexp_replace(path, '[^/]*$', '') END AS dir
  FROM p, LATERAL (
    SELECT unnest(l) AS href, generate_subscripts(l, 1) AS k
    FROM (SELECT ['#frag', 'mailto:x@example.org', 'tel:1', 'javascript:void(0)', '/wiki/Help:X',
                  '//[bad/', 'https:///nohost', '/dup', '/dup#again', '/dup', '/q?b=2&a=1&c=',
                  '../up?x=1', 'sub/./leaf', 'HTTP://' || upper(host) || '/Mixed',
                  'https://other.example.org/x'] AS l)) n),
n_words AS (SELECT page_id, count(*) AS n FROM word GROUP BY page_id),
link AS (
  SELECT page_id, src, scheme, host, path, pos, href, NULL AS fault,
         scheme || '://' || host || href AS dst
  FROM word
  UNION ALL
  SELECT e.page_id, src, scheme, host, path, coalesce(n, 0) + k - 1, href,
         CASE WHEN k = 1 THEN 'fragment' WHEN k <= 5 THEN 'non_http_scheme'
              WHEN k = 6 THEN 'unresolvable' WHEN k = 7 AND scheme = 'http' THEN 'invalid' END,
         CASE WHEN k = 14 THEN 'http://' || host || '/Mixed'
              WHEN k = 15 THEN href
              ELSE scheme || '://' || host || CASE
                WHEN k = 7 THEN '/nohost' WHEN k <= 10 THEN '/dup' WHEN k = 11 THEN '/q?a=1&b=2'
                WHEN k = 12 THEN regexp_replace(dir, '[^/]+/$', '') || 'up?x=1'
                ELSE dir || 'sub/leaf' END END
  FROM extra e LEFT JOIN n_words USING (page_id))
"""

REQUESTS = """
wide AS (
  SELECT first AS crawl_id, host, 'http://' || host || '/' AS seed_url, '/' AS scope_path,
         first % 5 AS max_depth, CASE WHEN first % 3 = 0 THEN 5 ELSE 2000000000 END AS max_pages,
         first % 7 <> 0 AS respect
  FROM h),
narrow AS (
  SELECT crawl_id, host, seed_url, scope_path FROM wide
  UNION ALL
  SELECT crawl_id + 1000000000, host, 'https://' || host || '/en', '/en/' FROM wide)
"""

CLASSIFIED = f"""
{PAGES}, {NOISE}, {REQUESTS},
c AS (
  SELECT crawl_id, l.*, scope_path,
         l.host AS own_host, regexp_extract(dst, '^[a-z]+://([^/]*)', 1) AS dst_host,
         regexp_extract(dst, '^[a-z]+://[^/]*([^?]*)', 1) AS dst_path
  FROM link l JOIN narrow r ON r.host = l.host
  WHERE starts_with(l.path, scope_path)),
reasons AS (
  SELECT crawl_id, src, pos, href,
         CASE WHEN fault IS NOT NULL THEN fault
              WHEN dst_host <> own_host
                OR NOT (starts_with(dst_path, scope_path) OR dst_path || '/' = scope_path)
                THEN 'out_of_scope'
              WHEN dst = 'http://' || own_host || '/Mixed' THEN 'visited'
              WHEN row_number() OVER (PARTITION BY crawl_id, src, fault, dst ORDER BY pos) > 1
                THEN 'duplicate'
              ELSE 'accepted' END AS reason
  FROM c)
"""

EDGES = f"""
{PAGES}, {REQUESTS},
edge AS (
  SELECT crawl_id, src, min(pos)::BIGINT AS pos, scheme || '://' || word.host || href AS dst
  FROM word JOIN wide ON wide.host = word.host
  GROUP BY crawl_id, src, scheme || '://' || word.host || href)
"""

ROBOTS = """
verdict AS (
  SELECT src AS url,
         CASE first % 4
           WHEN 1 THEN NOT (path LIKE '/en/1%' OR path LIKE '/de/1%' OR path LIKE '/fr/%')
           WHEN 2 THEN path LIKE '/es/5%' OR path NOT LIKE '/es/%'
           ELSE TRUE END AS allowed,
         first % 4 = 1 AS has_named_group
  FROM p JOIN h USING (host))
"""

# -- crawls: breadth-first search by recursion ------------------------------------

# Needs req(crawl_id, seed, max_depth, max_pages, respect), node(url, ok, second),
# edge(src, dst, pos) and blocked(url).
SEARCH = """
t(crawl_id, url, depth, ord, parent) USING KEY (crawl_id, url) AS (
  SELECT crawl_id, seed, 0::BIGINT, []::BIGINT[], NULL::VARCHAR FROM req
  UNION
  SELECT t.crawl_id, e.dst, min(t.depth) + 1, min(list_append(t.ord, e.pos)),
         arg_min(t.url, list_append(t.ord, e.pos))
  FROM t JOIN req r ON r.crawl_id = t.crawl_id
         JOIN node n ON n.url = t.url AND n.ok
         JOIN edge e ON e.src = t.url
         LEFT JOIN blocked b ON b.url = t.url
  WHERE t.depth < r.max_depth AND NOT (r.respect AND b.url IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM recurring.t s WHERE s.crawl_id = t.crawl_id AND s.url = e.dst)
  GROUP BY t.crawl_id, e.dst),
stated AS (
  SELECT t.crawl_id, t.url, t.depth, t.ord, t.parent, r.max_depth, r.max_pages, n.second,
         CASE WHEN r.respect AND b.url IS NOT NULL THEN 'blocked'
              WHEN coalesce(n.ok, FALSE) THEN 'ok' ELSE 'failed' END AS state
  FROM t JOIN req r ON r.crawl_id = t.crawl_id
         LEFT JOIN node n ON n.url = t.url LEFT JOIN blocked b ON b.url = t.url),
s AS (
  SELECT *, coalesce(sum(CASE WHEN state = 'ok' THEN 1 ELSE 0 END) OVER (
              PARTITION BY crawl_id ORDER BY depth, ord
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= max_pages AS over
  FROM stated),
found AS (SELECT crawl_id, parent AS url, count(*) AS links_found FROM s
          WHERE parent IS NOT NULL GROUP BY ALL),
page AS (
  SELECT s.crawl_id, s.url, s.depth, s.ord, s.second, 200::BIGINT AS status_code,
         coalesce(links_found, 0)::BIGINT AS links_found
  FROM s LEFT JOIN found USING (crawl_id, url) WHERE state = 'ok' AND NOT over),
failure AS (SELECT crawl_id, url, depth, ord FROM s WHERE state = 'failed' AND NOT over),
total AS (
  SELECT r.crawl_id, r.seed AS seed_url,
         CASE WHEN bool_or(over) THEN 'max_pages_hit'
              WHEN bool_or(state = 'ok' AND NOT over AND depth = s.max_depth) THEN 'max_depth_hit'
              ELSE 'success' END AS status,
         count(*) FILTER (state = 'ok' AND NOT over) AS total_pages,
         count(*) FILTER (state = 'failed' AND NOT over) AS failed_urls,
         coalesce(max(depth) FILTER (state = 'ok' AND NOT over), 0)::BIGINT AS max_depth_reached,
         max(second) FILTER (state = 'ok' AND NOT over) AS seconds
  FROM req r JOIN s ON s.crawl_id = r.crawl_id GROUP BY r.crawl_id, r.seed)
"""

SHOP_WEB = f"""
req AS (
  SELECT r_regionkey::BIGINT AS crawl_id, '{SHOP}/3/' AS seed,
         [4, 3, 60, 6, 0][r_regionkey % 5 + 1] AS max_depth,
         [2000000000, 100, 2000000000, 500, 10][r_regionkey % 5 + 1] AS max_pages,
         [TRUE, TRUE, FALSE, FALSE, TRUE][r_regionkey % 5 + 1] AS respect
  FROM region),
k AS (SELECT unnest(range(10)) AS k),
r AS (SELECT r_regionkey::BIGINT AS r FROM region),
n AS (SELECT n_nationkey::BIGINT AS n FROM nation),
c AS (SELECT c_custkey AS c, c_acctbal FROM customer),
o AS (SELECT o_orderkey AS o, o_custkey FROM orders),
arc(src, dst, pos) AS (
  SELECT '/3/', '/3/region/' || r || '/', r FROM range(5) x(r)
  UNION ALL SELECT '/3/region/' || r || '/', '/3/nation/' || (r + 5 * k) || '/', k FROM r, k WHERE k < 5
  UNION ALL SELECT '/3/region/' || r || '/', '/3/', 99 FROM r
  UNION ALL SELECT '/3/nation/' || n || '/', '/3/customer/' || (8 * n + k) || '/', k FROM n, k WHERE k < 8
  UNION ALL SELECT '/3/nation/' || n || '/', '/3/region/' || (n % 5) || '/', 99 FROM n
  UNION ALL SELECT '/3/customer/' || c || '/', '/3/customer/' || (8 * c + 200 + k) || '/', k FROM c, k WHERE k < 8
  UNION ALL SELECT '/3/customer/' || c || '/', '/3/order/' || (10 * c + k) || '.html', 8 + k FROM c, k
  UNION ALL SELECT '/3/customer/' || c || '/',
                   CASE WHEN c < 200 THEN '/3/nation/' || (c // 8) || '/'
                        ELSE '/3/customer/' || ((c - 200) // 8) || '/' END, 99 FROM c
  UNION ALL SELECT '/3/order/' || o || '.html', '/3/customer/' || o_custkey || '/', 0 FROM o
  UNION ALL SELECT '/3/order/' || o || '.html', '/3/customer/' || (o // 10) || '/', 99 FROM o),
edge AS (SELECT '{SHOP}' || src AS src, '{SHOP}' || dst AS dst, pos::BIGINT AS pos FROM arc),
node(url, ok, second) AS (
  SELECT '{SHOP}/3/', TRUE, 0::BIGINT
  UNION ALL SELECT '{SHOP}/3/region/' || r || '/', TRUE, r FROM r
  UNION ALL SELECT '{SHOP}/3/nation/' || n || '/', TRUE, n FROM n
  UNION ALL SELECT '{SHOP}/3/customer/' || c || '/', c_acctbal >= 0, c % 86400 FROM c
  UNION ALL SELECT '{SHOP}/3/order/' || o || '.html', TRUE, o % 86400 FROM o),
blocked AS (
  SELECT DISTINCT dst AS url FROM edge WHERE starts_with(dst, '{SHOP}/3/customer/1'))
"""

HOST_WEB = f"""
{PAGES}, {REQUESTS}, {ROBOTS},
req AS (SELECT crawl_id, seed_url AS seed, max_depth, max_pages, respect FROM wide),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS rank FROM p0),
edge AS (
  SELECT src, scheme || '://' || host || href AS dst, pos::BIGINT AS pos FROM word
  UNION ALL
  SELECT a.src, b.src, 100000 + b.rank
  FROM ranked a JOIN ranked b ON a.host = b.host AND b.rank > 0 AND (b.rank - 1) // 8 = a.rank
  WHERE a.kept
  UNION ALL
  SELECT 'http://' || host || '/', src, 0 FROM ranked WHERE rank = 0),
node AS (
  SELECT src AS url, TRUE AS ok, 0::BIGINT AS second FROM p
  UNION ALL SELECT seed, TRUE, 0 FROM req),
blocked AS (
  SELECT url FROM verdict WHERE NOT allowed
  UNION
  SELECT scheme || '://' || host || href FROM word JOIN h USING (host)
  WHERE (first % 4 = 1 AND (href LIKE '/en/1%' OR href LIKE '/de/1%' OR href LIKE '/fr/%'))
     OR (first % 4 = 2 AND href LIKE '/es/%' AND href NOT LIKE '/es/5%'))
"""


def _shop(select: str) -> str:
    return f"WITH RECURSIVE {SHOP_WEB}, {SEARCH} {select}"


def _hosts(select: str) -> str:
    return f"WITH RECURSIVE {HOST_WEB}, {SEARCH} {select}"


# -- run store --------------------------------------------------------------------

RUNS = f"""
run AS (
  SELECT o_orderkey AS crawl_id,
         CASE WHEN o_custkey % 3 = 0 THEN 'https://shop.example.com/c/' || o_custkey || '/?q=é&r=1'
              ELSE 'http://shop.example.com/c//' || o_custkey END AS seed_url,
         CASE WHEN o_custkey % 3 = 0 THEN 'shop.example.com_c_' || o_custkey || '_q_é_r_1'
              ELSE 'shop.example.com_c_' || o_custkey END AS stem,
         CASE WHEN o_orderkey % 113 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'success'
              WHEN o_orderstatus = 'O' THEN 'max_pages_hit' ELSE 'max_depth_hit' END AS status,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 4 END AS total_pages,
         coalesce(array_to_string(['{SHOP}/c/' || o_custkey || '/p' || i
             FOR i IN range(1, o_orderkey % 4 + 1)], ' '), '') AS urls_visited,
         (o_orderkey % 4)::BIGINT AS n_pages,
         epoch_us(o_orderdate) + o_orderkey * 1000001 AS started_micros,
         round((o_orderkey % 1000) / 10.0, 3)::DOUBLE AS duration_seconds
  FROM orders),
stored AS (SELECT * FROM run WHERE status IS NOT NULL),
newest AS (
  SELECT * FROM stored
  QUALIFY row_number() OVER (PARTITION BY seed_url ORDER BY started_micros DESC) = 1),
seed AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'https://shop.example.com/c/' || c_custkey || '/?q=é&r=1'
              ELSE 'http://shop.example.com/c//' || c_custkey END AS seed_url
  FROM customer WHERE c_custkey % 2 = 0)
"""
_DOC = (
    "crawl_id, seed_url, status, total_pages, urls_visited, n_pages, started_micros, duration_seconds"
)
_FILE = "stem || '_' || strftime(make_timestamp(started_micros), '%Y%m%d_%H%M%S') || '.json'"

LOG = """
log AS (
  SELECT 'site' || user_id || '.example.com' AS domain, event_id AS seq, epoch_us(ts) AS ms,
         CASE WHEN user_id % 4 = 3 THEN 1000000 ELSE (user_id % 4) * 1800000000 + 500000 END AS delay
  FROM events)
"""
_FETCHES = f"""
WITH RECURSIVE {LOG},
f AS (
  SELECT domain, min(ms) AS ms FROM log GROUP BY domain
  UNION ALL
  SELECT f.domain, min(l.ms) FROM f JOIN log l ON l.domain = f.domain AND l.ms >= f.ms + 3600000000
  GROUP BY f.domain),
hit AS (SELECT domain, min(seq) AS seq FROM log JOIN f USING (domain, ms) GROUP BY domain, ms)
SELECT log.domain, log.seq, hit.seq IS NOT NULL AS fetches
FROM log LEFT JOIN hit ON hit.domain = log.domain AND hit.seq = log.seq
"""
_SCHEDULE = f"""
WITH RECURSIVE {LOG},
line AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ms, seq) AS i FROM log),
s AS (
  SELECT domain, seq, i, ms, ms AS start FROM line WHERE i = 1
  UNION ALL
  SELECT l.domain, l.seq, l.i, l.ms, greatest(l.ms, s.start + l.delay)
  FROM s JOIN line l ON l.domain = s.domain AND l.i = s.i + 1)
SELECT domain, seq, start AS start_micros, round((start - ms) / 1000000.0, 6)::DOUBLE AS wait_seconds
FROM s
"""

ATTEMPTS = f"""
a AS (
  SELECT o_orderkey AS o, o_orderkey % 97 = 0 AS bad,
         CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-valid-url-' || o_orderkey
              ELSE '{SHOP}/3/order/' || o_orderkey || '.html' END AS url,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '<p>' || o_orderkey || '</p>' END AS body
  FROM orders),
outcome AS (
  SELECT url,
         CASE WHEN bad OR o % 8 IN (3, 6) THEN -1 WHEN o % 8 IN (1, 7) THEN 404 ELSE 200 END::BIGINT AS status,
         CASE WHEN bad OR o % 8 IN (1, 3, 6, 7) THEN '' ELSE body END AS html
  FROM a)
"""

_TIME = "strftime(make_timestamp((1767225600 + {}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"
# Each list's rows, then the lines between the lists; a comma behind all but the last of a list.
_DOCUMENT_LINES = f"""
  SELECT crawl_id, 'shop.example.com_3__20260101_000000.json' AS filename, line,
         row_number() OVER (PARTITION BY crawl_id ORDER BY section, k, i) AS line_no
  FROM (
    SELECT crawl_id, section, k, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i
    FROM (
      SELECT crawl_id, 0 AS section, 0 AS k,
             '{{' || chr(10) || '  "seed_url": "' || seed_url || '",' || chr(10) || '  "status": "' || status || '",'
             || chr(10) || '  "error": null,' || chr(10) || '  "total_pages": ' || total_pages || ',' || chr(10)
             || '  "max_depth_reached": ' || max_depth_reached || ',' || chr(10) || '  "urls_visited": ['
             || CASE WHEN total_pages = 0 THEN '],' ELSE '' END AS text FROM total
      UNION ALL
      SELECT crawl_id, 1, row_number() OVER (PARTITION BY crawl_id ORDER BY url), '    "' || url || '"' ||
             CASE WHEN url = max(url) OVER (PARTITION BY crawl_id) THEN '' ELSE ',' END FROM page
      UNION ALL
      SELECT crawl_id, 2, 0, CASE WHEN total_pages = 0 THEN '' ELSE '  ],' || chr(10) END
             || '  "urls_failed": [' || CASE WHEN failed_urls = 0 THEN '],' ELSE '' END FROM total
      UNION ALL
      SELECT crawl_id, 3, k, '    "' || url || '"' || CASE WHEN k = n THEN '' ELSE ',' END FROM (
        SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, ord) AS k,
               count(*) OVER (PARTITION BY crawl_id) AS n FROM failure)
      UNION ALL
      SELECT crawl_id, 4, 0, CASE WHEN failed_urls = 0 THEN '' ELSE '  ],' || chr(10) END
             || '  "pages": [' || CASE WHEN total_pages = 0 THEN '],' ELSE '' END FROM total
      UNION ALL
      SELECT crawl_id, 5, k, concat_ws(chr(10), '    {{', '      "url": "' || url || '",', '      "depth": ' || depth || ',',
               '      "status_code": ' || status_code || ',', '      "links_found": ' || links_found || ',',
               '      "crawled_at": "' || {_TIME.format('second')} || '",', '      "error": null',
               '    }}' || CASE WHEN k = n THEN '' ELSE ',' END) FROM (
        SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, ord) AS k,
               count(*) OVER (PARTITION BY crawl_id) AS n FROM page)
      UNION ALL
      SELECT crawl_id, 6, 0, concat_ws(chr(10), CASE WHEN total_pages = 0 THEN NULL ELSE '  ],' END,
               '  "started_at": "2026-01-01T00:00:00+00:00",',
               '  "finished_at": ' || coalesce('"' || {_TIME.format('seconds')} || '"', 'null') || ',',
               '  "duration_seconds": ' || coalesce(seconds || '.0', 'null'), '}}') FROM total))
"""

ORACLE: dict[str, str] = {
    # sources and sinks
    "page_snapshot": f"""WITH {PAGES}
        SELECT src AS url, 200::BIGINT AS status, md5(html) AS html_md5 FROM p""",
    "validate_requests": """
        WITH r AS (SELECT c_custkey AS c, c_custkey % 12 AS k FROM customer),
        s AS (SELECT *, CASE
            WHEN k = 0 THEN '' WHEN k = 1 THEN 'ftp://h' || c || '.example.com/'
            WHEN k = 2 THEN 'HTTPS://h' || c || '.example.com/'
            WHEN k = 3 THEN ' https://h' || c || '.example.com/' WHEN k = 4 THEN NULL
            WHEN k = 5 THEN 'https://h' || c || '.example.com/a'
            WHEN k = 6 THEN 'http://h' || c || '.example.com/x'
            ELSE 'https://h' || c || '.example.com/' END AS seed_url FROM r)
        SELECT c AS crawl_id, seed_url,
          (CASE WHEN k = 7 THEN -1 WHEN c % 5 = 0 THEN 4 ELSE 2 END)::BIGINT AS max_depth,
          (CASE WHEN k IN (7, 8) THEN 0 ELSE 10 END)::BIGINT AS max_pages,
          CASE WHEN k IN (0, 4) THEN 'seed_url cannot be empty'
               WHEN k IN (1, 2, 3) THEN 'seed_url must start with http:// or https://: ' || seed_url
               WHEN k = 7 THEN 'max_depth cannot be negative'
               WHEN k = 8 THEN 'max_pages must be at least 1'
               WHEN k = 9 THEN 'concurrent_requests must be at least 1'
               WHEN k = 10 THEN 'politeness_delay cannot be negative'
               WHEN k = 11 THEN 'timeout must be at least 1 second' END AS error
        FROM s""",
    "save_runs": f"WITH {RUNS} SELECT {_DOC} FROM stored",
    "save_runs_json": f"WITH {RUNS} SELECT {_DOC} FROM stored",
    "save_many": f"""WITH {RUNS}
        SELECT count(status) AS saved, count(*) - count(status) AS failed, count(*) AS total FROM run""",
    "load_latest": f"WITH {RUNS} SELECT {_DOC} FROM newest",
    "load_latest_of_seeds": f"WITH {RUNS} SELECT {_DOC} FROM newest WHERE seed_url IN (FROM seed)",
    "run_exists": f"""WITH {RUNS}
        SELECT seed_url, seed_url IN (SELECT seed_url FROM stored) AS found FROM seed""",
    "delete_latest": f"""WITH {RUNS}
        SELECT seed_url, seed_url IN (SELECT seed_url FROM stored) AS deleted FROM seed""",
    "runs_after_delete": f"""WITH {RUNS}
        SELECT crawl_id, seed_url FROM stored
        WHERE crawl_id NOT IN (SELECT crawl_id FROM newest WHERE seed_url IN (FROM seed))""",
    "list_crawls": f"""WITH {RUNS}
        SELECT seed_url, status, coalesce(total_pages, 0) AS total_pages,
          strftime(make_timestamp(started_micros), '%Y-%m-%dT%H:%M:%S')
            || CASE WHEN started_micros % 1000000 = 0 THEN ''
                    ELSE '.' || lpad((started_micros % 1000000)::VARCHAR, 6, '0') END
            || '+00:00' AS started_at,
          {_FILE} AS filename
        FROM stored""",
    "run_filename": f"WITH {RUNS} SELECT crawl_id, {_FILE} AS filename FROM run",
    # URLs
    "scheme_filter": f"""WITH {PAGES}, {NOISE}
        SELECT href, count(*) AS n_links FROM link WHERE regexp_matches(lower(href), '^https?:')
        GROUP BY href""",
    "valid_url_filter": f"""WITH {PAGES}, {NOISE}
        SELECT href, count(*) AS n_links FROM link WHERE regexp_matches(lower(href), '^https?://[^/]')
        GROUP BY href""",
    "canonicalize_urls": f"WITH {PAGES} SELECT page_id, url, src AS url_norm FROM p0",
    "canonical_duplicates": f"""WITH {PAGES},
        b AS (SELECT url, src, split_part(split_part(url, '#', 1), '?', 1) AS bare FROM p0),
        twin AS (
          SELECT src AS url_norm, url FROM b
          UNION ALL SELECT src, split_part(url, '#', 1) || '#again' FROM b
          UNION ALL SELECT bare || '?a=2&z=1', bare || '?z=1&a=2' FROM b
          UNION ALL SELECT bare || '?a=2&z=1', bare || '?a=2&b=&z=1' FROM b)
        SELECT url_norm, count(*) AS n_urls, count(DISTINCT url) AS n_spellings,
               min(url) AS first_spelling
        FROM twin GROUP BY url_norm HAVING count(*) > 1""",
    "domain_rollup": f"WITH {PAGES} SELECT host AS domain, n AS n_pages FROM h",
    "resolve_links": f"""WITH {PAGES}, {NOISE}
        SELECT src, dst, count(*) AS n_links FROM link WHERE fault IS NULL GROUP BY src, dst""",
    "seed_scope": f"""WITH {PAGES}, {REQUESTS}
        SELECT crawl_id, seed_url, host AS domain, scope_path FROM narrow""",
    "scope_join": f"""WITH {PAGES}, {REQUESTS}
        SELECT crawl_id, src AS url FROM p JOIN narrow USING (host) WHERE starts_with(path, scope_path)""",
    # links
    "extract_hrefs": f"WITH {PAGES} SELECT src, pos, href FROM word",
    "extract_hrefs_noisy": f"WITH {PAGES}, {NOISE} SELECT src, pos, href FROM link",
    "page_base_url": f"""WITH {PAGES}
        SELECT src, CASE WHEN based THEN scheme || '://' || host || '/based/dir/page.html'
                         ELSE src END AS base FROM p""",
    "classify_links": f"WITH {CLASSIFIED} SELECT crawl_id, src, pos, href, reason FROM reasons",
    "classify_counts": f"""WITH {CLASSIFIED}
        SELECT crawl_id, reason, count(*) AS n_links FROM reasons GROUP BY crawl_id, reason""",
    "link_graph": f"WITH {EDGES} SELECT crawl_id, src, pos, dst FROM edge",
    "link_graph_by_domain": f"""WITH {EDGES}
        SELECT regexp_extract(src, '^[a-z]+://([^/]*)', 1) AS domain, count(*) AS n_edges
        FROM edge GROUP BY 1""",
    "drop_visited": f"""WITH {EDGES},
        known AS (SELECT crawl_id, dst FROM edge JOIN p0 USING (src) WHERE page_id % 2 = 0)
        SELECT crawl_id, src, dst FROM edge e
        WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.crawl_id = e.crawl_id AND k.dst = e.dst)""",
    # robots and politeness
    "robots_rules": f"""WITH {PAGES}
        SELECT host AS domain, '*' AS agents, CASE WHEN first % 4 = 1 THEN n % 5 END AS delay,
               CASE WHEN first % 4 = 1 THEN '-/en/1|+/en/|-/de/1|-/fr/'
                    ELSE '+/es/5|-/es/|+|-/en/' END AS rules
        FROM h WHERE first % 4 IN (1, 2)""",
    "robots_allowed": f"WITH {PAGES}, {ROBOTS} SELECT url, allowed FROM verdict",
    "robots_allowed_named_agent": f"""WITH {PAGES}, {ROBOTS}
        SELECT url, allowed AND NOT has_named_group AS allowed FROM verdict""",
    "crawl_delay": f"""WITH {PAGES}
        SELECT host AS domain, CASE WHEN first % 4 = 1 THEN n % 5 END AS delay FROM h""",
    "domain_delays": f"""WITH {PAGES}
        SELECT first AS crawl_id, host AS domain,
               greatest(1.5::DOUBLE, CASE WHEN first % 4 = 1 AND first % 7 <> 0 THEN n % 5
                                          ELSE 0 END::DOUBLE) AS delay
        FROM h""",
    "robots_fetch_plan": _FETCHES,
    "robots_fetch_plan_spread": _FETCHES,
    "politeness_schedule": _SCHEDULE,
    "politeness_schedule_spread": _SCHEDULE,
    # fetch log
    "fetch_outcome": f"WITH {ATTEMPTS} SELECT url, status, html FROM outcome",
    "retry_budget": f"""WITH {ATTEMPTS}
        SELECT url, (CASE WHEN bad THEN 0 ELSE [1, 1, 2, 3, 2, 3, 1, 3][o % 8 + 1] END)::BIGINT AS attempts_used,
               (CASE WHEN bad THEN 0 ELSE [0, 0, 2, 6, 2, 6, 0, 6][o % 8 + 1] END)::BIGINT AS backoff_seconds
        FROM a""",
    "split_outcomes": f"""WITH {ATTEMPTS}
        SELECT url, CASE WHEN status <> -1 AND html <> '' THEN 'visited' ELSE 'failed' END AS outcome
        FROM outcome""",
    # crawls
    "crawl": _shop("SELECT crawl_id, url, depth, status_code, links_found FROM page"),
    "crawl_failed": _shop("SELECT crawl_id, url, depth FROM failure"),
    "crawl_hosts": _hosts("SELECT crawl_id, url, depth, status_code, links_found FROM page"),
    "crawl_hosts_failed": _hosts("SELECT crawl_id, url, depth FROM failure"),
    "depth_limit": _shop(
        """SELECT crawl_id, max_depth::BIGINT AS max_depth, depth, count(*) AS n_pages
           FROM s WHERE state = 'ok' AND NOT over GROUP BY ALL"""
    ),
    "page_cap": f"""WITH {PAGES}, {REQUESTS}
        SELECT crawl_id, src AS url FROM p JOIN wide USING (host)
        QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY src) <= max_pages""",
    "links_found": _shop(
        """SELECT found.crawl_id, found.url, links_found FROM found
           JOIN s ON s.crawl_id = found.crawl_id AND s.url = found.url AND NOT s.over"""
    ),
    "crawl_status": f"""
        SELECT * FROM ({_shop("SELECT crawl_id, status FROM total")})
        UNION ALL
        SELECT * FROM ({_hosts("SELECT crawl_id + 1000, status FROM total")})""",
    "crawl_stats": _shop(
        """SELECT crawl_id, seed_url, status, total_pages, failed_urls, max_depth_reached,
                  (1767225600 + seconds) * 1000000 AS finished_micros,
                  seconds::DOUBLE AS duration_seconds FROM total"""
    ),
    "crawl_result_document": _hosts(
        """SELECT total.crawl_id, seed_url, status, '' AS error, max_depth_reached,
                  total_pages, coalesce(v.list, '') AS urls_visited, coalesce(f.list, '') AS urls_failed,
                  coalesce(v.pages, '') AS pages
           FROM total
           LEFT JOIN (SELECT crawl_id, string_agg(url, chr(10) ORDER BY url) AS list,
                        string_agg(url || ' ' || depth || ' ' || status_code || ' ' || links_found,
                                   chr(10) ORDER BY depth, ord) AS pages
                      FROM page GROUP BY crawl_id) v ON v.crawl_id = total.crawl_id
           LEFT JOIN (SELECT crawl_id, string_agg(url, chr(10) ORDER BY depth, ord) AS list
                      FROM failure GROUP BY crawl_id) f ON f.crawl_id = total.crawl_id"""
    ),
    "crawl_documents": _shop(_DOCUMENT_LINES),
    "crawl_summary": _shop(
        """SELECT crawl_id, 'seed=' || seed_url || ' status=' || status || ' pages=' || total_pages
             || ' failed=' || failed_urls || ' max_depth_reached=' || max_depth_reached
             || ' duration=' || CASE WHEN coalesce(seconds, 0) = 0 THEN 'ongoing'
                                     ELSE seconds || '.0s' END AS summary FROM total"""
    ),
    "crawl_report": _shop(
        """SELECT total.crawl_id, section, position, l.url, status, TRUE AS ok,
                  greatest(total_pages - 10, 0) AS more_visited
           FROM total LEFT JOIN (SELECT * FROM (SELECT crawl_id, 'visited' AS section, url,
                        row_number() OVER (PARTITION BY crawl_id ORDER BY url) AS position, 10 AS n FROM page
                 UNION ALL
                 SELECT crawl_id, 'failed', url,
                        row_number() OVER (PARTITION BY crawl_id ORDER BY depth, ord), 5 FROM failure)
                 WHERE position <= n) l ON total.crawl_id = l.crawl_id"""
    ),
    "crawl_store_pages": _hosts(
        """SELECT seed_url, page.url, depth, status_code, links_found
           FROM page JOIN total ON total.crawl_id = page.crawl_id"""
    ),
    "crawl_store_list": _hosts("SELECT seed_url, status, total_pages FROM total WHERE status <> 'success'"),
    "page_snapshot_errors": f"""WITH {PAGES}
        SELECT src AS url,
               CASE page_id % 7 WHEN 3 THEN 404 WHEN 5 THEN -1 ELSE 200 END::BIGINT AS status,
               md5(CASE WHEN page_id % 7 IN (3, 5) THEN '' ELSE html END) AS html_md5 FROM p""",
    "crawl_errors": f"""WITH {PAGES}
        SELECT p0.page_id AS crawl_id, CASE WHEN p.page_id % 7 IN (3, 5) THEN 'failed' ELSE 'ok' END AS state,
               CASE p.page_id % 7 WHEN 3 THEN 404 WHEN 5 THEN -1 ELSE 200 END::BIGINT AS status_code
        FROM p0 JOIN p ON p.src = p0.src""",
    "crawl_attempts": f"""WITH {ATTEMPTS}
        SELECT regexp_extract(url, '(\\d+)(\\.html)?$', 1)::BIGINT AS crawl_id,
               CASE WHEN status <> -1 AND html <> '' THEN 'ok' ELSE 'failed' END AS state,
               status AS status_code
        FROM outcome""",
    # streaming
    "stream_link_discovery": f"""WITH {PAGES}, {REQUESTS}
        SELECT DISTINCT crawl_id, scheme || '://' || word.host || href AS url
        FROM word JOIN wide ON wide.host = word.host""",
}
