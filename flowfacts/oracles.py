"""The queries of queries.py as DuckDB SQL."""

_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_size > 45
  UNION ALL SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 50) WHERE src <> dst)"""
_PATHS = "paths(src, dst) AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON p.dst = e.src)"
_CFG = "cfg AS (SELECT DISTINCT o_custkey AS function, o_orderkey % 24 AS src, (o_orderkey // 7) % 24 AS dst FROM orders)"
_REACH = "reach(function, block) AS (SELECT DISTINCT function, CAST(0 AS BIGINT) FROM cfg UNION SELECT r.function, e.dst FROM reach r JOIN cfg e ON e.function = r.function AND e.src = r.block)"
#: without(function, gone, block): blocks reached when `gone` may not be entered.
_WITHOUT = """without(function, gone, block) AS (
  SELECT function, block, CAST(0 AS BIGINT) FROM reach WHERE block <> 0
  UNION SELECT w.function, w.gone, e.dst FROM without w JOIN cfg e ON e.function = w.function AND e.src = w.block AND e.dst <> w.gone),
dom AS (
  SELECT r.function, r.block, d.block AS dom FROM reach r JOIN reach d ON d.function = r.function
  WHERE d.block = 0 OR d.block = r.block OR NOT EXISTS (SELECT 1 FROM without w WHERE w.function = r.function AND w.gone = d.block AND w.block = r.block))"""
_DOTTED = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/+$', ''), '/', '.', 'g')"
_PART_VERSION = "SELECT p_partkey AS requirement, p_brand AS package, concat(p_size, '.', p_partkey % 10, '.', p_partkey % 3) AS version, [p_size, p_partkey % 10, p_partkey % 3] AS v FROM part"
_ENTROPY = "(SELECT round(-sum(n / t * log2(n / t)), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT unnest(string_split({0}, '')) AS c) WHERE c <> '' GROUP BY c))"
_SECRETS = f"""hits AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_]+) = "([^"\\n]+)"')) AS hit, generate_subscripts(regexp_extract_all(text, '([A-Za-z_]+) = "([^"\\n]+)"'), 1) AS ordinal FROM documents),
parts AS (SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, regexp_extract(hit, '([A-Za-z_]+) = "([^"\\n]+)"', 1) AS name, regexp_extract(hit, '([A-Za-z_]+) = "([^"\\n]+)"', 2) AS value FROM hits),
scored AS (SELECT *, {_ENTROPY.format('value')} AS entropy, regexp_matches(name, '(?i)(token|secret|passw|api_?key|credential)') AS named FROM parts),
secrets AS (SELECT doc_id, ordinal, name, sha256(value) AS digest, entropy,
  CASE WHEN named AND entropy >= 3 THEN 'hardcoded-secret' WHEN named THEN 'hardcoded-credential' ELSE 'high-entropy-string' END AS rule,
  CASE WHEN named THEN 'high' ELSE 'low' END AS severity, CASE WHEN named AND entropy >= 3 THEN 'high' WHEN named THEN 'medium' ELSE 'low' END AS confidence
  FROM scored WHERE named OR entropy >= 3)"""

ORACLES = {
    "innermost_intervals": """WITH v AS (SELECT p_size % 2 AS half, p_partkey AS id, p_partkey - (p_partkey & -p_partkey) + 1 AS low FROM part)
        SELECT l_orderkey, l_linenumber, arg_min(id, id - low) AS inside, count(id) AS depth
        FROM (SELECT *, row_number() OVER () AS r FROM lineitem) LEFT JOIN v ON half = l_suppkey % 2 AND low <= l_partkey AND id >= l_partkey GROUP BY r, l_orderkey, l_linenumber""",
    "secret_assignments": f"WITH {_SECRETS} SELECT * FROM secrets",
    "secret_report": f"""WITH {_SECRETS} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 3 ELSE 1 END DESC, doc_id, ordinal) AS position,
        doc_id, ordinal, rule, severity, confidence, digest FROM secrets WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "suppress_partition": """SELECT d.doc_id, d.source AS rule, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic = 1 OR concat('src', l.quality) = d.source)) AS suppressed FROM documents d""",
    "report_order": "SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS position FROM orders",
    "coverage_summary": "SELECT source, lang, count(*) AS files, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS files_analysed FROM documents GROUP BY source, lang",
    "advisories_last_wins": """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "shared_names": "SELECT p_name, count(*) AS parts FROM part GROUP BY p_name HAVING count(*) > 1",
    "unique_names": """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE concat(p_name, '__', n) END AS unique_name
        FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
    "baseline_multiset": """SELECT e.event_id, e.n <= coalesce(b.have, 0) AS known
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) e
        LEFT JOIN (SELECT user_id, event_type, count(*) AS have FROM events WHERE value > 50 GROUP BY ALL) b ON b.user_id = e.user_id AND b.event_type = e.event_type""",
    "fingerprint_sha": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "policy_anti_join": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "version_parse": "SELECT p_partkey, concat(p_size, '.', p_partkey % 10) AS parsed FROM part",
    "version_satisfies": "SELECT p_partkey AS requirement, [p_size, p_partkey % 10, p_partkey % 3] >= [p_size, p_partkey % 7, 0] AND p_size < p_size + 1 AS holds FROM part",
    "specifier_forms": """SELECT p_partkey AS requirement, CASE p_partkey % 16
        WHEN 0 THEN v >= [a, b, 0] WHEN 1 THEN v > [a, b, 0] WHEN 2 THEN v < [a, b, 0] WHEN 3 THEN v <= [a, b, 0] WHEN 4 THEN v = [p_size, b, 0] WHEN 5 THEN true WHEN 6 THEN p_size = a
        WHEN 7 THEN v <> [p_size, b, 0] WHEN 8 THEN v <> [a, 0, 0] WHEN 9 THEN v >= [a, b, 0] AND p_size <= a WHEN 10 THEN v >= [a, 0, 0] AND p_size <= a WHEN 11 THEN v >= [0, b, 0] AND v < [0, b + 1, 0]
        WHEN 12 THEN v >= [a + 1, b, 0] AND p_size <= a + 1 WHEN 13 THEN v >= [a, b, 0] WHEN 14 THEN v < [10, 0, 0] OR v >= [40, 0, 0] AND v <> [p_size, b, 1] ELSE true END AS holds
        FROM (SELECT *, (p_partkey * 7) % 50 AS a, p_partkey % 10 AS b, [p_size, p_partkey % 10, p_partkey % 3] AS v FROM part)""",
    "osv_import": """SELECT concat('R-', p_partkey) AS advisory, 'the-lib' AS package, CASE p_partkey % 7 WHEN 0 THEN concat('<', p_size, '.1') WHEN 1 THEN concat('>=', p_size, '.0,<', p_size + 1)
        WHEN 2 THEN concat('>=1.0,<=', p_size) WHEN 3 THEN concat('>=', p_size) WHEN 4 THEN concat('<1.1 || >=2.0,<2.', p_size) END AS vulnerable,
        CASE p_partkey % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'medium' END AS severity FROM part WHERE p_partkey % 7 < 5""",
    "may_affect": """WITH b AS (SELECT p_brand, CAST(floor(avg(p_size)) AS BIGINT) AS mean FROM part GROUP BY p_brand)
        SELECT p_partkey AS requirement, concat('ADV-', p_brand) AS advisory FROM part JOIN b USING (p_brand) WHERE CASE p_partkey % 4 WHEN 0 THEN p_size < mean WHEN 1 THEN p_size < mean WHEN 2 THEN true ELSE 0 < mean END""",
    "vex_statuses": """SELECT l_suppkey AS advisory, l_linestatus AS package, CASE WHEN bool_or(l_returnflag = 'R') THEN 'affected'
        WHEN bool_and(l_returnflag = 'A') AND bool_and(l_tax > 0.01) AND bool_and(l_discount > 0.01) AND bool_and(l_quantity < 50) THEN 'not_affected' ELSE 'under_investigation' END AS status
        FROM lineitem GROUP BY ALL""",
    "merged_requirements": """WITH r AS (SELECT p_partkey, concat('lib-', p_size) AS package, CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('>=', p_partkey % 10) END AS specifier, CASE WHEN p_partkey % 5 = 0 THEN concat(p_size, '.', p_partkey % 7) END AS version, p_partkey % 4 = 0 AS optional, concat('d', p_partkey % 6) AS dependent FROM part)
        SELECT package, coalesce(arg_min(specifier, p_partkey) FILTER (WHERE specifier <> ''), '') AS specifier, arg_max(version, p_partkey) FILTER (WHERE version IS NOT NULL) AS version, bool_and(optional) AS optional, count(DISTINCT dependent) AS dependents FROM r GROUP BY package""",
    "affected_join": f"""WITH b AS (SELECT p_brand, CAST(floor(avg(p_size)) AS BIGINT) AS mean FROM part GROUP BY p_brand), r AS ({_PART_VERSION})
        SELECT requirement, concat('ADV-', package) AS advisory, package, version FROM r JOIN b ON b.p_brand = r.package
        WHERE v < [mean, 5, 0] OR v >= [mean + 10, 0, 0]""",
    "longest_prefix_source": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_DOTTED} AS symbol FROM pages)
        SELECT page_id, CASE WHEN symbol = concat(host, '.en') OR starts_with(symbol, concat(host, '.en.')) THEN concat(host, '.en') ELSE host END AS model FROM p WHERE contains(host, '.')""",
    "suffix_sinks": f"""WITH m(suffix, bits) AS (VALUES ('com.fr', 1), ('net.fr', 2), ('org.fr', 4), ('com.en', 8), ('net.en', 16), ('org.en', 32), ('en', 64), ('fr', 128), ('example.com.de', 256)),
        p AS (SELECT page_id, regexp_replace({_DOTTED}, '\\.[0-9]+(\\.html)?$', '') AS symbol FROM pages)
        SELECT page_id, CAST(bit_or(bits) AS BIGINT) AS kinds FROM p JOIN m ON symbol = suffix OR ends_with(symbol, concat('.', suffix)) GROUP BY page_id""",
    "url_proof": """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+/[^?#]*[?#]') THEN 'refuted' WHEN regexp_matches(url, '^https?://[^/?#]+/') THEN 'hotspot' ELSE 'vulnerability' END AS verdict FROM pages""",
    "value_entropy": f"SELECT event_id, {_ENTROPY.format('props')} AS entropy FROM events",
    "test_context": f"SELECT page_id, list_has_any(string_split({_DOTTED}, '.'), ['blog', 'm', 'test', 'tests']) AS in_test FROM pages",
    "module_closure": f"WITH RECURSIVE {_EDGES}, {_PATHS} SELECT src, dst FROM paths",
    "module_waves": f"""WITH RECURSIVE {_EDGES}, {_PATHS},
        nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
        parts AS (SELECT node, least(node, coalesce((SELECT min(p.dst) FROM paths p JOIN paths q ON q.src = p.dst AND q.dst = p.src WHERE p.src = node), node)) AS component FROM nodes),
        crossing AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges e JOIN parts a ON a.node = e.src JOIN parts b ON b.node = e.dst WHERE a.component <> b.component),
        walks(component, level) AS (SELECT component, CAST(0 AS BIGINT) FROM parts UNION SELECT c.src, w.level + 1 FROM walks w JOIN crossing c ON c.dst = w.component)
        SELECT node, component, max(level) AS level FROM parts JOIN walks USING (component) GROUP BY node, component""",
    "cfg_reachable": f"WITH RECURSIVE {_CFG}, {_REACH} SELECT function, block FROM reach",
    "avoid_reachable": f"WITH RECURSIVE {_CFG}, {_REACH.replace('e.src = r.block)', 'e.src = r.block AND e.dst <> 3)')} SELECT function, block FROM reach",
    "fixpoint_reach": f"WITH RECURSIVE {_CFG}, {_REACH} SELECT function, block AS node FROM reach",
    "dominators": f"""WITH RECURSIVE {_CFG}, {_REACH}, {_WITHOUT}, depth AS (SELECT function, block, count(*) AS n FROM dom GROUP BY ALL)
        SELECT d.function, d.block, arg_max(d.dom, p.n) AS idom FROM dom d JOIN depth p ON p.function = d.function AND p.block = d.dom WHERE d.dom <> d.block GROUP BY d.function, d.block""",
    "dominance_frontier": f"""WITH RECURSIVE {_CFG}, {_REACH}, {_WITHOUT}
        SELECT DISTINCT d.function, d.dom AS block, e.dst AS frontier FROM dom d JOIN cfg e ON e.function = d.function AND e.src = d.block
        WHERE d.dom = e.dst OR NOT EXISTS (SELECT 1 FROM dom x WHERE x.function = d.function AND x.block = e.dst AND x.dom = d.dom)""",
    "liveness": f"""WITH RECURSIVE {_CFG}, live(function, block, name) AS (
        SELECT function, src, concat('v', dst % 4) FROM cfg UNION
        SELECT e.function, e.src, l.name FROM live l JOIN cfg e ON e.function = l.function AND e.dst = l.block WHERE l.name <> concat('v', e.src % 3)) SELECT function, block, name FROM live""",
    "reaching_definitions": f"""WITH RECURSIVE {_CFG}, held(function, block, definition) AS (
        SELECT function, dst, src FROM cfg UNION
        SELECT e.function, e.dst, h.definition FROM held h JOIN cfg e ON e.function = h.function AND e.src = h.block WHERE h.block % 3 <> h.definition % 3) SELECT function, block, definition FROM held""",
    "constant_lattice": """SELECT l_orderkey, CASE count(DISTINCT l_returnflag) WHEN 0 THEN 'bottom' WHEN 1 THEN 'const' ELSE 'top' END AS state,
        CASE count(DISTINCT l_returnflag) WHEN 1 THEN min(l_returnflag) END AS constant FROM lineitem GROUP BY l_orderkey""",
    "interval_hull": "SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_partkey",
    "taint_bits": """WITH bits(b) AS (VALUES (1), (2), (4), (8)),
        s AS (SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'purchase' THEN 13 WHEN 'click' THEN 2 ELSE 0 END AS adds, CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 10 ELSE 0 END AS clears FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM s),
        x AS (SELECT event_id, event_type, b, max(CASE WHEN adds & b <> 0 THEN pos END) OVER w AS added, max(CASE WHEN clears & b <> 0 THEN pos END) OVER w AS cleared FROM n, bits
              WINDOW w AS (PARTITION BY user_id, b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, CAST(sum(b) AS BIGINT) AS kinds FROM x WHERE event_type = 'view' AND added > coalesce(cleared, 0) GROUP BY event_id""",
    "prior_calls": """WITH c AS (SELECT event_id, user_id, event_type, ts FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) <= 12)
        SELECT a.event_id, b.event_id AS prior FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type = b.event_type AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))""",
    "guard_verdict": """SELECT l_orderkey, count(*) AS origins, CASE WHEN NOT bool_or(l_quantity > 5) THEN 'refuted' WHEN bool_and(l_returnflag = 'A') THEN 'refuted'
        WHEN bool_or(l_linestatus = 'O' AND l_tax > 0.06) THEN 'hotspot' WHEN NOT bool_and(l_discount > 0.03 OR l_returnflag = 'A') THEN 'vulnerability' ELSE 'hotspot' END AS verdict FROM lineitem GROUP BY l_orderkey""",
    "route_precedence": """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'decorator' WHEN c_mktsegment = 'BUILDING' THEN 'base' ELSE concat('route-', c_nationkey) END AS model
        FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING' OR c_nationkey < 12""",
    "severity_coverage": """SELECT o_orderstatus, count(*) AS findings, CAST(sum(6 - CAST(o_orderpriority[1] AS BIGINT)) AS BIGINT) AS weight, max(6 - CAST(o_orderpriority[1] AS BIGINT)) AS worst FROM orders GROUP BY o_orderstatus""",
}
