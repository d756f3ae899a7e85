"""The queries' counterparts in DuckDB's SQL."""

from __future__ import annotations

_TOKENS = r"list_distinct(regexp_extract_all(coalesce({}, ''), '[\w$]+'))"
_SHAPED = r"(regexp_matches(substr(name, 2), '[A-Z_$0-9]') OR length(name) >= 12)"
_NAMES = rf"""
names AS (SELECT DISTINCT name FROM (SELECT unnest({_TOKENS.format('html')}) AS name FROM pages) WHERE {_SHAPED} AND length(name) > 2),
found AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS name FROM documents) JOIN names USING (name))
"""

_STARTS = "['fix:', 'chore:', 'feat(core):', 'Add `x` to', 'BREAKING CHANGE:', 'types:', 'docs(readme):', 'See the migration guide', 'bump a from 1 to 2', 'perf:', '[meta] x', 'improve typing of', '#12 fix(parser):', '**docs:** about', 'Thanks to', '`call()` now', 'non-breaking:']"
_TITLES = rf"""
titles AS (SELECT o_orderkey, {_STARTS}[o_orderkey % 17 + 1] || ' ' || o_orderpriority || ' of state ' || o_orderstatus AS title FROM orders),
bare AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(title, '`', ''), '^(?:#\d+\s+)+', ''), '^\*\*([^*]+?):?\*\*:?\s*', '\1: '), '(?i)^backport:\s*', '')) AS bare,
         regexp_matches(title, '`[^`]+`') AS coded, regexp_matches(title, '(?i)[\w$]\(\)|\.[a-z]\w*\(') AS called
  FROM titles
)"""
_KIND = r"""CASE
  WHEN regexp_matches(bare, '(?i)^(ci|chore|test|tests|docs|doc|build|style|refactor|perf\(bench\)|release|revert)(\([^)]*\))?!?:|^(deps?|dependencies)(\([^)]*\))?:|^bump\s+\S+\s+from\s|^merge (pull request|branch)|^update dependency\b|^v?\d+\.\d+\.\d+$')
    OR regexp_matches(bare, '(?i)^\w+\((types?|typings?|typescript|docs?|readme|ci|tests?|deps?|deps-dev|build|release|lint|examples?|website)\)!?:|^(readme|internal|release|examples?|website)\s*:')
    OR regexp_matches(bare, '(?i)^\[(meta|actions|dev deps|deps|tests?|docs?|readme|ci|refactor|robustness)\]|^(special )?thanks\b|^(upgrade|update|bump)\b.*\b(dev-?dependenc\w*|version)\b|^(upgrade|update|bump)\s+\S+\s+(from|to)\s+v?[\^~]?\d')
    OR (NOT coded AND regexp_matches(bare, '(?i)\b(linter|lint fixes|spelling|typos?|test suite|tests? for|in tests|ci\b|dtslint|package manager|readme|documentation|jsdoc)\b')) THEN 'housekeeping'
  WHEN regexp_matches(bare, '(?i)^(typescript|types?|typings?)\s*:|^(improve|update|fix)\s+(the\s+)?(typing|typings|types|type definitions?)\b|\bindex\.d\.ts\b') THEN 'types'
  WHEN NOT coded AND length(title) < 160 AND regexp_matches(title, '(?i)\b(migration guide|upgrade guide|blog post|announcement|release notes|changelog)\b') THEN 'reference'
  WHEN regexp_matches(bare, '(?i)^(feat|feature|perf)(\([^)]*\))?!?:|^(add|adds|added|new|support|supports|introduce|introduces|expose|exposes|allow|allows)\b') THEN 'addition'
  ELSE 'change' END"""

_LINES = """lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
)"""

_SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _cleaned(text: str) -> str:
    links = rf"regexp_replace(regexp_replace({text}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\[[^\]]*\]', '\1', 'g')"
    return rf"trim(regexp_replace(regexp_replace({links}, 'https?://[^{_SPACE}]+', '', 'g'), '[{_SPACE}]+', ' ', 'g'))"


_PREPARED = r"""replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<!--.*?-->', '', 'g'), 'https?://github\.com/[\w.-]+/[\w.-]+/(?:pull|issues)/(\d+)', '#\1', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'),
  '(?i)<img\b[^>]*>', '', 'g'), '(?i)</?(details|summary|p|div|br|sup|sub|b|i|em|strong|span|a|samp)\b[^>]*>', ' ', 'g'), '&nbsp;', ' ')"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

_RELEASED = """released AS (
  SELECT o_custkey AS pkg, [year(o_orderdate) - 1995, month(o_orderdate), day(o_orderdate)] AS k, min(o_orderdate) AS published_at, bool_or(o_orderstatus = 'P') AS deprecated
  FROM orders GROUP BY ALL
)"""
_TEXT = "array_to_string({}, '.')"

_PICKED = """base AS (SELECT pkg, min(k) AS i, arg_max(k, published_at) AS tag FROM released GROUP BY pkg),
        told AS (
          SELECT pkg, i, tag, k, CASE WHEN NOT k > i THEN 'older' WHEN deprecated THEN 'deprecated' WHEN published_at > TIMESTAMP '2001-09-01' - INTERVAL 180 DAY THEN 'too-new'
            WHEN (i[1] = k[1] AND (i[1] <> 0 OR i[2] = k[2])) AND (i[1] = tag[1] AND (i[1] <> 0 OR i[2] = tag[2])) AND k > tag THEN 'above-dist-tag' WHEN (i[1] = k[1] AND (i[1] <> 0 OR i[2] = k[2])) THEN 'ok' ELSE 'beyond' END AS why
          FROM base JOIN released USING (pkg)
        ), picked AS (
          SELECT pkg, i, max(k) FILTER (why = 'ok') AS t, max(k) FILTER (why = 'beyond') AS also,
                 list_reverse_sort(list({'k': k, 'why': why}) FILTER (why IN ('deprecated', 'too-new', 'above-dist-tag'))) AS skipped
          FROM told GROUP BY pkg, i
        )
"""

_CHANGES = """
member AS (
  SELECT l_shipdate >= TIMESTAMP '1998-05-24' AS late, 'lib:p' || l_partkey AS part, 'lib:p' || l_partkey || '#s' || l_suppkey AS path,
         list_sort(list_distinct(list(CAST(CAST(l_quantity AS INT) AS VARCHAR)))) AS sig, bool_or(l_returnflag = 'R') AS old
  FROM lineitem GROUP BY ALL
), symbols AS (
  SELECT late, path, 'method' AS kind, sig, old FROM member
  UNION ALL SELECT DISTINCT late, part, 'class', []::VARCHAR[], false FROM member
), changes AS (
  SELECT * FROM (
    SELECT coalesce(a.path, b.path) AS path, coalesce(b.kind, a.kind) AS kind, a.sig AS before, b.sig AS after,
           CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added'
                WHEN a.sig <> b.sig THEN CASE WHEN list_has_all(b.sig, a.sig) THEN 'widened' ELSE 'changed' END
                WHEN NOT a.old AND b.old THEN 'deprecated' END AS bucket
    FROM (SELECT * FROM symbols WHERE NOT late) a FULL JOIN (SELECT * FROM symbols WHERE late) b ON a.path = b.path
  ) WHERE bucket IS NOT NULL
), kept AS (
  SELECT * FROM changes c WHERE NOT (bucket IN ('removed', 'added') AND contains(path, '#') AND EXISTS (SELECT 1 FROM changes p WHERE p.bucket = c.bucket AND p.path = split_part(c.path, '#', 1)))
)
"""

_RULES = """
per AS (
  SELECT o_custkey, count_if(o_orderstatus = 'F' AND o_totalprice > 400000) AS removed, count_if(o_orderstatus = 'O' AND o_totalprice > 350000) AS changed,
         count_if(o_orderstatus = 'P' AND o_totalprice > 200000) AS deprecated, count_if(o_orderpriority = '1-URGENT') AS matched,
         count_if(o_orderpriority = '2-HIGH' AND o_orderstatus = 'F') AS ub, count(*) AS refs, max(o_totalprice) AS top
  FROM orders GROUP BY o_custkey
), met AS (
  SELECT c_custkey, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed, coalesce(deprecated, 0) AS deprecated, coalesce(matched, 0) AS matched, coalesce(ub, 0) AS ub, coalesce(refs, 0) AS refs,
         coalesce(refs, 0) > 0 AND c_acctbal >= 0 AS computed, coalesce(refs, 0) > 0 AND c_acctbal < 0 AS failed, c_custkey % 4 = 1 AS cut, top IS NOT NULL AS complete, coalesce(top > 420000, false) AS major
  FROM customer LEFT JOIN per ON c_custkey = o_custkey
), told AS (
  SELECT *, list_filter([
    CASE WHEN computed AND removed > 0 THEN 'removed-touched' END, CASE WHEN changed > 0 THEN 'changed-touched' END, CASE WHEN deprecated > 0 THEN 'deprecated-touched' END,
    CASE WHEN matched > 0 THEN 'notes-match' END, CASE WHEN ub > 0 THEN 'unattributed-breaking' END, CASE WHEN refs = 0 THEN 'not-referenced' END,
    CASE WHEN failed OR (computed AND cut) THEN 'surface-incomplete' END, CASE WHEN NOT complete AND NOT computed THEN 'no-evidence' END,
    CASE WHEN major AND NOT (computed AND complete AND removed + changed + deprecated + matched + ub = 0) THEN 'major-unproven' END], lambda x: x IS NOT NULL) AS codes
  FROM met
)
"""

_MADE = r"""
WITH RECURSIVE lines AS (
  SELECT o_custkey AS f, o_orderkey AS pos, 'v' || o_orderkey % 5 AS name, CASE o_orderkey // 4 % 7 WHEN 5 THEN 'lib' WHEN 6 THEN 'other' ELSE 'v' || o_orderkey // 4 % 7 END AS src,
         CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS phase,
         CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 3 = 0 THEN '' ELSE '.m' || o_orderkey % 3 || CASE WHEN o_orderkey % 2 = 0 THEN '()' ELSE '' END END AS chain,
         o_orderkey % 4 = 1 AND o_orderpriority <> '5-LOW' AS called
  FROM orders
), files AS (
  SELECT DISTINCT o_custkey AS f FROM orders
), handed AS (
  -- what importing v1 of a file gives: its own, or through one file the next one's
  SELECT f, f AS of FROM files WHERE f % 2 = 0
  UNION ALL
  SELECT a.f, b.f FROM files a JOIN files b ON b.f = a.f + 1 WHERE a.f % 2 = 1 AND b.f % 2 = 0
), made AS (
  SELECT f, name, 'p' || f % 3 AS pkg, {'hops': 0, 'round': 0, 'phase': phase, 'pos': pos} AS place, [{'hops': 0, 'round': 0, 'phase': phase, 'pos': pos}] AS ways,
         CASE WHEN phase = 0 THEN chain END AS built, CASE WHEN phase = 0 THEN called END AS self, false AS cut
  FROM lines WHERE src = 'lib'
  UNION ALL
  SELECT f, name, pkg, place, ways, built, self, cut FROM (
    SELECT *, row_number() OVER (PARTITION BY f, name, pkg, place ORDER BY ways) AS best FROM (
      SELECT l.f, l.name, m.pkg,
             {'hops': m.place.hops, 'round': CASE WHEN m.place.round = 0 AND l.phase = 0 THEN 1 WHEN (l.phase, l.pos) > (m.place.phase, m.place.pos) THEN m.place.round ELSE m.place.round + 1 END, 'phase': l.phase, 'pos': l.pos} AS place,
             list_prepend({'hops': m.place.hops, 'round': CASE WHEN m.place.round = 0 AND l.phase = 0 THEN 1 WHEN (l.phase, l.pos) > (m.place.phase, m.place.pos) THEN m.place.round ELSE m.place.round + 1 END, 'phase': l.phase, 'pos': l.pos}, m.ways) AS ways,
             CASE WHEN l.phase = 0 THEN CASE WHEN l.called AND m.built <> '' AND NOT ends_with(m.built, '()') THEN m.built || '()' ELSE m.built END || l.chain END AS built,
             CASE WHEN l.phase = 0 THEN m.self OR (m.built = '' AND l.called) END AS self,
             CASE WHEN m.place.round = 0 AND l.phase = 0 THEN 1 WHEN (l.phase, l.pos) > (m.place.phase, m.place.pos) THEN m.place.round ELSE m.place.round + 1 END > 3 AS cut
      FROM made m JOIN lines l ON l.f = m.f AND l.src = m.name WHERE NOT m.cut
      UNION ALL
      SELECT l.f, l.name, m.pkg, {'hops': m.place.hops + 1, 'round': 0, 'phase': l.phase, 'pos': l.pos}, list_prepend({'hops': m.place.hops + 1, 'round': 0, 'phase': l.phase, 'pos': l.pos}, m.ways),
             CASE WHEN l.phase = 0 THEN CASE WHEN l.called AND m.built <> '' AND NOT ends_with(m.built, '()') THEN m.built || '()' ELSE m.built END || l.chain END,
             CASE WHEN l.phase = 0 THEN m.self OR (m.built = '' AND l.called) END, m.place.hops + 1 > 3
      FROM made m JOIN handed h ON h.of = m.f AND m.name = 'v1' JOIN lines l ON l.f + 1 = h.f AND l.src = 'other' WHERE NOT m.cut
    )) WHERE best = 1
), best AS (
  SELECT *, row_number() OVER (PARTITION BY f, name, pkg ORDER BY cut, ways) AS rank FROM made
)
"""

ORACLES: dict[str, str] = {
    "name_text_match": f"WITH {_NAMES} SELECT doc_id, name FROM found",
    "df_demotion": f"""
        WITH df AS (SELECT lang, name, count(DISTINCT doc_id) AS df FROM (SELECT lang, doc_id, unnest({_TOKENS.format('text')}) AS name FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
             n AS (SELECT lang, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY lang)
        SELECT lang, name, df, n_docs FROM df JOIN n USING (lang) WHERE df >= 3 AND df >= 0.25 * n_docs""",
    "match_buckets": f"""
        WITH {_NAMES}, toxic AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        docs AS (SELECT d.doc_id, coalesce(n_chars, 0) AS n, coalesce(toxic = 1, false) AS breaking, d.doc_id % 4 = 0 AS example FROM documents d LEFT JOIN toxic USING (doc_id)),
        often AS (SELECT name FROM found WHERE doc_id % 4 = 0 GROUP BY name HAVING count(*) >= 3 AND count(*) >= 0.02 * (SELECT count(*) FROM documents WHERE doc_id % 4 = 0)),
        hit AS (SELECT doc_id, length(name) % 2 = 0 AS strong, example FROM found JOIN docs USING (doc_id) WHERE NOT (example AND NOT breaking AND name IN (SELECT name FROM often))),
        per AS (SELECT doc_id, count(*) AS n_hits, bool_or(strong AND NOT example) AS direct FROM hit GROUP BY doc_id)
        SELECT doc_id, breaking, coalesce(n_hits, 0) AS n_hits, coalesce(direct, false) AS direct,
               CASE WHEN n % 7 = 0 THEN 'none' WHEN n_hits > 0 THEN 'matched' WHEN breaking AND n % 3 <> 0 THEN 'unattributed-breaking' WHEN n % 5 <> 0 AND n % 3 <> 0 THEN 'unattributed-change' ELSE 'none' END AS bucket
        FROM docs LEFT JOIN per USING (doc_id)""",
    "entry_kind": rf"""
        WITH {_TITLES} SELECT o_orderkey, {_KIND} AS kind, regexp_matches(title, '(?i)^\s*(\*{{1,2}}|_{{1,2}}|\[|\()?\s*(⚠️|:warning:|breaking|💥|:boom:)|BREAKING CHANGE') AS breaking,
               CASE WHEN coded OR called THEN 'headline' ELSE 'none' END AS names_api FROM bare""",
    "entry_regions": r"""
        SELECT doc_id, (CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN 1 ELSE 0 END + 2 * len(regexp_extract_all(coalesce(text, ''), '`([^`]+)`', 1)))::BIGINT AS n_regions, len(regexp_extract_all(coalesce(text, ''), '`([^`]+)`', 1)) AS n_code,
               array_to_string(list_transform(list_filter(list_zip(refs, range(len(refs))), lambda p: list_position(refs, p[1]) = p[2] + 1), lambda p: p[1]), ',') AS refs,
               array_to_string(list_sort(list_distinct(list_filter(toks, lambda name: length(name) >= 3 AND regexp_matches(name, '[a-z][A-Z]|[_$]|\d|^[A-Z][a-z]+[A-Z]')))), ',') AS names
        FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?:^|[^\w/])(#\d{1,7})\b', 1) AS refs, regexp_extract_all(coalesce(text, ''), '[A-Za-z_$][\w$]*') AS toks FROM documents)""",
    "html_clean": f"SELECT page_id, {_cleaned(_PREPARED)} AS text FROM pages",
    "url_parts": f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, len(list_filter(string_split({_PATH}, '/'), lambda p: p <> '')) AS depth FROM pages",
    "fence_parity": rf"""
        WITH {_LINES}, told AS (
          SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lines
        ) SELECT doc_id, count(*) AS n_lines, count_if(b % 2 = 1)::BIGINT AS n_fenced FROM told GROUP BY doc_id""",
    "line_runs": """
        WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem),
             i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS island FROM d)
        SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM i GROUP BY l_orderkey, l_returnflag, island""",
    "split_entries": """
        WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderpriority AS pri, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
        a AS (SELECT *, coalesce(sum(CASE WHEN k % 7 = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM o),
        b AS (SELECT *, CASE WHEN k % 7 = 5 THEN 'fence' WHEN code THEN 'code' WHEN k % 7 = 0 THEN 'heading' WHEN k % 7 = 3 THEN 'blank' WHEN k % 7 IN (1, 6) THEN 'bullet' ELSE 'text' END AS what FROM a),
        c AS (SELECT *, sum((what IN ('heading', 'bullet'))::INT) OVER (PARTITION BY o_custkey ORDER BY pos) AS seg,
                     last_value(CASE WHEN what IN ('blank', 'text', 'heading', 'bullet') THEN what END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
                     last_value(CASE WHEN what = 'heading' THEN 'part ' || pri END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM b),
        d AS (SELECT *, first_value(what) OVER (PARTITION BY o_custkey, seg ORDER BY pos) AS under FROM c),
        e AS (SELECT *, coalesce((what = 'text' AND seg > 0 AND under = 'bullet' AND k % 7 <> 4 AND prev = 'blank') OR (seg = 0 AND what IN ('text', 'fence')), false) AS could FROM d),
        f AS (SELECT *, what IN ('heading', 'bullet') OR (could AND coalesce(sum(could::INT) OVER (PARTITION BY o_custkey, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS start FROM e),
        g AS (SELECT *, sum(start::INT) OVER (PARTITION BY o_custkey ORDER BY pos) AS entry, what IN ('code', 'text') AS part FROM f),
        h AS (SELECT *, CASE WHEN what = 'text' THEN 'prose' WHEN what = 'code' AND coalesce(lag(what) OVER (PARTITION BY o_custkey, entry, part ORDER BY pos), '') <> 'code' THEN 'code-block' END AS region FROM g WHERE entry > 0),
        i AS (SELECT o_custkey, entry, arg_min(CASE WHEN what IN ('heading', 'bullet') THEN what ELSE 'paragraph' END, pos) AS form,
                     arg_min(CASE WHEN what = 'heading' THEN 'part ' || pri WHEN what = 'fence' THEN '' WHEN what = 'bullet' THEN CASE k % 7 WHEN 1 THEN 'order number ' ELSE 'step number ' END || k WHEN k % 7 = 4 THEN 'nested under ' || k ELSE 'plain text of ' || k END, pos) AS title,
                     arg_min(CASE WHEN what = 'heading' THEN '' ELSE coalesce(head, '') END, pos) AS path,
                     coalesce(list(region ORDER BY pos) FILTER (region IS NOT NULL), []) AS regions, count_if(part) AS n, bool_or(part AND k % 7 <> 3) AS said FROM h GROUP BY o_custkey, entry),
        j AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY entry) - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS every FROM i WHERE (form <> 'heading' OR n > 0) AND (title <> '' OR said)),
        l AS (SELECT *, min(ord) FILTER (form <> 'paragraph') OVER (PARTITION BY o_custkey) AS listed FROM j)
        SELECT o_custkey, ord, title, path, array_to_string(list_concat(CASE WHEN title <> '' THEN ['title'] ELSE [] END, regions), ',') AS regions,
               CASE WHEN coalesce(listed > 0 AND every - listed >= 2 AND ord < listed, false) AND NOT list_contains(regions, 'code-block') THEN 'intro' ELSE 'change' END AS kind FROM l""",
    "candidate_pick": f"""
        WITH {_RELEASED}, {_PICKED}
        SELECT pkg, {_TEXT.format("i")} AS version, {_TEXT.format("t")} AS target,
               CASE WHEN t IS NULL THEN NULL WHEN i[1] <> t[1] OR (i[1] = 0 AND i[2] <> t[2]) THEN 'major' WHEN i[2] <> t[2] THEN 'minor' ELSE 'patch' END AS bump,
               coalesce(array_to_string(list_transform(list_slice(list_filter(skipped, lambda s: t IS NULL OR s.k > t), 1, 3), lambda s: array_to_string(s.k, '.') || ':' || s.why), ','), '') AS held_back,
               {_TEXT.format("also")} AS also
        FROM picked""",
    "semver_sort": f"WITH {_RELEASED} SELECT * FROM (SELECT pkg, {_TEXT.format('k')} AS version, row_number() OVER (PARTITION BY pkg ORDER BY k DESC) AS rank FROM released) WHERE rank <= 5",
    "bump_kinds": f"""
        WITH {_RELEASED}, s AS (SELECT pkg, lag(k) OVER (PARTITION BY pkg ORDER BY k) AS f, k AS t FROM released)
        SELECT CASE WHEN f[1] <> t[1] OR (f[1] = 0 AND f[2] <> t[2]) THEN 'major' WHEN f[2] <> t[2] THEN 'minor' ELSE 'patch' END AS bump, count(*) AS n, count(DISTINCT pkg) AS packages
        FROM s WHERE f IS NOT NULL GROUP BY 1""",
    "range_matches": f"""
        WITH {_RELEASED}, v AS (SELECT DISTINCT k FROM released), r AS (
          SELECT k, unnest(list_filter([CASE WHEN k >= [1,2,0] AND k < [2,0,0] THEN '^1.2.0' END, CASE WHEN k >= [2,3,0] AND k < [2,4,0] THEN '~2.3' END,
            CASE WHEN k >= [0,5,0] AND k < [2,1,0] THEN '>=0.5.0 <2.1.0' END, CASE WHEN k >= [1,4,0] AND k < [4,0,0] THEN '1.4 - 3' END,
            CASE WHEN k[1] = 4 OR (k[1] = 0 AND k[2] = 1) THEN '4.x || 0.1.x' END, '*'], lambda x: x IS NOT NULL)) AS declared FROM v
        ) SELECT declared, count(*) AS n, array_to_string(max(k), '.') AS highest FROM r GROUP BY declared""",
    "snapshot_plan": """
        WITH o AS (SELECT o_custkey AS name, o_orderpriority AS manifest, o_orderstatus AS key, [month(o_orderdate), day(o_orderdate), 0] AS k, o_orderdate < TIMESTAMP '1998-01-01' AS base FROM orders),
             e AS (SELECT name, manifest, key, min(k) AS before, list(DISTINCT k) AS everything FROM o WHERE base GROUP BY ALL)
        SELECT name, manifest, key, array_to_string(k, '.') AS version, array_to_string(before, '.') AS before,
               CASE WHEN before IS NULL THEN 'added' WHEN list_contains(everything, k) THEN 'unchanged' ELSE 'changed' END AS state
        FROM (SELECT DISTINCT name, manifest, key, k FROM o WHERE NOT base) LEFT JOIN e USING (name, manifest, key)""",
    "surface_diff": f"WITH {_CHANGES} SELECT path, kind, bucket, coalesce(array_to_string(before, ','), '') AS before, coalesce(array_to_string(after, ','), '') AS after FROM changes",
    "drop_children": f"WITH {_CHANGES} SELECT path, kind, bucket FROM kept",
    "collapse_changes": f"""
        WITH {_CHANGES}, g AS (
          SELECT bucket, kind, list_sort(list([CASE WHEN contains(path, '#') THEN '12' ELSE '11' END, path])) AS seen
          FROM kept GROUP BY bucket, kind, CASE WHEN contains(path, '#') THEN '#' || split_part(path, '#', 2) ELSE split_part(path, ':', 2) END, before, after
        ) SELECT seen[1][2] AS path, kind, bucket, len(seen) - 1 AS n_also FROM g""",
    "longest_prefix": f"""
        WITH p AS (SELECT page_id, {_HOST} || {_PATH} AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
        f AS (SELECT page_id, path, array_to_string(list_slice(parts, 1, k), '/') AS prefix FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM s)),
        shared AS (SELECT prefix FROM f GROUP BY prefix HAVING count(*) > 1),
        best AS (SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM f JOIN shared USING (prefix) GROUP BY page_id)
        SELECT page_id, path, prefix FROM p LEFT JOIN best USING (page_id)""",
    "followup_interval": """
        SELECT * FROM (
          SELECT a.user_id, a.event_id AS id, b.event_id AS next_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS rank
          FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 14 DAY
          WHERE a.event_type = 'signup' AND b.event_type = 'purchase') WHERE rank <= 10""",
    "multiset_lines": r"""
        WITH l AS (SELECT source, n_chars < 1000 AS small, regexp_replace(translate(regexp_replace(regexp_replace(t, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '', 'g'), '[,;]', '', 'g'), '''`', '""'), '\(([A-Za-z_$][\w$]*)\)=>', '\1=>', 'g') AS same
                   FROM (SELECT source, n_chars, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)),
             c AS (SELECT source, same, count_if(small) AS a, count_if(NOT small) AS b FROM l WHERE same <> '' GROUP BY ALL)
        SELECT source, count(*) AS n_lines, sum(least(a, b))::BIGINT AS pairs FROM c WHERE a > 0 AND b > 0 GROUP BY source""",
    "closure_reach": """
        WITH RECURSIVE edges AS (
          SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
          UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
        ), seen AS (
          SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0::BIGINT AS depth FROM region
          UNION SELECT root, dst, depth + 1 FROM seen JOIN edges ON node = src WHERE depth < 12
        ) SELECT root, depth, count(*) AS n, false AS cut FROM (SELECT root, node, min(depth) AS depth FROM seen GROUP BY ALL) GROUP BY root, depth""",
    "waterfall": """
        WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), m AS (SELECT *, lang IS NOT NULL AND n_chars >= 200 AS fits FROM documents LEFT JOIN l USING (doc_id) WHERE source IS NOT NULL)
        SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality::VARCHAR WHEN fits THEN lang END AS body, CASE WHEN quality IS NOT NULL THEN 'labels' WHEN fits THEN 'documents' END AS found_in,
               CASE WHEN quality IS NULL AND NOT fits THEN 'labels: not found; documents: ' || CASE WHEN lang IS NULL THEN 'no language' ELSE 'too short' END END AS reason FROM m""",
    "verdict_reasons": f"""
        WITH {_RULES} SELECT c_custkey, CASE WHEN list_contains(codes, 'removed-touched') THEN 'blocked' WHEN len(codes) > 0 THEN 'review' ELSE 'quiet' END AS verdict,
               CASE WHEN len(codes) > 0 THEN array_to_string(codes, ',') ELSE 'notes-complete-no-match,surface-clean' END AS reasons FROM told""",
    "findings_order": """
        WITH e AS (SELECT 'u' || user_id AS pkg, event_id, event_type AS t, value > 50 AS high, event_id % 3 = 0 AS breaking, event_id % 2 = 0 AS hinted FROM events),
        r AS (SELECT pkg, event_id, CASE WHEN t IN ('error', 'purchase') THEN 'type' WHEN t = 'click' THEN 'note' WHEN t = 'signup' THEN 'breaking-no-api' ELSE 'change-no-api' END AS kind,
                CASE WHEN t IN ('error', 'purchase') THEN CASE WHEN coalesce(high, false) THEN CASE WHEN t = 'error' THEN 0 ELSE 1 END ELSE 5 END WHEN t = 'signup' THEN 4 WHEN t <> 'click' THEN 5
                     WHEN breaking THEN CASE WHEN high THEN 0 ELSE 2 END WHEN high THEN 3 ELSE 5 END AS rank,
                CASE WHEN t IN ('error', 'purchase') THEN 0 WHEN t = 'click' THEN 1 WHEN t = 'signup' THEN 2 ELSE 3 END AS net, CASE WHEN t NOT IN ('error', 'purchase', 'click') AND NOT hinted THEN 1 ELSE 0 END AS late FROM e)
        SELECT pkg, kind, event_id::VARCHAR AS id, rank::BIGINT AS rank, row_number() OVER (PARTITION BY pkg ORDER BY rank, net, late, event_id) AS place FROM r""",
    "split_80_20": "SELECT doc_id, ('0x' || substr(sha256(concat_ws('#', source, doc_id)), 1, 8))::BIGINT % 100 < 20 AS held_back FROM documents",
    "score_totals": """
        WITH e AS (SELECT DISTINCT source, lang, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
             per AS (SELECT source, count(*) AS expected, count_if(n_chars >= 2000) AS found FROM e GROUP BY source),
             r AS (SELECT source, bool_and(NOT coalesce(n_chars >= 2000, false)) AS wrong_quiet, count_if(n_chars >= 2000) AS reported FROM documents GROUP BY source),
             c AS (SELECT source, expected >= 3 AS many, found, coalesce(wrong_quiet, false) AS wrong_quiet, coalesce(reported, 0) AS reported FROM per LEFT JOIN r USING (source))
        SELECT many, count(*) AS cases, count_if(found > 0)::BIGINT AS found_cases, count_if(wrong_quiet)::BIGINT AS wrong_quiet, coalesce(median(reported), 0)::DOUBLE AS median_reported,
               round(coalesce(sum(found) / nullif(sum(reported), 0), 0), 4)::DOUBLE AS precision FROM c GROUP BY GROUPING SETS ((many), ())""",
    "medians": "SELECT event_type, round(median(value), 6) AS median, list_sort(list(value))[floor(count(value) / 2)::BIGINT + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "manifest_rows": r"""
        SELECT event_id, name, json_extract_string(props, '$.' || name) AS spec,
               CASE WHEN regexp_matches(json_extract_string(props, '$.' || name), '^[\sv\d^~<>=|*xX.-]*[\d*xX][\w.+-]*(\s.*)?\z') THEN 'range' ELSE 'tag' END AS kind
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events)""",
    "counted_examples": "SELECT event_type, count(*) AS n, array_to_string(list_slice(list_sort(list(event_id)), 1, 3), ',') AS examples FROM events GROUP BY event_type",
    "uniq_sites": """
        WITH s AS (SELECT conv_id, role, turn // 4 AS line, min({'q': coalesce(ends_with(text, '?'), false)::INT, 't': turn}) AS s FROM conversations GROUP BY ALL)
        SELECT conv_id, role, line, s.q = 1 AS type_only, s.t AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, line) AS place FROM s""",
    "content_ids": "SELECT doc_id, substr(sha1(coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 12) AS content_id FROM documents",
    "first_sentences": rf"""
        WITH f AS (SELECT doc_id, {_cleaned("coalesce(text, '')")} AS plain FROM documents), g AS (SELECT *, regexp_extract(plain, '^(.{{20,160}}?[.!?])(?: |$)', 1) AS s FROM f)
        SELECT doc_id, CASE WHEN s <> '' THEN s ELSE substr(plain, 1, 160) END AS sentence FROM g""",
    "release_groups": """
        WITH u AS (SELECT CASE WHEN o_custkey % 3 = 1 THEN '@s' || (o_custkey % 7) || '/c' || o_custkey ELSE 'c' || o_custkey END AS name,
                   CASE WHEN o_custkey % 3 = 0 THEN 'github.com/o/r' || (o_custkey % 11) WHEN o_custkey % 3 = 1 THEN '@s' || (o_custkey % 7) || '@' || year(o_orderdate) ELSE 'c' || o_custkey END AS "group",
                   CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS rank FROM orders)
        SELECT "group", count(DISTINCT name) AS packages, min(name) AS first, ['patch', 'minor', 'major'][max(rank)] AS bump FROM u GROUP BY 1""",
    "release_tags": f"""
        WITH {_RELEASED}, t AS (SELECT 'c' || pkg AS bare, '@scope/c' || pkg AS pkg, {_TEXT.format("k")} AS v, month(published_at) AS m FROM released)
        SELECT pkg, v AS version, CASE WHEN m <= 2 THEN 'v' || v WHEN m <= 4 THEN v WHEN m = 5 THEN pkg || '@' || v WHEN m = 6 THEN bare || '@' || v WHEN m = 7 THEN pkg || '-v' || v WHEN m = 8 THEN bare || '-v' || v WHEN m = 9 THEN 'release-' || v END AS tag,
               CASE WHEN m <= 2 THEN 0 WHEN m <= 4 THEN 1 WHEN m <= 9 THEN m - 3 END::BIGINT AS scheme FROM t""",
    "notes_coverage": f"""
        WITH {_RELEASED} SELECT pkg, CASE WHEN count_if(NOT deprecated) = count(*) THEN 'complete' WHEN count_if(NOT deprecated) > 0 THEN 'partial' WHEN pkg % 3 = 0 THEN 'none-published' ELSE 'unavailable' END AS coverage
        FROM released GROUP BY pkg""",
    "version_bumps": f"""
        WITH {_RELEASED}, b AS (SELECT pkg, max(k) FILTER (published_at < TIMESTAMP '1998-01-01') AS f, max(k) FILTER (published_at >= TIMESTAMP '1998-01-01') AS t FROM released GROUP BY pkg)
        SELECT pkg AS key, {_TEXT.format("f")} AS "from", {_TEXT.format("t")} AS "to",
               CASE WHEN f[1] <> t[1] OR (f[1] = 0 AND f[2] <> t[2]) THEN 'major' WHEN f[2] <> t[2] THEN 'minor' ELSE 'patch' END AS bump FROM b WHERE f IS NOT NULL AND t > f""",
    "changed_exports": """
        WITH c AS (
          SELECT 'p' || l_partkey AS path, l_returnflag AS name, CAST(l_quantity AS INT) AS fp, count_if(l_shipdate < TIMESTAMP '1998-05-24') AS a, count_if(l_shipdate >= TIMESTAMP '1998-05-24') AS b
          FROM lineitem GROUP BY ALL
        ), alive AS (SELECT path FROM c GROUP BY path HAVING sum(a) > 0 AND sum(b) > 0)
        SELECT path, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM c WHERE a <> b AND path IN (SELECT path FROM alive) GROUP BY path""",
    "worst_verdicts": f"""
        WITH {_RULES}, v AS (SELECT c_custkey, CASE WHEN list_contains(codes, 'removed-touched') THEN 2 WHEN len(codes) > 0 THEN 1 ELSE 0 END AS r FROM told)
        SELECT c_nationkey, ['quiet', 'review', 'blocked'][max(r) + 1] AS worst, count_if(r = 0)::BIGINT AS quiet, count_if(r = 1)::BIGINT AS review, count_if(r = 2)::BIGINT AS blocked
        FROM v JOIN customer USING (c_custkey) GROUP BY c_nationkey""",
    "title_scopes": rf"""
        WITH {_TITLES}, s AS (
          SELECT *, regexp_replace(title, '^(?:#\d+\s+)+', '') AS plain, regexp_replace(replace(regexp_replace(title, '^(?:#\d+\s+)+', ''), '`', ''), '^\*\*([^*]+?):?\*\*:?\s*', '\1: ') AS loose FROM bare
        ), t AS (
          SELECT *, nullif(concat(regexp_extract(plain, '{(_S := r"^(?:[a-z]+\(([\w$./-]+)\)!?|([\w$]+)):\s")}', 1), regexp_extract(plain, '{_S}', 2)), '') AS scope,
                 nullif(concat(regexp_extract(loose, '{_S}', 1), regexp_extract(loose, '{_S}', 2)), '') AS own,
                 regexp_replace(regexp_replace(plain, '^[^:]*:\s', ''), '#\d+', '', 'g') AS rest
          FROM s
        ) SELECT o_orderkey, scope,
                 regexp_matches(rest, '(?i)[\w$]\(\)|\.[a-z]\w*\(') OR coded
                 OR len(list_filter(regexp_extract_all(rest, '[A-Za-z_$][\w$]*'), lambda w: w <> coalesce(scope, '') AND (regexp_matches(substr(w, 2), '[A-Z_$0-9]') OR length(w) >= 12) AND NOT regexp_matches(w, '^([A-Z]+|[A-Z][a-z]+)$'))) > 0 AS another,
                 array_to_string(list_sort(list_distinct(list_filter(list_concat(list_concat(
                   regexp_extract_all(regexp_extract(title, '`([^`]+)`', 1), '[A-Za-z_$][\w$]*'),
                   list_filter(regexp_extract_all(title, '[A-Za-z_$][\w$]*'), lambda w: regexp_matches(w, '[a-z][A-Z]|[_$]|\d|^[A-Z][a-z]+[A-Z]'))), [own]), lambda w: length(w) >= 3))), ',') AS names
          FROM t""",
    "prefix_reach": r"""
        WITH p AS (SELECT page_id, list_filter(string_split(translate(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '.#', '--'), '/'), lambda x: x <> '') AS parts FROM pages),
        s AS (SELECT DISTINCT 'w:' || array_to_string(CASE WHEN len(parts) > 1 THEN parts[1:len(parts) - 1] ELSE parts END, '.') AS subject FROM p),
        a AS (SELECT page_id, 'w:' || array_to_string(parts[1:k], '.') AS subject FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM p))
        SELECT subject, count(DISTINCT page_id) AS n, min(page_id) AS first FROM a JOIN s USING (subject) GROUP BY subject""",
    "json_strings": "SELECT event_id || '.json' AS path, event_type AS value, 2::BIGINT AS n FROM events UNION ALL SELECT event_id || '.json', 'x', 1 FROM events",
    "highest_versions": f"""
        WITH {_RELEASED}, r AS (SELECT DISTINCT pkg, unnest(['^2.0.0', '~3.4', '*', 'first', '<1.0.0']) AS range FROM released),
        m AS (SELECT r.pkg, r.range, max(k) FILTER (CASE r.range WHEN '^2.0.0' THEN k[1] = 2 WHEN '~3.4' THEN k[1] = 3 AND k[2] = 4 WHEN '*' THEN true WHEN '<1.0.0' THEN k[1] = 0 ELSE false END) AS best, min(k) AS lowest FROM r JOIN released USING (pkg) GROUP BY ALL)
        SELECT pkg::VARCHAR AS name, range, {_TEXT.format("CASE WHEN range = 'first' THEN lowest ELSE best END")} AS version FROM m""",
    "name_sets": """
        WITH g AS (SELECT l_orderkey, list_sort(list_distinct(list((l_partkey % 10)::VARCHAR))) AS s, list_sort(list_distinct(list((l_suppkey % 10)::VARCHAR))) AS w, count(DISTINCT l_returnflag) AS files, count(*) AS refs FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey::VARCHAR AS pkg, array_to_string(s, ',') AS strong, array_to_string(list_filter(w, lambda x: NOT list_contains(s, x)), ',') AS weak, files, refs FROM g""",
    "sites_by_name": """
        WITH r AS (SELECT l_orderkey::VARCHAR AS pkg, l_returnflag AS name, l_linestatus AS file, l_suppkey AS line, min((l_quantity < 10)::INT) = 1 AS type_only FROM lineitem GROUP BY ALL),
        o AS (SELECT DISTINCT l_orderkey::VARCHAR AS pkg, 'R' AS name, 'call' AS file, l_partkey AS line, false AS type_only FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
        b AS (SELECT * FROM r UNION ALL SELECT * FROM o)
        SELECT *, row_number() OVER (PARTITION BY pkg, name ORDER BY file, line) AS place FROM b""",
    "brief_groups": f"""
        WITH {_RULES}, v AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS pkg, codes, CASE WHEN list_contains(codes, 'removed-touched') THEN 1 WHEN len(codes) > 0 THEN 2 ELSE 3 END AS rank FROM told),
        g AS (SELECT pkg, rank, CASE WHEN rank = 3 THEN 'quiet' WHEN rank = 2 AND list_has_all(['opaque-usage', 'not-referenced', 'blind-spots', 'no-evidence', 'flagged-install', 'surface-incomplete'], codes) AND codes <> ['no-evidence'] THEN 'unseen' ELSE 'detailed' END AS shown FROM v)
        SELECT pkg, shown, row_number() OVER (PARTITION BY shown ORDER BY rank, pkg) AS place, false AS one_net FROM g""",
    "coverage_labels": f"""
        WITH {_RELEASED}, g AS (SELECT pkg, count(*) AS total, count_if(NOT deprecated) AS found, list_sort(list_distinct(list(CASE WHEN deprecated THEN NULL WHEN month(published_at) <= 6 THEN 'releases' ELSE 'changelog' END))) AS sources FROM released GROUP BY pkg)
        SELECT pkg, CASE WHEN found > 0 THEN (CASE WHEN found = total THEN 'complete ' ELSE 'partial ' END) || found || ' of ' || total || ': ' || array_to_string(sources, ', ') WHEN pkg % 2 = 0 THEN 'none-published' ELSE 'unavailable: stub-body' END AS label FROM g""",
    "typed_usage": """
        WITH p AS (SELECT 'p' || p_partkey AS pkg, p_size < 25 AS used, p_size::BIGINT AS refs, p_brand, p_type = 'ECONOMY' AS typed FROM part)
        SELECT pkg, refs, p_brand AS strong, '' AS opaque FROM p WHERE used
        UNION ALL SELECT '@types/' || pkg, CASE WHEN used THEN refs ELSE 0 END, CASE WHEN used THEN p_brand ELSE '' END, CASE WHEN used THEN '' ELSE 'ambient-types' END FROM p WHERE typed""",
    "fix_evidence": """
        WITH e AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS file, l_linenumber AS line FROM lineitem WHERE l_quantity < 20),
        f AS (SELECT l_orderkey AS id, l_returnflag AS file, l_linenumber AS line, l_suppkey % 3 AS kind, 'part' || (l_suppkey % 20) AS name FROM lineitem),
        s AS (SELECT id, list_sort(list_distinct(list(file || ':' || line) FILTER (kind = 0))) AS on_site, list_sort(list_distinct(list(file || ':' || line) FILTER (kind = 1))) AS options FROM e JOIN f USING (id, file, line) WHERE kind < 2 GROUP BY id),
        t AS (SELECT l_orderkey AS id, 'part' || (l_partkey % 20) AS name FROM lineitem WHERE l_quantity < 20
              UNION SELECT l_orderkey, 'part' || (l_partkey % 20) FROM lineitem JOIN (SELECT DISTINCT id, file FROM e) x ON l_orderkey = x.id AND l_returnflag = x.file WHERE l_quantity > 45),
        n AS (SELECT id, list_sort(list_distinct(list(name))) AS names FROM t JOIN (SELECT id, name FROM f WHERE kind = 2) y USING (id, name) GROUP BY id)
        SELECT id, coalesce(array_to_string(on_site, ','), '') AS on_site, coalesce(array_to_string(options, ','), '') AS options, coalesce(array_to_string(names, ','), '') AS names FROM s FULL JOIN n USING (id)""",
    "reformatted_lines": """
        WITH l AS (SELECT l_orderkey AS id, l_linenumber AS line, 'row("' || l_returnflag || '"' || floor(l_quantity / 10)::BIGINT || ')' AS same, l_linestatus = 'O' AS gone FROM lineitem),
        p AS (SELECT id, same, count(*) AS pool FROM l WHERE NOT gone GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id, same ORDER BY line) AS place FROM l WHERE gone),
        told AS (SELECT r.*, coalesce(place <= pool, false) AS again FROM r LEFT JOIN p USING (id, same)),
        rest AS (SELECT *, line - row_number() OVER (PARTITION BY id ORDER BY line, same) AS island FROM told WHERE NOT again),
        runs AS (SELECT id, string_agg(same, '' ORDER BY line, same) AS joined, list(line) AS places FROM rest GROUP BY id, island),
        gained AS (SELECT id, string_agg(same, '' ORDER BY line, same) AS gained FROM l WHERE NOT gone GROUP BY id)
        SELECT id, line FROM told WHERE again UNION ALL SELECT id, unnest(places) FROM runs JOIN gained USING (id) WHERE length(joined) >= 6 AND contains(gained, joined)""",
    "registry_choice": """
        WITH p AS (SELECT p_partkey, lower(replace(p_brand, '#', '')) AS brand FROM part)
        SELECT CASE WHEN p_partkey % 2 = 0 THEN '@' || brand || '/p' || p_partkey ELSE 'p' || p_partkey END AS pkg, CASE WHEN p_partkey % 2 = 0 THEN 'https://r.io/' || brand ELSE 'https://d.io' END AS registry,
               CASE WHEN p_partkey % 2 = 1 THEN NULL WHEN starts_with(brand, 'brand1') THEN 'narrow' ELSE 'wide' END AS token FROM p""",
    "stale_locks": f"""
        WITH {_RELEASED}, t AS (SELECT pkg, k AS new, coalesce(lag(k) OVER w, k) AS old, row_number() OVER w AS rank FROM released WINDOW w AS (PARTITION BY pkg ORDER BY k))
        SELECT 'c' || pkg || '-' || rank AS dir, {_TEXT.format("CASE WHEN pkg % 2 = 0 OR old = new THEN old ELSE new END")} AS version, CASE WHEN pkg % 2 = 0 OR old = new THEN 'lockfile' ELSE 'manifest-range' END AS version_source, CASE WHEN pkg % 2 = 0 OR old = new THEN 0 ELSE 1 END::BIGINT AS late FROM t""",
    "removed_names": """
        SELECT DISTINCT 'lib:v.p' || l_partkey AS path, 'removed' AS bucket FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-05-24'
        AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-05-24' AND l_returnflag = 'N')""",
    "type_walk": r"""
WITH RECURSIVE place AS (
  SELECT n_nationkey AS nk, n_regionkey AS rk, 'lib:r' || n_regionkey || '.n' || n_nationkey AS path FROM nation
), symbols AS (
  SELECT 'lib:' || k || r_regionkey AS path, 'namespace' AS kind, CASE WHEN k = 'a' THEN 'lib:r' || r_regionkey END AS alias_of, NULL AS returns, NULL AS instance_of
  FROM region, (VALUES ('r'), ('a')) v(k)
  UNION ALL
  SELECT p.path, ['class', 'function', 'interface'][p.nk % 3 + 1], NULL, CASE WHEN p.nk % 3 = 1 THEN q.path END, CASE WHEN p.nk % 3 = 0 THEN p.path END
  FROM place p LEFT JOIN place q ON q.nk = (p.nk + 1) % 25
  UNION ALL
  SELECT p.path || '#c' || c_custkey, 'method', NULL, q.path, NULL FROM customer JOIN place p ON p.nk = c_nationkey JOIN place q ON q.nk = c_custkey % 25
), known AS (
  SELECT s.path, coalesce(t.path, s.path) AS at_path, coalesce(t.kind, s.kind) AS kind, coalesce(t.returns, s.returns) AS returns, coalesce(t.instance_of, s.instance_of) AS instance_of,
         t.path IS NOT NULL AS aliased
  FROM symbols s LEFT JOIN symbols t ON s.alias_of = t.path
), firsts AS (
  SELECT c_nationkey AS nk, min(c_custkey) AS first FROM customer GROUP BY 1
), chains AS (
  SELECT o_orderkey AS k, list_filter([
      {'name': (CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'r' END) || p.rk, 'call': false, 'con': false, 'args': NULL},
      {'name': 'n' || p.nk, 'call': o_orderkey % 3 > 0, 'con': o_orderkey % 3 = 2, 'args': NULL},
      {'name': 'c' || c_custkey, 'call': o_orderkey % 5 > 0, 'con': false, 'args': o_orderkey % 5},
      {'name': 'c' || first, 'call': o_orderkey % 7 = 0, 'con': false, 'args': NULL},
      {'name': CASE WHEN o_orderkey % 7 < 2 THEN 'x' END, 'call': false, 'con': false, 'args': NULL}], lambda s: s.name IS NOT NULL) AS segs
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN place p ON p.nk = c_nationkey LEFT JOIN firsts f ON f.nk = c_custkey % 25
), walk AS (
  SELECT k, segs, 0 AS i, 'lib:' AS base, 'ns' AS cur, []::VARCHAR[] AS paths, []::VARCHAR[] AS rest, false AS missing, false AS done FROM chains
  UNION ALL
  SELECT k, segs, i + 1, base, cur, paths,
         CASE WHEN done THEN list_transform(segs[CASE WHEN found THEN i + 2 ELSE i + 1 END:], lambda s: s.name) ELSE [] END, NOT found AND i = 0, done OR i + 1 >= len(segs)
  FROM (
    SELECT *, NOT found OR (i + 1 < len(segs) AND base IS NULL) AS done FROM (
      SELECT w.k, segs, i, n.path IS NOT NULL AS found,
             CASE WHEN n.path IS NULL THEN paths ELSE list_concat(paths, CASE WHEN aliased THEN [n.path || coalesce('/' || args, ''), at_path || coalesce('/' || args, '')] ELSE [n.path || coalesce('/' || args, '')] END) END AS paths,
             CASE WHEN kind = 'namespace' OR (NOT uses AND kind = 'class') THEN 'ns' ELSE 'type' END AS cur,
             CASE WHEN kind = 'namespace' THEN at_path WHEN uses THEN CASE WHEN con OR kind = 'class' THEN coalesce(instance_of, returns) ELSE returns END
                  WHEN kind IN ('class', 'interface') THEN at_path ELSE instance_of END AS base
      FROM (SELECT *, segs[i + 1].call OR segs[i + 1].con AS uses, segs[i + 1].con AS con, CASE WHEN segs[i + 1].call THEN segs[i + 1].args END AS args,
                   CASE WHEN cur = 'type' THEN base || '#' WHEN base = 'lib:' THEN base ELSE base || '.' END || segs[i + 1].name AS path
            FROM walk WHERE NOT done) w LEFT JOIN known n ON n.path = w.path)
    )
)
SELECT k AS o_orderkey, array_to_string(paths, ' ') AS paths, array_to_string(rest, ' ') AS unresolved, missing AS missing_head FROM walk WHERE done""",
    "derived_values": _MADE + r"""
SELECT 'f' || f AS file, name, pkg, place.hops::BIGINT AS hops, cut, CASE WHEN built IS NOT NULL THEN substr(built, 2) END AS built, self AS built_called FROM best WHERE rank = 1""",
    "upgrade_briefs": f"""
        WITH {_RELEASED}, {_PICKED}, cand AS (
          SELECT pkg, i, t, CASE WHEN i[1] <> t[1] OR (i[1] = 0 AND i[2] <> t[2]) THEN 'major' WHEN i[2] <> t[2] THEN 'minor' ELSE 'patch' END AS bump FROM picked WHERE t IS NOT NULL
        ), lines AS (
          SELECT o_custkey AS pkg, [year(o_orderdate) - 1995, month(o_orderdate), day(o_orderdate)] AS k, 'part' || l_partkey % 6 AS part, l_quantity, l_returnflag, l_linenumber, l_orderkey, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        ), symbols AS (
          SELECT pkg, k, part, min(l_quantity::INT) % 4 AS sig, bool_or(l_returnflag = 'R') AS old FROM lines GROUP BY ALL
        ), refs AS (
          SELECT l.pkg, part, l_quantity > 49 AS blind FROM lines l JOIN cand c ON l.pkg = c.pkg WHERE l.k = c.i OR (l.pkg % 3 = 0 AND l_quantity > 25)
        ), used AS (
          SELECT pkg, count_if(NOT blind) AS refs, count_if(blind) AS blind, list_sort(list(DISTINCT part) FILTER (NOT blind)) AS names FROM refs GROUP BY pkg
        ), changes AS (
          SELECT a.pkg, a.part, CASE WHEN b.part IS NULL THEN 'removed' WHEN a.sig <> b.sig THEN 'changed' WHEN NOT a.old AND b.old THEN 'deprecated' END AS bucket
          FROM (SELECT s.*, c.t FROM symbols s JOIN cand c ON s.pkg = c.pkg AND s.k = c.i) a LEFT JOIN symbols b ON a.pkg = b.pkg AND a.t = b.k AND a.part = b.part
        ), hit AS (
          SELECT c.pkg, count(bucket)::BIGINT AS changes, count_if(bucket IS NOT NULL AND list_contains(names, part)) AS touched, count_if(bucket = 'removed' AND list_contains(names, part)) AS removed,
                 count_if(bucket = 'changed' AND list_contains(names, part)) AS changed, count_if(bucket = 'deprecated' AND list_contains(names, part)) AS deprecated
          FROM changes c LEFT JOIN used USING (pkg) GROUP BY c.pkg
        ), unread AS (
          SELECT DISTINCT r.pkg FROM refs r JOIN cand c ON r.pkg = c.pkg LEFT JOIN symbols s ON s.pkg = r.pkg AND s.k = c.i AND s.part = r.part WHERE NOT blind AND s.part IS NULL
        ), said AS (
          SELECT o_custkey AS pkg, [year(o_orderdate) - 1995, month(o_orderdate), day(o_orderdate)] AS k, min(o_orderkey) AS key FROM orders GROUP BY ALL
        ), noted AS (
          SELECT c.pkg, count(s.k) AS n, count_if(key % 5 < 4) AS found, count_if(key % 5 < 3) AS live, count_if(key % 5 = 0 AND coalesce(list_contains(names, 'part' || key % 7), false)) AS matched, count_if(key % 5 = 1) AS unplaced, count_if(key % 5 = 2) AS breaking
          FROM cand c LEFT JOIN used USING (pkg) LEFT JOIN said s ON s.pkg = c.pkg AND s.k > c.i AND s.k <= c.t GROUP BY c.pkg
        ), met AS (
          SELECT c.pkg, i, t, bump, coalesce(refs, 0) AS refs, coalesce(blind, 0) AS blind, coalesce(names, []) AS names, coalesce(changes, 0) AS changes, coalesce(touched, 0) AS touched, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed, coalesce(deprecated, 0) AS deprecated, noted.* EXCLUDE (pkg), u.pkg IS NOT NULL AND coalesce(refs, 0) > 0 AND a.pkg IS NOT NULL AND b.pkg IS NOT NULL AS unread, c_acctbal < -500 AS opaque,
                 coalesce(refs, 0) > 0 AND a.pkg IS NOT NULL AND b.pkg IS NOT NULL AS computed, found = n AS complete
          FROM cand c JOIN customer ON c_custkey = c.pkg LEFT JOIN hit ON hit.pkg = c.pkg LEFT JOIN (SELECT DISTINCT pkg, k FROM symbols) a ON a.pkg = c.pkg AND a.k = c.i LEFT JOIN (SELECT DISTINCT pkg, k FROM symbols) b ON b.pkg = c.pkg AND b.k = c.t JOIN noted ON noted.pkg = c.pkg LEFT JOIN used ON used.pkg = c.pkg LEFT JOIN unread u ON u.pkg = c.pkg
        ), judged AS (
          SELECT *, list_filter([
            CASE WHEN computed AND removed > 0 THEN 'removed-touched' END, CASE WHEN computed AND changed > 0 THEN 'changed-touched' END, CASE WHEN computed AND deprecated > 0 THEN 'deprecated-touched' END,
            CASE WHEN matched > 0 THEN 'notes-match' END, CASE WHEN breaking > 0 THEN 'unattributed-breaking' END, CASE WHEN unplaced > 0 THEN 'unattributed-change' END, CASE WHEN blind > 0 OR unread THEN 'blind-spots' END,
            CASE WHEN opaque THEN 'opaque-usage' END, CASE WHEN refs = 0 AND NOT opaque AND blind = 0 AND NOT unread THEN 'not-referenced' END, CASE WHEN pkg % 11 = 0 THEN 'flagged-install' END, CASE WHEN pkg % 13 = 0 THEN 'out-of-sync' END,
            CASE WHEN NOT complete AND NOT computed THEN 'no-evidence' END,
            CASE WHEN bump = 'major' AND NOT (computed AND complete AND touched + matched + breaking + unplaced = 0) THEN 'major-unproven' END], lambda x: x IS NOT NULL) AS codes
          FROM met
        )
        SELECT 'c' || pkg AS pkg, {_TEXT.format("i")} AS "from", {_TEXT.format("t")} AS "to", bump, CASE WHEN list_contains(codes, 'removed-touched') THEN 'blocked' WHEN len(codes) > 0 THEN 'review' ELSE 'quiet' END AS verdict,
               CASE WHEN len(codes) > 0 THEN array_to_string(codes, ',') ELSE array_to_string(list_filter([CASE WHEN complete THEN 'notes-complete-no-match' END, CASE WHEN computed THEN 'surface-clean' ELSE 'caveat-no-types' END, CASE WHEN NOT complete THEN 'caveat-no-notes' END], lambda x: x IS NOT NULL), ',') END AS reasons,
               CASE WHEN computed THEN changes END AS changes, CASE WHEN computed THEN touched ELSE 0 END AS touched,
               CASE WHEN complete THEN 'complete' WHEN found > 0 THEN 'partial' ELSE 'unavailable' END AS coverage, live AS entries, matched, unplaced, refs AS sites, array_to_string(names, ',') AS names, len(names) AS named_sites
        FROM judged""",
    "touched_uses": _MADE + r"""
, refs AS (
  SELECT o_custkey AS f, l_orderkey AS line, l_linenumber AS col, CASE WHEN l_partkey % 8 < 5 THEN 'v' || l_partkey % 8 WHEN l_partkey % 8 = 5 THEN 'lib' WHEN l_partkey % 8 = 6 THEN 'other' ELSE 'none' END AS local,
         list_filter(['m' || l_suppkey % 3 || CASE WHEN l_quantity < 25 THEN '()' ELSE '' END, CASE WHEN l_suppkey % 2 = 0 THEN 'm' || l_suppkey // 3 % 3 END], lambda x: x IS NOT NULL) AS chain
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), kept AS (
  SELECT f, name, pkg, place.hops AS hops, CASE WHEN built = '' THEN [] WHEN built IS NOT NULL THEN string_split(substr(built, 2), '.') END AS built, self, cut FROM best WHERE rank = 1
), ways AS (
  SELECT f, line, col, 'p' || f % 3 AS pkg, 'direct' AS way, chain AS segs, 0 AS own, false AS lost FROM refs WHERE local = 'lib'
  UNION ALL
  SELECT r.f, line, col, k.pkg, 'derived', CASE WHEN built IS NULL THEN chain ELSE list_concat(built, chain) END, coalesce(len(built), 0), built IS NULL OR self
  FROM refs r JOIN kept k ON k.f = r.f AND k.name = r.local WHERE NOT cut
  UNION ALL
  SELECT r.f, line, col, k.pkg, 'derived', CASE WHEN built IS NULL THEN chain ELSE list_concat(built, chain) END, coalesce(len(built), 0), built IS NULL OR self
  FROM refs r JOIN handed h ON h.f = r.f + 1 AND r.local = 'other' JOIN kept k ON k.f = h.of AND k.name = 'v1' WHERE NOT cut AND k.hops + 1 <= 3
), members AS (
  SELECT 'p' || p_partkey % 3 AS pkg, 'p' || p_partkey % 3 || ':' || CASE WHEN p_partkey // 3 % 4 = 3 THEN '' ELSE 'T' || p_partkey // 3 % 4 || '#' END || 'm' || p_partkey // 12 % 3 AS path, p_partkey // 3 % 4 = 3 AS top,
         min(p_size) AS size, min(p_partkey) AS first FROM part GROUP BY ALL
), changes AS (
  SELECT pkg, path, CASE WHEN first % 5 = 0 THEN 'removed' ELSE 'changed' END AS bucket FROM members WHERE first % 5 = 0 OR first % 2 = 0
), shapes AS (
  SELECT DISTINCT pkg, segs, own, lost FROM ways
), walk AS (
  SELECT *, segs AS whole, 0 AS i, pkg || ':' AS base, []::VARCHAR[] AS paths, CASE WHEN lost THEN list_transform(segs, lambda s: replace(s, '()', '')) ELSE [] END AS rest, lost OR len(segs) = 0 AS done FROM shapes
  UNION ALL
  SELECT pkg, segs, own, lost, whole, i + 1, base, paths, CASE WHEN NOT found THEN list_transform(segs[i + 1:], lambda s: replace(s, '()', '')) WHEN i + 1 < len(segs) AND (base IS NULL OR i + 1 >= 6) THEN list_transform(segs[i + 2:], lambda s: replace(s, '()', '')) ELSE [] END,
         NOT found OR i + 1 >= len(segs) OR base IS NULL OR i + 1 >= 6
  FROM (
    SELECT w.pkg, segs, own, lost, whole, i, m.path IS NOT NULL AS found, CASE WHEN m.path IS NOT NULL AND i >= own THEN list_append(paths, m.path) ELSE paths END AS paths,
           CASE WHEN ends_with(segs[i + 1], '()') THEN m.pkg || ':T' || m.size % 4 END AS base
    FROM walk w LEFT JOIN members m ON m.pkg = w.pkg AND m.path = CASE WHEN ends_with(base, ':') THEN base ELSE base || '#' END || replace(segs[i + 1], '()', '')
    WHERE NOT done
  )
), reached AS (
  SELECT w.f, w.line, w.col, w.pkg, w.way, s.paths, s.rest FROM ways w JOIN walk s ON s.done AND s.pkg = w.pkg AND s.whole = w.segs AND s.own = w.own AND s.lost = w.lost
), strong AS (
  SELECT DISTINCT f, line, col, r.pkg, c.path, bucket, way FROM (SELECT *, unnest(paths) AS ref FROM reached) r JOIN changes c ON c.pkg = r.pkg AND c.path = r.ref
), weak AS (
  SELECT DISTINCT f, line, col, r.pkg, c.path, bucket, way FROM (SELECT *, unnest(rest) AS name FROM reached) r JOIN changes c ON c.pkg = r.pkg AND contains(c.path, '#') AND split_part(c.path, '#', 2) = r.name
  WHERE (c.pkg, c.path) NOT IN (SELECT (pkg, path) FROM strong)
)
SELECT 'f' || f AS file, line, col, pkg, path, bucket, 'strong' AS strength, way FROM strong UNION ALL SELECT 'f' || f, line, col, pkg, path, bucket, 'weak', way FROM weak
""",
    "branch_split": """
        WITH c AS (SELECT conv_id AS id, turn AS pos, role = 'user' AS bot, coalesce(length(text) % 7 = 0, false) AS merge FROM conversations),
        f AS (SELECT id, min(pos) FILTER (NOT bot AND NOT merge) AS first, arg_min(bot, pos) AS begun FROM c GROUP BY id),
        t AS (SELECT id, begun, first, max(pos) FILTER (pos < first) AS upgraded, coalesce(bool_or(merge AND pos < first), false) AS merged, min(pos) FILTER (merge AND pos > first) AS stop FROM c JOIN f USING (id) GROUP BY ALL),
        e AS (SELECT id, max(pos) AS fix_to, count(*) AS fixes FROM c JOIN t USING (id) WHERE NOT bot AND NOT merge AND (stop IS NULL OR pos < stop) GROUP BY id),
        r AS (SELECT *, CASE WHEN first IS NULL THEN 'no human commit' WHEN upgraded IS NULL OR NOT begun THEN 'first commit is not by a bot' WHEN merged THEN 'merge commit before the fix' END AS reason FROM t LEFT JOIN e USING (id))
        SELECT id, reason, CASE WHEN reason IS NULL THEN upgraded END AS upgraded, CASE WHEN reason IS NULL THEN first END AS fix_from, CASE WHEN reason IS NULL THEN fix_to END AS fix_to, CASE WHEN reason IS NULL THEN fixes END AS fixes FROM r""",
    "tag_lookups": f"""
        WITH {_RELEASED}, r AS (SELECT 'c' || pkg AS pkg, k, array_to_string(k, '.') AS version, k[2] AS m FROM released),
        o AS (SELECT *, pkg IN (SELECT pkg FROM r WHERE m <= 2) AS learned FROM r WHERE m > 2),
        a AS (SELECT *, CASE WHEN learned OR m % 3 = 0 OR m = 10 THEN ['v' || version] ELSE ['v' || version, version, pkg || '@' || version] END AS asked FROM o),
        b AS (SELECT *, coalesce(sum(len(asked)) OVER (PARTITION BY pkg ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS skipped FROM a)
        SELECT pkg, version, CASE WHEN skipped THEN '' ELSE array_to_string(asked, ',') END AS asked, CASE WHEN skipped OR m = 10 THEN NULL WHEN m % 3 = 0 THEN 'v' || version WHEN m = 5 AND NOT learned THEN pkg || '@' || version END AS tag,
               CASE WHEN m = 10 AND NOT skipped THEN 'rate-limited' END AS failure, skipped FROM b""",
    "path_aliases": """
        SELECT 'n' || n_nationkey || '/c' || c_custkey || '.ts' AS file, '@/c' || c_custkey AS specifier,
               CASE WHEN n_nationkey % 2 = 1 THEN 'n' || n_nationkey || '/own/c' || c_custkey || '.tsx' WHEN c_custkey % 3 = 0 THEN 'r' || n_regionkey || '/lib/c' || c_custkey || '.js' ELSE 'r' || n_regionkey || '/gen/c' || c_custkey || '/index.ts' END AS target
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE CASE WHEN n_nationkey % 2 = 1 THEN c_custkey % 5 = 0 ELSE c_custkey % 3 <= 1 END""",
    "settings_uses": """
        WITH used AS (
          SELECT 'p' || s_suppkey % 97 AS pkg, 'css-import' AS kind, 's' || s_suppkey || '.css' AS path, 1 AS line FROM supplier UNION SELECT 'p' || s_suppkey % 89, 'css-import', 's' || s_suppkey || '.css', 3 FROM supplier
          UNION ALL SELECT pkg, kind, path, min(line) FROM (SELECT 'p' || c_custkey % 83 AS pkg, 'config-reference' AS kind, 'c' || c_custkey || '/.toolrc' AS path, 2 AS line FROM customer UNION ALL SELECT 'p' || c_custkey % 79, 'config-reference', 'c' || c_custkey || '/.toolrc', 3 FROM customer) GROUP BY ALL
        ) SELECT pkg, kind, path, line::INT AS line FROM used WHERE pkg IN (SELECT 'p' || p_partkey FROM part)""",
    "tied_removals": """
        WITH RECURSIVE marked AS (
          SELECT n_nationkey AS n, n_nationkey AS at_n, 0 AS hop FROM nation UNION ALL SELECT n, (at_n + 2) % 25, hop + 1 FROM marked WHERE at_n % 5 = 1 AND at_n % 3 <> 0 AND hop < 5
        ), old AS (SELECT DISTINCT n FROM marked WHERE at_n % 3 = 0)
        SELECT 'lib:n' || n_nationkey AS path, n_nationkey % 2 = 0 AS namespace, n_nationkey IN (SELECT n FROM old) AS was_deprecated FROM nation
        UNION ALL SELECT 'lib:n' || c_nationkey || '.c' || c_custkey, false, c_nationkey IN (SELECT n FROM old) FROM customer""",
    "adapting_commits": """
        WITH near AS (
          SELECT a.event_id AS id, b.event_id AS next_id, b.event_type, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS rank
          FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id <> a.event_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 14 DAY WHERE a.event_type = 'signup'
        ) SELECT id, next_id, rank FROM near WHERE rank <= 10 AND next_id % 3 > 0 AND (next_id % 5 = 0 OR event_type = 'purchase')""",
}
