"""DuckDB SQL for the registered queries that SQL can express, written apart from the Spark code.

The others have none: XXH64 of UTF-8 text with a seed, tokenizers and trained models are not in
SQL, and grouping all 400-byte strings is too slow there.  Tests hold them against brute force.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REST = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) END"
_HOST = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_QUERY = f"regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1)"
_KEPT = f"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&')"
_ADDRESS = (
    f"regexp_replace(regexp_replace({_HOST}, ':(80|443)$', ''), '^www\\.', '') || regexp_replace({_PATH}, '/+$', '')"
    f" || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"
)
_CANONICAL = """regexp_extract_all(html, '(?is)(<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>)', 1)"""
_REFRESH = """regexp_extract_all(html, '(?is)(<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>)', 1)"""
_HREF = """'(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)'"""
_URL = """'(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)'"""
_SITE = "regexp_extract(url, '^(.*?://[^/?#]*)', 1)"
_WITHOUT_DOTS = "array_to_string(list_reduce(list_transform(string_split({0}, '/'), lambda x: [x]), lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, b) END), '/')"
_FOLDER = f"coalesce(nullif(regexp_extract({_PATH.format('url')}, '^(.*/)', 1), ''), '/')"
_TO_PATH, _TO_QUERY = "regexp_extract(target, '^([^?#]*)', 1)", "regexp_extract(target, '^[^?#]*(\\?[^#]*)', 1)"


def _rounds(n: int) -> str:
    """CTEs c1 ... cn: the centroids after each round, from those before."""
    return ",\n".join(
        f"""a{r} AS MATERIALIZED (SELECT v.n, v.x, (SELECT arg_min(c.cluster, {{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.cluster}}) FROM c{r - 1} c) AS cluster FROM v),
m{r} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
c{r} AS MATERIALIZED (SELECT c.cluster, coalesce(moved.x, c.x) AS x FROM c{r - 1} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY cluster) moved ON moved.cluster = c.cluster)"""
        for r in range(1, n + 1)
    )


_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 2 * octet_length(encode({0})) + 1, 2), lambda i: CAST('0x' || substr(hex(encode({0})), i, 2) AS BIGINT))),"
    " lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
)


def _cheapest(*ways: tuple[str, str]) -> str:
    """The least (cost, audit) of those whose condition holds."""
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {{'c': {way}}} END" for when, way in ways) + "], lambda w: w IS NOT NULL))[1]"


def _over_row(state: str, asked: str, keeps: dict[str, str]) -> str:
    """The best from ``state`` that does not begin with an insert; cS, aS ... are known after the row."""
    ways = [("true", f"3 + w.{state}.c, 'a': 'D' || w.{state}.a"), ("NOT r.gone", f"2 + r.cut + w.{asked}.c, 'a': 'R' || w.{asked}.a")]
    return _cheapest(*ways, *((f"NOT r.gone AND r.initial = '{role}'", f"r.cut + w.{to}.c, 'a': 'K' || w.{to}.a") for role, to in keeps.items()))


_WITH_INSERTS = {
    state: _cheapest(("true", f"{state}.c, 'a': {state}.a"), *(("true", f"{2 * len(marks)} + {to}.c, 'a': '{marks}' || {to}.a") for marks, to in ways))
    for state, ways in {"b": (("I", "u"), ("II", "p")), "s": (("I", "u"), ("II", "p")), "u": (("I", "p"),), "p": (("I", "u"),)}.items()
}  # b before anything, s after a system row, u after a user's, p after an assistant's

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN links ON r = a),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON vec_id = id LEFT JOIN degree ON vec_id = a""",
    "op4_url_filter": f"""WITH RECURSIVE
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, rhost, rpath)),
found AS (SELECT url, list_filter(list_transform({_CANONICAL}, lambda t: regexp_extract(t, {_HREF}, 1)), lambda v: v <> '')[1] AS target FROM pages WHERE strpos(url, '://') > 0
  UNION ALL SELECT url, list_filter(list_transform({_REFRESH}, lambda t: regexp_extract(t, {_URL}, 1)), lambda v: v <> '')[1] FROM pages WHERE strpos(url, '://') > 0),
links AS (SELECT url, CASE WHEN strpos(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || target
  WHEN starts_with(target, '/') THEN {_SITE} || {_WITHOUT_DOTS.format(_TO_PATH)} || {_TO_QUERY}
  WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(target, '#') THEN NULL
  WHEN starts_with(target, '?') THEN {_SITE} || {_PATH.format("url")} || {_TO_QUERY}
  ELSE {_SITE} || {_WITHOUT_DOTS.format(_FOLDER + " || " + _TO_PATH)} || {_TO_QUERY} END AS target FROM found WHERE target IS NOT NULL),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM links WHERE target IS NOT NULL) WHERE strpos(url, '://') > 0),
parts AS (SELECT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_ADDRESS.format("url")} AS address FROM urls),
ruled AS (SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
edges AS (SELECT x.address AS a, y.address AS b FROM links JOIN parts x ON links.url = x.url JOIN parts y ON links.target = y.url WHERE x.address <> y.address),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
blocked(address) AS (SELECT address FROM parts JOIN ruled USING (url) WHERE verdict = 'block' UNION SELECT b FROM blocked JOIN both_ways ON address = a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN ruled.verdict IS NOT NULL THEN ruled.verdict WHEN blocked.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  ruled.verdict IS NULL AND blocked.address IS NOT NULL AS by_alias
FROM pages LEFT JOIN parts USING (url) LEFT JOIN ruled USING (url) LEFT JOIN blocked ON parts.address = blocked.address""",
    "op12_clustering": f"""WITH
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM v ORDER BY h, x LIMIT 8)),
{_rounds(11)},
placed AS (SELECT vec_id, a11.cluster, list_sum(list_transform(list_zip(a11.x, c10.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance, array_to_string(c10.x, ',') AS centroid
  FROM v JOIN a11 ON v.n = a11.n JOIN c10 ON a11.cluster = c10.cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(centroid) AS centroid_sha256 FROM placed""",
    "op13_conversation_repair": f"""WITH RECURSIVE
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
marked AS (SELECT *, {_CRC.format("name")} % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), role, text) AS i FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS unfinished, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
lines AS MATERIALIZED (SELECT conv_id, i, turn, role, text, initial, before, blank, again AND NOT blank AS duplicate, unfinished AND NOT again AND NOT blank AS truncated, blank OR again AS gone,
  CAST(unfinished AS INTEGER) AS cut, count(*) OVER (PARTITION BY conv_id) AS n FROM judged),
best(conv_id, i, b, s, u, p) AS (
  SELECT DISTINCT conv_id, n + 1, {{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM lines
  UNION ALL SELECT conv_id, i, {_WITH_INSERTS["b"]}, {_WITH_INSERTS["s"]}, {_WITH_INSERTS["u"]}, {_WITH_INSERTS["p"]}
  FROM (SELECT r.conv_id, r.i, {_over_row("b", "u", {"s": "s", "u": "u"})} AS b, {_over_row("s", "u", {"u": "u"})} AS s, {_over_row("u", "p", {"a": "p"})} AS u, {_over_row("p", "u", {"u": "u"})} AS p
    FROM best w JOIN lines r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i - 1)),
chosen AS (SELECT conv_id, b.c AS cost, b.a AS audit FROM best WHERE i = 1),
letters AS (SELECT conv_id, pos, substr(audit, pos, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM chosen)),
counted AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
put AS (SELECT c.conv_id, c.k, c.letter, r.role, CASE WHEN c.letter = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN k = 1 AND letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS lead
  FROM counted c LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i WHERE c.letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM put GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
  count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN chosen ON o.conv_id IS NOT DISTINCT FROM chosen.conv_id
  LEFT JOIN repaired ON o.conv_id IS NOT DISTINCT FROM repaired.conv_id""",
}
