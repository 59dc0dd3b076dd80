"""The same queries in DuckDB's SQL, over views named like the tables. Queries without an entry are beyond it:
order-dependent assignment, layouts, lookaround patterns."""

from __future__ import annotations

from storyloom import fixed
from storyloom.functions.hashing import BANDS, PERMUTATIONS, PRIME, coefficients


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WS = r"[ \t\n\r\f]+"
COLLAPSE = "trim(regexp_replace({}, '" + _WS + "', ' ', 'g'))"

ARTICLES = f"""a0 AS (SELECT doc_id AS id, source AS source_id, lang, {COLLAPSE.format("coalesce(text, '')")} AS body FROM documents),
articles AS (SELECT id, source_id, lang, body, TIMESTAMP '2024-01-01' + to_minutes(id * 7) AS discovered_at,
  left(body, 160) AS title, left(body, 1000) AS lede, sha256(body) AS content_hash,
  CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS word_count,
  CASE WHEN id % 3 = 0 THEN 'feed' ELSE 'page' END AS content_origin,
  CASE WHEN id % 4 = 0 THEN id * 37 % 500 END AS hn_points, CASE WHEN id % 4 = 0 THEN id * 13 % 90 END AS hn_comments,
  CASE WHEN id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(id * 7) - to_hours(id % 49) END AS published_at,
  min(id) OVER (PARTITION BY sha256(body)) AS story_id FROM a0)"""
SOURCES = """s0 AS (SELECT DISTINCT source AS source_id, coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) AS n FROM documents WHERE source IS NOT NULL),
sources AS (SELECT source_id, 0.5::DOUBLE + 0.02::DOUBLE * (n % 20) AS authority_prior, (['primary', 'press', 'independent', 'community'])[n % 4 + 1] AS category, n % 10 <> 9 AS enabled, n FROM s0)"""
NOW = "now_ AS (SELECT TIMESTAMP '2024-01-01' + to_minutes(max(doc_id) * 7) AS t FROM documents)"
FEATURES = f"""{ARTICLES}, {SOURCES}, {NOW},
f0 AS (SELECT story_id, count(*) AS article_count, count(DISTINCT source_id) AS source_count, max(authority_prior) AS max_authority, avg(authority_prior) AS mean_authority,
  coalesce(max(hn_points), 0) AS hn_points_max, coalesce(max(hn_comments), 0) AS hn_comments_max, min(coalesce(published_at, discovered_at)) AS ep, min(discovered_at) AS fs,
  avg(CASE WHEN content_origin = 'feed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS feed_share, max(word_count) AS words_max, max(coalesce(published_at, discovered_at)) AS latest
  FROM articles JOIN sources USING (source_id) GROUP BY 1),
features AS (SELECT f0.*, greatest(epoch_us(t) - epoch_us(ep), 0) / 3.6e9 AS hours_since_published, greatest(epoch_us(t) - epoch_us(fs), 0) / 3.6e9 AS hours_since_first_seen FROM f0, now_),
scored AS (SELECT *, 1.2::DOUBLE * ln(1 + source_count) AS coverage, max_authority AS authority, 0.35::DOUBLE * ln(1 + hn_points_max) AS community, pow(0.5, hours_since_published / 18) AS freshness,
  (1.2::DOUBLE * ln(1 + source_count) + max_authority + 0.35::DOUBLE * ln(1 + hn_points_max)) * pow(0.5, hours_since_published / 18) AS score FROM features)"""
SUMMARY = f"""{ARTICLES}, {SOURCES},
m AS (SELECT a.*, authority_prior, row_number() OVER (PARTITION BY story_id ORDER BY authority_prior DESC, discovered_at, id) AS r FROM articles a JOIN sources USING (source_id)),
lead AS (SELECT story_id, id, source_id, title FROM m WHERE r = 1),
summary AS (SELECT m.story_id, count(*) AS article_count, count(DISTINCT m.source_id) AS source_count, any_value(l.id) AS representative_id, any_value(l.title) AS title, any_value(l.source_id) AS lead_source,
  any_value(l.source_id) || coalesce('|' || string_agg(DISTINCT m.source_id, '|' ORDER BY m.source_id) FILTER (m.source_id <> l.source_id), '') AS sources,
  min(m.discovered_at) AS first_seen_at, min(m.published_at) AS published_at FROM m JOIN lead l USING (story_id) GROUP BY 1)"""
POOL = f"""{FEATURES}, pool AS (SELECT story_id, latest FROM features, now_ WHERE latest >= t - INTERVAL 72 HOUR ORDER BY latest DESC, story_id LIMIT 500),
{SUMMARY.split(SOURCES + ",", 1)[1]},
pf0 AS (SELECT s.*, lead_source, title FROM scored s JOIN pool USING (story_id) JOIN summary USING (story_id)),
feed AS (SELECT *, row_number() OVER (ORDER BY score DESC, story_id) AS rank FROM pf0)"""
DISCUSSIONS = f"""d0 AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
discussions AS (SELECT conv_id * 100 + turn AS id, conv_id AS thread_id, turn, turn > 0 AS is_comment, {COLLAPSE.format("text")} AS body,
  (['hn', 'github', 'lobsters', 'stackexchange'])[conv_id % 4 + 1] AS platform, 'forum' || (conv_id % 9) AS source_id,
  CASE WHEN (conv_id + turn) % 13 <> 0 THEN role || '-' || (conv_id % 37) END AS author_hash,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 11 + turn) AS observed_at, (conv_id * 31 + turn) % 60 - 5 AS points, last - turn AS comments, CASE WHEN turn = 0 THEN conv_id % 8 END AS reactions,
  ((conv_id * 7 + turn * 13) % 100) / 100.0::DOUBLE AS p_problem,
  (['bug_or_reliability', 'cost_or_performance', 'missing_capability', 'workflow_friction'])[(conv_id + turn) % 4 + 1] AS category,
  CASE WHEN (conv_id * 7 + turn * 13) % 100 >= 50 THEN conv_id // 5 END AS problem_id FROM d0)"""
PROBLEMS = f"""{DISCUSSIONS}, pm AS (SELECT *, coalesce(author_hash, id::VARCHAR) AS voice, greatest(points, 0) + coalesce(comments, 0) + coalesce(reactions, 0) AS eng FROM discussions WHERE problem_id IS NOT NULL),
pv AS (SELECT problem_id, count(*) AS voice_count, sum(p) AS effective_voices FROM (SELECT problem_id, voice, max(p_problem) AS p FROM pm GROUP BY 1, 2) GROUP BY 1),
pc AS (SELECT problem_id, category FROM (SELECT problem_id, category, row_number() OVER (PARTITION BY problem_id ORDER BY round(sum(p_problem), 9) DESC, category) AS r FROM pm GROUP BY 1, 2) WHERE r = 1),
pr AS (SELECT problem_id, id AS representative_id, left(body, 160) AS statement FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY p_problem DESC, eng DESC, observed_at, id) AS r FROM pm) WHERE r = 1),
pa AS (SELECT problem_id, count(*) AS member_count, count(DISTINCT source_id) AS source_count, count(DISTINCT platform) AS platform_count, sum(eng)::BIGINT AS engagement, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at FROM pm GROUP BY 1),
problems AS (SELECT * FROM pa JOIN pv USING (problem_id) JOIN pc USING (problem_id) JOIN pr USING (problem_id)),
pnow AS (SELECT max(observed_at) AS t FROM discussions),
factors AS (SELECT p.*, ln(1 + greatest(effective_voices, 0)) AS f_voices, 1 + 0.5::DOUBLE * ln(1 + greatest(source_count, 0)) AS f_sources,
  pow(0.5, greatest(epoch_us(t) - epoch_us(last_seen_at), 0) / 8.64e10 / 30) AS f_recency, 1 + 0.2::DOUBLE * ln(1 + greatest(engagement, 0)) AS f_engagement,
  CASE category {" ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in fixed.CATEGORY_WEIGHTS.items())} ELSE {fixed.OTHER_CATEGORY}::DOUBLE END AS f_category FROM problems p, pnow),
demand AS (SELECT *, f_voices * f_sources * f_recency * f_engagement * f_category AS demand, f_voices * f_sources * f_engagement * f_category AS stored FROM factors),
listed AS (SELECT *, row_number() OVER (ORDER BY round(demand, 6) DESC, problem_id) AS rank FROM (SELECT d.* FROM demand d, pnow WHERE last_seen_at >= t - INTERVAL 30 DAY AND voice_count >= 2 ORDER BY round(stored, 6) DESC, problem_id LIMIT 500) QUALIFY rank <= 50)"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(replace({x}, '’', '''')), {literal(fixed.TOKEN)})"


def kept(array: str, words: list[str], longer: int = 1) -> str:
    return f"list_filter({array}, lambda t: length(t) > {longer} AND NOT list_contains({quoted(words)}, t))"


CONTENT = lambda x: kept(tokens(x), fixed.STOPWORDS)
SHINGLES = "list_distinct(CASE WHEN len(c) < 3 THEN c ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2]) END)"
SIGNED = f"""{ARTICLES}, og AS (SELECT id, body, discovered_at FROM articles QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY discovered_at, id) = 1),
sh AS (SELECT id, unnest({SHINGLES}) AS s FROM (SELECT id, {CONTENT("body")} AS c FROM og)),
hx AS (SELECT id, ('0x' || left(md5(s), 8))::BIGINT % {PRIME} AS x FROM sh),
sg AS (SELECT id, [{", ".join(f"min((x * {a} + {b}) % {PRIME})" for a, b in coefficients())}] AS sig FROM hx GROUP BY id),
bd AS (SELECT id, sig, [{", ".join("md5('" + str(b) + ",' || array_to_string(sig[" + str(b * (PERMUTATIONS // BANDS) + 1) + ":" + str((b + 1) * (PERMUTATIONS // BANDS)) + "], ','))" for b in range(BANDS))}] AS bands FROM sg)"""
PAIRS = f"""{SIGNED}, be AS (SELECT id, discovered_at, unnest(bands) AS band FROM bd JOIN og USING (id)),
p0 AS (SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM be a JOIN be b ON a.band = b.band AND a.id <> b.id AND a.discovered_at >= b.discovered_at - INTERVAL 72 HOUR AND a.discovered_at <= b.discovered_at),
pairs AS (SELECT a, b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {PERMUTATIONS}::DOUBLE AS jaccard FROM p0 JOIN bd x ON x.id = a JOIN bd y ON y.id = b)"""


def index(docs: str) -> str:
    """Postings of a CTE with id, title and body."""
    return f"""tk AS (SELECT id, list_concat({CONTENT("title")}, {CONTENT("title")}, {CONTENT("body")}) AS terms FROM {docs}),
cs AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM tk),
po AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(terms) AS length, unnest(terms) AS term FROM tk) GROUP BY ALL),
qt AS (SELECT qid, len(terms) AS n_terms, unnest(terms) AS term FROM (SELECT qid, list_distinct({CONTENT("text")}) AS terms FROM qs)),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT qid, id, n_terms, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score, count(*) AS matched
  FROM po JOIN dfs USING (term) JOIN qt USING (term), cs GROUP BY 1, 2, 3)"""


QUERIES = "qs AS (SELECT item_id AS qid, coalesce(text, '') AS text FROM benchmark)"
LEXICAL = f"{ARTICLES}, {QUERIES}, {index('articles')}, lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 200)"
DENSE = """kn AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM kn QUALIFY rank <= 20)"""
FUSED = f"""{LEXICAL}, {DENSE}, ls AS (SELECT qid, id, rank, 0 AS l FROM lex UNION ALL SELECT qid // 100, id, rank, 1 FROM dense),
fu AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (l = 0) AS rank_0, min(rank) FILTER (l = 1) AS rank_1 FROM ls GROUP BY 1, 2),
fs0 AS (SELECT f.*, story_id FROM fu f JOIN articles USING (id) QUALIFY row_number() OVER (PARTITION BY qid, story_id ORDER BY score DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, id) = 1),
fst AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, story_id) AS rank FROM fs0 QUALIFY rank <= 50)"""
GRADED = "g AS (SELECT doc_id, quality AS gold, ((doc_id * 37 + quality * 29) % 101) / 100.0::DOUBLE AS score, doc_id % 5 AS stratum FROM labels)"


SIM = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6)"


def wilson(k: str, n: str) -> str:
    half = f"1.96::DOUBLE * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n}))"
    mid, den = f"({k} / {n} + 3.8416::DOUBLE / (2 * {n}))", f"(1 + 3.8416::DOUBLE / {n})"
    return f"round(({mid} - {half}) / {den}, 6) AS low, round(({mid} + {half}) / {den}, 6) AS high"


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_BARE = f"regexp_replace(title, {literal(fixed.TEMPLATE_PREFIX)}, ' ', 'g')"
_CUE = {g: f"len(regexp_extract_all(body, {literal('(?i)' + p)}))" for g, p in fixed.CUES.items()}
_RULE = " ".join(f"WHEN {_CUE[g]} > 0 THEN '{label}'" for g, label in zip(("bug", "cost_perf", "missing", "friction", "how_to"), fixed.LABELS))
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1)), ':\d*$', ''), '\.+$', ''), '^((www|amp)\.)+', '')"
_PROF = {
    "de": "der die und den das von mit ist nicht ein", "en": "the of and to in is that for was on",
    "es": "de la que el en los del las por con", "fr": "le la les des et une est du dans pour",
}
_DETECT = ", ".join(f"{{'n': len(list_filter(w, lambda x: list_contains({quoted(p.split())}, x))), 'lang': '{k}'}}" for k, p in _PROF.items())
_MAPW = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(title), {literal(fixed.MAP_WORD)}), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')), lambda t: length(t) > 2 AND NOT list_contains({quoted(fixed.MAP_STOPWORDS)}, t)))"


_UNTAGGED = "replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_ENTITIES = {"article-fr": "(?i)#(une|des)$", "negation": "(?i)#(nicht ein|nicht|not)$", "opening-de": "#(Der|Die|Das)$", "past": "(?i)#(that was|was)$"}
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(body, {literal(p.replace('#', '(^|[^A-Za-z0-9])').replace('$', '([^A-Za-z0-9]|$)'))}) THEN '{k}' END" for k, p in _ENTITIES.items()) + "], lambda x: x IS NOT NULL)"
FULL = FUSED.replace("QUALIFY rank <= 20)", "QUALIFY rank <= 200)")
HEADLINED = f"""{DISCUSSIONS}, h0 AS (SELECT id, thread_id, observed_at, p_problem, author_hash, CASE WHEN is_comment THEN left(body, 160) ELSE 'thread ' || thread_id END AS title FROM discussions),
hd AS (SELECT h0.*, list_sort(list_distinct({kept(tokens(_BARE), fixed.STOPWORDS + fixed.BOILERPLATE)})) AS t, embedding::DOUBLE[] AS v FROM h0 LEFT JOIN embeddings ON vec_id = thread_id)"""
ASSIGNED = f"""{HEADLINED}, k0 AS (SELECT * REPLACE (CASE WHEN id % 17 <> 0 THEN p_problem END AS p_problem), CASE WHEN thread_id % 10 = 0 THEN -thread_id - 1 END AS existing FROM hd),
k1 AS (SELECT *, lag(id) OVER w AS c_id, lag(observed_at) OVER w AS c_at, lag(t) OVER w AS c_t, lag(v) OVER w AS c_v, lag(author_hash) OVER w AS c_author FROM k0 WHERE p_problem >= 0.5 AND existing IS NULL WINDOW w AS (PARTITION BY thread_id ORDER BY observed_at, id)),
k2 AS (SELECT *, CASE WHEN c_id IS NOT NULL THEN 1 / (1 + exp(-greatest(-50, least(50, -0.8::DOUBLE + 25 * (coalesce(round(list_dot_product(v, c_v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c_v, c_v))), 9), -1) - 0.84::DOUBLE)
  + 4 * CASE WHEN len(t) = 0 OR len(c_t) = 0 THEN 0.0 ELSE len(list_intersect(t, c_t)) / len(list_distinct(list_concat(t, c_t)))::DOUBLE END - 0.02::DOUBLE / 24 * (epoch_us(observed_at) - epoch_us(c_at)) / 3.6e9 - CASE WHEN author_hash = c_author THEN 2 ELSE 0 END)))) END AS probability FROM k1),
k3 AS (SELECT *, last_value(CASE WHEN coalesce(probability >= 0.6, false) THEN NULL ELSE id END IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY observed_at, id ROWS UNBOUNDED PRECEDING) AS own FROM k2),
assigned AS (SELECT k0.id, k0.p_problem, probability, CASE WHEN k0.p_problem IS NULL THEN 'unclassified' WHEN k0.p_problem < 0.5 THEN 'not_problem' WHEN k0.existing IS NOT NULL THEN 'kept' WHEN coalesce(probability >= 0.6, false) THEN 'joined' ELSE 'created' END AS decision,
  CASE WHEN k0.p_problem >= 0.5 THEN coalesce(k0.existing, own) END AS problem_id FROM k0 LEFT JOIN k3 USING (id))"""


def with_(cte: str, select: str) -> str:
    """A select that begins with a comma brings CTEs of its own."""
    return f"WITH {cte}{select}" if select.startswith(",") else f"WITH {cte} {select}"


ALL: dict[str, str] = {
    "tokens_shingles": with_(f"{ARTICLES}, t AS (SELECT id, {tokens('body')} AS t FROM articles), c AS (SELECT id, len(t) AS n_tokens, {kept('t', fixed.STOPWORDS)} AS c FROM t), s AS (SELECT *, {SHINGLES} AS s FROM c)",
        "SELECT id, n_tokens::INT AS n_tokens, len(c)::INT AS n_content, len(s)::INT AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM s"),
    "headline_tokens": with_(ARTICLES, f"SELECT id, array_to_string(list_sort(list_distinct({kept(tokens(_BARE), fixed.STOPWORDS + fixed.BOILERPLATE)})), '|') AS tokens FROM articles"),
    "cue_counts": with_(DISCUSSIONS, f"SELECT id, {', '.join(f'{x}::INT AS {g}' for g, x in _CUE.items())} FROM discussions"),
    "rule_label": with_(DISCUSSIONS, f"SELECT id, CASE WHEN {_CUE['praise_or_chat']} > 0 AND {_CUE['bug']} = 0 AND {_CUE['missing']} = 0 THEN 'not_a_problem' {_RULE} ELSE 'not_a_problem' END AS label FROM discussions"),
    "excerpts": with_(ARTICLES, "SELECT id, CASE WHEN length(body) <= 280 THEN body ELSE regexp_replace(left(body, 279), ' [^ ]*$', '') || '…' END AS excerpt FROM articles"),
    "language": f"""WITH x AS (SELECT doc_id, lang, coalesce(text, '') AS text, string_split(lower({COLLAPSE.format("coalesce(text, '')")}), ' ') AS w FROM documents),
y AS (SELECT *, list_reverse(list_sort([{_DETECT}]))[1] AS best FROM x)
SELECT doc_id, CASE WHEN length(text) >= 60 AND best.n > 0 THEN best.lang ELSE coalesce(CASE WHEN regexp_matches(lang, '^[a-zA-Z]{{2,3}}$') THEN lower(lang) END, 'und') END AS detected FROM y""",
    "url_canonical": rf"""WITH u AS (SELECT page_id, {_HOST} AS host, regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '(/amp|/)+$', '') AS path, regexp_extract(trim(url), '\?([^#]*)', 1) AS q FROM pages),
v AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END),
  lambda p: NOT starts_with(lower(p), 'utm_') AND NOT list_contains({quoted(fixed.TRACKING)}, lower(string_split(p, '=')[1])))) AS ps FROM u),
w AS (SELECT page_id, host, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(ps, '&') END AS canonical_url FROM v)
SELECT page_id, canonical_url, sha256(canonical_url) AS article_id, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site FROM w""",
    "author_hashes": with_(DISCUSSIONS, "SELECT id, CASE WHEN author_hash IS NOT NULL THEN sha256('salt|' || platform || '|' || lower(trim(author_hash))) END AS author, sha256('extracted|' || id || '|' || sha256(body)) AS key FROM discussions"),
    "idempotency_dedup": "WITH e AS (SELECT *, sha256(event_type || '|' || user_id || '|' || coalesce(json_extract_string(props, '$.k'), '')) AS key FROM events) SELECT key, event_id, user_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1",
    "upsert_latest": "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1",
    "envelope_errors": with_(ARTICLES, """, x AS (SELECT id, list_filter([CASE WHEN NOT regexp_matches(coalesce(lang, ''), '^[a-z]{2,3}$') THEN 'lang' END, CASE WHEN length(lede) > 1000 THEN 'lede' END,
  CASE WHEN published_at IS NULL THEN 'published_at' END, CASE WHEN length(title) NOT BETWEEN 1 AND 500 THEN 'title' END, CASE WHEN word_count < 20 THEN 'word_count' END], lambda e: e IS NOT NULL) AS e FROM articles)
SELECT id, array_to_string(e, '|') AS errors FROM x WHERE len(e) > 0"""),
    "registry_sync": with_(SOURCES, """, c AS (SELECT source_id AS id, authority_prior, category, enabled, n FROM sources),
w AS (SELECT id, authority_prior, upper(category) AS category FROM c WHERE n % 5 <> 0 UNION ALL SELECT id || '-new', authority_prior, category FROM c WHERE n % 7 = 0)
SELECT coalesce(w.id, c.id) AS id, round(CASE WHEN w.id IS NOT NULL THEN w.authority_prior ELSE c.authority_prior END, 6) AS authority_prior, CASE WHEN w.id IS NOT NULL THEN w.category ELSE c.category END AS category, w.id IS NOT NULL AS enabled
FROM c FULL JOIN w ON c.id = w.id"""),
    "registry_problems": with_(SOURCES, """, b AS (SELECT CASE WHEN n % 6 = 0 THEN upper(source_id) ELSE source_id END AS id, n, authority_prior + CASE WHEN n % 7 = 0 THEN 0.9::DOUBLE ELSE 0 END AS p FROM sources),
x AS (SELECT id, list_filter([CASE WHEN p > 1 THEN 'authority_prior' END, CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9-]{0,63}$') THEN 'id' END, CASE WHEN n % 4 = 0 THEN 'kind' END, CASE WHEN n % 5 = 0 THEN 'url' END], lambda e: e IS NOT NULL) AS e FROM b)
SELECT id, array_to_string(e, '|') AS errors FROM x WHERE len(e) > 0"""),
    "mature_items": with_(DISCUSSIONS, ", n AS (SELECT max(observed_at) AS t FROM discussions) SELECT id, platform FROM discussions, n WHERE turn = 0 AND observed_at > t - INTERVAL 48 HOUR AND observed_at < t - INTERVAL 2 HOUR"),
    "thread_comments_top": with_(f"RECURSIVE {DISCUSSIONS}, c AS (SELECT thread_id, id, CASE WHEN turn > 0 THEN thread_id * 100 + (turn - 1) // 2 END AS parent_id, points FROM discussions), up AS (SELECT id AS node, id AS \"at\", parent_id, thread_id FROM c WHERE parent_id IS NOT NULL UNION ALL SELECT u.node, c.id, c.parent_id, u.thread_id FROM up u JOIN c ON c.id = u.parent_id WHERE c.parent_id IS NOT NULL), b AS (SELECT thread_id, \"at\" AS id, count(*) - 1 AS replies FROM up GROUP BY 1, 2)",
        "SELECT b.thread_id, b.id, replies, row_number() OVER (PARTITION BY b.thread_id ORDER BY replies DESC, b.id) AS place FROM b JOIN c ON c.id = b.id JOIN c p ON p.id = c.parent_id WHERE p.parent_id IS NULL AND p.points >= 10 QUALIFY place <= 3"),
    "content_duplicates": with_(ARTICLES, "SELECT id, CASE WHEN f <> id THEN f END AS duplicate_of FROM (SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY discovered_at, id) AS f FROM articles)"),
    "minhash_bands": with_(SIGNED, "SELECT id, md5(array_to_string(sig, ',')) AS signature, md5(array_to_string(bands, '|')) AS bands FROM bd"),
    "lsh_pairs": with_(PAIRS, "SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs"),
    "pair_scores": with_(f"""{PAIRS}, sd AS (SELECT id, list_distinct({CONTENT("title")}) AS t, source_id, discovered_at, embedding::DOUBLE[] AS v FROM articles LEFT JOIN embeddings ON vec_id = id),
f AS (SELECT a, b, jaccard, coalesce(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), -1.0) AS max_member_cosine,
  CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0.0 ELSE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE END AS title_jaccard,
  abs(epoch_us(y.discovered_at) - epoch_us(x.discovered_at)) / 3.6e9 AS hours_gap, (x.source_id = y.source_id)::INT AS same_source FROM pairs JOIN sd x ON x.id = a JOIN sd y ON y.id = b),
z AS (SELECT *, 1 / (1 + exp(-greatest(-50, least(50, -3.5::DOUBLE + 30 * (max_member_cosine - 0.85::DOUBLE) + 4 * jaccard + 3 * title_jaccard - 0.03::DOUBLE * hours_gap - 2 * same_source)))) AS probability FROM f)""",
        f"SELECT a, b, {six('max_member_cosine', 'title_jaccard', 'hours_gap')}, same_source, round(probability, 6) AS probability, probability >= 0.5 AS joins FROM z"),
    "story_components": with_(f"RECURSIVE {PAIRS}, e0 AS (SELECT a, b FROM pairs WHERE jaccard >= 0.5 UNION SELECT story_id, id FROM articles WHERE story_id <> id), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), reach AS (SELECT id AS a, id AS b FROM articles UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)",
        "SELECT a AS id, min(b) AS story_id FROM reach GROUP BY 1"),
    "label_centroids": """WITH u AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS "at", unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT label, "at", sum(x) AS x FROM u GROUP BY 1, 2) SELECT label, "at"::INT AS "at", round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s""",
    "story_summary": with_(SUMMARY, "SELECT story_id, article_count, source_count::INT AS source_count, representative_id, title, lead_source, sources, epoch(first_seen_at)::BIGINT AS first_seen, epoch(published_at)::BIGINT AS published FROM summary"),
    "story_features": with_(FEATURES, f"SELECT story_id, article_count, source_count, {six('max_authority', 'mean_authority', 'feed_share', 'hours_since_published', 'hours_since_first_seen')}, hn_points_max, hn_comments_max, words_max::INT AS words_max, round(article_count / greatest(hours_since_first_seen, 1.0), 6) AS velocity_per_hour FROM features"),
    "feed_scores": with_(FEATURES, f"SELECT story_id, {six('coverage', 'authority', 'community', 'freshness', 'score')} FROM scored"),
    "recent_pool": with_(POOL, "SELECT story_id, epoch(latest)::BIGINT AS latest FROM pool"),
    "feed_top": with_(POOL, "SELECT rank::INT AS rank, story_id, round(score, 6) AS score, lead_source, title FROM feed WHERE rank <= 50"),
    "rank_delta": with_(POOL, """, t AS (SELECT story_id, (2.0::DOUBLE * ln(1 + source_count) + max_authority + 0.35::DOUBLE * ln(1 + hn_points_max)) * pow(0.5, hours_since_published / 48) AS score FROM feed),
r AS (SELECT story_id, row_number() OVER (ORDER BY score DESC, story_id) AS rank FROM t) SELECT story_id, r.rank::INT AS rank, feed.rank::INT AS default_rank, (feed.rank - r.rank)::INT AS change FROM r JOIN feed USING (story_id)"""),
    "source_share": with_(POOL, ", c AS (SELECT lead_source, count(*) AS n FROM feed WHERE rank <= 20 GROUP BY 1) SELECT count(*) AS lead_sources, (SELECT lead_source FROM c ORDER BY n DESC, lead_source LIMIT 1) AS top_source, round(max(n) / sum(n), 6) AS top_share FROM c"),
    "race_to_report": with_(ARTICLES, ", r AS (SELECT *, coalesce(published_at, discovered_at) AS w FROM articles WHERE story_id IN (SELECT story_id FROM articles GROUP BY 1 HAVING count(DISTINCT source_id) > 1)) SELECT story_id, id, source_id, row_number() OVER (PARTITION BY story_id ORDER BY w, id)::INT AS place, round((epoch_us(w) - min(epoch_us(w)) OVER (PARTITION BY story_id)) / 6e7, 6) AS minutes_behind FROM r"),
    "briefing": with_(ARTICLES, ", r AS (SELECT *, coalesce(published_at, discovered_at) AS w, row_number() OVER (PARTITION BY story_id ORDER BY coalesce(published_at, discovered_at), id) AS n FROM articles) SELECT story_id, any_value(source_id) FILTER (n = 1) AS first_source, count(DISTINCT source_id) - 1 AS others, round((epoch_us(max(w)) - epoch_us(min(w))) / 3.6e9, 6) AS span_hours FROM r GROUP BY 1"),
    "primary_stories": with_(f"{ARTICLES}, {SOURCES}", "SELECT DISTINCT story_id FROM articles JOIN sources USING (source_id) WHERE category = 'primary'"),
    "adaptive_window": with_(f"{ARTICLES}, {NOW}", ", x AS (SELECT story_id, min(epoch_us(t) - epoch_us(coalesce(published_at, discovered_at))) / 3.6e9 AS age FROM articles, now_ GROUP BY 1), y AS (SELECT * FROM x WHERE age <= 72), c AS (SELECT count(*) FILTER (age <= 24) AS n FROM y) SELECT story_id, round(age, 6) AS age, CASE WHEN n < 8 THEN 72 ELSE 24 END AS window_hours FROM y, c WHERE age <= 24 OR n < 8"),
    "feed_rows": with_(SUMMARY, "SELECT story_id, '<item><title>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</title><guid>story-' || story_id || '</guid><source>' || lead_source || '</source></item>' AS item FROM summary"),
    "feed_interleaved": with_(f"{POOL}, {PROBLEMS}", "SELECT rank + (rank - 1) // 4 AS place, 'story' AS kind, story_id AS id FROM feed UNION ALL SELECT rank * 5, 'problem', problem_id FROM listed WHERE rank <= (SELECT max(rank) // 4 FROM feed)"),
    "bm25_top": with_(LEXICAL, "SELECT qid, id, rank::INT AS rank, score, matched FROM lex"),
    "and_match": with_(f"{ARTICLES}, {QUERIES}, {index('articles')}",
        "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score / (score + 1), 6) DESC, id)::INT AS rank, round(score / (score + 1), 6) AS score FROM sc WHERE matched = n_terms QUALIFY rank <= 200"),
    "knn_top": with_(DENSE, "SELECT qid, id, rank::INT AS rank, similarity FROM dense"),
    "rrf_fused": with_(FUSED, "SELECT qid, id, score, rank_0::INT AS rank_0, rank_1::INT AS rank_1 FROM fu"),
    "stories_fused": with_(FUSED, "SELECT qid, story_id, id, score, rank::INT AS rank FROM fst"),
    "judging_pool": with_(f"{LEXICAL}, {DENSE}", "SELECT qid, id FROM lex WHERE rank <= 50 UNION SELECT qid // 100, id FROM dense WHERE rank <= 20"),
    "eval_metrics": with_(f"""{LEXICAL}, qr AS (SELECT qid, id, rank, (id + qid) % 4 AS grade FROM lex WHERE rank <= 50),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM qr)""",
        """SELECT qid, round(CASE WHEN sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (r <= 10) > 0 THEN coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) / sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (r <= 10) ELSE 0 END, 6) AS ndcg,
round(CASE WHEN count(*) FILTER (grade >= 2) > 0 THEN count(*) FILTER (grade >= 2 AND rank <= 10) / count(*) FILTER (grade >= 2)::DOUBLE ELSE 0 END, 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 2), 0), 6) AS mrr FROM i GROUP BY 1"""),
    "problem_summary": with_(PROBLEMS, "SELECT problem_id, member_count, voice_count, round(effective_voices, 6) AS effective_voices, source_count, platform_count, engagement, category, representative_id, statement, epoch(first_seen_at)::BIGINT AS first_seen, epoch(last_seen_at)::BIGINT AS last_seen FROM problems"),
    "demand_score": with_(PROBLEMS, f"SELECT problem_id, {six('f_voices', 'f_sources', 'f_recency', 'f_engagement', 'f_category', 'demand')} FROM demand"),
    "problem_list": with_(PROBLEMS, "SELECT rank::INT AS rank, problem_id, category, round(demand, 6) AS final FROM listed"),
    "topic_relevance": with_(f"{DISCUSSIONS}, dm AS (SELECT id, left(body, 160) AS title, body, problem_id FROM discussions WHERE problem_id IS NOT NULL), {QUERIES}, {index('dm')}, lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 200), b AS (SELECT qid, problem_id, max(round(1.0::DOUBLE / (60 + rank), 9)) AS s FROM lex JOIN dm USING (id) GROUP BY 1, 2)",
        "SELECT qid, problem_id, round(s / max(s) OVER (PARTITION BY qid), 6) AS relevance FROM b"),
    "evidence_top": with_(DISCUSSIONS, ", e AS (SELECT *, coalesce(points, 0) + coalesce(comments, 0) + coalesce(reactions, 0) AS eng FROM discussions WHERE problem_id IS NOT NULL) SELECT problem_id, id, row_number() OVER (PARTITION BY problem_id ORDER BY p_problem DESC NULLS LAST, eng DESC, id)::INT AS rn, eng, round(p_problem, 6) AS p_problem FROM e QUALIFY rn <= 3"),
    "join_positions": with_(DISCUSSIONS, "SELECT problem_id, id, row_number() OVER w::INT AS position, row_number() OVER w > 1 AS joined, first_value(id) OVER w AS creator_id FROM discussions WHERE problem_id IS NOT NULL WINDOW w AS (PARTITION BY problem_id ORDER BY observed_at, id)"),
    "entity_top": with_(DISCUSSIONS, f", t AS (SELECT problem_id, unnest(list_distinct({CONTENT('body')})) AS term FROM discussions WHERE problem_id IS NOT NULL), c AS (SELECT problem_id, term, count(*) AS n FROM t GROUP BY 1, 2) SELECT problem_id, term, n, row_number() OVER (PARTITION BY problem_id ORDER BY n DESC, term)::INT AS place FROM c QUALIFY place <= 10"),
    "problem_platforms": with_(DISCUSSIONS, "SELECT problem_id, string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms FROM discussions WHERE problem_id IS NOT NULL GROUP BY 1"),
    "admission": with_(DISCUSSIONS, "SELECT source_id, count(*) AS docs, count(problem_id) AS admitted, round(count(problem_id) / count(*)::DOUBLE, 6) AS share FROM discussions GROUP BY 1"),
    "corpus_stats": with_(f"{PROBLEMS}, {ARTICLES}, {SOURCES}, st AS (SELECT story_id, count(DISTINCT source_id) AS n FROM articles GROUP BY 1), rp AS (SELECT p.* FROM problems p, pnow WHERE last_seen_at >= t - INTERVAL 30 DAY)",
        "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT epoch(max(discovered_at))::BIGINT FROM articles) AS last_discovered_at, (SELECT count(*) FROM st) AS stories, (SELECT count(*) FROM st WHERE n >= 2) AS multi_source_stories, (SELECT count(*) FROM discussions) AS discussions, (SELECT count(DISTINCT author_hash) FROM discussions) AS voices, (SELECT string_agg(DISTINCT platform, ',' ORDER BY platform) FROM discussions) AS platforms, (SELECT count(*) FROM rp) AS problems, (SELECT count(*) FROM rp WHERE voice_count >= 2) AS multi_voice_problems, (SELECT count(*) FROM sources WHERE enabled) AS sources"),
    "pulse_hourly": """WITH l AS (SELECT max(ts) AS t FROM events), h AS (SELECT unnest(generate_series(date_trunc('hour', t) - INTERVAL 47 HOUR, date_trunc('hour', t), INTERVAL 1 HOUR)) AS hour FROM l),
k AS (SELECT DISTINCT event_type AS kind FROM events), c AS (SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, kind, coalesce(n, 0) AS n FROM (SELECT * FROM h, k) LEFT JOIN c USING (hour, kind)""",
    "island_labels": with_(ARTICLES, f""", w AS (SELECT label AS island, unnest({_MAPW}) AS word FROM articles JOIN embeddings ON vec_id = id), c AS (SELECT island, word, count(*) AS n FROM w GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1),
k AS (SELECT count(DISTINCT label) AS k FROM articles JOIN embeddings ON vec_id = id), s AS (SELECT island, word, round(n * ln(1 + k / df::DOUBLE), 6) AS score FROM c JOIN d USING (word), k WHERE n >= 2)
SELECT island, word, score, row_number() OVER (PARTITION BY island ORDER BY score DESC, word)::INT AS place FROM s QUALIFY place <= 3"""),
    "wilson_floors": with_(GRADED, f", f AS (SELECT unnest([0.5, 0.7, 0.74, 0.77, 0.8]::DOUBLE[]) AS floor), c AS (SELECT floor, count(*) AS n, sum(gold)::BIGINT AS k FROM f JOIN g ON score >= floor GROUP BY 1) SELECT floor, n, k, round(k / n::DOUBLE, 6) AS precision, {wilson('k', 'n::DOUBLE')} FROM c"),
    "threshold_select": with_(GRADED, """, s AS (SELECT score, sum(gold) AS k, count(*) AS n FROM g GROUP BY 1), c AS (SELECT score AS threshold, sum(k) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS selected, (SELECT sum(gold) FROM g)::BIGINT AS pos FROM s),
m AS (SELECT threshold, tp, selected, tp / selected::DOUBLE AS precision, CASE WHEN pos = 0 THEN 0 ELSE tp / pos::DOUBLE END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
x AS (SELECT 'f1' AS rule, * FROM (SELECT * FROM f ORDER BY round(f1, 9) DESC, threshold DESC LIMIT 1) UNION ALL SELECT 'precision', * FROM (SELECT * FROM f ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN round(recall, 9) ELSE round(precision, 9) END DESC, threshold DESC LIMIT 1))
SELECT rule, round(threshold, 6) AS threshold, tp, selected, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM x"""),
    "stratified_sample": with_(GRADED, "SELECT stratum, doc_id, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || doc_id), doc_id)::INT AS place FROM g QUALIFY place <= 10"),
    "weighted_prf": with_(GRADED, """, p AS (SELECT doc_id % 5 AS stratum, count(*) AS population FROM documents GROUP BY 1), n AS (SELECT stratum, count(*) AS n FROM g GROUP BY 1), w AS (SELECT g.*, population / n::DOUBLE AS w, (score >= 0.5)::INT AS pr FROM g JOIN p USING (stratum) JOIN n USING (stratum)),
c AS (SELECT sum(w) FILTER (gold = 1 AND pr = 1) AS tp, coalesce(sum(w) FILTER (gold = 0 AND pr = 1), 0) AS fp, coalesce(sum(w) FILTER (gold = 1 AND pr = 0), 0) AS fn FROM w) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""),
    "class_metrics": with_(DISCUSSIONS, f""", x AS (SELECT category AS gold, ({quoted(fixed.LABELS[:4])})[id % 4 + 1] AS predicted FROM discussions), l AS (SELECT gold AS label FROM x UNION SELECT predicted FROM x),
c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold = label) AS g, count(*) FILTER (predicted = label) AS p FROM l, x GROUP BY 1),
m AS (SELECT label, CASE WHEN p = 0 THEN 0 ELSE tp / p::DOUBLE END AS precision, CASE WHEN g = 0 THEN 0 ELSE tp / g::DOUBLE END AS recall FROM c)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM m"""),
    "bootstrap": """WITH v AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, length(text)::DOUBLE AS value FROM benchmark), n AS (SELECT count(*) AS n, avg(value) AS mean FROM v),
d AS (SELECT r, floor(('0x' || left(md5('7|' || r || '|' || j), 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS i FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(n)) AS j, n FROM n)),
m AS (SELECT r, avg(value) AS m FROM d JOIN v USING (i) GROUP BY 1) SELECT round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m, n""",
    "judgment_parse": "SELECT 'q' || (doc_id % 20) AS qid, doc_id AS id, (quality * 2 + toxic)::INT AS grade FROM labels",
    "merge_precision": f"WITH c AS (SELECT doc_id % 2 AS audit, doc_id % 3 AS policy, count(*) AS n, sum(quality)::BIGINT AS k FROM labels GROUP BY 1, 2) SELECT audit, policy, n, k, round(k / n::DOUBLE, 6) AS precision, {wilson('k', 'n::DOUBLE')} FROM c",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "native_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, GROUPING(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "native_semi_anti": "SELECT c_nationkey, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders FROM customer GROUP BY 1",
    "newest_members": with_(ARTICLES, "SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY discovered_at DESC, id)::INT AS place FROM articles QUALIFY place <= 25"),
    "story_problem_links": with_(f"{ARTICLES}, {PROBLEMS}", f""", x AS (SELECT a.id, problem_id AS owner, {SIM.format(a='e.embedding', b='q.embedding')} AS similarity FROM articles a JOIN embeddings e ON e.vec_id = a.id JOIN problems p ON p.last_seen_at <= a.discovered_at JOIN embeddings q ON q.vec_id = problem_id)
SELECT id, owner, similarity FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, owner) = 1"""),
    "zero_shot_labels": f"SELECT e.vec_id AS id, q.vec_id AS owner, {SIM.format(a='e.embedding', b='q.embedding')} AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id < 6 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY similarity DESC, q.vec_id) = 1",
    "pair_sample": with_(PAIRS, """, y AS (SELECT a, b, floor(jaccard * 10)::BIGINT || '|' || (x.source_id = z.source_id)::INT AS stratum FROM pairs JOIN articles x ON x.id = a JOIN articles z ON z.id = b)
SELECT stratum, a, b, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || a || '-' || b), a || '-' || b)::INT AS place FROM y QUALIFY place <= 5"""),
    "problem_detail": with_(PROBLEMS, "SELECT problem_id, statement, category, voice_count, source_count, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("f_voices", "f_sources", "f_recency", "f_engagement", "f_category", "demand")) + " FROM demand WHERE problem_id = 1"),
    "statement_echo": with_(PROBLEMS, """, e AS (SELECT *, coalesce(points, 0) + coalesce(comments, 0) + coalesce(reactions, 0) AS e2, CASE WHEN length(body) <= 280 THEN body ELSE regexp_replace(left(body, 279), ' [^ ]*$', '') || '…' END AS x FROM discussions WHERE problem_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY p_problem DESC NULLS LAST, e2 DESC, id) <= 3),
f AS (SELECT problem_id, id, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') AS x, left(regexp_replace(lower(statement), '[^a-z0-9]+', '', 'g'), 60) AS s FROM e JOIN problems USING (problem_id)) SELECT problem_id, id, s <> '' AND starts_with(x, s) AS echo FROM f"""),
    "folded_tokens": with_(ARTICLES, f"SELECT id, array_to_string(list_transform({CONTENT('title')}, lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END), '|') AS tokens FROM articles"),
    "clean_text": f"WITH x AS (SELECT page_id, {COLLAPSE.format(_UNTAGGED)} AS t FROM pages) SELECT page_id, length(t)::INT AS chars, md5(t) AS digest FROM x",
    "opening_texts": with_(ARTICLES, ", x AS (SELECT id, CASE WHEN body = '' THEN left(title, 60) ELSE left(title, 60) || '. ' || left(body, 1000) END AS t FROM articles) SELECT id, md5(t) AS digest, length(t) >= 80 AS long_enough FROM x"),
    "cards": with_(f"{ARTICLES}, {NOW}", """, m AS (SELECT id, source_id, floor((epoch_us(t) - epoch_us(discovered_at)) / 6e7)::BIGINT AS m FROM articles, now_)
SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age, CASE WHEN source_id IS NOT NULL THEN 'N' || upper(left(source_id, 1)) END AS initials FROM m"""),
    "query_parse": f"""WITH x AS (SELECT item_id AS qid, {COLLAPSE.format("lower(replace(left('Latest ' || coalesce(text, ''), 256), '’', ''''))")} AS text FROM benchmark)
SELECT qid, text, array_to_string({CONTENT('text')}, '|') AS tokens, regexp_matches(text, {literal(fixed.RECENCY)}) AS recency FROM x""",
    "gazetteer_entities": with_(ARTICLES, f"SELECT id, array_to_string({_NAMED}, '|') AS entities FROM articles"),
    "entity_unions": with_(ARTICLES, f"SELECT story_id, coalesce(string_agg(DISTINCT e, '|' ORDER BY e), '') AS entities FROM (SELECT story_id, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS e FROM (SELECT story_id, {_NAMED} AS x FROM articles)) GROUP BY 1"),
    "feed_fallback": f"""WITH x AS (SELECT page_id, {COLLAPSE.format("regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')")} AS t FROM pages)
SELECT page_id, CASE WHEN length(t) >= 80 THEN 'Page ' || page_id END AS title, CASE WHEN length(t) >= 80 THEN md5(t) END AS text,
  CASE WHEN length(t) >= 80 THEN md5(CASE WHEN length(t) <= 1000 THEN t ELSE regexp_replace(left(t, 999), ' [^ ]*$', '') || '…' END) END AS lede, CASE WHEN length(t) >= 80 THEN 'feed' END AS origin FROM x""",
    "doc_kinds": with_(DISCUSSIONS, ", k AS (SELECT id, turn % 2 = 1 AS has, coalesce(CASE turn % 3 WHEN 1 THEN 'article' WHEN 2 THEN 'discussion' END, 'article') AS k FROM discussions) SELECT id, CASE WHEN (k = 'article') = NOT has THEN k END AS kind FROM k"),
    "tree_rerank": with_(POOL, """, x AS (SELECT story_id, round(score, 6) AS rrf, round(0.0::DOUBLE + CASE WHEN max_authority <= 0.7 THEN 0.1::DOUBLE WHEN hours_since_published <= 30 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN source_count <= 1 THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END, 6) AS model_score FROM feed WHERE rank <= 50)
SELECT row_number() OVER (ORDER BY model_score DESC, rrf DESC, story_id)::INT AS rank, story_id, model_score, rrf FROM x"""),
    "feed_diversified": with_(f"RECURSIVE {POOL}", """, pick AS (SELECT 0 AS slot, []::BIGINT[] AS taken, []::VARCHAR[] AS leads UNION ALL
SELECT slot + 1, list_append(any_value(taken), arg_min(rank, k)), list_append(any_value(leads), arg_min(lead_source, k)) FROM (
  SELECT p.*, f.rank, f.lead_source, CASE WHEN len(list_filter(p.leads, lambda x: x = f.lead_source)) < CASE WHEN slot < 10 THEN 2 ELSE 3 END THEN 0 ELSE 1000000 END + f.rank AS k
  FROM pick p JOIN feed f ON NOT list_contains(p.taken, f.rank) WHERE slot < 20) GROUP BY slot),
best AS (SELECT taken FROM pick ORDER BY slot DESC LIMIT 1), top AS (SELECT unnest(taken) AS rank, unnest(range(1, len(taken) + 1)) AS position FROM best)
SELECT coalesce(t.position, len(b.taken) + row_number() OVER (PARTITION BY t.position IS NULL ORDER BY f.rank))::INT AS position, f.rank::INT AS rank, story_id, lead_source, round(score, 6) AS score FROM feed f LEFT JOIN top t ON t.rank = f.rank, best b"""),
    "hybrid_fused": with_(FULL, "SELECT qid, id, score, rank_0::INT AS rank_0, rank_1::INT AS rank_1 FROM fu"),
    "hybrid_stories": with_(FULL, "SELECT qid, story_id, id, score, rank::INT AS rank FROM fst"),
    "headlines": with_(HEADLINED, "SELECT id, title AS headline, array_to_string(t, '|') AS tokens FROM hd"),
    "problem_assignment": with_(ASSIGNED, "SELECT id, decision, problem_id, round(probability, 6) AS probability FROM assigned"),
    "assigned_summary": with_(f"{ASSIGNED}, am AS (SELECT d.* REPLACE (a.problem_id AS problem_id, a.p_problem AS p_problem), coalesce(d.author_hash, d.id::VARCHAR) AS voice, greatest(points, 0) + coalesce(comments, 0) + coalesce(reactions, 0) AS eng FROM discussions d JOIN assigned a USING (id) WHERE a.problem_id IS NOT NULL)",
        """SELECT problem_id, count(*) AS member_count, (SELECT count(DISTINCT voice) FROM am y WHERE y.problem_id = x.problem_id) AS voice_count, round((SELECT sum(p) FROM (SELECT max(p_problem) AS p FROM am y WHERE y.problem_id = x.problem_id GROUP BY voice)), 6) AS effective_voices, sum(eng)::BIGINT AS engagement,
  (SELECT category FROM am y WHERE y.problem_id = x.problem_id GROUP BY 1 ORDER BY round(sum(p_problem), 9) DESC, category LIMIT 1) AS category, (SELECT id FROM am y WHERE y.problem_id = x.problem_id ORDER BY p_problem DESC, eng DESC, observed_at, id LIMIT 1) AS representative_id FROM am x GROUP BY 1"""),
    "problem_sizes": with_(PROBLEMS, "SELECT member_count, count(*) AS problems, count(*) FILTER (voice_count >= 2) AS multi_voice FROM problems GROUP BY 1"),
    "topic_listing": with_(f"{PROBLEMS}, dm AS (SELECT id, left(body, 160) AS title, body, problem_id FROM discussions WHERE problem_id IS NOT NULL), {QUERIES}, {index('dm')}, lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 200), b AS (SELECT problem_id, max(round(1.0::DOUBLE / (60 + rank), 9)) AS s FROM lex JOIN dm USING (id) WHERE qid = (SELECT min(item_id) FROM benchmark) GROUP BY 1)",
        """, rel AS (SELECT problem_id, round(s / max(s) OVER (), 6) AS relevance FROM b), pool2 AS (SELECT * FROM demand JOIN rel USING (problem_id), pnow WHERE relevance >= 0.5 AND last_seen_at >= t - INTERVAL 30 DAY AND voice_count >= 1 ORDER BY round(stored, 6) DESC, problem_id LIMIT 500),
fin AS (SELECT problem_id, relevance, round(relevance * sqrt(demand), 6) AS final FROM pool2) SELECT row_number() OVER (ORDER BY final DESC, problem_id)::INT AS rank, problem_id, relevance, final FROM fin QUALIFY rank <= 50"""),
    "classified": with_(DISCUSSIONS, f""", f AS (SELECT id, [{", ".join(f"ln(1 + {x})" for x in _CUE.values())}] AS f FROM discussions),
z AS (SELECT id, [{", ".join(f"{i / 10}::DOUBLE" + "".join(f" + ({((i * 7 + j * 3) % 5 - 2) / 2}::DOUBLE) * f[{j + 1}]" for j in range(6)) for i in range(6))}] AS z FROM f),
e AS (SELECT id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
s AS (SELECT id, p, p[1] + p[2] + p[3] + p[4] AS t FROM p) SELECT id, round(t, 6) AS p_problem, t >= 0.5 AS is_problem, ({quoted(fixed.LABELS)})[CASE WHEN t >= 0.5 THEN list_position(p[1:4], list_max(p[1:4])) ELSE 4 + list_position(p[5:6], list_max(p[5:6])) END] AS category FROM s"""),
    "json_feed_rows": with_(SUMMARY, "SELECT story_id, to_json({'id': 'story-' || story_id, 'title': title, 'tags': string_split(sources, '|')})::VARCHAR AS item FROM summary"),
    "problem_feed_rows": with_(PROBLEMS, "SELECT problem_id, '<item><title>' || replace(replace(replace(replace(replace(statement, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</title><guid>problem-' || problem_id || '</guid><category>' || category || '</category></item>' AS item FROM problems"),
    "cross_folds": with_(GRADED, "SELECT doc_id, stratum, ((row_number() OVER (PARTITION BY stratum ORDER BY ('0x' || left(md5('fold0|' || doc_id), 8))::BIGINT, doc_id) - 1) % 5)::INT AS fold FROM g"),
    "bin_precision": with_(GRADED, f", f AS (SELECT gold, len(list_filter([0.0, 0.3, 0.5, 0.7, 0.9, 1.1]::DOUBLE[], lambda e: score >= e)) - 1 AS bin FROM g), c AS (SELECT bin, count(*) AS n, sum(gold)::BIGINT AS k FROM f WHERE bin BETWEEN 0 AND 4 GROUP BY 1) SELECT bin::INT AS bin, n, k, round(k / n::DOUBLE, 6) AS precision, {wilson('k', 'n::DOUBLE')} FROM c"),
    "class_overall": with_(DISCUSSIONS, f""", x AS (SELECT category AS gold, ({quoted(fixed.LABELS[:4])})[id % 4 + 1] AS predicted FROM discussions), l AS (SELECT gold AS label FROM x UNION SELECT predicted FROM x),
c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold = label) AS g, count(*) FILTER (predicted = label) AS p FROM l, x GROUP BY 1)
SELECT (SELECT round(avg((gold = predicted)::INT), 6) FROM x) AS accuracy, round(avg(2.0::DOUBLE * tp / (g + p)), 6) AS macro_f1, count(*) AS classes FROM c"""),
    "missing_strata": "SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL EXCEPT SELECT source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "matrix_fingerprint": with_(GRADED, "SELECT count(*) AS n, sum(('0x' || left(sha256(doc_id || '|' || round(score, 6)::VARCHAR), 12))::HUGEINT)::VARCHAR AS digest FROM g"),
}
