"""SQL for the registered queries, run by DuckDB on the same tables."""

from __future__ import annotations

import re

from ..functions import text as X
from ..operators.keywords import CATEGORY_RULES


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SPACE = r"[\s\x{85}\p{Z}]"

MSGS = """m AS (
    SELECT conv_id::VARCHAR AS conversation_id, conv_id || ':' || turn AS node_id,
        CASE WHEN turn >= 3 AND turn % 3 = 0 THEN conv_id || ':' || (turn - 3) WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_node_id,
        turn::DOUBLE AS create_time, role, text FROM conversations)"""
VISIBLE = f"(role IS NOT NULL OR NOT regexp_matches(coalesce(text, ''), '^{SPACE}*$'))"

PATHS = """up AS (
    SELECT conversation_id, node_id AS leaf, node_id, parent_node_id, 0 AS back, create_time AS lt FROM m
    WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.conversation_id = m.conversation_id AND c.parent_node_id = m.node_id)
    UNION ALL
    SELECT up.conversation_id, leaf, m.node_id, m.parent_node_id, back + 1, lt FROM up JOIN m ON m.conversation_id = up.conversation_id AND m.node_id = up.parent_node_id),
placed AS (
    SELECT conversation_id, dense_rank() OVER (PARTITION BY conversation_id ORDER BY lt, leaf)::INT AS branch, leaf, back, node_id FROM up),
paths AS (
    SELECT conversation_id, branch, leaf, (row_number() OVER (PARTITION BY conversation_id, leaf ORDER BY back DESC) - 1)::INT AS pos, node_id
    FROM placed JOIN m USING (conversation_id, node_id) WHERE role IS NOT NULL OR NOT regexp_matches(coalesce(text, ''), '^[\\s\\x{85}\\p{Z}]*$'))"""

TRIM = lambda c: f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"
BODY = TRIM(rf"regexp_replace(regexp_replace(regexp_replace(line0, '^([#>]{SPACE}*)+', ''), '^[-*+] {SPACE}*', ''), '\*\*|__|`', ' ', 'g')")
NUMBER = rf"CASE WHEN regexp_matches(body, '^[0-9.]*[0-9][0-9.]*([):]|{SPACE})') THEN regexp_replace(body, '^[0-9.]+([):]{SPACE}*|{SPACE}+)', '') ELSE body END"


def tokens(raw: str = "r") -> str:
    t = f"trim(CASE lower({raw}) WHEN 'c#' THEN 'csharp' WHEN 'f#' THEN 'fsharp' WHEN '.net' THEN 'dotnet' ELSE lower({raw}) END, '.-_#+')"
    return f"""list_filter(list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{Nd}}+#.\\-_]+'), lambda {raw}: CASE
        WHEN length({t}) > 0 AND NOT starts_with({t}, 'http') AND {t} NOT IN {listed(X.NOISE_TOKENS)} AND regexp_matches({t}, '[\\p{{L}}\\p{{Nd}}]')
            AND NOT regexp_matches({t}, '^\\p{{Nd}}+$') AND length({t}) <= 48 AND {t} NOT IN {listed(X.STOP_WORDS)}
            AND (length({t}) >= 3 OR {t} IN {listed(X.SHORT_TOKENS)} OR regexp_matches(regexp_replace({raw}, '[^\\p{{L}}]', '', 'g'), '^\\p{{Lu}}{{2,4}}$'))
        THEN {t} END), lambda x: x IS NOT NULL)"""


LINES = lambda source: f"""raws AS (SELECT *, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw FROM {source}),
lines0 AS (SELECT *, {TRIM('raw')} AS line0 FROM raws),
lines1 AS (SELECT *, {BODY} AS body FROM lines0),
lines AS (SELECT *, CASE WHEN regexp_matches(line0, '^(```|~~~)') THEN '' ELSE {TRIM(NUMBER)} END AS line FROM lines1),
toks AS (SELECT *, {tokens()} AS t FROM lines WHERE line <> '')"""  # noqa: E731

TITLES = f"""titles AS (
    SELECT conversation_id, CASE WHEN conversation_id LIKE '%0' OR regexp_matches(coalesce(t, ''), '^{SPACE}*$') THEN '(untitled)' ELSE {TRIM("t")} END AS title
    FROM (SELECT conversation_id, left(arg_min(text, create_time), 40) AS t FROM m WHERE {VISIBLE} GROUP BY 1))"""
_weights = " ".join(f"WHEN '{k}' THEN {round(v * X.UNIT)}" for k, v in X.ROLE_WEIGHTS.items())
TERMS = f"""{TITLES},
src AS (
    SELECT conversation_id, text, CASE lower(role) {_weights} ELSE {round(X.OTHER_ROLE * X.UNIT)} END AS units, false AS forced FROM m WHERE {VISIBLE}
    UNION ALL SELECT conversation_id, title, {round(X.TITLE * X.UNIT)}, true FROM titles),
src1 AS (SELECT * FROM src WHERE units > 0 AND NOT regexp_matches(coalesce(text, ''), '^{SPACE}*$')),
{LINES('src1')},
weighed AS (SELECT conversation_id, t, s, units::BIGINT * (CASE WHEN s THEN 115 ELSE 100 END) AS w
    FROM (SELECT *, forced OR length(line) + len(regexp_extract_all(line, '[\\x{{10000}}-\\x{{10FFFF}}]')) <= 96 OR regexp_matches(line0, '^(#|[-*+] |[0-9]+[.)])') AS s FROM toks)),
scored AS (
    SELECT conversation_id, unnest(t) AS term, w * 100 AS u FROM weighed
    UNION ALL SELECT conversation_id, t[i] || ' ' || t[i + 1], w * 175 FROM weighed, unnest(range(1, least(len(t) - 1, 7) + 1)) AS q(i) WHERE s),
terms AS (SELECT conversation_id, term, sum(u)::BIGINT AS units FROM scored GROUP BY 1, 2)"""

SHORT = listed(X.SHORT_TOKENS)
OVER = f"list_distinct(list_filter(string_split(%s, ' '), lambda q: length(q) >= 3 OR q IN {SHORT}))"


def diverse(candidates: str, take: int) -> str:
    """Greedy choice over a list of terms. Lists of one term each, so that sum and element have one type."""
    a, b = OVER % "y", OVER % "x[1]"
    same = f"(y = x[1] OR (len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) IN (len({a}), len({b}))))"
    return f"list_reduce(list_transform({candidates}, lambda c: [c]), lambda acc, x: CASE WHEN len(acc) >= {take} OR len(list_filter(acc, lambda y: {same})) > 0 THEN acc ELSE list_concat(acc, x) END)"


KEYWORDS = f"""{TERMS},
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY units * (CASE WHEN words > 1 THEN 175 ELSE 100 END) DESC, words DESC, replace(upper(replace(term, chr(223), chr(57567))), chr(57567), chr(223))) AS rk
    FROM (SELECT *, len(string_split(term, ' ')) AS words FROM terms)),
picked AS (SELECT conversation_id, {diverse("list(term ORDER BY rk)", 18)} AS p FROM ranked GROUP BY 1),
kws AS (
    SELECT k.conversation_id, (k.i - 1)::INT AS rank, k.keyword, round_even(r.units / top.units, 4) AS score
    FROM (SELECT conversation_id, unnest(p) AS keyword, generate_subscripts(p, 1) AS i FROM picked) k
    JOIN ranked r ON r.conversation_id = k.conversation_id AND r.term = k.keyword JOIN ranked top ON top.conversation_id = k.conversation_id AND top.rk = 1)"""
COOC = """pairs AS (SELECT a.keyword AS left_keyword, b.keyword AS right_keyword, count(*) AS n FROM (SELECT * FROM kws WHERE rank < 6) a JOIN (SELECT * FROM kws WHERE rank < 6) b
        ON a.conversation_id = b.conversation_id AND replace(upper(replace(a.keyword, chr(223), chr(57567))), chr(57567), chr(223)) < replace(upper(replace(b.keyword, chr(223), chr(57567))), chr(57567), chr(223)) GROUP BY 1, 2),
cooc AS (SELECT left_keyword, right_keyword, n, round_even(n / (SELECT max(n) FROM pairs), 4) AS weight FROM pairs WHERE n >= 2)"""
CORPUS = f"corpora AS (SELECT conversation_id, string_agg(CASE WHEN regexp_matches(coalesce(text, ''), '^{SPACE}*$') THEN '' ELSE text || chr(10) END, '' ORDER BY create_time NULLS LAST, node_id) AS corpus FROM m WHERE {VISIBLE} GROUP BY 1)"
_score = lambda terms: " + ".join(f"(contains(lower(corpus), '{t}'))::INT" for t in terms)
_rules = " UNION ALL ".join(f"SELECT conversation_id, {i} AS i, '{n}' AS category, {_score(ts)} AS score FROM corpora" for i, (n, ts) in enumerate(CATEGORY_RULES))
CATEGORIES = f"""{CORPUS}, rules AS ({_rules}),
cats AS (SELECT conversation_id, CASE WHEN score > 0 THEN category ELSE 'Uncategorized' END AS category, score::INT AS score
    FROM rules QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, i) = 1)"""
HIERARCHY = """steps AS (SELECT lang AS parent, lang || '/' || source AS child, count(*) AS n FROM documents WHERE lang <> '' AND source <> '' GROUP BY 1, 2)"""

def humanized(x: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all(trim(translate({x}, '_-', '  ')), '\p{{L}}[\p{{L}}\p{{M}}\p{{N}}'']*|[^\p{{L}}]+'),
        lambda w: CASE WHEN regexp_matches(w, '^\p{{L}}') AND regexp_matches(w, '\p{{Ll}}') THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), '')"""


def humanized_terms(terms: str) -> str:
    return f"array_to_string(list_filter(list_transform({terms}, lambda h: {humanized('h')}), lambda h: NOT regexp_matches(h, '^{SPACE}*$')), ' / ')"


FOLD = lambda c: f"replace(upper(replace({c}, chr(223), chr(57567))), chr(57567), chr(223))"


def line_tokens(name: str, source: str) -> str:
    """CTEs that end in ``name``_toks: the rows of ``source``, whose ``raw`` is one line each, with its tokens ``t``."""
    out = LINES(source).replace("raws AS (SELECT *, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw FROM", "raws AS (SELECT * FROM")
    for cte in ("raws", "lines0", "lines1", "lines", "toks"):
        out = re.sub(rf"\b{cte}\b", f"{name}_{cte}", out)
    return out


OWN = f"list_distinct(list_filter(string_split(%s, ' '), lambda q: length(q) >= 3 OR q IN {SHORT}))"
TOPICS = f"""{KEYWORDS}, {line_tokens('title', '(SELECT conversation_id, title AS raw FROM titles)')},
tt AS (SELECT conversation_id, coalesce(t, []) AS t FROM titles LEFT JOIN title_toks USING (conversation_id)),
kl AS (SELECT conversation_id, list(keyword ORDER BY rank) AS kw FROM kws GROUP BY 1),
phrase AS (
    SELECT conversation_id, arg_min(term, (-total, i)) AS term FROM (
        SELECT conversation_id, i, term, coalesce((SELECT sum(score) FROM kws k WHERE k.conversation_id = q.conversation_id AND k.keyword IN (SELECT unnest({OWN % 'term'}))), 0) AS total
        FROM (SELECT conversation_id, i, t[i] || ' ' || t[i + 1] AS term FROM tt, unnest(range(1, least(len(t) - 1, 7) + 1)) AS u(i)) q) GROUP BY 1),
own AS (
    SELECT conversation_id, list(term ORDER BY -score, {FOLD('term')}, term) AS own FROM (
        SELECT o.conversation_id, o.term, coalesce(k.score, 0) AS score FROM (SELECT DISTINCT conversation_id, unnest(t) AS term FROM tt) o
        LEFT JOIN kws k ON k.conversation_id = o.conversation_id AND k.keyword = o.term) GROUP BY 1),
rest AS (
    SELECT conversation_id, list(keyword ORDER BY -score * CASE WHEN n > 1 THEN 2.1::DOUBLE ELSE 1.0::DOUBLE END, -n, {FOLD('keyword')}, keyword) AS rest
    FROM (SELECT *, len(string_split(keyword, ' ')) AS n FROM kws) GROUP BY 1),
cand AS (
    SELECT conversation_id, list_concat(list_concat(CASE WHEN term IS NULL THEN []::VARCHAR[] ELSE [term] END, coalesce(own, [])), coalesce(rest, [])) AS c
    FROM titles LEFT JOIN phrase USING (conversation_id) LEFT JOIN own USING (conversation_id) LEFT JOIN rest USING (conversation_id)),
topic AS (SELECT conversation_id, CASE WHEN len(c) = 0 THEN []::VARCHAR[] ELSE {diverse("c", 8)} END AS topics FROM cand)"""

PAIRS = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
d2 AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p)"""


def edges(name: str, k: int) -> str:
    return f"""{name} AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round_even(max(score), 4) AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM d2) WHERE r <= {k} GROUP BY 1, 2)"""


def neighbors(name: str, e: str) -> str:
    return f"""{name} AS (SELECT id, neighbor, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, neighbor)::INT AS rank
        FROM (SELECT a AS id, b AS neighbor, weight FROM {e} UNION ALL SELECT b, a, weight FROM {e}))"""


E4 = f"{PAIRS}, {edges('e', 4)}"
N4 = f"{E4}, {neighbors('n', 'e')}"
BOTH = f"{N4}, {edges('e2', 2)}, {neighbors('n2', 'e2')}"
CLUSTERS = f"""{PAIRS}, {edges('e1', 4)}, sym AS (SELECT a, b FROM e1 UNION ALL SELECT b, a FROM e1),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.id),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1),
cl AS (SELECT id, 'cluster:' || lpad((dense_rank() OVER (ORDER BY c))::VARCHAR, 4, '0') AS cluster FROM comp)"""
CATALOG = """catalog AS (SELECT vec_id AS id, 'c' || (label % 5) AS category, CASE WHEN vec_id % 3 = 0 THEN 'c' || ((label + 1) % 5) END AS secondary,
    CASE WHEN vec_id % 6 = 0 THEN 'c' || ((label + 2) % 5) END AS tertiary, (vec_id % 7)::VARCHAR AS cluster FROM embeddings),
frows AS (SELECT id, cluster, 'primary' AS facet, category FROM catalog UNION ALL SELECT id, cluster, 'secondary', secondary FROM catalog WHERE secondary IS NOT NULL
    UNION ALL SELECT id, cluster, 'tertiary', tertiary FROM catalog WHERE tertiary IS NOT NULL)"""
PRED = """pred AS (
    SELECT DISTINCT conv_id::VARCHAR AS conversation_id, 0 AS pos, 'c' || (conv_id % 4) AS category, 0.75::DOUBLE AS score, 'baseline' AS source FROM conversations
    UNION ALL SELECT DISTINCT conv_id::VARCHAR, i, 'c' || ((conv_id * i + i) % 7), w, 'model'
    FROM conversations, (VALUES (1, 0.40::DOUBLE), (2, 0.22::DOUBLE), (3, 0.15::DOUBLE), (4, 0.10::DOUBLE)) AS v(i, w)),
one AS (SELECT *, min(pos) OVER (PARTITION BY conversation_id, category) AS first FROM pred
    QUALIFY row_number() OVER (PARTITION BY conversation_id, category ORDER BY source = 'model' DESC, score DESC, pos) = 1),
flag AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY source = 'model' DESC, first) = 1 AS is_selected FROM one),
sel AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY is_selected DESC, score DESC, category)::INT AS rank, category, score, source, is_selected FROM flag),
alt AS (SELECT conversation_id, category, row_number() OVER (PARTITION BY conversation_id ORDER BY rank) AS k FROM sel WHERE rank BETWEEN 2 AND 3 AND score >= 0.11),
fac AS (SELECT s.conversation_id, s.category, a.category AS secondary, b.category AS tertiary FROM sel s
    LEFT JOIN alt a ON a.conversation_id = s.conversation_id AND a.k = 1 LEFT JOIN alt b ON b.conversation_id = s.conversation_id AND b.k = 2 WHERE s.rank = 1)"""
FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(%s, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def representatives(name: str, group: str, members: str, each: int, top: int) -> str:
    """The group's keywords by their summed scores among the members' first."""
    return f"""{name}_sum AS (SELECT {group}, {FOLD('keyword')} AS u, min(keyword) AS keyword, sum(score::DECIMAL(18, 4)) AS score FROM {members} JOIN kws USING (conversation_id) WHERE rank < {each} GROUP BY 1, 2),
{name} AS (SELECT {group}, list(keyword ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, u) AS r FROM {name}_sum) WHERE r <= {top} GROUP BY 1)"""


#: What an index with the heuristic profile holds: a conversation has its rule category alone, so its community is that category.
INDEX = f"""{TOPICS}, {CATEGORIES},
cat AS (SELECT conversation_id, title, coalesce(category, 'Uncategorized') AS category FROM titles LEFT JOIN cats USING (conversation_id)),
leafs AS (SELECT *, list_filter(list_transform(string_split(category, '/'), lambda x: trim(x)), lambda x: x <> '')[-1] AS leaf FROM cat),
{line_tokens('leaf', "(SELECT conversation_id, leaf AS raw FROM leafs WHERE upper(leaf) <> 'UNCATEGORIZED')")},
{line_tokens('term', "(SELECT conversation_id, unnest(list_concat(topics, coalesce(kw, []))) AS raw FROM topic LEFT JOIN kl USING (conversation_id))")},
grounded AS (SELECT DISTINCT l.conversation_id FROM (SELECT conversation_id, unnest(t) AS x FROM leaf_toks) l JOIN (SELECT conversation_id, unnest(t) AS x FROM term_toks) r ON l.conversation_id = r.conversation_id AND l.x = r.x),
mc AS (
    SELECT conversation_id, title, category, coalesce(kw, []) AS kw, list_concat(list_concat(topics, coalesce(kw, [])[1:6]), CASE WHEN conversation_id IN (SELECT conversation_id FROM grounded) THEN [leaf] ELSE []::VARCHAR[] END) AS c
    FROM leafs JOIN topic USING (conversation_id) LEFT JOIN kl USING (conversation_id)),
mt AS (SELECT conversation_id, title, category, kw, CASE WHEN len(c) = 0 THEN []::VARCHAR[] ELSE {diverse("c", 8)} END AS topics FROM mc),
analysis AS (
    SELECT conversation_id, title, category, kw, topics, CASE WHEN len(topics) > 0 THEN {humanized_terms('topics[1:3]')} WHEN len(kw) > 0 THEN {humanized_terms('kw[1:3]')}
        WHEN title <> '(untitled)' AND NOT regexp_matches(title, '^{SPACE}*$') THEN title ELSE category END AS topic_label FROM mt),
ctoks AS (SELECT conversation_id, token, count(*) AS n FROM (SELECT conversation_id, unnest(t) AS token FROM body_toks) GROUP BY 1, 2),
vec AS (SELECT conversation_id, h % 384 AS k, sum(CASE WHEN h & 2 = 0 THEN n ELSE -n END)::BIGINT AS v FROM (SELECT *, {FNV % 'token'} AS h FROM ctoks) GROUP BY 1, 2),
norm AS (SELECT conversation_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM vec GROUP BY 1),
cpairs AS (
    SELECT *, dot / (l.norm * r.norm) AS score FROM (SELECT a.conversation_id AS a, b.conversation_id AS b, sum(a.v * b.v)::DOUBLE AS dot FROM vec a JOIN vec b ON a.k = b.k AND a.conversation_id <> b.conversation_id GROUP BY 1, 2)
    JOIN norm l ON l.conversation_id = a JOIN norm r ON r.conversation_id = b WHERE dot / (l.norm * r.norm) >= 0.72),
sim AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round_even(max(score), 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 12) DESC, b) AS r FROM cpairs) WHERE r <= 4 GROUP BY 1, 2),
both_ways AS (SELECT a, b FROM sim UNION ALL SELECT b, a FROM sim),
creach AS (SELECT conversation_id AS id, conversation_id AS r FROM titles UNION SELECT both_ways.b, creach.r FROM creach JOIN both_ways ON both_ways.a = creach.id),
member AS (SELECT id AS conversation_id, 'cluster:' || lpad((dense_rank() OVER (ORDER BY c))::VARCHAR, 4, '0') AS cluster FROM (SELECT id, min(r) AS c FROM creach GROUP BY 1)),
communal AS (SELECT category, 'catcomm:' || lpad((row_number() OVER (ORDER BY count(*) DESC, category))::VARCHAR, 4, '0') AS community, count(*) AS members FROM cat GROUP BY 1),
cmember AS (SELECT conversation_id, community, category FROM cat JOIN communal USING (category)),
{representatives('ckw', 'cluster', 'member', 6, 8)},
{representatives('mkw', 'community', 'cmember', 8, 10)},
ccat AS (SELECT cluster, arg_min(category, (-n, {FOLD('category')}, category)) AS category FROM (SELECT cluster, category, count(*) AS n FROM member JOIN cat USING (conversation_id) GROUP BY 1, 2) GROUP BY 1),
crow AS (
    SELECT cluster, count(*) AS members, list(conversation_id ORDER BY conversation_id) AS ids,
        min(CASE WHEN topic_label <> '(untitled)' AND NOT regexp_matches(topic_label, '^{SPACE}*$') THEN topic_label WHEN title <> '(untitled)' AND NOT regexp_matches(title, '^{SPACE}*$') THEN title END) AS single
    FROM member JOIN analysis USING (conversation_id) GROUP BY 1),
clusters AS (
    SELECT cluster, category, members, ids, coalesce(keywords, []) AS keywords,
        CASE WHEN members = 1 AND single IS NOT NULL THEN single WHEN len(coalesce(keywords, [])) > 0 THEN array_to_string(list_transform(keywords[1:3], lambda h: {humanized('h')}), ' / ') ELSE category END AS label,
        CASE WHEN len(coalesce(keywords, [])) = 0 THEN category ELSE category || ': ' || array_to_string(keywords[1:5], ', ') END AS summary
    FROM crow JOIN ccat USING (cluster) LEFT JOIN ckw USING (cluster)),
cids AS (SELECT community, list(conversation_id ORDER BY conversation_id) AS ids FROM cmember GROUP BY 1),
communities AS (
    SELECT community, category AS label, category || ' centered across ' || members || ' conversations.' AS summary, category, members, ids, coalesce(keywords, []) AS keywords
    FROM communal JOIN cids USING (community) LEFT JOIN mkw USING (community)),
parts AS (SELECT list_filter(list_transform(string_split(category, '/'), lambda x: trim(x)), lambda x: x <> '') AS p FROM cat),
levels AS (SELECT array_to_string(p[1:i], '/') AS parent, array_to_string(p[1:i + 1], '/') AS child, count(*) AS n FROM parts, unnest(range(1, len(p))) AS q(i) GROUP BY 1, 2),
iedges AS (
    SELECT conversation_id AS scope_id, conversation_id AS from_id, 'kw:' || keyword AS to_id, 'has_keyword' AS edge_type, score AS weight FROM kws WHERE rank < 10
    UNION ALL SELECT conversation_id, conversation_id, 'cat:' || category, 'has_category', 1.0 FROM cat
    UNION ALL SELECT conversation_id, conversation_id, 'topic:' || unnest(topics), 'has_topic', 1.0 FROM analysis
    UNION ALL SELECT conversation_id, conversation_id, 'topiclabel:' || topic_label, 'has_topic_label', 1.0 FROM analysis WHERE NOT regexp_matches(topic_label, '^{SPACE}*$')
    UNION ALL SELECT p.conversation_id, p.node_id, m.node_id, 'reply', 1.0 FROM m JOIN m p ON p.conversation_id = m.conversation_id AND p.node_id = m.parent_node_id
    UNION ALL SELECT 'global', a, b, 'similar_to', weight FROM sim
    UNION ALL SELECT 'global', conversation_id, cluster, 'belongs_to_cluster', 1.0 FROM member
    UNION ALL SELECT 'global', cluster, 'cat:' || category, 'cluster_category', 1.0 FROM clusters
    UNION ALL SELECT 'global', cluster, 'kw:' || unnest(keywords[1:5]), 'cluster_keyword', 1.0 FROM clusters
    UNION ALL SELECT 'global', conversation_id, community, 'belongs_to_category_community', 1.0 FROM cmember
    UNION ALL SELECT 'global', community, 'cat:' || category, 'community_category', 1.0 FROM communities
    UNION ALL SELECT 'global', community, 'kw:' || unnest(keywords[1:5]), 'community_keyword', 1.0 FROM communities
    UNION ALL SELECT 'global', 'kw:' || left_keyword, 'kw:' || right_keyword, 'co_occurs_with', weight FROM cooc
    UNION ALL SELECT 'global', 'cat:' || parent, 'cat:' || child, 'category_parent', n FROM levels),
edges AS (SELECT scope_id, from_id, to_id, edge_type, max(weight)::DOUBLE AS weight FROM iedges GROUP BY 1, 2, 3, 4)"""
INDEX = f"{MSGS}, {line_tokens('body', '(SELECT conversation_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw FROM m)')}, {INDEX.replace(CATEGORIES, CATEGORIES + ',' + COOC, 1)}"
_mean = lambda k: f"coalesce(round_even(list_filter(c.s, lambda y: y.k = {k})[1].v / c.n, 4), 0)"
_low = f"list_sum(list_transform(w, lambda x: least(x.v, {_mean('x.k')})))"
_high = f"(list_sum(list_transform(w, lambda x: greatest(x.v, {_mean('x.k')}))) + coalesce(list_sum(list_transform(list_filter(c.s, lambda z: NOT list_contains(list_transform(w, lambda x: x.k), z.k)), lambda z: round_even(z.v / c.n, 4))), 0))"
_match = f"least(1.0::DOUBLE, {_low} / {_high} + CASE WHEN c.p = c1 THEN 0.05::DOUBLE ELSE 0 END)"
#: Groups in order, each joining the best community or founding its own: a recursive walk whose state is the list of communities.
COMMUNITIES = f"""sg AS (SELECT concat_ws(' | ', category, secondary, tertiary) AS signature, count(*)::BIGINT AS n, min(category) AS c1, min(secondary) AS c2, min(tertiary) AS c3 FROM fac GROUP BY 1),
pf AS (SELECT *, list_filter([{{'k': c1, 'v': 1.0::DOUBLE}}, {{'k': CASE WHEN c2 <> c1 THEN c2 END, 'v': 0.68::DOUBLE}}, {{'k': CASE WHEN c3 <> c1 AND c3 IS DISTINCT FROM c2 THEN c3 END, 'v': 0.44::DOUBLE}}], lambda x: x.k IS NOT NULL) AS w FROM sg),
anchored AS (SELECT bool_or(n >= 3) AS a FROM sg),
pend AS (SELECT *, row_number() OVER (ORDER BY n DESC, signature) AS i FROM pf, anchored WHERE a AND n < 3),
walk AS (
    SELECT 0::BIGINT AS i, (SELECT list({{'seed': signature, 'n': n, 'p': c1, 's': list_transform(w, lambda x: {{'k': x.k, 'v': x.v * n}}), 'm': [signature]}}) FROM pf, anchored WHERE NOT a OR n >= 3) AS cs
    UNION ALL
    SELECT i, CASE WHEN -best.a >= 0.46 THEN list_transform(cs, lambda c: CASE WHEN c.seed = best.c THEN {{'seed': c.seed, 'n': c.n + n, 'p': c.p,
            's': list_concat(list_transform(c.s, lambda y: {{'k': y.k, 'v': y.v + coalesce(list_filter(w, lambda x: x.k = y.k)[1].v, 0) * n}}), list_transform(list_filter(w, lambda x: NOT list_contains(list_transform(c.s, lambda y: y.k), x.k)), lambda x: {{'k': x.k, 'v': x.v * n}})),
            'm': list_append(c.m, signature)}} ELSE c END)
        ELSE list_append(cs, {{'seed': signature, 'n': n, 'p': c1, 's': list_transform(w, lambda x: {{'k': x.k, 'v': x.v * n}}), 'm': [signature]}}) END
    FROM (SELECT pend.*, cs, list_sort(list_transform(cs, lambda c: {{'a': -({_match}), 'b': -c.n, 'c': c.seed}}))[1] AS best FROM walk JOIN pend ON pend.i = walk.i + 1)),
ended AS (SELECT unnest(arg_max(cs, i)) AS c FROM walk),
named AS (SELECT 'catcomm:' || lpad((row_number() OVER (ORDER BY c.n DESC, c.seed))::VARCHAR, 4, '0') AS community, c.m AS m FROM ended),
found AS (SELECT community, unnest(m) AS signature FROM named)"""
RUNS = """runs AS (SELECT profile, vec_id AS id, 'c' || ((label + (vec_id % 11 < i)::INT) % 5) AS category, (vec_id * (i + 1)) % 13 AS bridge_score
    FROM embeddings, (VALUES ('heuristic', 0), ('hybrid', 1), ('mlnet', 2), ('onnx', 3)) AS v(profile, i)),
mat AS (SELECT id, count(*) AS profiles, count(DISTINCT category) AS categories, max(bridge_score) AS max_bridge, round_even(avg(bridge_score), 3) AS avg_bridge,
    array_to_string(list_sort(list(DISTINCT category)), ' | ') AS category_list, string_agg(profile || '=' || category, '; ' ORDER BY profile) AS category_map FROM runs GROUP BY 1)"""
SHORT_NUMBER = lambda x: rf"regexp_replace(regexp_replace(round(CAST({x} AS DECIMAL(38, 12)), 3)::VARCHAR, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
CATALOGUE = rf"""{INDEX},
nears AS (SELECT a AS id, b AS neighbor, weight FROM sim UNION ALL SELECT b, a, weight FROM sim),
listed AS (
    SELECT id, neighbor, weight, title, category, cluster, row_number() OVER (PARTITION BY id ORDER BY weight DESC, {FOLD('title')}, neighbor) AS rank
    FROM nears JOIN cat ON cat.conversation_id = neighbor JOIN member ON member.conversation_id = neighbor),
active AS (
    SELECT id AS conversation_id, string_agg(concat_ws(':', rank::VARCHAR, neighbor, listed.title, round(weight * 10000)::BIGINT::VARCHAR, listed.category, cluster), ' | ' ORDER BY rank) AS neighbors,
        count(*) FILTER ({FOLD('listed.category')} <> {FOLD('cat.category')}) AS crossed, list_sort(list(DISTINCT listed.category) FILTER ({FOLD('listed.category')} <> {FOLD('cat.category')})) AS others
    FROM listed JOIN cat ON cat.conversation_id = id WHERE rank <= 12 GROUP BY 1),
kwl AS (SELECT conversation_id, list(keyword || ':' || round(score * 10000)::BIGINT ORDER BY rank) AS keyword_list, list(keyword || ':' || {SHORT_NUMBER('score')} ORDER BY rank) AS shown_keywords FROM kws WHERE rank < 18 GROUP BY 1),
leafs_n AS (SELECT conversation_id, count(*) AS branches FROM m WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.conversation_id = m.conversation_id AND c.parent_node_id = m.node_id) GROUP BY 1),
chunk_ns AS (SELECT conversation_id, sum(CASE WHEN regexp_matches(coalesce(text, ''), '^{SPACE}*$') THEN 0 ELSE ceil(length(text) / 1200.0) END)::BIGINT AS chunk_n FROM m GROUP BY 1),
catalogue AS (
    SELECT a.conversation_id, a.title, branches, a.category, community, communities.label AS community_label, member.cluster, clusters.label AS cluster_label, clusters.summary AS cluster_summary, a.topic_label, a.topics, a.kw[1:18] AS kw,
        coalesce(keyword_list, []) AS keyword_list, coalesce(shown_keywords, []) AS shown_keywords, chunk_n, left(regexp_replace(a.title || '__' || a.conversation_id, '[\x00-\x1F"<>|:*?\\/]', '_', 'g'), 140) AS name, crossed, others, neighbors
    FROM analysis a JOIN cmember USING (conversation_id) JOIN communities USING (community) JOIN member ON member.conversation_id = a.conversation_id JOIN clusters ON clusters.cluster = member.cluster
    LEFT JOIN active ON active.conversation_id = a.conversation_id LEFT JOIN kwl ON kwl.conversation_id = a.conversation_id JOIN leafs_n ON leafs_n.conversation_id = a.conversation_id JOIN chunk_ns ON chunk_ns.conversation_id = a.conversation_id)"""
CHUNKS = f"""chunks AS (SELECT source AS conversation_id, doc_id::VARCHAR AS node_id, i::INT AS pos, upper(sha256('text' || chr(10) || substr(text, (i * 1200 + 1)::INT, 1200))) AS chunk_hash
    FROM documents, unnest(range(0, CAST(ceil(length(text) / 1200.0) AS BIGINT))) AS q(i) WHERE NOT regexp_matches(text, '^{SPACE}*$'))"""
TOKC = f"{MSGS}, {LINES('(SELECT conversation_id, text FROM m)')}"

SQL: dict[str, str] = {
    "messages_visible": f"WITH {MSGS} SELECT conversation_id, node_id, row_number() OVER (PARTITION BY conversation_id ORDER BY create_time NULLS LAST, node_id)::INT AS pos FROM m WHERE {VISIBLE}",
    "parent_links": f"WITH {MSGS} SELECT m.conversation_id, m.node_id, p.node_id AS parent FROM m LEFT JOIN m p ON p.conversation_id = m.conversation_id AND p.node_id = m.parent_node_id",
    "leaf_paths": f"WITH RECURSIVE {MSGS}, {PATHS} SELECT * FROM paths",
    "current_path": f"WITH RECURSIVE {MSGS}, {PATHS}, last AS (SELECT conversation_id, arg_max(leaf, lt) AS leaf FROM up WHERE back = 0 GROUP BY 1) SELECT conversation_id, pos, node_id FROM paths JOIN last USING (conversation_id, leaf)",
    "conversation_order": f"WITH {MSGS}, c AS (SELECT conversation_id, min(create_time) AS started, count(*) AS n_messages FROM m GROUP BY 1) SELECT *, row_number() OVER (ORDER BY started NULLS LAST, conversation_id)::INT AS conv_idx FROM c",
    "corpus_hash": f"WITH {MSGS}, {CORPUS} SELECT conversation_id, length(corpus)::BIGINT AS n_chars, sha256(corpus) AS corpus_sha256 FROM corpora",
    "transcripts": f"""WITH RECURSIVE {MSGS}, {PATHS} SELECT conversation_id, branch, count(*) AS n_messages,
        sha256(string_agg('## ' || coalesce(role, 'unknown') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY pos)) AS document_sha256
        FROM paths JOIN m USING (conversation_id, node_id) GROUP BY 1, 2""",
    "token_counts": f"WITH {TOKC} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM toks) GROUP BY 1",
    "term_weights": f"WITH {MSGS}, {TERMS} SELECT * FROM terms",
    "keywords_top": f"WITH {MSGS}, {KEYWORDS} SELECT * FROM kws",
    "topics_top": f"WITH {MSGS}, {TOPICS} SELECT conversation_id, (i - 1)::INT AS rank, topics[i] AS topic FROM topic, unnest(range(1, len(topics) + 1)) AS q(i)",
    "category_scores": f"WITH {MSGS}, {CATEGORIES} SELECT * FROM cats",
    "keyword_cooccurrence": f"WITH {MSGS}, {KEYWORDS}, {COOC} SELECT * FROM cooc",
    "category_hierarchy": f"WITH {HIERARCHY} SELECT * FROM steps",
    "char_chunks": f"WITH {CHUNKS} SELECT * FROM chunks",
    "stored_chunks": f"WITH {CHUNKS} SELECT conversation_id, count(DISTINCT chunk_hash) AS chunks FROM chunks GROUP BY 1",
    "hash_embeddings": f"""WITH {TOKC}, c AS (SELECT conversation_id, token, count(*) AS n FROM (SELECT conversation_id, unnest(t) AS token FROM toks) GROUP BY 1, 2),
        h AS (SELECT *, {FNV % 'token'} AS h FROM c),
        v AS (SELECT conversation_id, (h % 384)::BIGINT AS bucket, sum(CASE WHEN h & 2 = 0 THEN n ELSE -n END)::BIGINT AS v FROM h GROUP BY 1, 2)
        SELECT conversation_id, bucket, round(v / norm, 6) AS value FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY conversation_id)::DOUBLE) AS norm FROM v) WHERE norm > 0""",
    "similar_pairs": f"WITH {PAIRS}, c AS (SELECT min(vec_id) AS id FROM embeddings GROUP BY embedding) SELECT a, b, round(score, 4) AS score FROM p WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c) AND (SELECT embedding FROM embeddings WHERE vec_id = a) <> (SELECT embedding FROM embeddings WHERE vec_id = b)",
    "similar_classes": f"""WITH {PAIRS}, c AS (SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id, count(*) OVER (PARTITION BY embedding) AS copies FROM embeddings),
        n AS (SELECT a AS id, count(*) AS links FROM d2 GROUP BY 1) SELECT id, class_id, copies, coalesce(links, 0)::BIGINT AS links FROM c LEFT JOIN n USING (id)""",
    "similar_edges": f"WITH {E4} SELECT * FROM e",
    "neighbor_lists": f"WITH {N4} SELECT * FROM n",
    "clusters": f"WITH RECURSIVE {CLUSTERS} SELECT * FROM cl",
    "cluster_sizes": f"WITH RECURSIVE {CLUSTERS}, s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, round_even(avg(n), 4) AS mean_size FROM s",
    "embedding_overlap": f"WITH {BOTH}, j AS (SELECT e.a AS x, e2.a AS y FROM e FULL JOIN e2 ON e.a = e2.a AND e.b = e2.b) SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS overlap, count(*) AS union_n, round_even(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 4) AS jaccard FROM j",
    "neighbor_changes": f"""WITH {BOTH}, j AS (SELECT coalesce(n.id, n2.id) AS id, n.id AS l, n2.id AS r FROM n FULL JOIN n2 ON n.id = n2.id AND n.neighbor = n2.neighbor),
        c AS (SELECT id, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only FROM j GROUP BY 1)
        SELECT *, left_only + right_only AS difference FROM c ORDER BY difference DESC, id LIMIT 50""",
    "predictions_selected": f"WITH {PRED} SELECT * FROM sel",
    "category_facets": f"WITH {PRED} SELECT * FROM fac",
    "category_communities": f"WITH RECURSIVE {PRED}, {COMMUNITIES} SELECT conversation_id, community FROM fac JOIN found ON found.signature = concat_ws(' | ', category, secondary, tertiary)",
    "signature_groups": f"WITH {PRED} SELECT concat_ws(' | ', category, secondary, tertiary) AS signature, count(*) AS n FROM fac GROUP BY 1",
    "label_examples": """WITH r AS (SELECT coalesce(nullif(trim(regexp_extract(url, '//([^/]+)', 1)), ''), 'Uncategorized') AS label, html AS text, page_id FROM pages),
        n AS (SELECT CASE WHEN count(*) OVER (PARTITION BY upper(label)) < 4 THEN 'Uncategorized' ELSE label END AS label, text, page_id FROM r)
        SELECT arg_min(label, page_id) AS label, arg_min(text, page_id) AS text FROM n WHERE trim(text) <> '' GROUP BY upper(label), upper(text)""",
    "category_agreement": "SELECT count(*) AS rows_n, count(*) FILTER (quality = toxic) AS agreements, count(*) FILTER (toxic IS NOT NULL AND quality <> toxic) AS disagreements, round_even(count(*) FILTER (quality = toxic) / count(*), 4) AS agreement_rate FROM labels",
    "graph_edges": f"""WITH {MSGS}, {KEYWORDS}, {COOC}, {CATEGORIES}, {HIERARCHY}, every AS (
        SELECT p.node_id AS from_id, m.node_id AS to_id, 'reply' AS edge_type, 1.0::DOUBLE AS weight FROM m JOIN m p ON p.conversation_id = m.conversation_id AND p.node_id = m.parent_node_id
        UNION ALL SELECT conversation_id, 'kw:' || keyword, 'has_keyword', score FROM kws WHERE rank < 10
        UNION ALL SELECT conversation_id, 'cat:' || category, 'has_category', 1.0 FROM cats
        UNION ALL SELECT 'kw:' || left_keyword, 'kw:' || right_keyword, 'co_occurs_with', weight FROM cooc
        UNION ALL SELECT 'cat:' || parent, 'cat:' || child, 'category_parent', n FROM steps)
        SELECT from_id, to_id, edge_type, max(weight)::DOUBLE AS weight FROM every GROUP BY 1, 2, 3""",
    "graph_nodes": f"""WITH {MSGS}, {KEYWORDS}, {COOC}, {CATEGORIES}, {HIERARCHY}, known AS (SELECT node_id AS id, CASE WHEN regexp_matches(coalesce(text, ''), '^{SPACE}*$') THEN '' WHEN length(flat) > 80 THEN left(flat, 80) || '...' ELSE flat END AS label, coalesce(role, 'message') AS kind
            FROM (SELECT *, {TRIM("translate(text, chr(13) || chr(10), '  ')")} AS flat FROM m)),
        ends AS (SELECT conversation_id AS id FROM cats UNION SELECT 'cat:' || category FROM cats UNION SELECT 'cat:' || parent FROM steps UNION SELECT 'cat:' || child FROM steps
            UNION SELECT 'kw:' || keyword FROM kws WHERE rank < 10 UNION SELECT 'kw:' || left_keyword FROM cooc UNION SELECT 'kw:' || right_keyword FROM cooc)
        SELECT * FROM known UNION ALL SELECT id, regexp_replace(id, '^(cat|kw):', ''), CASE WHEN id LIKE 'cat:%' THEN 'category' WHEN id LIKE 'kw:%' THEN 'keyword' ELSE 'node' END FROM ends WHERE id NOT IN (SELECT id FROM known)""",
    "bridge_scores": f"""WITH {N4}, {CATALOG}, x AS (SELECT n.id, o.category AS their FROM n JOIN catalog c ON c.id = n.id JOIN catalog o ON o.id = n.neighbor WHERE n.rank <= 12 AND o.category <> c.category),
        k AS (SELECT id, count(DISTINCT their) AS cc, count(*) AS cn FROM x GROUP BY 1),
        r AS (SELECT id, (1 + (secondary IS NOT NULL)::INT + (tertiary IS NOT NULL)::INT)::BIGINT AS facets, coalesce(cc, 0) AS cross_categories, coalesce(cn, 0) AS cross_neighbors FROM catalog LEFT JOIN k USING (id))
        SELECT *, (4 * (facets - 1) + 2 * cross_categories + cross_neighbors)::BIGINT AS bridge_score FROM r ORDER BY bridge_score DESC, id LIMIT 100""",
    "category_blends": f"""WITH {CATALOG}, f AS (SELECT DISTINCT id, category FROM frows)
        SELECT a.category AS left_category, b.category AS right_category, count(*) AS n, array_to_string(list_sort(list(a.id))[1:3], ',') AS examples
        FROM f a JOIN f b ON a.id = b.id AND a.category < b.category GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25""",
    "category_insights": f"""WITH {CATALOG} SELECT category, count(*) FILTER (facet = 'primary') AS primary_n, count(*) FILTER (facet = 'secondary') AS secondary_n, count(*) FILTER (facet = 'tertiary') AS tertiary_n,
        count(DISTINCT id) AS conversations, count(DISTINCT cluster) AS clusters FROM frows GROUP BY 1 ORDER BY conversations DESC, upper(category) LIMIT 20""",
    "cross_category": f"WITH {E4}, {CATALOG} SELECT a, b, weight, l.category AS left_category, r.category AS right_category FROM e JOIN catalog l ON l.id = a JOIN catalog r ON r.id = b WHERE l.category <> r.category ORDER BY weight DESC, a, b LIMIT 100",
    "perspective": f"""WITH {BOTH}, j AS (SELECT coalesce(n.id, n2.id) AS id, n.id AS l, n2.id AS r FROM n FULL JOIN n2 ON n.id = n2.id AND n.neighbor = n2.neighbor),
        c AS (SELECT id, count(*) FILTER (r IS NULL) AS lo, count(*) FILTER (l IS NULL) AS ro FROM j GROUP BY 1),
        x AS (SELECT vec_id AS id, vec_id % 9 = 0 AS disagrees, coalesce(lo, 0) AS left_only, coalesce(ro, 0) AS right_only FROM embeddings LEFT JOIN c ON c.id = vec_id)
        SELECT *, left_only + right_only AS difference, (CASE WHEN disagrees THEN 100 ELSE 0 END + left_only + right_only)::BIGINT AS score, disagrees OR left_only + right_only >= 4 AS strong FROM x ORDER BY score DESC, id LIMIT 100""",
    "primary_categories": f"WITH {CATALOG}, g AS (SELECT cluster, category, count(*) AS n FROM catalog GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, upper(category)) = 1",
    "profile_matrix": f"WITH {RUNS} SELECT * FROM mat",
    "profile_agreement": f"WITH {RUNS} SELECT l.profile AS left_profile, r.profile AS right_profile, count(*) AS compared, round_even(avg((l.category = r.category)::INT), 4) AS match_rate FROM runs l JOIN runs r ON l.id = r.id AND l.profile < r.profile GROUP BY 1, 2",
    "profile_hot_paths": f"WITH {RUNS} SELECT id, max_bridge, categories FROM mat WHERE max_bridge > 0 OR categories > 1 ORDER BY max_bridge DESC, categories DESC, id LIMIT 75",
    "profile_top_bridges": f"WITH {RUNS} SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY bridge_score DESC, id)::INT AS rank, id, bridge_score FROM runs QUALIFY rank <= 15",
    "catalog_selection": f"""WITH {CATALOG}, s AS (SELECT *, lower(concat_ws(' ', category, secondary, tertiary, cluster)) AS search_text FROM catalog)
        SELECT id, search_text FROM s WHERE contains(search_text, 'c1') AND (category IN ('c1', 'c2') OR secondary IN ('c1', 'c2') OR tertiary IN ('c1', 'c2'))""",
    "text_filter": f"WITH {MSGS} SELECT conversation_id, node_id, role FROM m WHERE regexp_matches(text, '(?i)the|plot|chart')",
    "scalar_formats": f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS at, event_type || '_' || user_id AS file_name, ({FNV % 'event_type'})::BIGINT AS fnv, user_id::VARCHAR AS leaf FROM events""",
    "index_edges": f"WITH RECURSIVE {INDEX} SELECT * FROM edges",
    "index_clusters": f"WITH RECURSIVE {INDEX} SELECT cluster, label, summary, category, category AS categories, members, array_to_string(ids, ' | ') AS ids, array_to_string(keywords, ' | ') AS keywords FROM clusters",
    "index_communities": f"WITH RECURSIVE {INDEX} SELECT community, label, summary, category, category AS categories, members, array_to_string(ids, ' | ') AS ids, array_to_string(keywords, ' | ') AS keywords FROM communities",
    "index_summary": f"""WITH RECURSIVE {INDEX} SELECT count(*) AS conversations, (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM communities) AS communities, 0::BIGINT AS with_secondary, 0::BIGINT AS with_tertiary,
        0::BIGINT AS category_disagreements, 0::BIGINT AS embedding_divergences, 0::BIGINT AS strong_signals, count(DISTINCT upper(category)) AS categories,
        (SELECT count(*) FROM sim) AS similarity_edges, (SELECT count(*) FROM cooc) AS keyword_pairs, 'hash' AS embedding_provider, 'hash:384' AS embedding_model FROM cat""",
    "index_nodes": f"""WITH RECURSIVE {INDEX}, known AS (
            SELECT conversation_id AS id, title AS label, 'conversation' AS kind, 1 AS prio FROM titles
            UNION ALL SELECT node_id, CASE WHEN regexp_matches(coalesce(text, ''), '^{SPACE}*$') THEN '' WHEN length(flat) > 80 THEN left(flat, 80) || '...' ELSE flat END, coalesce(role, 'message'), 2
                FROM (SELECT *, {TRIM("translate(text, chr(13) || chr(10), '  ')")} AS flat FROM m)
            UNION ALL SELECT cluster, label, 'topic_cluster', 3 FROM clusters UNION ALL SELECT community, label, 'category_community', 3 FROM communities
            UNION ALL SELECT 'kw:' || keyword, keyword, 'keyword', 2 FROM kws),
        ends AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges UNION SELECT 'kw:' || unnest(keywords) FROM clusters UNION SELECT 'kw:' || unnest(keywords) FROM communities),
        mine AS (SELECT id, arg_max(label, prio) AS label, arg_max(kind, prio) AS kind FROM known GROUP BY 1)
        SELECT id, label, kind FROM mine UNION ALL SELECT id, regexp_replace(id, '^(kw|topic|topiclabel|cat):', ''),
            CASE split_part(id, ':', 1) WHEN 'kw' THEN 'keyword' WHEN 'topic' THEN 'topic' WHEN 'topiclabel' THEN 'topic_label' WHEN 'cat' THEN 'category' WHEN 'cluster' THEN 'topic_cluster' WHEN 'catcomm' THEN 'category_community' ELSE 'node' END
        FROM ends WHERE id NOT IN (SELECT id FROM mine)""",
    "index_catalog": f"""WITH RECURSIVE {CATALOGUE} SELECT conversation_id, title, '(null)' AS created, NULL::VARCHAR AS source_file, branches, category, NULL::VARCHAR AS secondary, NULL::VARCHAR AS tertiary, 'baseline' AS category_source,
        community, community_label, cluster, cluster_label, cluster_summary, topic_label, NULL::VARCHAR AS model_summary, array_to_string(topics, ' | ') AS topics, array_to_string(keyword_list, ' | ') AS keywords,
        '1:' || category || ':7500:baseline:true' AS predictions, '../transcripts/' || url_encode(name) || '.txt' AS transcript_path,
        lower(concat_ws(' ', title, category, community_label, topic_label, cluster_label, nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(kw, ' '), ''))) AS search_text, false AS category_disagrees, NULL::VARCHAR AS baseline_category, NULL::VARCHAR AS ml_category,
        NULL::VARCHAR AS selected_source, NULL::VARCHAR AS selected_category, 0::BIGINT AS perspective_score, 0::BIGINT AS embedding_differences, (2 * len(coalesce(others, [])) + coalesce(crossed, 0))::BIGINT AS bridge_score,
        coalesce(crossed, 0)::BIGINT AS cross_category_neighbors, array_to_string(coalesce(others, []), ' | ') AS neighbor_categories, neighbors, false AS strong_signal FROM catalogue""",
    "index_examples": f"""WITH RECURSIVE {CATALOGUE},
        r AS (SELECT conversation_id, started, category AS label, concat_ws(chr(10), CASE WHEN title <> '(untitled)' THEN title END, nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(kw[1:12], ' '), ''), CASE WHEN NOT regexp_matches(corpus, '^{SPACE}*$') THEN corpus END) AS text
            FROM catalogue JOIN corpora USING (conversation_id) JOIN (SELECT conversation_id, min(create_time) AS started FROM m GROUP BY 1) USING (conversation_id)),
        n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY upper(label)) < 4 THEN 'Uncategorized' ELSE label END AS named, row_number() OVER (ORDER BY started NULLS LAST, conversation_id) AS place FROM r),
        f AS (SELECT arg_min(named, place) AS label, arg_min(text, place) AS text FROM n WHERE trim(text) <> '' GROUP BY upper(named), upper(text))
        SELECT label, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM f""",
    "index_transcripts": f"""WITH RECURSIVE {CATALOGUE}, {PATHS},
        said AS (
            SELECT conversation_id, node_id, '[' || coalesce(role, 'unknown') || '] Node=' || node_id || ' Parent=' || coalesce(parent_node_id, '') || ' Time=' || strftime(make_timestamp((create_time * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%SZ') || ' ContentType=' || chr(10)
                || CASE WHEN regexp_matches(coalesce(text, ''), '^{SPACE}*$') THEN '' ELSE regexp_replace(text, '\\s+$', '') || chr(10) END || chr(10) || repeat('-', 80) || chr(10) || chr(10) AS part FROM m),
        last AS (SELECT conversation_id, arg_max(leaf, lt) AS leaf FROM up WHERE back = 0 GROUP BY 1),
        bodies AS (
            SELECT conversation_id, branch, string_agg(part, '' ORDER BY pos) AS body FROM paths JOIN said USING (conversation_id, node_id) GROUP BY 1, 2
            UNION ALL SELECT conversation_id, 0, string_agg(part, '' ORDER BY pos) FROM paths JOIN last USING (conversation_id, leaf) JOIN said USING (conversation_id, node_id) GROUP BY 1),
        shared AS (
            SELECT *, 'Title: ' || title || chr(10) || 'ConversationId: ' || conversation_id || chr(10) AS head, 'Category: ' || category || chr(10) AS facets,
                'CategoryCommunity: ' || community || chr(10) || 'CategoryCommunityLabel: ' || community_label || chr(10) || CASE WHEN chunk_n > 0 THEN 'ChunkCount: ' || chunk_n || chr(10) ELSE '' END || 'Topics: ' || array_to_string(topics, ', ') || chr(10)
                || CASE WHEN topic_label <> '' THEN 'TopicLabel: ' || topic_label || chr(10) ELSE '' END || 'TopicCluster: ' || cluster || chr(10) || 'TopicClusterLabel: ' || cluster_label || chr(10) AS mid FROM catalogue)
        SELECT conversation_id, branch, CASE WHEN branch = 0 THEN name ELSE name || '__branch-' || lpad(branch::VARCHAR, 3, '0') END AS name,
            sha256(CASE WHEN branch = 0 THEN head || 'SourceFile: ' || chr(10) || 'Created: (null)' || chr(10) || 'CurrentNode: ' || chr(10) || facets || 'CategorySource: baseline' || chr(10) || mid || 'TopicClusterSummary: ' || cluster_summary || chr(10)
                || 'Keywords: ' || array_to_string(shown_keywords, ', ') || chr(10) || 'CategoryCandidates: ' || category || ':0.75 [baseline,selected]' || chr(10) || repeat('=', 80) || chr(10) || chr(10)
                ELSE head || 'Branch: ' || branch || chr(10) || facets || mid || repeat('-', 80) || chr(10) || chr(10) END || coalesce(body, '')) AS document_sha256
        FROM shared JOIN bodies USING (conversation_id)""",
    "prediction_edges": f"""WITH {PRED} SELECT s.conversation_id AS from_id, 'cat:' || s.category AS to_id,
        CASE WHEN s.category = f.category THEN 'has_category' WHEN s.category = f.secondary THEN 'has_secondary_category' WHEN s.category = f.tertiary THEN 'has_tertiary_category' ELSE 'candidate_category' END AS edge_type,
        CASE WHEN s.category = f.category THEN greatest(1.0, s.score) ELSE s.score END::DOUBLE AS weight FROM sel s JOIN fac f USING (conversation_id)""",
    "prediction_comparison": f"""WITH {PRED} SELECT b.conversation_id, b.category AS baseline, m.category AS model, m.score AS model_score, s.source AS selected_source, s.category AS selected, b.category = m.category AS agrees
        FROM pred b JOIN pred m ON m.conversation_id = b.conversation_id AND m.pos = 1 JOIN sel s ON s.conversation_id = b.conversation_id AND s.rank = 1 WHERE b.pos = 0""",
    "label_distribution": "SELECT regexp_extract(url, '//([^/]+)', 1) AS label, count(*) AS n FROM pages GROUP BY 1",
    "perspective_summary": f"""WITH {BOTH}, j AS (SELECT coalesce(n.id, n2.id) AS id, n.id AS l, n2.id AS r FROM n FULL JOIN n2 ON n.id = n2.id AND n.neighbor = n2.neighbor),
        c AS (SELECT id, count(*) FILTER (r IS NULL OR l IS NULL) AS d FROM j GROUP BY 1),
        x AS (SELECT vec_id % 9 = 0 AS wrong, coalesce(d, 0) AS d FROM embeddings LEFT JOIN c ON c.id = vec_id)
        SELECT count(*) FILTER (wrong) AS category_disagreements, count(*) FILTER (d > 0) AS embedding_divergences, count(*) FILTER (wrong OR d >= 4) AS strong_signals FROM x""",
    "profile_summaries": f"WITH {RUNS} SELECT profile, count(*) AS conversations, count(DISTINCT category) AS categories, 1::BIGINT AS clusters, count(*) FILTER (bridge_score > 0) AS bridges, round_even(avg(bridge_score), 3) AS mean_bridge FROM runs GROUP BY 1",
    "profile_full_matrix": f"""WITH {RUNS}, r AS (SELECT *, lower(category) AS topic_label, CASE WHEN id % 2 = 0 THEN category END AS cluster_label FROM runs)
        SELECT id, 't' || id AS title, count(*) AS profiles, count(DISTINCT category) AS categories, array_to_string(list_sort(list(DISTINCT category)), ' | ') AS category_list, string_agg(profile || '=' || category, '; ' ORDER BY profile) AS category_map,
        count(DISTINCT topic_label) AS topic_labels, array_to_string(list_sort(list(DISTINCT topic_label)), ' | ') AS topic_list, string_agg(profile || '=' || topic_label, '; ' ORDER BY profile) AS topic_map,
        count(DISTINCT cluster_label) AS cluster_labels, coalesce(array_to_string(list_sort(list(DISTINCT cluster_label) FILTER (cluster_label IS NOT NULL)), ' | '), '') AS cluster_list, coalesce(string_agg(profile || '=' || cluster_label, '; ' ORDER BY profile), '') AS cluster_map,
        max(bridge_score) AS max_bridge, round_even(avg(bridge_score), 3) AS avg_bridge, max(bridge_score * 2) AS max_perspective, round_even(avg(bridge_score * 2), 3) AS avg_perspective
        FROM r GROUP BY id HAVING max(bridge_score) > 0 OR count(DISTINCT category) > 1 ORDER BY max_bridge DESC, max_perspective DESC, upper(title), id LIMIT 75""",
    "score_softmax": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v)
        SELECT id, (i - 1)::INT AS pos, round(e[i] / list_sum(e), 9) AS score FROM e, unnest(range(1, len(e) + 1)) AS q(i)""",
    "scalar_labels": r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(trim(translate(p_type || '_' || p_name, '_-', '  ')), '\p{L}[\p{L}\p{M}\p{N}'']*|[^\p{L}]+'),
        lambda w: CASE WHEN regexp_matches(w, '^\p{L}') AND regexp_matches(w, '\p{Ll}') THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), '') AS label,
        url_encode(p_name) AS href, regexp_replace(regexp_replace(round(CAST(p_retailprice / 7 AS DECIMAL(38, 12)), 3)::VARCHAR, '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS price FROM part""",
}
