"""SQL of the numbered operators that DuckDB can express."""

from __future__ import annotations

from corpusforge.llm import secrets
from corpusforge.llm.common import LOWER, UPPER

_ESCAPE = "regexp_replace({}, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"

OP6_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(%ROLE%) + 1 + length(%TEXT%) + 8)::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM rows GROUP BY conv_id
"""

#: DuckDB's patterns have no back references, so six equal characters are spelled out for each character of a token.
_SIX = "|".join(f"{'[+]' if c == '+' else c}{{6}}" for c in LOWER + "0123456789+/_-")
_DUMMY = secrets.DUMMY.replace("(.)\\1{5}", _SIX)


def _found(rank: int, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT r, {rank} AS rank, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM src WHERE regexp_matches(t, '{p}')"


OP1_SQL = f"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repo FROM documents),
found AS ({_found(0, secrets.ASSIGN, 2)} UNION ALL {_found(1, secrets.ACCESS)} UNION ALL {_found(2, secrets.HEX)} UNION ALL {_found(3, secrets.TOKEN)}),
parts AS (SELECT r, rank, unnest(b[1:len(m)]) AS b, unnest(m) AS m, unnest(v) AS value, generate_subscripts(m, 1) AS i FROM found),
ends AS (SELECT r, rank, value, length(m) AS n, (sum(length(b) + length(m)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS "end" FROM parts),
spans AS (
  SELECT r, rank, "end" - n AS start, "end", value, list_value('assign', 'access', 'hex', 'live')[rank + 1] || ':' || ("end" - n) || ':' || "end" AS shown FROM ends
  WHERE CASE rank WHEN 0 THEN length(value) >= 6
    WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(value, '{_DUMMY}')
    ELSE true END
),
counted AS (
  SELECT value, owners, repos FROM (SELECT value, count(*) AS owners FROM (SELECT DISTINCT value, owner FROM spans JOIN src USING (r)) GROUP BY value)
  JOIN (SELECT value, count(*) AS repos FROM (SELECT DISTINCT value, repo FROM spans JOIN src USING (r)) GROUP BY value) USING (value)
),
held AS (
  SELECT s.*, owners, repos, owners >= 3 OR repos >= 5 AS copied,
    rank = 3 AND owners < 3 AND repos < 5 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = s.r AND b.rank < 3 AND b.start <= s.start AND b."end" >= s."end") AS added
  FROM spans s JOIN counted USING (value)
),
per AS (
  SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY start, rank, "end") FILTER (WHERE rank < 3) AS base,
    string_agg(shown, ',' ORDER BY start, rank, "end") FILTER (WHERE rank < 3 OR added) AS spans, count(*) FILTER (WHERE added) AS n_live,
    count(DISTINCT value) FILTER (WHERE rank < 3 AND copied) AS n_copied, count(DISTINCT value) FILTER (WHERE rank < 3 AND NOT copied) AS n_owned,
    max(owners) AS max_owners, max(repos) AS max_repos
  FROM held GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned,
  coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM src LEFT JOIN per USING (r)
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = f"""
WITH items AS (SELECT DISTINCT item_id::VARCHAR AS item_id, words, least(13, len(words)) AS m FROM (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL) WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
grams AS (
  SELECT r, m, i, array_to_string(words[i:i + m - 1], ' ') AS gram
  FROM (SELECT r, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM items) WHERE len(words) >= m)
),
met AS (SELECT r, item_id, i, m FROM grams JOIN windows USING (m, gram)),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT r, i, m FROM met)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


OP11_SQL = f"""
WITH words AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)
),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS c FROM (
    SELECT lang, k, w[i:i + k - 1] AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  ) GROUP BY ALL
),
sizes AS (SELECT lang, sum(c)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
big AS MATERIALIZED (SELECT * FROM f WHERE c >= 100),
longer AS (
  SELECT lang, part, max(c) AS c FROM (SELECT lang, phrase[1:k - 1] AS part, c FROM big WHERE k > 2 UNION ALL SELECT lang, phrase[2:k] AS part, c FROM big WHERE k > 2) GROUP BY ALL
),
kept AS (SELECT b.lang, b.k, b.phrase, b.c AS a FROM big b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.phrase WHERE b.k > 1 AND (o.c IS NULL OR o.c < b.c)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scores AS (
  SELECT q.lang, q.phrase, q.a, q.cut, x.c AS l, y.c AS r, n, (1000::HUGEINT * q.a * n) // (x.c::HUGEINT * y.c) AS score
  FROM cuts q JOIN big x ON x.lang = q.lang AND x.phrase = q.phrase[1:q.cut] JOIN big y ON y.lang = q.lang AND y.phrase = q.phrase[q.cut + 1:q.k] JOIN sizes s ON s.lang = q.lang
),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM scores),
ranked AS (SELECT *, array_to_string(phrase, ' ') AS shown, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM low WHERE first = 1)
SELECT lang, rank, shown AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_TERMS = f"list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
sized AS MATERIALIZED (SELECT d, doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
stats AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM sized),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
posted AS MATERIALIZED (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), stats),
scores AS (
  SELECT item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN (SELECT d, n FROM sized) USING (d), stats GROUP BY item_id, d
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN (SELECT d, doc_id FROM sized) USING (d) WHERE score > 0
) WHERE rank <= 50
"""

def oracle_sql() -> dict[str, str]:
    role = _ESCAPE.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")
    return {
        "op1_secret_scans": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op6_chat_formatting": OP6_SQL.replace("%ROLE%", role).replace("%TEXT%", _ESCAPE.format("text")),
        "op11_phrase_collocations": OP11_SQL, "op12_ranked_search": OP12_SQL,
    }
