"""SQL that the registered queries are checked against, on the same tables."""

from __future__ import annotations

from spanlens.llm.quality import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


SPACED, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words("text", SPACED)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(b) FROM reach WHERE a = s.doc_id) AS component_id FROM s"""

_ESCAPED = (
    "length({t}) + length({t}) - length(replace({t}, chr(92), '')) "  # a backslash for each backslash
    "+ length(regexp_replace({t}, '[^#]', '', 'g')) - length(regexp_replace(regexp_replace({t}, '#+', chr(1), 'g'), '[^\\x01]', '', 'g')) "
    "+ (length({t}) - length(replace({t}, '</turn>', ''))) // 7"
)
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(4 + length(role) + 2 + {_ESCAPED.format(t="text")} + 9) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

LEAKS = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text", PLAIN)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len AS n, list_slice(w, i, i + len - 1) AS win
    FROM (SELECT item, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words("text", PLAIN)} AS w FROM documents),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
n AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
    CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '[^\x20\x09-\x0D]') ORDER BY p) END AS k FROM l),
w AS (SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM n WHERE worded WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w WHERE win IS NOT NULL),
c AS (SELECT DISTINCT doc_id, k + o AS k FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE nth > 1),
m AS (SELECT n.*, c.k IS NOT NULL AS gone FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.k = c.k),
t AS (SELECT doc_id, count(k) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN d.text WHEN n_removed = n_lines THEN '' ELSE kept END AS text FROM documents d JOIN t USING (doc_id)"""


def _quality(risk: float = 0.04, error: float = 0.05, price: float = 10.0) -> str:
    share = risk / len(RULES)
    values = ", ".join(f"('{rule}', {step}, {float(cut)!r}::DOUBLE)" for rule, (_, cuts) in RULES.items() for step, cut in enumerate(cuts))
    measure = "CASE rule " + " ".join("WHEN '{0}' THEN CASE WHEN {2} > 0 THEN CAST({1} AS DOUBLE) / {2} END".format(r, *m.split(" / ")) for r, (m, _) in RULES.items()) + " END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{SPACED}')) AS l FROM documents),
v AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS k FROM v) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
grid(rule, step, cutoff) AS (VALUES {values}),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
cells AS (SELECT lang, rule, step, cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND {measure} > cutoff) AS k,
        count(*) FILTER (WHERE quality = 0 AND {measure} > cutoff) AS good
    FROM f JOIN q USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * {share} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))
        FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p FROM cells),
worst AS (SELECT lang, rule, max(p) AS worst, row_number() OVER (ORDER BY max(p), lang NULLS FIRST, rule) AS place, count(*) OVER () AS chains FROM tail GROUP BY lang, rule),
whole AS (SELECT *, min(CAST(worst <= {error} / (chains - place + 1) AS INT)) OVER (ORDER BY place) AS whole FROM worst),
level AS (SELECT lang, rule, whole, {error} / greatest(1, chains - sum(whole) OVER ()) AS level FROM whole),
passed AS (SELECT t.*, greatest(whole, min(CAST(p <= level AS INT)) OVER (PARTITION BY t.lang, t.rule ORDER BY step ROWS UNBOUNDED PRECEDING)) AS ok
    FROM tail t JOIN level l ON t.lang IS NOT DISTINCT FROM l.lang AND t.rule = l.rule),
cut AS (SELECT lang, rule, cutoff FROM passed WHERE ok = 1 AND good - {price} * k > 0
    QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY good - {price} * k DESC, step) = 1),
over AS (SELECT DISTINCT doc_id FROM f JOIN cut ON f.lang IS NOT DISTINCT FROM cut.lang WHERE {measure} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM f"""


MIXING = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
fill(clamped, level, again) AS (
    SELECT CAST(0 AS BIGINT), CAST((SELECT sum(source_size) FROM s) * 1.5 AS DOUBLE) / (SELECT sum(weight) FROM s), true
    UNION ALL
    SELECT n, CASE WHEN n = (SELECT count(*) FROM s) THEN NULL ELSE rest / open END, n > clamped AND n < (SELECT count(*) FROM s) FROM (
        SELECT clamped, count(*) FILTER (WHERE shut) AS n, CAST(sum(weight) FILTER (WHERE NOT shut) AS DOUBLE) AS open,
            CAST(sum(source_size) * 1.5 AS DOUBLE) - coalesce(CAST(sum(2.0 * source_size) FILTER (WHERE shut) AS DOUBLE), 0.0) AS rest
        FROM (SELECT f.clamped, s.*, 2.0 * source_size < weight * f.level AS shut FROM fill f, s WHERE f.again) GROUP BY clamped)),
goal AS (SELECT level FROM fill ORDER BY clamped DESC, again LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(2.0 * source_size, weight * (SELECT level FROM goal)), 2.0 * source_size)::DOUBLE AS target FROM s),
x AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS reps FROM g),
o AS (SELECT d.doc_id, d.size, x.*, round(target)::BIGINT - reps * source_size AS extra,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(reps * size + greatest(0, least(size, extra - ahead)) AS BIGINT) AS taken FROM o"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text", TERM)} AS w FROM documents),
l AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
m AS (SELECT r, doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM l, t),
i AS (SELECT row_number() OVER () AS item, item_id, {words("text", TERM)} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, t GROUP BY term),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN v USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

ORACLES = {
    "op1_jaccard_join": JACCARD,
    "op4_chat_formatting": CHAT,
    "op5_benchmark_decontamination": LEAKS,
    "op6_line_dedup": LINES,
    "op7_quality_rules": _quality(),
    "op9_mixing": MIXING,
    "op11_lexical_search": RANKING,
}
