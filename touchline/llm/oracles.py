"""DuckDB SQL for the operators that SQL can express: mixing (5), quality rules (6), lexical search (12), license scans (13)."""

from __future__ import annotations

from . import licenses, mixing, quality, search

_WORD = r"[^\x20\x09-\x0D]"


def _list(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


#: The schedule is simulated slot by slot: of the released blocks the one with the earliest deadline.
OP5 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'none') AS s, ('0x' || substr(md5(doc_id::VARCHAR), 1, {mixing.HASH_DIGITS}))::BIGINT AS h FROM documents
), counts AS (SELECT s, count(*) AS n FROM docs GROUP BY s),
k AS (SELECT greatest({mixing.SLOTS}, 4 * count(*)) AS slots, sum(pow(n, {mixing.TEMPERATURE})) AS total FROM counts),
exact AS (SELECT s, n, pow(n, {mixing.TEMPERATURE}) / total * slots AS x, slots FROM counts, k),
floors AS (SELECT *, greatest(floor(x), 1)::BIGINT AS low, row_number() OVER (ORDER BY x - floor(x) DESC, s) AS place FROM exact),
shares AS (
  SELECT s, slots, low + CASE WHEN place <= slots - (SELECT sum(low) FROM floors) THEN 1 ELSE 0 END AS m, row_number() OVER (ORDER BY s) AS j FROM floors
), all_shares AS (SELECT list(m ORDER BY j) AS m, max(slots) AS slots, count(*) AS n FROM shares),
sched AS (
  SELECT 0::BIGINT AS slot, list_transform(m, lambda x: 0::BIGINT) AS served, 0::BIGINT AS pick, m, slots, n FROM all_shares
  UNION ALL
  SELECT slot + 1, list_transform(range(1, n + 1), lambda j: served[j] + (j = best)::BIGINT), best, m, slots, n FROM (
    SELECT *, list_min(list_transform(range(1, n + 1), lambda j: CASE WHEN served[j] < m[j] AND served[j] * slots // m[j] <= slot
      THEN (((served[j] + 1) * slots + m[j] - 1) // m[j] * 1000000 + served[j] * slots // m[j]) * 100000 + j END)) % 100000 AS best
    FROM sched WHERE slot < slots
  )
), places AS (SELECT slot - 1 AS slot, pick AS j, served[pick] AS i FROM sched WHERE pick > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS r FROM docs),
blocks AS (SELECT doc_id, source, r // {mixing.BLOCK_DOCS} + 1 AS block, m, j, slots FROM ranked JOIN shares USING (s))
SELECT doc_id, source, block, (block - 1) * b.slots // m AS release_time, (block * b.slots + m - 1) // m AS deadline,
  (block - 1) // m * b.slots + p.slot AS slot, true AS in_mix
FROM blocks b JOIN places p ON b.j = p.j AND (block - 1) % m + 1 = p.i
"""

_RATES = {
    "symbols": "n_symbols / nw", "dup_lines": "n_dup_lines / nw * 10.0", "repeats": "n_repeat_words / nw", "long_words": "greatest(word_chars / nw - 6.0, 0.0)",
}

OP6 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0) || 'none') AS own, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, own, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS nw FROM counts
), scored AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _RATES.items())} FROM judged),
labelled AS (
  SELECT s.*, l.quality = 1 AS good, substr(md5(s.doc_id::VARCHAR), 1, 1) < '{quality.FIT_BELOW}' AS fit
  FROM scored s JOIN labels l ON s.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND NOT base_failed
), strata AS (SELECT own FROM labelled GROUP BY own ORDER BY count(*) DESC, own LIMIT {quality.MAX_STRATA}),
named AS (SELECT l.*, l.own AS stratum FROM labelled l JOIN strata s ON l.own = s.own),
rule_scores AS (SELECT rid, stratum, good, fit, rule, score FROM named UNPIVOT (score FOR rule IN ({", ".join(_RATES)}))),
grid AS (SELECT unnest({_list(quality.GRID)})::DOUBLE AS cutoff, unnest(range(1, {len(quality.GRID) + 1})) AS i),
ladder AS (SELECT unnest({_list(quality.LADDER)})::DOUBLE AS weight, unnest(range(1, {len(quality.LADDER) + 1})) AS step),
reached AS (
  SELECT stratum, rule, i, cutoff, count(*) FILTER (NOT good AND score >= cutoff) AS b, count(*) FILTER (good AND score >= cutoff) AS g,
    greatest(count(*) FILTER (NOT good), 1)::DOUBLE AS m, greatest(count(*) FILTER (good), 1)::DOUBLE AS n
  FROM rule_scores, grid WHERE fit GROUP BY ALL
), sequence AS (
  SELECT step, stratum, rule, cutoff FROM reached, ladder WHERE b / m - weight * g / n > 0
  QUALIFY row_number() OVER (PARTITION BY step, stratum, rule ORDER BY b / m - weight * g / n DESC, i) = 1
), held AS (SELECT DISTINCT rid, stratum FROM named WHERE good AND NOT fit),
sizes AS (SELECT stratum, count(*) AS n FROM named WHERE good AND NOT fit GROUP BY stratum),
hits AS (
  SELECT q.step, h.stratum, count(DISTINCT h.rid) AS k FROM held h JOIN rule_scores r ON r.rid = h.rid AND r.stratum = h.stratum
  JOIN sequence q ON q.stratum = h.stratum AND q.rule = r.rule AND r.score >= q.cutoff GROUP BY ALL
), steps AS (
  SELECT l.step, s.stratum, s.n, coalesce(h.k, 0) AS k, {quality.ERROR} / (SELECT greatest(count(*), 1) FROM strata) AS level
  FROM ladder l CROSS JOIN sizes s LEFT JOIN hits h ON h.step = l.step AND h.stratum = s.stratum
), tested AS (
  SELECT step, stratum, k <= n * {quality.RISK} AND (k < n) AND (
    SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK}))) FROM unnest(range(0, k + 1)) AS u(i)
  ) <= level AS safe FROM steps
), chosen AS (
  SELECT stratum, max(step) AS step FROM tested t WHERE NOT EXISTS (SELECT 1 FROM tested f WHERE f.stratum = t.stratum AND f.step <= t.step AND NOT f.safe) GROUP BY stratum
), cutoffs AS (SELECT stratum, rule, cutoff FROM sequence JOIN chosen USING (stratum, step)),
bad AS (
  SELECT DISTINCT rid FROM (
    SELECT s.*, s.own AS stratum FROM scored s JOIN strata t ON s.own = t.own
  ) UNPIVOT (score FOR rule IN ({", ".join(_RATES)})) JOIN cutoffs USING (stratum, rule) WHERE score >= cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.rid IS NULL AS kept
FROM scored LEFT JOIN bad b USING (rid)
"""



def _texts(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _cut(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{pattern}')"


_PHRASES = " UNION ALL ".join(
    f"SELECT r, i - 1 AS i, '{label}' AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i] = '{phrase.split()[0]}' AND list_slice(ws, i, i + {len(phrase.split()) - 1}) = {_texts(phrase.split())}"
    for phrase, label in licenses.PHRASES.items()
)
_TEMPLATES = ", ".join(f"('{t.label}', {_texts(t.words)}, {licenses.need(len(t.words), licenses.THRESHOLD)}, {t.size})" for t in licenses.template_sets(licenses.TEMPLATES))
_STARTS = " UNION ALL ".join(
    f"SELECT r, ws, {k} AS size, {block} AS n, unnest(range(0, greatest(0, ceil((len(ws) - {block}) / {step}))::BIGINT + 1)) * {step} AS s FROM d" for k, (block, step) in enumerate(licenses.SIZES)
)

#: Every block of every text is held against every template.
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_cut("text", licenses.WORD)} AS ws FROM documents),
phrases AS ({_PHRASES}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM phrases GROUP BY r),
starts AS ({_STARTS}),
blocks AS (SELECT r, size, list_distinct(list_slice(ws, s + 1, s + n)) AS b FROM starts),
templates(label, words, least, size) AS (VALUES {_TEMPLATES}),
shared AS (SELECT r, label, len(list_filter(words, lambda w: list_contains(b, w))) AS n, len(words) AS m, least FROM blocks JOIN templates USING (size)),
found AS (SELECT r, label, n / m AS containment FROM shared WHERE n >= least),
best AS (SELECT r, max(containment) AS best FROM found GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM phrases) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN named USING (r)
"""

#: Every document that holds a term of an item is scored.
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_cut("text", search.PATTERN)} AS ws FROM documents),
t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
lengths AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
q AS (SELECT DISTINCT item_id, unnest({_cut("text", search.PATTERN)}) AS w FROM benchmark),
df AS (SELECT w, count(*) AS df FROM t WHERE w IN (SELECT w FROM q) GROUP BY w),
weights AS (SELECT item_id, w, floor(1000 * ln((2.0 * nn + 2)::DOUBLE / (2.0 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN df USING (w), total),
hits AS (
  SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM weights JOIN t USING (w) JOIN lengths USING (r), total GROUP BY item_id, r
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM hits JOIN lengths USING (r) WHERE score > 0
) WHERE rank <= {search.K}
"""

ORACLES = {"op5_mixing": OP5, "op6_quality_rules": OP6, "op12_lexical_search": OP12, "op13_licenses": OP13}
