"""The queries of this package that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from taquilla.llm import licenses, quality_rules
from taquilla.llm.queries import CONTROL_CONVERSATION


def _words(text: str) -> str:
    return (
        rf"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), "
        "lambda x: x <> '')"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRING_DEDUP = f"""
WITH words AS (
  SELECT doc_id, {_words("text")} AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50
), edges AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS edge FROM starts
), sources AS (
  SELECT edge, min(doc_id) AS source FROM edges GROUP BY edge
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM edges JOIN sources USING (edge) WHERE source < doc_id
), gone AS (
  SELECT doc_id, list(i) AS positions, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE
         list_filter(w, lambda x, i: NOT list_contains(positions, i)) END, ' ')) AS kept_sha256
FROM words d LEFT JOIN gone USING (doc_id)
"""

_OWN = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_CONVERSATION)
_CONTROLS = r"\\|<s>|\[INST\]|\[/INST\]|</s>"

CHAT_FORMATTING = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT * FROM (VALUES {_OWN}) own)
), sized AS (
  SELECT *,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    9 + 7 + 4 + len(role) + len(text)
      + len(regexp_extract_all(role, '{_CONTROLS}'))
      + len(regexp_extract_all(text, '{_CONTROLS}')) AS size
  FROM turns
), used AS (
  SELECT *,
    count(*) FILTER (role = 'assistant') OVER later AS trained_after,
    max(CASE WHEN role = 'assistant' THEN place ELSE 0 END) OVER (PARTITION BY conv_id) AS last_one,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized
  WINDOW later AS (PARTITION BY conv_id ORDER BY place
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
    sum(size * (trained_after + CASE WHEN last_one < n THEN 1 ELSE 0 END)) AS formatted_chars
  FROM used GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, len(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM told
"""

_SPACE = r"'[\x20\x09-\x0D]'"
_RULE_VALUES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "repeated_words": "n_repeat_words / nullif(n_words, 0)",
    "repeated_lines": "n_dup_lines / nullif(n_lines, 0)",
    "shouting": "n_shouts / nullif(word_chars, 0)",
    "few_words": "1.0 - n_distinct_words / nullif(n_words, 0)",
}
_RISK = quality_rules.ALPHA / len(_RULE_VALUES)
_LEVEL = quality_rules.DELTA / len(_RULE_VALUES)

QUALITY_RULES = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         {_words("text")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_replace(x, {_SPACE}, '', 'g') <> '') AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} AS three
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), measures AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words,
    len(regexp_replace(text, {_SPACE}, '', 'g'))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    len(text) - len(replace(text, '!', '')) AS n_shouts,
    len(list_distinct(w)) AS n_distinct_words
  FROM words LEFT JOIN covered USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures
), known AS (
  SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id
), rules AS (
  {" UNION ALL ".join(
      f"SELECT doc_id, stratum, base_failed, '{name}' AS rule, coalesce({value}, 0.0) AS v FROM based"
      for name, value in _RULE_VALUES.items()
  )}
), cuts AS (
  SELECT n AS step, (39 - n) / 40 AS cutoff FROM range(0, 39) r(n)
), labelled AS (
  SELECT stratum, rule, quality, v FROM rules JOIN known USING (doc_id)
  WHERE NOT base_failed AND quality IS NOT NULL
), tried AS (
  SELECT stratum, rule, step, cutoff,
    count(*) FILTER (quality = 1) AS n,
    count(*) FILTER (quality = 1 AND v >= cutoff) AS good,
    count(*) FILTER (quality = 0 AND v >= cutoff) AS bad
  FROM labelled CROSS JOIN cuts GROUP BY ALL
), judged AS (
  SELECT *, good < n * {_RISK} AND list_sum(list_transform(range(0, good + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
          + j * ln({_RISK}) + (n - j) * ln(1 - {_RISK}))))
      <= {_LEVEL} / (SELECT count(DISTINCT stratum) FROM labelled) AS harmless
  FROM tried
), proven AS (
  SELECT * FROM judged
  QUALIFY bool_and(harmless) OVER (PARTITION BY stratum, rule ORDER BY step)
), chosen AS (
  SELECT stratum, rule, cutoff FROM proven WHERE bad > {quality_rules.PRICE} * good
  QUALIFY row_number() OVER (
    PARTITION BY stratum, rule ORDER BY bad - {quality_rules.PRICE} * good DESC, cutoff DESC) = 1
), failed AS (
  SELECT DISTINCT doc_id FROM rules JOIN chosen USING (stratum, rule) WHERE v >= cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM based
"""


def _canonical(text: str) -> str:
    line = licenses.COPYRIGHT_LINE.replace("(?i)", "(?im)")
    form = f"lower(regexp_replace({text}, '{line}', ' ', 'g'))"
    form = rf"' ' || trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for spelling, other in licenses.EQUIVALENT:
        form = f"replace({form}, ' {spelling} ', ' {other} ')"
    return f"trim({form})"


LICENSE_SCAN = f"""
WITH given(license, text) AS (
  VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.KNOWN)}
), known AS (
  SELECT form, min(license) AS license
  FROM (SELECT license, {_canonical("text")} AS form FROM given) WHERE form <> '' GROUP BY form
), units AS (
  SELECT doc_id, true AS whole, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
), found AS (
  SELECT doc_id, whole, license
  FROM (SELECT doc_id, whole, {_canonical("unit")} AS form FROM units) JOIN known USING (form)
), per_doc AS (
  SELECT doc_id, min(license) FILTER (whole) AS whole_license,
    count(*) FILTER (NOT whole) AS n_notices,
    string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, whole_license, coalesce(n_notices, 0)::BIGINT AS n_notices,
       coalesce(licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""

PHRASE_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM places CROSS JOIN (VALUES (1), (2), (3)) sizes(size) WHERE i + size - 1 <= len(w))
  GROUP BY ALL HAVING count(*) >= 10
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, one.f AS l, two.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (one.f::HUGEINT * two.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN f one ON one.lang = c.lang AND one.phrase = array_to_string(w[1:k], ' ')
  JOIN f two ON two.lang = c.lang AND two.phrase = array_to_string(w[k + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longest
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM candidates WHERE size = 3)
  GROUP BY ALL
), ranked AS (
  SELECT v.*, row_number() OVER (
    PARTITION BY v.lang ORDER BY score DESC, a DESC, encode(v.phrase)) AS rank
  FROM worst v LEFT JOIN inside i ON i.lang = v.lang AND i.phrase = v.phrase
  WHERE v.size = 3 OR longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

EXACT_DEDUP = r"""
WITH forms AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS form FROM documents
), groups AS (
  SELECT form, min(doc_id) AS keep_id, count(*) AS group_size FROM forms GROUP BY form
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(form) AS text_sha256
FROM forms JOIN groups USING (form)
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op4_chat_formatting": CHAT_FORMATTING,
    "op7_quality_rules": QUALITY_RULES,
    "op10_license_scan": LICENSE_SCAN,
    "op11_phrase_collocations": PHRASE_COLLOCATIONS,
    "op13_exact_dedup": EXACT_DEDUP,
}
