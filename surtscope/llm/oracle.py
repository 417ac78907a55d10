"""Plain SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from surtscope.llm.quality_rules import RULES, STOP_WORDS

_SPACE = r"\x20\x09-\x0D"

EXACT_DEDUP = rf"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[{_SPACE}]', '', 'g')) AS text_sha256
    FROM documents
), best AS (
    SELECT text_sha256, count(*) AS group_size, max(points) AS most FROM d GROUP BY text_sha256
), winner AS (
    SELECT text_sha256, min(doc_id) AS keep_id, any_value(group_size) AS group_size, any_value(most) AS most
    FROM d JOIN best USING (text_sha256) WHERE points = most GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND points = most AS kept, text_sha256
FROM d JOIN winner USING (text_sha256)
"""

WARC_INDEX = """
WITH p AS (
    SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
    SELECT sha, payload_bytes, min(page_id) AS first FROM p GROUP BY ALL
)
SELECT page_id, url, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (('0x' || substr(sha, bit // 20 * 5 + 1, 5))::INT >> (15 - bit % 20)::INT & 31) + 1, 1)
           for bit in range(0, 160, 5)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (sha, payload_bytes)
"""

LEXICAL_SEARCH = r"""
WITH word AS (
    SELECT r, doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, doc_id,
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
), tf AS (
    SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM word GROUP BY r, term
), doc AS (
    SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r
), totals AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc
), df AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs
), asked AS (
    SELECT DISTINCT item, item_id, term FROM (
        SELECT item, item_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id,
                     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
              FROM (SELECT DISTINCT item_id, text FROM benchmark)))
), scored AS (
    SELECT item, item_id, r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN doc USING (r), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def _holds(rule) -> str:
    bounds = [f"{rule.measure} >= {rule.low}"] if rule.low is not None else []
    holds = " AND ".join(bounds + ([f"{rule.measure} <= {rule.high}"] if rule.high is not None else []))
    return f"({rule.unless[0]} > {rule.unless[1]} OR {holds})" if rule.unless else holds


def quality_rules_sql(rules=RULES) -> str:
    """The measures counted word by word and line by line, then the same thresholds."""
    ratio = "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0.0 END".format
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " AND ".join(_holds(r) for r in rules)
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents
), split AS (
    SELECT r, regexp_extract_all(body, '[^{_SPACE}]+') AS words FROM d
), word AS (
    SELECT r, unnest(words) AS a, unnest(range(len(words))) AS i FROM split
), triple AS (
    SELECT r, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM word WINDOW w AS (PARTITION BY r ORDER BY i)
), again AS (
    SELECT r, i FROM triple WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), covered AS (
    SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), counted AS (
    SELECT r, count(*) AS n, sum(length(a))::BIGINT AS chars, count_if(lower(a) IN ({stop}))::BIGINT AS stops
    FROM word GROUP BY r
), line AS (
    SELECT r, l FROM (SELECT r, unnest(string_split(body, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^{_SPACE}]')
), lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup,
           count_if(regexp_matches(l, '(\.\.\.|…)[{_SPACE}]*$'))::BIGINT AS n_ellipsis,
           count_if(regexp_matches(l, '^[{_SPACE}]*[-*•]'))::BIGINT AS n_bullet
    FROM line GROUP BY r
), m AS (
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(chars, 0) AS word_chars,
           length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(body) - length(regexp_replace(body, '[^\x{{0}}-\x{{24F}}]', '', 'g')) AS n_other_script,
           coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
           coalesce(n_lines, 0) AS n_lines, coalesce(stops, 0) AS n_stop_words,
           coalesce(n_ellipsis, 0) AS n_ellipsis_lines, coalesce(n_bullet, 0) AS n_bullet_lines
    FROM d LEFT JOIN counted USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), ratios AS (
    SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbol_ratio,
           {ratio("n_stop_words", "n_words")} AS stop_word_ratio,
           {ratio("n_other_script", "word_chars")} AS other_script_ratio,
           {ratio("n_repeat_words", "n_words")} AS repeat_word_ratio, {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio,
           {ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio,
           {ratio("n_bullet_lines", "n_lines")} AS bullet_line_ratio
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {verdict} AS kept,
       mean_word_chars, symbol_ratio, stop_word_ratio, dup_line_ratio
FROM ratios
"""
