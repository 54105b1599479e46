"""Name matching as SQL, where it can be said in SQL."""
from ..operators.match import BED_WORDS, STAFF_WORDS
from .base import register


def vocab(words: dict) -> str:
    exact = " ".join(f"WHEN s = '{t}' THEN '{v}'" for t, v in words.items())
    inside = " ".join(f"WHEN contains(s, '{t}') THEN '{words[t]}'" for t in sorted(words, key=len, reverse=True))
    return f"CASE {exact} {inside} END"


_SAID = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
register("t_said", """
SELECT 'E' || event_id AS utterance_id, CASE k % 6 WHEN 0 THEN f || ' ' || s WHEN 1 THEN f[1:1] || f[3:] || ' ' || s
    WHEN 2 THEN f || ' ' || s || ' ke do sau tablet aaye' WHEN 3 THEN s || ' ' || lower(f) || ' 650 mg'
    WHEN 4 THEN 'hello ' || f ELSE 'haan ji boliye' END AS text
FROM (SELECT event_id, k, split_part(display_name, ' ', 1) AS f, split_part(display_name, ' ', 2) AS s
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) JOIN (SELECT *, split_part(item_id, '#', 2)::BIGINT AS n FROM t_items) ON n = k % 25 + 1)
UNION ALL SELECT 'C' || conv_id || '-' || turn, text FROM conversations
""")
register("t_words", r"""
SELECT utterance_id, text, list_distinct(list_filter_words) AS words FROM (SELECT utterance_id, text,
  [w FOR w IN string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '\b\d+(\.\d+)?\s*(mg|ml|mcg|g|gm|iu|lac|%)?\b', ' ', 'gi'),
    '[\x{0080}-\x{00FF}]', '', 'g')), '[^\p{L}\p{N}]', ' ', 'g'), '\s+') IF w <> ''] AS list_filter_words FROM t_said)
""")
# Indel score of two strings: the common subsequence as the zero bits of one integer, updated per
# character of the first; bit i of a mask says that character i of the second is this one.
def common(a: str, b: str) -> str:
    mask = f"coalesce(list_sum([(1::HUGEINT << (i - 1)::INTEGER) FOR i IN range(1, length({b}) + 1) IF {b}[i:i] = c]), 0)::HUGEINT"
    full = f"((1::HUGEINT << length({b})::INTEGER) - 1)"
    return (f"(length({b}) - bit_count(list_reduce([{mask} FOR c IN string_split({a}, '')], "
            f"lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full})))")


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '\b\d+(\.\d+)?\s*(mg|ml|mcg|g|gm|iu|lac|%)?\b', ' ', 'gi'), '\s+', ' ', 'g'))"""
register("t_names", rf"""
SELECT DISTINCT ON (key) key, item_id, display_name, pos, [w FOR w IN string_split_regex(regexp_replace(regexp_replace(key, '[\x{{0080}}-\x{{00FF}}]', '', 'g'), '[^\p{{L}}\p{{N}}]', ' ', 'g'), '\s+') IF w <> ''] AS words
FROM (SELECT item_id, display_name, {_KEY} AS key, pos FROM (SELECT item_id, display_name,
    unnest([display_name, lower(s || ' ' || f || ' goli'), 'गोली ' || split_part(item_id, '#', 2), lower(f[1:3] || s[1:3])]) AS v, unnest([0, 3, 4, 5]) AS pos
  FROM (SELECT item_id, display_name, split_part(display_name, ' ', 1) AS f, split_part(display_name, ' ', 2) AS s FROM t_items)))
WHERE key <> '' ORDER BY key, display_name, pos, item_id
""")
register("t_name_scores", f"""
WITH u AS MATERIALIZED (SELECT DISTINCT list_sort(words) AS ws FROM t_words WHERE len(words) > 0),
whole AS MATERIALIZED (SELECT ws, item_id, display_name, pos, 1 AS stage, round_even(200.0::DOUBLE * {common("a", "b")} / (length(a) + length(b)), 0)::INTEGER AS score
  FROM (SELECT *, array_to_string(ws, ' ') AS a, array_to_string(list_sort(words), ' ') AS b FROM u, t_names)
  WHERE 200.0::DOUBLE * least(length(a), length(b)) / (length(a) + length(b)) >= 84),
parts AS (SELECT *, array_to_string(list_sort([w FOR w IN list_distinct(ws) IF NOT list_contains(words, w)]), ' ') AS a,
    array_to_string(list_sort([w FOR w IN list_distinct(words) IF NOT list_contains(ws, w)]), ' ') AS b,
    length(array_to_string(list_distinct([w FOR w IN ws IF list_contains(words, w)]), ' ')) AS c
  FROM (SELECT ws FROM u WHERE ws NOT IN (SELECT ws FROM whole WHERE score >= 85)), t_names WHERE length(key) >= 4 AND len(words) > 0),
sized AS (SELECT *, length(a) AS la, length(b) AS lb, (c > 0)::INTEGER AS gap, c + gap + la AS na, c + gap + lb AS nb FROM parts),
inside AS (SELECT ws, item_id, display_name, pos, 2 AS stage, CASE WHEN c > 0 AND (la = 0 OR lb = 0) THEN 100 ELSE round_even(greatest(
    CASE WHEN abs(la - lb) > 0.12 * (na + nb) THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (1.0::DOUBLE - (la + lb - 2 * {common("a", "b")})::DOUBLE / (na + nb)) END,
    CASE WHEN c > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - (gap + la)::DOUBLE / (c + na)) ELSE 0.0::DOUBLE END,
    CASE WHEN c > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - (gap + lb)::DOUBLE / (c + nb)) ELSE 0.0::DOUBLE END), 0)::INTEGER END AS score FROM sized)
SELECT ws, item_id, stage, score FROM (SELECT * FROM whole WHERE score >= 85 UNION ALL SELECT * FROM inside WHERE score >= 90)
QUALIFY row_number() OVER (PARTITION BY ws ORDER BY stage, score DESC, display_name, pos, item_id) = 1
""")
SQL = {
    "L1_match_items": """SELECT utterance_id, text, item_id AS matched_id, stage, score FROM t_words LEFT JOIN t_name_scores ON ws = list_sort(words)""",
    "L1_contained_names": """
        WITH v AS (SELECT item_id, display_name, unnest([[lower(f), lower(s)], [lower(s), lower(f), 'goli'], [lower(f[1:3] || s[1:3])]]) AS ws, unnest([0, 3, 5]) AS pos
          FROM (SELECT item_id, display_name, split_part(display_name, ' ', 1) AS f, split_part(display_name, ' ', 2) AS s FROM t_items))
        SELECT utterance_id, text, (SELECT first(item_id ORDER BY display_name, pos) FROM v WHERE list_has_all(words, ws)) AS matched_id FROM t_words""",
    "L2_match_vocabulary": f"""SELECT conv_id, turn, {vocab(BED_WORDS)} AS bed, {vocab(STAFF_WORDS)} AS staff FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations)""",
    "L3_verify_item_id": "SELECT event_id, item_id AS matched_id, matched_by FROM t_gate",
    "L4_quick_list": """SELECT item_id, display_name, 'गोली ' || split_part(item_id, '#', 2) AS hindi_name,
        lower(split_part(display_name, ' ', 2) || ' ' || split_part(display_name, ' ', 1) || ' goli') AS spoken, unit, ven_class FROM t_items WHERE is_forecast_item""",
}
