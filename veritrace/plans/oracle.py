"""The pool of plans/pool.py in DuckDB's SQL: CTEs that the oracle queries begin with."""

_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}'']+', ' ', 'g'))"

MERGED = rf"""
WITH base AS (
    SELECT conv_id, turn, role AS speaker_role, text AS reference, {_NORM} AS reference_norm,
        concat(conv_id, '__', lpad(CAST(turn AS VARCHAR), 4, '0')) AS segment_id, concat('call', conv_id) AS sample_id,
        ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] AS lang, ['calls', 'read', 'debate'][conv_id % 3 + 1] AS corpus,
        ['clean', 'noise'][conv_id % 2 + 1] AS condition, turn * 10.0 AS start_time,
        concat('group', conv_id // 2) AS group_id
    FROM conversations),
worded AS (SELECT *, CASE WHEN reference_norm = '' THEN [] ELSE string_split(reference_norm, ' ') END AS w FROM base),
merged AS (
    SELECT *, CAST(len(w) AS INTEGER) AS n_ref_words, round(len(w) * 0.4 + 0.5, 3)::DOUBLE AS duration,
        CASE WHEN (conv_id * 7 + turn) % 29 <> 0 THEN list_filter(list_transform(w, lambda x, i:
            CASE WHEN i % 7 = 0 THEN '' WHEN i % 11 = 5 THEN 'uh' ELSE x END), lambda x: x <> '') END AS target,
        list_filter(w, lambda x, i: i % 5 <> 0) AS proxy_a,
        CASE WHEN (conv_id + turn) % 13 <> 0 THEN list_transform(w, lambda x, i: CASE WHEN i % 9 = 4 THEN reverse(x) ELSE x END) END AS proxy_b
    FROM worded)
"""


def edits(ref: str, hyp: str) -> str:
    """Least errors, then substitutions, then deletions of two word lists, in one integer: e * 2^42 + s * 2^21 + d."""
    e, s, d = 1 << 42, (1 << 42) + (1 << 21), (1 << 42) + 1
    return f"""list_reduce(
        list_prepend(list_transform(range(0, len({hyp}) + 1), lambda j: j * {e}), list_transform(range(1, len({ref}) + 1), lambda k: [k])),
        lambda prev, r: list_reduce(
            list_prepend([prev[1] + {d}], list_transform(range(1, len({hyp}) + 1), lambda j: [j])),
            lambda acc, j: list_append(acc, least(prev[j[1]] + (CASE WHEN {hyp}[j[1]] = {ref}[r[1]] THEN 0 ELSE {s} END),
                prev[j[1] + 1] + {d}, acc[-1] + {e}))))[-1]"""


LABELLED = (
    MERGED
    + f""", costs AS (SELECT *, {edits("w", "target")} AS cost FROM merged WHERE target IS NOT NULL),
labelled AS (
    SELECT *, cost // {1 << 42} AS label_errors, (cost // {1 << 21}) % {1 << 21} AS label_s, cost % {1 << 21} AS label_d,
        cost // {1 << 42} - (cost // {1 << 21}) % {1 << 21} - cost % {1 << 21} AS label_i, len(target) AS n_hyp_words,
        CASE WHEN len(w) > 0 THEN (cost // {1 << 42})::DOUBLE / len(w) WHEN len(target) > 0 THEN 1.0 ELSE 0.0 END AS label_wer
    FROM costs)
"""
)
