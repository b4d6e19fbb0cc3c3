"""DuckDB SQL fragments shared by oracle queries (Latin profile)."""

from cadenza.profiles import BORDER_SYLLABLES, LATIN_VOWELS, METRES

V = LATIN_VOWELS


def verse_lines_sql(text: str = "text") -> str:
    return (f"list_filter(list_transform(string_split(regexp_replace({text}, '([.?!;]) +', "
            f"'\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '\\p{{L}}'))")


def filter_lines_sql(text: str = "text") -> str:
    return (f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), "
            f"lambda x: regexp_matches(x, '\\p{{L}}'))")


LINES_CTE = f"""lines AS (
  SELECT doc_id, unnest(range(len(arr))) AS line_no, unnest(arr) AS text
  FROM (SELECT doc_id, {verse_lines_sql('text')} AS arr FROM documents))"""


def words_sql(line: str) -> str:
    return f"regexp_extract_all(lower({line}), '\\p{{L}}+')"


def vowels_sql(word: str) -> str:
    return f"length(regexp_replace({word}, '[^{V}]', '', 'g'))"


def pattern_sql(line: str) -> str:
    """Default-stress S/U/A pattern of a line."""
    return (f"array_to_string(list_transform(list_transform({words_sql(line)}, lambda w: {vowels_sql('w')}), "
            "lambda k: CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'A' ELSE "
            "repeat('U', (k + 1) // 2 - 1) || 'S' || repeat('U', k - (k + 1) // 2) END), '')")


def metre_ctes(patterns_from: str) -> str:
    """Recursive-CTE metre matcher over ``patterns_from`` (a relation with a
    ``pattern`` column).  Produces ``pat_err(pattern, metre, midx, strong, weak,
    template, failed)``.  Independent of the Spark implementation: a set-based
    walk over the template automaton, one recursion step per syllable."""
    from cadenza.operators.metre import compile_template, transitions
    mrows, trows = [], []
    for idx, (name, template, border, coef, sum_coef) in enumerate(METRES):
        _, _, _, s_index = compile_template(template)
        mrows.append(f"('{name}', {idx}, {border}, {s_index})")
        trows += [f"('{name}', {s}, {d}, '{c}')" for s, d, c in transitions(template)]
    return f"""
metres(metre, midx, border, sidx) AS (VALUES {', '.join(mrows)}),
trans(metre, src, dst, ch) AS (VALUES {', '.join(trows)}),
pats AS (SELECT DISTINCT pattern FROM {patterns_from}),
walk(metre, pattern, i, node, s, w, t) AS (
  SELECT m.metre, p.pattern, 0, -1, 0, 0, ''
  FROM pats p CROSS JOIN metres m
  WHERE length(p.pattern) BETWEEN 1 AND {BORDER_SYLLABLES}
  UNION ALL
  SELECT metre, pattern, i, node, s, w, min(t) FROM (
    SELECT wk.metre, wk.pattern, wk.i + 1 AS i, tr.dst AS node,
      wk.s + CASE WHEN tr.ch = upper(tr.ch) AND tr.ch <> substr(wk.pattern, wk.i + 1, 1)
                   AND substr(wk.pattern, wk.i + 1, 1) <> 'A' THEN 1 ELSE 0 END AS s,
      wk.w + CASE WHEN tr.ch = lower(tr.ch) AND tr.ch <> lower(substr(wk.pattern, wk.i + 1, 1))
                   AND substr(wk.pattern, wk.i + 1, 1) <> 'A' THEN 1 ELSE 0 END AS w,
      wk.t || tr.ch AS t, m.border
    FROM walk wk
    JOIN trans tr ON tr.metre = wk.metre AND tr.src = wk.node
    JOIN metres m ON m.metre = wk.metre
    WHERE wk.i < length(wk.pattern)
  ) x WHERE s + w <= border GROUP BY metre, pattern, i, node, s, w
),
reach AS (SELECT metre, pattern, max(i) AS mi FROM walk GROUP BY metre, pattern),
best AS (
  SELECT r.metre, r.pattern, r.mi, min(struct_pack(s := wk.s, w := wk.w, t := wk.t)) FILTER (WHERE wk.node >= m.sidx) AS bst
  FROM reach r JOIN walk wk ON wk.metre = r.metre AND wk.pattern = r.pattern AND wk.i = r.mi
  JOIN metres m ON m.metre = r.metre
  GROUP BY r.metre, r.pattern, r.mi
),
pat_err AS (
  SELECT b.pattern, b.metre, m.midx,
    coalesce(b.bst.s, 0) + CASE WHEN b.mi < length(b.pattern) THEN length(b.pattern) - b.mi ELSE 0 END AS strong,
    coalesce(b.bst.w, 0) AS weak, coalesce(b.bst.t, '') AS template,
    (b.mi < length(b.pattern) OR b.bst IS NULL) AS failed
  FROM best b JOIN metres m ON m.metre = b.metre
  UNION ALL
  SELECT p.pattern, m.metre, m.midx, 0, 0, '', false
  FROM pats p CROSS JOIN metres m
  WHERE length(p.pattern) = 0 OR length(p.pattern) > {BORDER_SYLLABLES}
)"""


def metre_coef_values() -> str:
    return ", ".join(f"('{n}', {i}, {c}, {sc})" for i, (n, _, _, c, sc) in enumerate(METRES))


def clean_text_sql(t: str) -> str:
    return f"""regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s.,;:!?"''«»()\\[\\]\\-–—…]', '', 'g')"""


def word_set_sql(t: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: x <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    """word-Jaccard of two texts (NULL when both have no words)."""
    sa, sb = word_set_sql(a), word_set_sql(b)
    u = f"len(list_distinct(list_concat({sa}, {sb})))"
    return f"CASE WHEN {u} > 0 THEN len(list_intersect({sa}, {sb})) / {u} END"


def shingles_sql(t: str, n: int = 3) -> str:
    return (f"CASE WHEN length({t}) >= {n} THEN list_distinct(list_transform(range(1, length({t}) - {n - 2}), "
            f"lambda i: substr({t}, i, {n}))) ELSE []::VARCHAR[] END")


def shingle_jaccard_sql(a: str, b: str, n: int = 3) -> str:
    sa, sb = shingles_sql(f"lower({a})", n), shingles_sql(f"lower({b})", n)
    return f"len(list_intersect({sa}, {sb})) / (len(list_distinct(list_concat({sa}, {sb}))) + 1e-6)"


PAIRS_CTE = """pairs AS (
  SELECT conv_id, turn, text AS input, t1 AS output, CASE WHEN r2 = 'user' THEN t2 END AS new_input
  FROM (SELECT conv_id, turn, role, text,
               lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS t1,
               lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS t2
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND r1 = 'assistant')"""


def sentence_split_sql(t: str) -> str:
    """Sentence boundaries marked with chr(1) (three passes: a boundary
    consumes the next capital, so adjacent short sentences need re-passes)."""
    x = t
    for _ in range(3):
        x = (f"regexp_replace({x}, '([^\\p{{Lu}}].[^\\p{{Lu}}][.?!;]) +(\\p{{Lu}})', "
             f"'\\1' || chr(1) || '\\2', 'g')")
    return f"string_split({x}, chr(1))"


def seeded_hash_sql(*keys: str, seed: int = 42) -> str:
    parts = " || ".join(f"CAST({k} AS VARCHAR) || ':'" for k in keys)
    return f"md5({parts} || '{seed}')"


FOLD_FROM = "àâäáéèêëîïíôöóûùüú"
FOLD_TO = "aaaaeeeeiiiooouuuu"
SYL_RX = f"[^{V}]*[{V}](?:[^{V}]+$)?"


def syllables_sql(w: str) -> str:
    return (f"CASE WHEN len(regexp_extract_all({w}, '{SYL_RX}')) = 0 THEN [{w}] "
            f"ELSE regexp_extract_all({w}, '{SYL_RX}') END")


def last_word_sql(line: str) -> str:
    return f"CASE WHEN len({words_sql(line)}) > 0 THEN {words_sql(line)}[-1] END"


def clausula_ctes(src: str, keys: str, word: str = "lw") -> str:
    """CTE chain src -> cl1 -> cl2 -> cl (adds ``clausula``); ``keys`` are the
    columns carried along, ``word`` the last-word column of ``src``."""
    return f"""cl1 AS (SELECT {keys}, {word} AS lw, {vowels_sql(word)} AS k,
                 ({vowels_sql(word)} + 1) // 2 AS s, {syllables_sql(word)} AS syls FROM {src}),
cl2 AS (SELECT *, length(array_to_string(syls[1:s - 1], '')) + length(regexp_extract(syls[s], '^[^{V}]*')) + 1 AS pos
        FROM cl1),
cl AS (SELECT {keys}, lw, CASE WHEN k > 0 THEN translate(substr(lw, CASE WHEN s = k AND pos > 1 THEN pos - 1 ELSE pos END),
                 '{FOLD_FROM}', '{FOLD_TO}') END AS clausula FROM cl2)"""


REQ_PAIRS_CTE = PAIRS_CTE + """,
req AS (SELECT conv_id, turn, input, output,
               ['AABB', 'ABAB', 'ABBA'][conv_id % 3 + 1] AS rhyme_scheme,
               CASE WHEN conv_id % 2 = 0 THEN 'choreios' ELSE 'iambos' END AS meter,
               'turn' || CAST(turn + 1 AS VARCHAR) AS model
        FROM pairs)"""


def shingles_chars_sql(c: str, n: int = 3) -> str:
    """Distinct n-grams from a character-array column ``c`` (string_split(t, ''))."""
    cat = " || ".join(f"{c}[i + {k}]" for k in range(n))
    return (f"CASE WHEN len({c}) >= {n} THEN list_distinct(list_transform(range(1, len({c}) - {n - 2}), "
            f"lambda i: {cat})) ELSE []::VARCHAR[] END")
