"""Word evidence for item types in SQL: the matching-blocks ratio as a recursion over pieces of both words."""

from __future__ import annotations

from tallyweave.operators.classification import MINIMUM_SCORE, TYPE_SYNONYMS

# A block's size, then its place in the token and in the word, packed in one number of which the greatest is the first longest block.
_PLACES = 10_000

_WORDS = ", ".join(f"('{kind}', '{word.upper()}')" for kind, words in TYPE_SYNONYMS.items() for word in words)


def _longest_block(a_low: str, a_high: str, b_low: str, b_high: str) -> str:
    """The longest common block of a piece of the token and a piece of the word, packed; null if there is none."""
    piece = f"token[{a_low} + 1:{a_high}]"
    size, place = "(x.e - x.j)", f"strpos({piece}, word[x.j + 1:x.e])"
    spans = f"flatten(list_transform(range({b_low}, {b_high}), lambda j: list_transform(range(j + 1, {b_high} + 1), lambda e: {{'j': j, 'e': e}})))"
    packed = f"{size} * {_PLACES * _PLACES} + ({_PLACES - 1} - ({a_low} + {place} - 1)) * {_PLACES} + ({_PLACES - 1} - x.j)"
    return f"list_max(list_transform({spans}, lambda x: CASE WHEN {place} > 0 THEN {packed} END))"


def token_scores_sql(tokens: str) -> str:
    """token, payment, credit_note, invoice: the best score of every distinct ``token`` of a query with each type's words."""
    i, j, k = f"{_PLACES - 1} - (m // {_PLACES}) % {_PLACES}", f"{_PLACES - 1} - m % {_PLACES}", f"m // {_PLACES * _PLACES}"
    left = f"{{'al': al, 'ah': {i}, 'bl': bl, 'bh': {j}}}"
    right = f"{{'al': {i} + {k}, 'ah': ah, 'bl': {j} + {k}, 'bh': bh}}"
    ratio = f"CAST(2 * sum(coalesce({k}, 0)) AS DOUBLE) / (length(token) + length(word))"
    score = "CASE WHEN token = word THEN 1.0 WHEN starts_with(token, word) OR starts_with(word, token) THEN 0.9 ELSE ratio END"
    return f"""(WITH RECURSIVE words(kind, word) AS (VALUES {_WORDS}), given AS (SELECT DISTINCT token FROM ({tokens}) t),
    piece AS (
      SELECT token, word, CAST(0 AS BIGINT) AS al, length(token) AS ah, CAST(0 AS BIGINT) AS bl, length(word) AS bh, {_longest_block("0", "length(token)", "0", "length(word)")} AS m FROM given, words
      UNION ALL SELECT token, word, c.al, c.ah, c.bl, c.bh, {_longest_block("c.al", "c.ah", "c.bl", "c.bh")}
      FROM (SELECT token, word, unnest([{left}, {right}]) AS c FROM piece WHERE m IS NOT NULL) s WHERE c.al < c.ah AND c.bl < c.bh
    ),
    ratios AS (SELECT token, word, {ratio} AS ratio FROM piece GROUP BY token, word),
    scored AS (SELECT token, kind, least(CAST({score} AS DOUBLE), CASE WHEN length(word) > 2 THEN 1.0 ELSE 0.8 END) AS score FROM ratios JOIN words USING (word))
    SELECT token, {", ".join(f"max(CASE WHEN kind = '{kind}' THEN score END) AS {kind}" for kind in TYPE_SYNONYMS)} FROM scored GROUP BY token)"""


def guesses_sql(items: str) -> str:
    """k, guessed, settled: the type of every row of a query (k, hint, joined), and whether contained words or none settled it."""
    candidate = {"payment": "hint IS DISTINCT FROM 'invoice'", "credit_note": "hint IS DISTINCT FROM 'invoice'", "invoice": "hint IS DISTINCT FROM 'credit'"}
    default = "CASE WHEN hint = 'credit' THEN 'payment' ELSE 'invoice' END"
    contained = " ".join(
        f"WHEN {candidate[kind]} AND regexp_matches(compact, '{'|'.join(w.upper() for w in words)}') THEN '{kind}'" for kind, words in TYPE_SYNONYMS.items()
    )
    score = {kind: f"CASE WHEN {candidate[kind]} THEN coalesce({kind}, 0) ELSE 0.0 END" for kind in TYPE_SYNONYMS}
    best_type = " ".join(f"WHEN {candidate[kind]} AND {score[kind]} = best THEN '{kind}'" for kind in TYPE_SYNONYMS)
    needed = " ".join(f"WHEN '{kind}' THEN {low}" for kind, low in MINIMUM_SCORE.items())
    tokens = "regexp_extract_all(upper(joined), '[A-Z0-9]+')"
    return f"""(WITH asked AS (SELECT k, hint, {tokens} AS tokens, regexp_replace(upper(trim(joined)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS compact FROM ({items}) i),
    first AS (SELECT *, CASE WHEN len(tokens) = 0 THEN {default} {contained} END AS settled FROM asked),
    listed AS (SELECT k, unnest(list_distinct(tokens)) AS token FROM first WHERE settled IS NULL),
    best AS (SELECT k, {", ".join(f"max({kind}) AS {kind}" for kind in TYPE_SYNONYMS)} FROM listed JOIN {token_scores_sql("SELECT token FROM listed")} s USING (token) GROUP BY k),
    weighed AS (SELECT f.*, b.* EXCLUDE (k), greatest({", ".join(score.values())}) AS best FROM first f LEFT JOIN best b ON b.k = f.k),
    named AS (SELECT *, CASE {best_type} END AS best_type FROM weighed)
    SELECT k, settled IS NOT NULL AS settled, coalesce(settled, CASE WHEN best > 0 AND best >= CASE best_type {needed} END THEN best_type ELSE {default} END) AS guessed FROM named)"""


# Rows of items_flat with the text of their cells and the side their amounts are on.
CELL_WORDS = """SELECT k, CASE WHEN layout <> 0 THEN NULL WHEN is_credit = 1 THEN 'credit' ELSE 'invoice' END AS hint,
  CASE layout WHEN 0 THEN concat_ws(' ', nullif(date_text, ''), nullif(number, ''), nullif(reference, ''), amount_text, amount_text)
    WHEN 1 THEN concat_ws(' ', nullif(date_text, ''), nullif(reference, ''), nullif(due_text, ''), amount_text, amount_text)
    ELSE concat_ws(' ', nullif(date_text, ''), nullif(number, ''), amount_text) END AS joined FROM items_flat"""

GUESSES = guesses_sql(CELL_WORDS)
