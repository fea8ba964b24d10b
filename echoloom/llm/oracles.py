"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS r(i)"
#: Unsigned CRC-32 of a text's UTF-8 bytes; `crc.t` is the table of bytes.
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _scores(count: int) -> str:
    draw = "(CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{s}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
    return ", ".join(f"-ln({draw.format(s=s)})" for s in range(count))


OP2 = f"""
WITH crc AS ({_CRC_TABLE}),
rows AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         CAST({_CRC.format(text="coalesce(text, '')")} AS BIGINT) AS text_crc32,
         [{_scores(16)}] AS a, [{_scores(17)}] AS b
  FROM documents, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(list_position(a, list_min(a)) - 1 AS INT) AS shard,
       CAST(list_position(b, list_min(b)) - 1 AS INT) AS grown_shard,
       row_number() OVER (PARTITION BY list_position(a, list_min(a))
                          ORDER BY substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), text_crc32, size)), 1, 3), doc_id, text_crc32, size) - 1 AS slot
FROM rows"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def _quality() -> str:
    """Counts of each text, votes, rounds of expectation-maximisation as one table each, and the verdict."""
    from . import quality as q

    names = [f"v{j}" for j in range(len(q.RULES))]

    def good(m: str) -> str:
        odds = (f"CASE v{j} WHEN -1 THEN ln({m}.w{j} / {m}.r{j}) WHEN 1 THEN ln((1 - {m}.w{j}) / (1 - {m}.r{j})) ELSE 0 END" for j in range(len(names)))
        return f"1 / (1 + exp(-({' + '.join([f'ln({m}.prior / (1 - {m}.prior))', *odds])})))"

    def share(bad: str, cast: str, first: float) -> str:
        return f"((coalesce({bad}, 0) + {q.START_VOTES * first}) / (coalesce({cast}, 0) + {q.START_VOTES}))::DOUBLE"

    rounds = [f"m0 AS MATERIALIZED (SELECT {q.PRIOR}::DOUBLE AS prior, {', '.join(f'{q.WRONG}::DOUBLE AS w{j}, {q.RIGHT}::DOUBLE AS r{j}' for j in range(len(names)))})"]
    for k in range(q.ROUNDS):
        parts = [f"{share('sum(n * p)', 'sum(n)', q.PRIOR)} AS prior"]
        for j in range(len(names)):
            for name, weight, first in (("w", "n * p", q.WRONG), ("r", "n * (1 - p)", q.RIGHT)):
                parts.append(f"{share(f'sum({weight}) FILTER (v{j} = -1)', f'sum({weight}) FILTER (v{j} <> 0)', first)} AS {name}{j}")
        rounds.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join(parts)} FROM (SELECT t.*, {good(f'm{k}')} AS p FROM t, m{k}))")
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END AS {name}" for name, (yes, no) in zip(names, q.RULES.values()))
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '{word}') AS w FROM d),
g AS MATERIALIZED (SELECT row, i, w[i:i + {q.WINDOW - 1}] AS g FROM (SELECT row, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM w)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
c AS (SELECT row, sum(least({q.WINDOW}, coalesce(next - i, {q.WINDOW}))) AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM r) GROUP BY row),
f AS MATERIALIZED (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{q.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_exclamations, 
         length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_letters, len(list_filter(w, lambda x: x <> translate(x, '{q.SYMBOLS}', ''))) AS n_marked,
         coalesce(list_sum(list_transform(range(0, len(w), {q.SPAN}), lambda i: len(list_distinct(w[i + 1:i + {q.SPAN}])))), 0) AS n_spread
  FROM (SELECT w.*, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM w) LEFT JOIN c USING (row)),
v AS MATERIALIZED (SELECT *, {votes} FROM f),
t AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{', '.join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {good(f"m{q.ROUNDS}")} >= {q.KEEP} AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v), m{q.ROUNDS}"""


OP4 = _quality()


def _repair() -> str:
    """Damaged rows, their faults, and the least (cost, audit) from each row and output state, from the last row back."""
    blank = "[^\\x20\\x09-\\x0D]"
    names, step, keep = ("", "system", "user", "assistant"), (3, 3, 4, 3), {(1, "s"): 2} | {(s, "u"): 3 for s in (1, 2, 4)} | {(3, "a"): 4}

    def edit(cost: str, letter: str, after: int, line: str | None) -> str:
        lines = f"t[{after}].o" if line is None else f"list_prepend({line}, t[{after}].o)"
        return f"{{'c': t[{after}].c + {cost}, 'a': '{letter}' || t[{after}].a, 'o': {lines}}}"

    def row(s: int) -> str:
        extra = "CASE fault WHEN 2 THEN 5 ELSE 0 END"
        kept = " ".join(f"WHEN '{i}' THEN {edit(extra, 'K', to, q)}" for (a, i), to in keep.items() if a == s for q in ["role || ':' || text"])
        reroled = edit(f"1 + {extra}", "R", step[s - 1], f"'{names[step[s - 1] - 1]}:' || text")
        return f"list_min(list_filter([{edit('2', 'D', s, None)}, CASE WHEN fault >= 2 THEN {reroled} END, CASE WHEN fault >= 2 THEN CASE left(role, 1) {kept} END END], lambda x: x IS NOT NULL))"

    inserted = ", ".join(f"list_min([t[{s}], {edit('5', 'I', step[s - 1], repr(names[step[s - 1] - 1] + ':'))}])" for s in range(1, 5))
    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format(text="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 0 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 2 ELSE 3 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM n),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 0) AS blank, count_if(fault = 1) AS duplicate,
         count_if(fault = 2) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM f GROUP BY conv_id),
ends AS (SELECT [{{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}}, {{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}}] AS t),
best AS (
  SELECT conv_id, rows + 1 AS i, t FROM g, ends
  UNION ALL
  SELECT conv_id, i, [{inserted}] FROM (SELECT conv_id, i, [{inserted}] AS t FROM (
    SELECT b.conv_id, f.i, [{', '.join(row(s) for s in range(1, 5))}] AS t FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(t[1].c, 0) AS BIGINT) AS cost,
       coalesce(t[1].a, '') AS audit, sha256(coalesce(array_to_string(t[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1"""


OP13 = _repair()
