"""The same results as SQL of DuckDB, where it can say them."""

#: CRC-32 of a short text, from its table of 256 remainders.
CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))
"""
CRC_OF = """
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)
"""
BLANKS = r"\x20\x09-\x0D"


def _repair() -> str:
    """Row by row, the cheapest edits that lead to each of four states, with their letters and
    the text they leave; then the missing rows at the end."""
    after, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    states = range(4)

    def put(x: str, cost: str, letter: str, line: str | None) -> str:
        kept = f"{x}.r" if line is None else f"CASE WHEN {x}.r IS NULL THEN {line} ELSE {x}.r || chr(10) || {line} END"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {kept}}}"

    def least(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]" if len(options) > 1 else options[0]

    def inserts(level: str) -> str:
        cols = []
        for j in states:
            found = [f"s{j}"] + [put(f"s{i}", "2", "I", f"'{role[i]}:'") for i in states if after[i] == j]
            cols.append(f"{least(found)} AS s{j}")
        return f"SELECT conv_id, k, {', '.join(cols)} FROM {level}"

    cols = []
    none = "{'c': 1000000000::BIGINT, 'a': '', 'r': NULL::VARCHAR}"
    for j in states:
        found = [put(f"s{j}", "3", "D", None)]
        for i in states:
            for initial, to in keeps.items():
                if to.get(i) == j:
                    kept = put(f"s{i}", "short", "K", "role || ':' || text")
                    found.append(f"CASE WHEN initial = '{initial}' AND NOT gone THEN {kept} ELSE {none} END")
            if after[i] == j:
                changed = put(f"s{i}", "2 + short", "R", f"'{role[i]}:' || text")
                found.append(f"CASE WHEN NOT gone THEN {changed} ELSE {none} END")
        cols.append(f"{least(found)} AS s{j}")
    begin = "{'c': 0::BIGINT, 'a': '', 'r': NULL::VARCHAR}"
    return f"""
WITH RECURSIVE {CRC},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC_OF.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN lot = 0 THEN 0 WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given),
numbered AS (
  SELECT *, row_number() OVER w AS k, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^{BLANKS}]') AS blank, NOT regexp_matches(text, '[.!?][{BLANKS}]*$') AS cut
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows_ AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS short FROM numbered),
before_(conv_id, k, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {begin}, {none}, {none}, {none} FROM rows_
  UNION ALL
  SELECT b.conv_id, b.k + 1, {", ".join(cols)}
  FROM ({inserts(f"({inserts('before_')})")}) b
  JOIN rows_ r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.k + 1 = r.k),
last_ AS (
  SELECT conv_id, max(k) AS k FROM before_ GROUP BY 1),
ended AS (
  SELECT b.conv_id, least_.c AS cost, least_.a AS audit, coalesce(least_.r, '') AS r FROM (
    SELECT conv_id, k, list_sort([s0, s3])[1] AS least_ FROM ({inserts(f"({inserts('before_')})")})) b
  JOIN last_ l ON b.conv_id IS NOT DISTINCT FROM l.conv_id AND b.k = l.k),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


REPAIR = _repair()

NEGATIVES = """
WITH given AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

#: Every query against every candidate. Where all lists are scanned (up to 8 lists, some 2000
#: vectors) the index gives the same rows; beyond that it may miss a few.
NEAREST = """
WITH sound AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, MAX(list_cosine_similarity(q.v, c.v)) AS score
  FROM sound q JOIN sound c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
