"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .mixing import DIMS, SEED, TEMPER, TOL

SQL: dict[str, str] = {}

# Five-word shingles as sets; the size of each intersection against each item.  Items below
# five words are one shingle, looked for anywhere in a document.
SQL["op9_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents),
i AS (SELECT DISTINCT item_id,
             trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark),
iw AS (SELECT item_id, t, string_split(t, ' ') AS w FROM i WHERE t <> ''),
ish AS (SELECT DISTINCT item_id, t, array_to_string(list_slice(w, k, k + 4), ' ') AS s
        FROM iw, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k)),
n AS (SELECT item_id, t, count(*) AS n_item FROM ish GROUP BY ALL),
dw AS (SELECT r, doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''),
dsh AS (SELECT DISTINCT r, doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
        FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM dw)),
short AS (SELECT item_id, t FROM iw WHERE len(w) < 5),
pairs AS (SELECT r, doc_id, item_id, ish.t, s FROM dsh JOIN ish USING (s)
         UNION SELECT d.r, d.doc_id, item_id, short.t, short.t FROM d JOIN short ON contains(' ' || d.t || ' ', ' ' || short.t || ' ')),
hit AS (SELECT r, doc_id, item_id, t, count(*) AS n_shared FROM pairs GROUP BY ALL)
SELECT doc_id, item_id, n_shared::INT AS n_shared, n_item::INT AS n_item, n_shared / n_item AS containment
FROM hit JOIN n USING (item_id, t) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""


def _mixing_sql() -> str:
    share = "(length(t) - length(replace(t, '{m}', ''))) / {n} / greatest(n_tokens, 1)"
    parts = [r"""
d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
             coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n_tokens,
             ('0x' || substr(md5('%d:' || coalesce(doc_id::VARCHAR, '(null)')), 1, 12))::BIGINT / 281474976710656.0 AS u
      FROM documents)""" % SEED, f"""
e AS (SELECT doc_id, source, lang, n_tokens, u, CASE
        WHEN {share.format(m=' | ', n=3)} > 0.2 THEN 'table' WHEN {share.format(m='!!', n=2)} > 0.2 THEN 'shout'
        WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 300 THEN 'medium'
        WHEN n_tokens < 1500 THEN 'long' ELSE 'book' END AS topic FROM d)""", """
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM e GROUP BY ALL)"""]
    for x in DIMS:
        parts.append(f"""
m_{x} AS MATERIALIZED (SELECT {x}, g / sum(g) OVER () AS t_{x} FROM (
    SELECT {x}, pow(sum(tokens), {TEMPER}) AS g FROM c GROUP BY {x} HAVING sum(tokens) > 0))""")
    sums = ", ".join(f"sum(share) OVER (PARTITION BY {x}) AS s_{x}" for x in DIMS)
    gap = ", ".join(f"abs(s_{x} - t_{x})" for x in DIMS)
    step = f"(SELECT *, max(greatest({gap})) OVER () AS gap FROM (SELECT *, {sums} FROM it))"
    keep = ", ".join(("i", *DIMS, "tokens", *[f"t_{x}" for x in DIMS]))
    for k, x in enumerate(DIMS):
        where = f" WHERE gap > {TOL}" if k == 0 else ""
        step = (f"(SELECT {keep}, CASE WHEN n > 0 THEN share * t_{x} / n ELSE 0 END AS share FROM (SELECT *, "
                f"sum(share) OVER (PARTITION BY {x}) AS n FROM {step}{where}))")
    parts.append(f"""
it AS (SELECT 0 AS i, {", ".join(DIMS)}, tokens, {", ".join(f"coalesce(t_{x}, 0) AS t_{x}" for x in DIMS)},
              tokens / (SELECT sum(tokens) FROM c) AS share
       FROM c {" ".join(f"LEFT JOIN m_{x} USING ({x})" for x in DIMS)}
       UNION ALL SELECT {keep.replace("i, ", "i + 1, ", 1)}, share FROM {step})""")
    parts.append("""
w AS (SELECT source, lang, topic, CASE WHEN tokens > 0
        THEN round(share * (SELECT sum(tokens) FROM c) / tokens, 6) ELSE 0 END AS weight
      FROM it WHERE i = (SELECT max(i) FROM it))""")
    return "WITH RECURSIVE " + ",".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, weight, least(weight, 1.0) AS probability
FROM e JOIN w USING (source, lang, topic) WHERE u < weight AND n_tokens > 0"""


SQL["op5_mixing"] = _mixing_sql()

# Every phrase of one to four words counted; HUGEINT keeps the products exact.
SQL["op11_phrases"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, w[k:k + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k
                                               FROM w, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, p, count(*) AS f FROM (SELECT lang, m, array_to_string(g, ' ') AS p FROM g)
                  GROUP BY ALL HAVING m = 1 OR count(*) >= 30),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, p, f AS a, string_split(p, ' ') AS w FROM f WHERE m > 1),
cut AS MATERIALIZED (SELECT lang, p, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
                    FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT cut.*, l.f AS l, r.f AS r, 2000000::HUGEINT * a // (l.f + r.f) AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.p = lp JOIN f r ON r.lang = cut.lang AND r.p = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, p, max(a) AS most FROM (
             SELECT lang, a, array_to_string(w[:m - 1], ' ') AS p FROM c
             UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') AS p FROM c) GROUP BY ALL),
kept AS (SELECT best.*, best.p AS phrase FROM best LEFT JOIN held USING (lang, p)
         WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN n USING (lang) WHERE rank <= 2000
"""

# The products are whole numbers below 2**53, so sums of doubles are exact.
SQL["op12_negatives"] = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.r AS ar, a.id AS anchor_id, e.r, e.id, a.label = e.label AS same,
                          list_inner_product(a.v, e.v)::BIGINT AS score
                   FROM e a JOIN e ON a.r <> e.r WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
