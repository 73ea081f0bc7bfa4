"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tessera.llm import quality_rules, source_mix, topk_search, url_filter
from tessera.llm.common import UPPER

BREAK = r"[\x20\x09-\x0D]+"


def top_k() -> str:
    k, every, scale = topk_search.TOP, topk_search.QUERY_EVERY, topk_search.SCALE
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS MATERIALIZED (SELECT *, row_number() OVER () AS q FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % {every} = 0)),
s AS (SELECT q.q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM asked q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def url_verdicts() -> str:
    bias, weights = url_filter.trained_weights()
    fits = lambda at, start: f"((host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}'))"
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(*r[0].split('/', 1))} THEN '{value(r)}'" for r in ordered) + " END"
    grams = lambda kind, s: "list_concat(" + ", ".join(f"list_transform(range(1, length({s}) - {n} + 2), lambda i: ('0x' || substr(md5('{kind}{n}' || substr({s}, i, {n})), 1, 3))::INT)" for n in url_filter.GRAMS) + ")"
    total = lambda g: f"coalesce(list_sum(list_transform({g}, lambda b: w[b + 1])), 0.0)"
    return f"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
table_ AS (SELECT [{', '.join(f'{x}::DOUBLE' for x in weights)}] AS w),
grams AS (SELECT *, {grams('h', 'host')} AS hg, {grams('p', 'path')} AS pg FROM parts),
z AS (SELECT page_id, host, path, {bias} + {total('hg')} * {url_filter.HOST_GRAM} + {total('pg')} / greatest(len(pg), 1) AS z FROM grams, table_)
SELECT page_id, host, path, {case(lambda r: r[0])} AS rule, coalesce({case(lambda r: r[1])}, CASE WHEN 1 / (1 + exp(-z)) >= {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM z"""


def quality() -> str:
    q = quality_rules
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    votes = []
    for _, top, under, bad, good in q.RULES:
        share = f"(CASE WHEN {under} > 0 THEN {top}::DOUBLE / {under} ELSE 0.0 END)"
        agrees = f" WHEN {share} <= {good} AND n_words >= {q.MIN_WORDS} THEN '1'" if good is not None else ""
        votes.append(f"CASE WHEN {share} > {bad} THEN '0'{agrees} ELSE '2' END")
    cells = [(j, v) for j in range(len(q.RULES)) for v in (0, 1)]
    priors = [q.PRIOR_BAD_VOTE if v == 0 else q.PRIOR_GOOD_VOTE for _, v in cells]
    cast = lambda j, v: f"substr(votes, {j + 1}, 1) = '{v}'"
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE WHEN {cast(j, v)} THEN ln(g[{i + 1}] / b[{i + 1}]) ELSE 0.0 END" for i, (j, v) in enumerate(cells))
    listed = lambda xs: "[" + ", ".join(xs) + "]"
    weight = f"({q.PRIOR_WEIGHT} * n_all)"
    steps = [f"par0 AS (SELECT {q.PRIOR_GOOD}::DOUBLE AS good, {listed(f'{p[0]}::DOUBLE' for p in priors)} AS b, {listed(f'{p[1]}::DOUBLE' for p in priors)} AS g)"]
    for k in range(1, q.ROUNDS + 1):
        sums = ", ".join(f"sum(CASE WHEN {cast(j, v)} THEN n * (1 - q) ELSE 0 END) AS b{i}, sum(CASE WHEN {cast(j, v)} THEN n * q ELSE 0 END) AS g{i}" for i, (j, v) in enumerate(cells))
        bads = [f"(b{i} + {weight} * {p[0]}) / (n_all - n_good + {weight})" for i, p in enumerate(priors)]
        goods = [f"(g{i} + {weight} * {p[1]}) / (n_good + {weight})" for i, p in enumerate(priors)]
        bound = [f"{'least' if v == 0 else 'greatest'}({x}, {y})" for (_, v), x, y in zip(cells, goods, bads)]
        steps.append(f"q{k} AS (SELECT votes, n, 1 / (1 + exp(-({odds}))) AS q FROM patterns, par{k - 1})")
        steps.append(f"sum{k} AS (SELECT sum(n * q) AS n_good, sum(n) AS n_all, {sums} FROM q{k})")
        steps.append(f"par{k} AS MATERIALIZED (SELECT (n_good + {weight} * {q.PRIOR_GOOD}) / (n_all + {weight}) AS good, {listed(bads)} AS b, {listed(bound)} AS g FROM sum{k})")
    failed = f"(n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)"
    return rf"""WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda w: w <> '') AS words FROM documents),
windows_ AS (SELECT row_, unnest(range(1, len(words) - {q.WINDOW} + 2)) AS i, words FROM rows_ WHERE len(words) > {q.WINDOW}),
again AS (SELECT row_, i FROM (SELECT row_, i, count(*) OVER (PARTITION BY row_, words[i:i + {q.WINDOW - 1}]) AS c FROM windows_) WHERE c > 1),
covered AS (SELECT row_, sum(least({q.WINDOW}, coalesce(next_ - i, {q.WINDOW})))::BIGINT AS n_repeat_words FROM (SELECT row_, i, lead(i) OVER (PARTITION BY row_ ORDER BY i) AS next_ FROM again) GROUP BY 1),
lines_ AS (SELECT row_, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows_),
counted AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(words) - len(list_distinct(words)) AS n_same, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, {count(q.SYMBOLS)} AS n_symbols, {count('[#*$%&|<>=_^~][' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')} AS n_marked,
  {count(chr(92) + 'p{Lu}')} AS n_upper, {count(chr(92) + 'p{L}')} AS n_letters, {count('!')} AS n_exclaims, len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) AS n_bare
  FROM rows_ JOIN lines_ USING (row_) LEFT JOIN covered USING (row_)),
voted AS MATERIALIZED (SELECT *, {' || '.join(f'({v})' for v in votes)} AS votes FROM counted),
patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY 1),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND 1 / (1 + exp(-({odds}))) >= {q.KEEP} AS kept FROM voted, par{q.ROUNDS}"""


def mixed() -> str:
    m, seed = source_mix.MAX_EPOCHS, source_mix.SEED
    return rf"""WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), lambda w: w <> '')) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
classed AS MATERIALIZED (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS size_class, substr(mark, 1, length(format('{{:x}}', (SELECT count(*) FROM documents) // {source_mix.SALTED}))) AS salt FROM sized),
sums AS (SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY 1),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w FROM sums),
level AS (SELECT *, sum(s) OVER () AS total, coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM weighed WINDOW o AS (ORDER BY s * 6 // w, source ASC NULLS LAST)),
clamped AS (SELECT *, (total - {m} * filled) * w > {m} * s * open_w AS c FROM level),
goal AS MATERIALIZED (SELECT source, s::BIGINT AS source_size, CASE WHEN c THEN ({m} * s)::DOUBLE ELSE ((total - {m} * coalesce(sum(s) FILTER (c) OVER (), 0)) * w)::DOUBLE / (sum(w) FILTER (NOT c) OVER ())::DOUBLE END AS target FROM clamped),
rated AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
classes AS MATERIALIZED (SELECT source, size_class, count(*) AS n, sum(size)::DOUBLE AS s, ('0x' || substr(md5('{seed}|' || coalesce(source, '') || '|' || size_class::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u, row_number() OVER (PARTITION BY source ORDER BY size_class DESC) AS i FROM classed GROUP BY source, size_class),
walk AS (SELECT source, 0::BIGINT AS i, 0 AS size_class, 0::BIGINT AS n, 0::BIGINT AS m, target - whole * source_size::DOUBLE AS need, source_size::DOUBLE AS left_ FROM rated
  UNION ALL SELECT source, i, size_class, n, taken, need - taken * mean, rest FROM (SELECT *, CASE WHEN greatest(0, pick * mean - need) + greatest(0, need - pick * mean - rest) <= greatest(0, other * mean - need) + greatest(0, need - other * mean - rest) THEN pick ELSE other END AS taken
    FROM (SELECT *, CASE WHEN pick = low THEN least(n, low + 1) ELSE low END AS other FROM (SELECT *, floor(n * share)::BIGINT AS low, least(n, floor(n * share + u)::BIGINT) AS pick FROM (
      SELECT c.source, c.i, c.size_class, c.n, c.u, c.s / c.n AS mean, w.left_ - c.s AS rest, w.need, CASE WHEN w.left_ > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, w.need / w.left_)) ELSE 0.0::DOUBLE END AS share FROM walk w JOIN classes c ON c.source IS NOT DISTINCT FROM w.source AND c.i = w.i + 1))))),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, size_class ORDER BY salt, size DESC, mark, doc_id ASC NULLS FIRST) - 1 AS place FROM classed)
SELECT doc_id, size, source_size, target, ((whole + (place + 1) * w.m // w.n - place * w.m // w.n) * size)::BIGINT AS taken FROM placed p JOIN rated r ON r.source IS NOT DISTINCT FROM p.source JOIN walk w ON w.source IS NOT DISTINCT FROM p.source AND w.size_class = p.size_class"""
