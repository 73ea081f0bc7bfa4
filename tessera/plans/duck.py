"""DuckDB SQL for the plans: string builders that mirror the column builders."""

from __future__ import annotations

from tessera.functions import vocab


def text_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def clean(x: str) -> str:
    mark, end = "chr(1)", "chr(2)"
    pattern = r"\b(?:[A-Za-z]\.){2,}[A-Za-z]?\.?"
    pieces = f"string_split(regexp_replace(coalesce({x}, ''), '{pattern}', {mark} || '\\0' || {end}, 'g'), {mark})"
    joined = f"array_to_string(list_transform({pieces}, lambda z: case when contains(z, {end}) then replace(string_split(z, {end})[1], '.', '') || string_split(z, {end})[2] else z end), '')"
    s = f"lower(strip_accents({joined}))"
    for old, new in (("&", " and "), ("+", " and "), ("''", "")):
        s = f"replace({s}, '{old}', '{new}')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


def tokens(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda t: t <> '')"


def strip_zeros(t: str) -> str:
    return f"case when regexp_full_match({t}, '[0-9]+') then case when ltrim({t}, '0') = '' then '0' else ltrim({t}, '0') end else {t} end"


def repair_digits(t: str) -> str:
    a, b = vocab.DIGIT_AS_LETTER
    return f"case when not regexp_full_match({t}, '[a-z]+') and length(regexp_replace({t}, '[^a-z]', '', 'g')) >= 2 and not regexp_full_match({t}, '[0-9]+(st|nd|rd|th)') then translate({t}, '{a}', '{b}') else {t} end"


def name_tokens(x: str) -> str:
    return f"list_transform(list_transform({tokens(clean(x))}, lambda t: {repair_digits('t')}), lambda t: {strip_zeros('t')})"


def address_tokens(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({clean(x)}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    return f"list_transform({tokens(spaced)}, lambda t: {strip_zeros('t')})"


def skeleton(t: str) -> str:
    a, b = vocab.SOUND_ALIKE
    s = f"regexp_replace(translate(replace({t}, 'ph', 'f'), '{a}', '{b}'), '[aeiouyh]', '', 'g')"
    for ch in "fjklmnprstv":
        s = f"regexp_replace({s}, '{ch}+', '{ch}', 'g')"
    return f"case when regexp_full_match({t}, '[a-z]+') and length({s}) >= 2 then {s} else '' end"


def ratio(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1.0::DOUBLE when length({a}) = 0 or length({b}) = 0 then 0.0::DOUBLE else (length({a}) + length({b}) - levenshtein({a}, {b}))::DOUBLE / (length({a}) + length({b})) end"


def joined(a: str) -> str:
    return f"array_to_string({a}, ' ')"


def token_sort(a: str, b: str) -> str:
    return ratio(joined(f"list_sort({tokens(a)})"), joined(f"list_sort({tokens(b)})"))


def token_set(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    only = lambda p, q: joined(f"list_sort(list_distinct(list_filter({p}, lambda t: not list_contains({q}, t))))")
    shared = joined(f"list_sort(list_distinct(list_filter({x}, lambda t: list_contains({y}, t))))")
    # bound once by a one-element list
    left, right = f"trim(z.s || ' ' || {only(x, y)})", f"trim(z.s || ' ' || {only(y, x)})"
    inner = f"case when w.s = '' then {ratio('w.l', 'w.r')} else greatest({ratio('w.s', 'w.l')}, {ratio('w.s', 'w.r')}, {ratio('w.l', 'w.r')}) end"
    return f"list_transform(list_transform([{{'s': {shared}}}], lambda z: {{'s': z.s, 'l': {left}, 'r': {right}}}), lambda w: {inner})[1]"


def partial(a: str, b: str) -> str:
    windows = f"list_transform(range(1, length(w.l) - length(w.s) + 2), lambda i: {ratio('w.s', 'substr(w.l, i, length(w.s))')})"
    best = f"list_transform([{windows}], lambda r: coalesce(list_filter(r, lambda q: q >= 0.99)[1], list_max(r)))[1]"
    bound = f"list_transform([{{'s': case when length({a}) <= length({b}) then {a} else {b} end, 'l': case when length({a}) <= length({b}) then {b} else {a} end}}], lambda w: {best})[1]"
    return f"case when length({a}) = 0 or length({b}) = 0 then 0.0::DOUBLE when {a} = {b} then 1.0::DOUBLE else {bound} end"


def no_space(a: str, b: str) -> str:
    return ratio(f"replace({a}, ' ', '')", f"replace({b}, ' ', '')")


def jaro_winkler(a: str, b: str) -> str:
    """Matches as codes 4096 * place in a + place in b, found from left to right."""
    reach = f"(greatest(length({a}), length({b})) // 2 - 1)"
    free = f"list_filter(range(greatest(1, x[1] - {reach}), least(length({b}), x[1] + {reach}) + 1), lambda j: substr({b}, j::INT, 1) = substr({a}, x[1]::INT, 1) and not list_contains(list_transform(st, lambda c: c % 4096), j))[1:1]"
    codes = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda q: [q::BIGINT]), lambda st, x: list_concat(st, list_transform({free}, lambda j: x[1] * 4096 + j)), []::BIGINT[])"
    crossed = f"len(list_filter(range(1, len(m.c) + 1), lambda k: substr({a}, (m.c[k] // 4096)::INT, 1) <> substr({b}, list_sort(list_transform(m.c, lambda c: c % 4096))[k]::INT, 1)))"
    jaro = f"case when len(m.c) = 0 then 0.0::DOUBLE else (len(m.c) / length({a})::DOUBLE + len(m.c) / length({b})::DOUBLE + (len(m.c) - {crossed} / 2.0::DOUBLE) / len(m.c)) / 3 end"
    same = f"len(list_filter([1, 2, 3, 4], lambda k: k <= least(length({a}), length({b})) and substr({a}, 1, k) = substr({b}, 1, k)))"
    whole = f"list_transform(list_transform([{{'c': {codes}}}], lambda m: {jaro}), lambda j: j + {same} * 0.1::DOUBLE * (1 - j))[1]"
    return f"case when {a} = {b} then 1.0::DOUBLE when length({a}) = 0 or length({b}) = 0 then 0.0::DOUBLE else case when len({codes}) = 0 then 0.0::DOUBLE else {whole} end end"


#: The records of pages, as sources.records.from_pages() makes them.
RECORDS = r"""
pages_ AS (SELECT page_id, coalesce(url, '') AS url, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
src_ AS (SELECT *, CASE WHEN contains(url, '?') THEN 'S2' WHEN regexp_matches(url, '(\.html|/|#[^#]*)$') THEN 'S3' ELSE 'S1' END AS src FROM pages_),
records AS (SELECT src, src || '-' || lpad(page_id::VARCHAR, 8, '0') AS id, replace(regexp_replace(host, '^(www|m|blog)\.', ''), '.', ' ') AS name, path AS address, regexp_extract(path, '^/([a-z]{2})/', 1) AS country FROM src_)"""

_stop = "CASE country WHEN " + " WHEN ".join(f"'{k}' THEN {text_list(v)}" for k, v in vocab.FREQUENT_WORDS.items()) + f" ELSE {text_list(vocab.FREQUENT_WORDS['US'])} END"
_core = f"list_filter(name_toks, lambda t: NOT list_contains({_stop}, t))"
_marked = "list_concat(list_transform(name_toks, lambda t: 'n:' || t), list_transform(skels, lambda t: 'k:' || t), flatten(list_transform(range(1, len(skels) + 1), lambda i: list_transform(skels[i + 1:], lambda b: 'p:' || skels[i] || '_' || b))), list_transform(range(1, least(3, len(name_toks)) + 1), lambda i: 'c:' || array_to_string(name_toks[1:i], '')), list_transform(addr_toks, lambda t: 'a:' || t), list_transform(range(1, len(addr_toks)), lambda i: 'b:' || addr_toks[i] || '_' || addr_toks[i + 1]))"

#: The prepared records, as operators.blocking.prepare() makes them.
PREPARED = f"""{RECORDS},
toks AS (SELECT *, {name_tokens('name')} AS name_toks, {address_tokens('address')} AS addr_toks FROM records),
prep0 AS (SELECT *, array_to_string(name_toks, ' ') AS name_text, array_to_string(addr_toks, ' ') AS addr_text,
  array_to_string(list_transform(name_toks, lambda t: coalesce(nullif({skeleton('t')}, ''), t)), ' ') AS skel_text,
  array_to_string(CASE WHEN len({_core}) = 0 THEN name_toks ELSE {_core} END, ' ') AS core_text,
  list_filter(addr_toks, lambda t: regexp_full_match(t, '[0-9]+'))[1:4] AS numbers,
  list_sort(list_distinct(list_filter(list_transform(name_toks[1:6], lambda t: {skeleton('t')}), lambda s: s <> ''))) AS skels FROM toks),
prep AS (SELECT *, list_distinct({_marked}) AS keys FROM prep0),
s1 AS (SELECT * FROM prep WHERE src = 'S1'), pool AS (SELECT * FROM prep WHERE src <> 'S1')"""

#: The index and the candidates, as operators.blocking makes them.
INDEX = f"""{PREPARED},
pool_keys AS (SELECT id, country, unnest(keys) AS key FROM pool), s1_keys AS (SELECT id, country, unnest(keys) AS key FROM s1),
df AS (SELECT key, count(*) AS df FROM pool_keys GROUP BY key),
idf AS (SELECT key, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df, (SELECT count(*) AS n FROM pool) WHERE NOT (df > 5000 AND df > 0.4 * n)),
a AS (SELECT id, country, key, idf FROM s1_keys JOIN idf USING (key)), b AS (SELECT id, country, key, idf FROM pool_keys JOIN idf USING (key)),
s1_norms AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM a GROUP BY id), pool_norms AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM b GROUP BY id)"""


def blocking_pass(tag: str, k: int = 50, prefixes: tuple[str, ...] = (), by_country: bool = False, hard: bool = False) -> str:
    """CTEs up to ranked_<tag>(s1_id, pool_id, cos, block_rank) over keys of these prefixes; needs PREPARED."""
    which = f" WHERE substr(key, 1, 2) IN ({', '.join(repr(p) for p in prefixes)})" if prefixes else ""
    scope = "key, country" if by_country else "key"
    sized = "(SELECT country, count(*) AS n FROM pool GROUP BY 1) USING (country)" if by_country else "(SELECT count(*) AS n FROM pool) ON true"
    keys = lambda side: f"(SELECT * FROM (SELECT id, country, unnest(keys) AS key FROM {side}){which})"
    return f"""pk_{tag} AS {keys('pool')}, df_{tag} AS (SELECT {scope}, count(*) AS df FROM pk_{tag} GROUP BY ALL),
idf_{tag} AS (SELECT {scope}, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df_{tag} JOIN {sized} WHERE NOT (df > 5000{'' if hard else ' AND df > 0.4 * n'})),
a_{tag} AS (SELECT id, country, key, idf FROM {keys('s1')} JOIN idf_{tag} USING ({scope})), b_{tag} AS (SELECT id, country, key, idf FROM pk_{tag} JOIN idf_{tag} USING ({scope})),
dots_{tag} AS (SELECT a.id AS s1_id, b.id AS pool_id, sum(a.idf * a.idf) AS dot FROM a_{tag} a JOIN b_{tag} b ON a.key = b.key AND (a.country = b.country OR a.country = '' OR b.country = '') GROUP BY 1, 2),
cos_{tag} AS (SELECT s1_id, pool_id, round(dot / (x.norm * y.norm), 9) AS cos FROM dots_{tag} JOIN (SELECT id, sqrt(sum(idf * idf)) AS norm FROM a_{tag} GROUP BY 1) x ON x.id = s1_id JOIN (SELECT id, sqrt(sum(idf * idf)) AS norm FROM b_{tag} GROUP BY 1) y ON y.id = pool_id),
ranked_{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, pool_id)::INT AS block_rank FROM cos_{tag}) WHERE block_rank <= {k})"""


def candidates(k: int = 50) -> str:
    return f"""{INDEX},
dots AS (SELECT a.id AS s1_id, b.id AS pool_id, sum(a.idf * b.idf) AS dot FROM a JOIN b ON a.key = b.key AND (a.country = b.country OR a.country = '' OR b.country = '') GROUP BY 1, 2),
cosines AS (SELECT s1_id, pool_id, round(dot / (x.norm * y.norm), 9) AS cos FROM dots JOIN s1_norms x ON x.id = s1_id JOIN pool_norms y ON y.id = pool_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, pool_id)::INT AS block_rank FROM cosines),
cands AS (SELECT *, max(cos) OVER (PARTITION BY s1_id) AS best_cos FROM ranked WHERE block_rank <= {k}),
pairs AS (SELECT c.*, x.name AS a_name, x.name_toks AS a_name_toks, x.name_text AS a_name_text, x.addr_text AS a_addr_text, x.skel_text AS a_skel_text, x.core_text AS a_core_text, x.numbers AS a_numbers, x.country AS a_country,
  y.name AS b_name, y.name_toks AS b_name_toks, y.name_text AS b_name_text, y.addr_text AS b_addr_text, y.skel_text AS b_skel_text, y.core_text AS b_core_text, y.numbers AS b_numbers FROM cands c JOIN s1 x ON x.id = s1_id JOIN pool y ON y.id = pool_id)"""


def r4(x: str) -> str:
    return f"round_even({x}, 4)"


_an, _bn, _aa, _ba = "a_name_text", "b_name_text", "a_addr_text", "b_addr_text"
_missing = f"({_aa} = '' OR {_ba} = '')"
_shared = "len(list_filter(b_numbers, lambda x: list_contains(a_numbers, x)))"
_primary = "len(a_numbers) > 0 AND len(b_numbers) > 0 AND a_numbers[1] {} b_numbers[1]"
FEATURES = {
    "block_score": r4("cos"),
    "block_score_rel": r4("CASE WHEN best_cos > 0 THEN cos / best_cos ELSE 1.0 END"),
    "name_ratio": r4(ratio(_an, _bn)),
    "name_token_set": r4(token_set(_an, _bn)),
    "name_token_sort": r4(token_sort(_an, _bn)),
    "name_partial": r4(partial(_an, _bn)),
    "name_nospace_ratio": r4(no_space(_an, _bn)),
    "skel_ratio": r4(ratio("a_skel_text", "b_skel_text")),
    "skel_token_set": r4(token_set("a_skel_text", "b_skel_text")),
    "core_ratio": r4(ratio("a_core_text", "b_core_text")),
    "core_token_set": r4(token_set("a_core_text", "b_core_text")),
    "name_jw": r4(jaro_winkler(_an, _bn)),
    "addr_ratio": r4(f"CASE WHEN {_missing} THEN 0.0::DOUBLE ELSE {ratio(_aa, _ba)} END"),
    "addr_token_set": r4(f"CASE WHEN {_missing} THEN 0.0::DOUBLE ELSE {token_set(_aa, _ba)} END"),
    "addr_partial": r4(f"CASE WHEN {_missing} THEN 0.0::DOUBLE ELSE {partial(_aa, _ba)} END"),
    "num_shared": f"{_shared}::INT",
    "num_s1": "len(a_numbers)::INT",
    "num_pool": "len(b_numbers)::INT",
    "num_pool_share": r4(f"CASE WHEN len(b_numbers) > 0 THEN {_shared}::DOUBLE / len(b_numbers) ELSE 0.0 END"),
    "primary_conflict": f"({_primary.format('<>')})::INT",
    "primary_match": f"({_primary.format('=')})::INT",
    "name_words_s1": "len(a_name_toks)::INT",
    "name_words_pool": "len(b_name_toks)::INT",
    "pool_addr_empty": f"({_ba} = '')::INT",
    "is_s3": "(starts_with(pool_id, 'S3-'))::INT",
}


def features(names=tuple(FEATURES), k: int = 50) -> str:
    listed = ", ".join(f"{FEATURES[n]} AS {n}" for n in names)
    return f"{candidates(k)},\nfeats AS (SELECT *, {listed} FROM pairs)"


def _sum(weights) -> str:
    return " + ".join(f"{name} * {w}::DOUBLE" for name, w in dict(weights).items())


_disjoint = "(num_s1 > 0 AND num_pool > 0 AND num_shared = 0)"


def reranked(k: int = 50, keep: int = 10) -> str:
    from tessera.operators import scoring as sc

    z = f"{sc.RERANK_BIAS}::DOUBLE + ({_sum(sc.RERANK)}) + CASE WHEN num_shared > 0 THEN {sc.RERANK_SHARED}::DOUBLE WHEN {_disjoint} THEN {sc.RERANK_DISJOINT}::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""{features(k=k)},
rr0 AS MATERIALIZED (SELECT *, 1 / (1 + exp(-({z}))) AS rerank_p FROM feats),
rr AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(rerank_p, 9) DESC, block_rank)::INT AS rerank_rank FROM rr0 WHERE rerank_p >= 0.005),
top AS (SELECT * FROM rr WHERE rerank_rank <= {keep})"""


def sibling(dialect: str = "batch") -> str:
    raw = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
    return f"(len(list_filter({raw('b_name')}, lambda t: list_contains({text_list(vocab.SIBLING_WORDS[dialect])}, t) AND NOT list_contains({raw('a_name')}, t))) > 0)"


def scored(dialect: str = "batch") -> str:
    from tessera.operators import scoring as sc

    m = sc.BATCH if dialect == "batch" else sc.STUDIO
    if dialect == "batch":
        numbers = f"CASE WHEN primary_match = 1 THEN 2.8::DOUBLE WHEN primary_conflict = 1 THEN -5.0::DOUBLE WHEN num_shared > 0 THEN 1.5::DOUBLE WHEN {_disjoint} THEN -3.0::DOUBLE ELSE 0.0::DOUBLE END"
        veto = "sibling"
    else:
        numbers = f"CASE WHEN num_shared > 0 THEN 2.0::DOUBLE WHEN {_disjoint} THEN -2.6::DOUBLE ELSE 0.0::DOUBLE END"
        veto = f"sibling AND {_disjoint}"
    z = f"{m.bias}::DOUBLE + ({_sum(m.names)}) + CASE WHEN pool_addr_empty = 0 THEN {_sum(m.with_address)} ELSE {m.without_address}::DOUBLE + CASE WHEN name_token_set > 0.95 THEN {m.exact_without_address}::DOUBLE ELSE 0.0::DOUBLE END END + {numbers} + CASE WHEN {veto} THEN {m.sibling}::DOUBLE ELSE 0.0::DOUBLE END"
    low, high = m.clip
    return f"""{reranked()},
sib AS (SELECT *, {sibling(dialect)} AS sibling FROM top),
scored AS (SELECT *, greatest({low}::DOUBLE, least({high}::DOUBLE, 1 / (1 + exp(-({z}))))) AS prob FROM sib)"""


UNSEEN = "(a_country IN ('fr'))"


def accepted() -> str:
    return f"{scored()},\naccepted AS (SELECT s1_id, pool_id, prob FROM scored WHERE prob >= CASE WHEN {UNSEEN} THEN 0.85 ELSE 0.675 END AND NOT sibling AND NOT ({UNSEEN} AND {_disjoint}))"


def owned() -> str:
    return f"{accepted()},\nowned AS (SELECT s1_id, pool_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY round(prob, 9) DESC, s1_id) AS place FROM accepted) WHERE place = 1)"


_block = "try_cast(regexp_extract(address, '([0-9]+)', 1) AS BIGINT) // 100"
TRUTH = f"truth AS (SELECT x.id AS s1_id, y.id AS pool_id FROM (SELECT id, name, country, {_block} AS k FROM s1) x JOIN (SELECT id, name, country, {_block} AS k FROM pool) y ON x.name = y.name AND x.country = y.country AND x.k = y.k)"


def entity_scores(pairs: str, by: str = "", cells: str = "(SELECT id AS s1_id FROM s1)") -> str:
    """CTEs up to scores_(by, s1_id, n_true, n_predicted, n_hits, f05) for the CTE or table pairs(by, s1_id, pool_id)."""
    own = f"{by}, " if by else ""
    on = f"h.{by} = c.{by} AND " if by else ""
    return f"""hits_ AS (SELECT {own}p.s1_id, count(*) AS p, count(t.s1_id) AS h FROM (SELECT DISTINCT {own}s1_id, pool_id FROM {pairs}) p LEFT JOIN (SELECT DISTINCT s1_id, pool_id FROM truth) t ON t.s1_id = p.s1_id AND t.pool_id = p.pool_id GROUP BY ALL),
n_true_ AS (SELECT s1_id, count(*) AS t FROM (SELECT DISTINCT s1_id, pool_id FROM truth) GROUP BY 1),
counts_ AS (SELECT {"c." + by + ", " if by else ""}c.s1_id, coalesce(t, 0) AS n_true, coalesce(p, 0) AS n_predicted, coalesce(h, 0) AS n_hits FROM {cells} c LEFT JOIN n_true_ n ON n.s1_id = c.s1_id LEFT JOIN hits_ h ON {on}h.s1_id = c.s1_id),
scores_ AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_predicted = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n_hits = 0 THEN 0.0::DOUBLE
  ELSE 1.25 * (n_hits / n_predicted::DOUBLE) * (n_hits / n_true::DOUBLE) / (0.25 * (n_hits / n_predicted::DOUBLE) + n_hits / n_true::DOUBLE) END AS f05 FROM counts_)"""


def report(by: str = "") -> str:
    own = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    r = lambda x: f"round(coalesce({x}, 0.0), 9)"
    precision = "CASE WHEN n_true = 0 THEN CASE WHEN n_predicted = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n_predicted = 0 THEN 0.0::DOUBLE ELSE n_hits / n_predicted::DOUBLE END"
    return f"""SELECT {own}count(*) AS n_entities, {r('avg(f05)')} AS macro_f05, {r('avg(f05) FILTER (n_true = 0)')} AS f05_singletons, {r('avg(f05) FILTER (n_true > 0)')} AS f05_matched,
{r(f'avg({precision})')} AS mean_precision, {r('avg(CASE WHEN n_true = 0 THEN 1.0::DOUBLE ELSE n_hits / n_true::DOUBLE END)')} AS mean_recall FROM scores_{group}"""


def swept(configs) -> str:
    from dataclasses import astuple

    grid = ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in (i + 1, *astuple(c))) + ")" for i, c in enumerate(configs))
    unseen = f"({UNSEEN} AND g.unseen_strict)"
    vetoes = [
        "g.suppress_primary_conflict AND primary_conflict = 1", _disjoint, "g.suppress_sibling AND sibling AND (primary_match = 0 OR addr_token_set < 0.75)",
        "g.require_address AND pool_addr_empty = 0 AND addr_token_set < 0.35 AND primary_match = 0", f"{unseen} AND (addr_token_set < 0.50 OR primary_conflict = 1)",
        "greatest(name_token_set, skel_token_set, name_jw) < 0.65",
    ]
    score = "name_token_set * 0.40::DOUBLE + name_jw * 0.20::DOUBLE + skel_token_set * 0.15::DOUBLE + addr_token_set * 0.25::DOUBLE + CASE WHEN primary_match = 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN num_shared > 0 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""{reranked()},
grid(iteration, threshold, unseen_strict, unseen_threshold, require_address, suppress_primary_conflict, suppress_sibling, competition) AS (VALUES {grid}),
composite AS (SELECT *, round({score}, 9) AS score, {sibling('evaluator')} AS sibling FROM top),
passed AS (SELECT g.iteration, g.competition, s1_id, pool_id, score FROM composite, grid g WHERE NOT ({' OR '.join(f'({v})' for v in vetoes)}) AND score >= CASE WHEN {unseen} THEN g.unseen_threshold ELSE g.threshold END),
kept AS (SELECT iteration, s1_id, pool_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iteration, pool_id ORDER BY score DESC, s1_id) AS place FROM passed) WHERE place = 1 OR NOT competition)"""


def seeded(seed: int = 42) -> str:
    return f"md5('{seed}:' || id)"
