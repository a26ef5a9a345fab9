"""DuckDB SQL that recomputes each registered query from the raw tables.

Written independently of the Spark code: the fixture view, its defects, the
fitted artifacts, the feature map and the fixture model are re-derived from
their definitions, and tree scoring steps a node number level by level.
"""

from __future__ import annotations

from mediascore.schema import CONTINUOUS_FIELDS, DECIMAL_FIELDS, FIELDS, INT_FIELDS, RULE_NAMES
from mediascore.sources.fixtures import COUNTRY_CODES, GENRE_BY_TYPE, GENRE_OTHER, LONG_GENRE, OVERRIDES

LIST_COLS = ["genre", "origin_country", "production_countries", "spoken_languages"]
CATEGORICALS = ["original_language", "production_status"]


def _cc(k: str) -> str:
    return f"substr('{COUNTRY_CODES}', CAST(1 + 2 * (({k}) % 25) AS INTEGER), 2)"


_LANG = "CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"
_GENRE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GENRE_BY_TYPE.items()) + f" ELSE '{GENRE_OTHER}' END"


def clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '_+', '_', 'g'), '_')"
    )


MEDIA = f"""
li AS (
  SELECT l_partkey, min(year(l_shipdate)) AS y, count(*) AS n,
         sum(CAST(floor(l_extendedprice) AS BIGINT)) AS rev,
         sum(CAST(floor(l_quantity) AS BIGINT)) AS qty
  FROM lineitem GROUP BY l_partkey),
mi AS (
  SELECT p_partkey,
    'tt' || CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE CAST(p_partkey AS VARCHAR) END AS imdb_id,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(y AS INTEGER) END AS release_year,
    CASE WHEN p_partkey % 7 <> 0 THEN CAST(floor(p_retailprice * 10000) AS BIGINT) END AS budget,
    CASE WHEN p_partkey % 13 <> 0 THEN CAST(rev AS BIGINT) END AS revenue,
    CAST(p_size * 4 AS BIGINT) AS runtime,
    [{_cc('p_partkey')}] AS origin_country,
    [p_brand] AS production_companies,
    [{_cc('p_partkey')}, {_cc('p_partkey + p_size')}] AS production_countries,
    CASE p_partkey % 3 WHEN 0 THEN 'Released' WHEN 1 THEN 'Post Production' ELSE 'Rumored' END AS production_status,
    CASE WHEN p_partkey % 17 <> 0 THEN {_LANG} END AS original_language,
    CASE WHEN p_partkey % 19 <> 0 THEN [{_LANG}, 'en'] END AS spoken_languages,
    [{_GENRE}, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS genre,
    p_name AS tagline, p_name || ' ' || p_type AS overview,
    CAST(p_retailprice / 100 AS DECIMAL(5,3)) AS tmdb_rating,
    CAST(n * 100 AS BIGINT) AS tmdb_votes,
    CAST(p_size * 2 AS INTEGER) AS rt_score,
    CAST(100 - p_size AS INTEGER) AS metascore,
    CAST(p_size * 1.5 AS DECIMAL(4,1)) AS imdb_rating,
    CAST(qty AS BIGINT) AS imdb_votes
  FROM part LEFT JOIN li ON l_partkey = p_partkey)"""

# Raw records as sent (one defect per part, see the fixture definition), with
# the typed value each field parses to.
_OWN = {
    "imdb_id": "WHEN d = 0 THEN 'invalid_id' WHEN d = 1 THEN imdb_id || chr(10)",
    "release_year": "WHEN d = 2 THEN 1800 WHEN d = 12 THEN NULL WHEN d = 56 AND release_year IS NOT NULL THEN 1",
    "budget": "WHEN d = 3 THEN -1",
    "tmdb_rating": "WHEN d = 4 THEN 8.7004",
    "rt_score": "WHEN d = 5 THEN 101",
    "origin_country": "WHEN d = 6 THEN ['USA']",
    "original_language": "WHEN d = 7 THEN 'eng'",
    "genre": f"WHEN d = 8 THEN [genre[1], rpad('{LONG_GENRE}', 45, 'x')] WHEN d = 9 THEN [genre[1], NULL]",
}
_WIDE = {"tmdb_rating": "DECIMAL(18,8)", "imdb_rating": "DECIMAL(18,6)"}


def _raw_field(f: str) -> str:
    """The typed value a field has as sent (null where its type is wrong)."""
    sent = " ".join(f"WHEN d = {k} THEN {value or 'NULL'}" for k, (n, _, value, _) in OVERRIDES.items() if n == f)
    plain = f"CAST({f} AS {_WIDE[f]})" if f in _WIDE else f
    return f"    CASE WHEN d IN (10, 55, 57, 59, 60) THEN NULL {_OWN.get(f, '')} {sent} ELSE {plain} END AS {f}"


_YEAR_TEXT = """    CASE WHEN d IN (10, 55, 57, 59, 60) THEN NULL WHEN d = 2 THEN '1800' WHEN d = 12 AND release_year IS NOT NULL THEN CAST(release_year AS VARCHAR) || '.5'
         WHEN d = 56 AND release_year IS NOT NULL THEN '1' ELSE CAST(release_year AS VARCHAR) END AS release_year_text"""
_RAW_FIELDS = ",\n".join([_YEAR_TEXT, *map(_raw_field, FIELDS)])
RAW_TAIL = f""",
rw AS (
  SELECT p_partkey, CAST(p_partkey // 10 AS BIGINT) AS request_id, CAST(p_partkey % 10 AS BIGINT) AS pos,
    p_partkey % 101 AS d, mi.*
  FROM mi),
rv AS (
  SELECT request_id, pos, d, d IN (10, 55, 57, 59, 60) AS is_corrupt, d IN (10, 55, 59, 60) AS breaks_envelope,
{_RAW_FIELDS}
  FROM rw)"""
RAW = MEDIA + RAW_TAIL


def _rule_sql() -> dict[str, str]:
    """rule name -> SQL condition on ``rv`` (true when the rule breaks)."""
    r = {
        "imdb_id:required": "imdb_id IS NULL",
        "imdb_id:pattern": "imdb_id IS NOT NULL AND NOT regexp_full_match(imdb_id, 'tt[0-9]{7,8}')",
        "release_year:type": "release_year_text IS NOT NULL AND release_year IS NULL",
        "release_year:range": "release_year NOT BETWEEN 1900 AND 2100",
        "tmdb_rating:range": "tmdb_rating NOT BETWEEN 0 AND 10",
        "tmdb_rating:scale": "round(tmdb_rating, 3) <> tmdb_rating",
        "imdb_rating:range": "imdb_rating NOT BETWEEN 0 AND 100",
        "imdb_rating:scale": "round(imdb_rating, 1) <> imdb_rating",
        "rt_score:range": "rt_score NOT BETWEEN 0 AND 100",
        "metascore:range": "metascore NOT BETWEEN 0 AND 100",
        "production_status:max_length": "length(production_status) > 25",
        "original_language:max_length": "length(original_language) > 2",
        "original_language:length": "length(original_language) <> 2",
        "tagline:max_length": "length(tagline) > 255",
        "genre:element_length": "list_bool_or(list_transform(genre, lambda x: length(x) > 20))",
    }
    for f in ["budget", "revenue", "runtime", "tmdb_votes", "imdb_votes"]:
        r[f"{f}:range"] = f"{f} < 0"
    for c in ["origin_country", "production_countries", "spoken_languages"]:
        r[f"{c}:element_length"] = f"list_bool_or(list_transform({c}, lambda x: length(x) <> 2))"
    for c in ["origin_country", "production_companies", "production_countries", "spoken_languages", "genre"]:
        r[f"{c}:null_element"] = f"list_bool_or(list_transform({c}, lambda x: x IS NULL))"
    for k, (_, _, _, rule) in OVERRIDES.items():
        if rule:
            r[rule] = f"{r[rule]} OR d = {k}" if rule in r and rule != "release_year:type" else f"d = {k}"
    return r


RULE_SQL = _rule_sql()


def errors_sql(rules: list[str]) -> str:
    """'|'-joined names of broken rules, in rule order ('' when valid)."""
    parts = [f"CASE WHEN coalesce({RULE_SQL[n]}, false) THEN '{n}' END" for n in rules if n in RULE_SQL]
    checks = "concat_ws('|', " + ", ".join(parts) + ")" if parts else "''"
    return f"CASE WHEN is_corrupt THEN 'record:malformed_json' ELSE {checks} END"


ALL_ERRORS = errors_sql(RULE_NAMES)


def rules_of(group: str) -> list[str]:
    from mediascore.schema import RULES

    kinds = {
        "id": {"required", "pattern"},
        "ranges": {"range"},
        "decimal_scale": {"scale", "decimal_type"},
        "lengths": {"max_length", "length_eq"},
        "list_elements": {"no_null_elements", "element_length_eq", "element_max_length"},
        "types": {"int_type", "decimal_type", "json_type"},
    }[group]
    return [r[0] for r in RULES if r[2] in kinds]


# -- fitted artifacts ---------------------------------------------------------------
def _unpivot_continuous() -> str:
    return "\n    UNION ALL ".join(
        f"SELECT imdb_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM mi" for f in CONTINUOUS_FIELDS
    )


ARTIFACTS = MEDIA + f""",
nv AS (
    {_unpivot_continuous()}),
norm AS (
  SELECT feature, min(x) AS mn, max(x) AS mx FROM nv GROUP BY feature HAVING min(x) IS NOT NULL),
mem AS (
""" + "\n  UNION\n".join(
    f"  SELECT DISTINCT imdb_id, '{c}' AS oc, {clean('v')} AS category FROM (SELECT imdb_id, unnest({c}) AS v FROM mi) WHERE v IS NOT NULL AND v <> ''"
    for c in LIST_COLS
) + """),
cats AS (
  SELECT DISTINCT oc, category, oc || '_' || category AS column_name FROM mem WHERE category <> ''),
voc AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS col, v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS v FROM mi WHERE {c} IS NOT NULL)"
    for c in CATEGORICALS
) + """),
feat AS (
  SELECT feature || '_norm' AS name FROM norm
  UNION ALL SELECT column_name FROM cats
  UNION ALL SELECT 'original_language' UNION ALL SELECT 'production_status'),
fidx AS (
  SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS k FROM feat),
fmeta AS (
  SELECT CAST(count(*) AS INTEGER) AS nf,
         list(k) FILTER (WHERE name IN ('original_language', 'production_status')) AS cat_ks
  FROM fidx)"""


def feature_values(local_codes: bool = False) -> str:
    """fv(imdb_id, name, val): normalised values for every item, 1.0 for every
    matched category (absent categories are 0), codes for the categoricals."""
    code = "CASE WHEN mi.{c} IS NOT NULL THEN 0.0 END" if local_codes else "CAST(voc.code AS DOUBLE)"
    cat_rows = "\n  UNION ALL\n".join(
        f"  SELECT mi.imdb_id, '{c}' AS name, {code.format(c=c)} AS val FROM mi "
        f"LEFT JOIN voc ON voc.col = '{c}' AND voc.v = mi.{c}"
        for c in CATEGORICALS
    )
    return f""",
fv AS (
  SELECT nv.imdb_id, nv.feature || '_norm' AS name,
         CASE WHEN nv.x IS NULL THEN 0.0 ELSE (nv.x - norm.mn) / (norm.mx - norm.mn) END AS val
  FROM nv JOIN norm ON nv.feature = norm.feature
  UNION ALL
  SELECT mem.imdb_id, cats.column_name AS name, 1.0 AS val
  FROM mem JOIN cats ON mem.oc = cats.oc AND mem.category = cats.category
  UNION ALL
{cat_rows}),
fm AS (
  SELECT fv.imdb_id, map_from_entries(list({{'k': fidx.k, 'v': CAST(fv.val AS DOUBLE)}})) AS m
  FROM fv JOIN fidx ON fv.name = fidx.name GROUP BY fv.imdb_id)"""


def scoring(n_trees: int = 8, depth: int = 3, tree_offset: int = 0, local_codes: bool = False) -> str:
    """CTE chain ending in sc(imdb_id, margin) for the fixture model."""
    t = f"(t + {tree_offset})"
    q = f"(7 * {t} + 3 * i) % (SELECT nf FROM fmeta)"
    val = f"map_extract_value(m, {q})"
    is_cat = f"list_contains((SELECT cat_ks FROM fmeta), {q})"
    go_yes = (
        f"CASE WHEN {is_cat} THEN ({val} IS NULL OR {val} = ({t} + i) % 3) "
        f"ELSE CAST(coalesce({val}, 0.0) AS FLOAT) < CAST(((13 * {t} + 5 * i) % 97) / 97 AS FLOAT) END"
    )
    steps = [f"s0 AS (SELECT imdb_id, m, unnest(range({n_trees})) AS t, 0 AS i FROM fm)"]
    for lvl in range(1, depth + 1):
        steps.append(
            f"s{lvl} AS (SELECT imdb_id, m, t, 2 * i + CASE WHEN {go_yes} THEN 1 ELSE 2 END AS i FROM s{lvl - 1})"
        )
    leaf = f"CAST(CAST(((31 * {t} + 17 * i) % 201 - 100) / 1000 AS FLOAT) AS DOUBLE)"
    steps.append(f"sc AS (SELECT imdb_id, sum({leaf}) AS margin FROM s{depth} GROUP BY imdb_id)")
    return feature_values(local_codes) + ",\n" + ",\n".join(steps)


def with_(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + select


PROB = "1.0 / (1.0 + exp(-margin))"


# -- per-key SQL -------------------------------------------------------------------------
def _j(c: str) -> str:
    return f"array_to_string({c}, '|') AS {c}"


def _keys() -> str:
    return "request_id, pos"


def _norm_expr(f: str) -> str:
    return (
        f"round(CASE WHEN {f} IS NULL THEN 0.0 ELSE (CAST({f} AS DOUBLE) - (SELECT mn FROM norm WHERE feature = '{f}')) "
        f"/ ((SELECT mx FROM norm WHERE feature = '{f}') - (SELECT mn FROM norm WHERE feature = '{f}')) END, 6) AS {f}_norm"
    )


def _long_features(extra_where: str = "") -> str:
    return (
        "SELECT fv.imdb_id, fv.name AS feature, round(fv.val, 6) AS value FROM fv "
        f"WHERE (fv.val IS NULL OR fv.val <> 0) {extra_where}"
    )


def _scored(tree_offset: str = "0", local: bool = False, extra: str = "") -> str:
    return ARTIFACTS + (",\n" + extra if extra else "") + scoring(8, 3, tree_offset, local)


LATEST = """reg AS (SELECT * FROM (VALUES ('1', 'None'), ('2', 'Staging'), ('9', 'Production'), ('10', 'Production')) AS r(version, stage)),
latest AS (SELECT version FROM reg ORDER BY CASE stage WHEN 'Production' THEN 0 WHEN 'Staging' THEN 1 ELSE 2 END, CAST(version AS INTEGER) DESC LIMIT 1)"""


#: Every 37th request is a bare array, every 39th ends in other text; of the others every 41st has no items.
_BARE = "(request_id % 37 = 5 OR request_id % 39 = 11)"
_EMPTY = f"(NOT {_BARE} AND request_id % 41 = 7)"


def _is_envelope(corrupt: str) -> str:
    return f"(NOT {_BARE} AND ({_EMPTY} OR NOT bool_or({corrupt})))"


def _valid_requests() -> str:
    return f"SELECT request_id FROM ev WHERE NOT {_BARE} AND NOT {_EMPTY} GROUP BY request_id HAVING bool_and(errors = '')"


EV = RAW + f""",
ev AS (SELECT *, {ALL_ERRORS} AS errors FROM rv)"""


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["media_items"] = with_(MEDIA, f"""SELECT imdb_id, CAST(release_year AS BIGINT) AS release_year, budget, revenue, runtime,
  {_j('origin_country')}, {_j('production_companies')}, {_j('production_countries')}, production_status, original_language,
  {_j('spoken_languages')}, {_j('genre')}, tagline, overview, CAST(tmdb_rating AS DOUBLE) AS tmdb_rating, tmdb_votes,
  CAST(rt_score AS BIGINT) AS rt_score, CAST(metascore AS BIGINT) AS metascore, CAST(imdb_rating AS DOUBLE) AS imdb_rating, imdb_votes
FROM mi""")
    q["media_typed"] = with_(MEDIA, "SELECT imdb_id, CAST(release_year AS BIGINT) AS release_year, true AS tagline_absent, true AS overview_absent FROM mi")
    q["scan_json_records"] = with_(RAW, f"""SELECT {_keys()}, imdb_id, release_year_text, {_j('genre')}, {_j('origin_country')}, original_language, is_corrupt FROM rv""")
    q["scan_batch_envelope"] = with_(RAW, f"""SELECT request_id, {_is_envelope('breaks_envelope')} AS is_envelope,
  CASE WHEN {_is_envelope('breaks_envelope')} THEN CASE WHEN {_EMPTY} THEN 0 ELSE count(*) END END AS n_items,
  CASE WHEN {_is_envelope('breaks_envelope')} THEN CASE WHEN {_EMPTY} THEN '' ELSE string_agg(imdb_id, '|' ORDER BY pos) END END AS ids
FROM rv GROUP BY request_id""")
    q["parse_typed"] = with_(RAW, f"""SELECT {_keys()}, imdb_id, CAST(release_year AS BIGINT) AS release_year, CAST(budget AS BIGINT) AS budget,
  CAST(rt_score AS BIGINT) AS rt_score, CAST(CAST(tmdb_rating AS DECIMAL(5,3)) AS DOUBLE) AS tmdb_rating,
  CAST(CAST(imdb_rating AS DECIMAL(4,1)) AS DOUBLE) AS imdb_rating FROM rv""")
    for group in ["id", "ranges", "decimal_scale", "lengths", "list_elements", "types"]:
        q[f"validate_{group}"] = with_(RAW, f"SELECT {_keys()}, imdb_id, {errors_sql(rules_of(group))} AS errors FROM rv")
    optional = [c for c in [
        "release_year_text", "budget", "revenue", "runtime", "origin_country", "production_companies",
        "production_countries", "production_status", "original_language", "spoken_languages", "genre", "tagline",
        "overview", "tmdb_rating", "tmdb_votes", "rt_score", "metascore", "imdb_rating", "imdb_votes"]]
    # a number that cannot be parsed is there all the same
    there = {c: [k for k, o in OVERRIDES.items() if o[0] == c and o[2] is None and c in INT_FIELDS + DECIMAL_FIELDS] for c in optional}
    n_null = " + ".join(f"CASE WHEN {c} IS NULL AND d NOT IN ({', '.join(map(str, there[c] or [-1]))}) THEN 1 ELSE 0 END" for c in optional)
    q["validate_flags"] = with_(EV, f"SELECT {_keys()}, CAST({n_null} AS BIGINT) AS n_null, errors = '' AS is_valid FROM ev")
    q["validate_report"] = with_(EV, """SELECT rule, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT unnest(string_split(errors, '|')) AS rule FROM ev WHERE errors <> '') GROUP BY rule""")
    q["validate_split_valid"] = with_(EV, f"""SELECT {_keys()}, imdb_id, CAST(release_year AS BIGINT) AS release_year, CAST(budget AS BIGINT) AS budget,
  CAST(tmdb_rating AS DOUBLE) AS tmdb_rating, {_j('genre')} FROM ev WHERE errors = ''""")
    q["validate_split_quarantine"] = with_(EV, f"SELECT {_keys()}, imdb_id, errors FROM ev WHERE errors <> ''")
    q["batch_all_or_nothing"] = with_(EV, f"SELECT {_keys()}, imdb_id FROM ev WHERE request_id IN ({_valid_requests()})")
    q["fit_normalization"] = with_(ARTIFACTS, "SELECT feature, mn AS min, mx AS max FROM norm")
    q["fit_category_schema"] = with_(ARTIFACTS, "SELECT oc AS original_column, category, column_name FROM cats")
    q["fit_category_vocab"] = with_(ARTIFACTS, "SELECT col AS column, v AS value, CAST(code AS BIGINT) AS code FROM voc")
    some = MEDIA.replace("mi AS (", "mi0 AS (", 1) + ",\nmi AS (SELECT * FROM mi0 WHERE p_partkey % 4 <> 0)" + ARTIFACTS[len(MEDIA):]
    q["fit_incremental"] = with_(some, """SELECT 'norm' AS kind, feature AS column, NULL::VARCHAR AS value, mn AS min, mx AS max, NULL::BIGINT AS code FROM norm
UNION ALL SELECT 'cat', oc, category, NULL, NULL, NULL FROM cats
UNION ALL SELECT 'voc', col, v, NULL, NULL, CAST(code AS BIGINT) FROM voc""")
    q["load_normalization"] = q["fit_normalization"]
    q["load_category_schema"] = with_(ARTIFACTS, "SELECT oc AS original_column, column_name FROM cats")
    q["category_map_parse"] = q["load_category_schema"]
    q["category_map_build"] = q["fit_category_schema"]
    q["clean_values"] = with_(MEDIA, "\nUNION\n".join(
        f"SELECT DISTINCT '{c}' AS original_column, v AS value, {clean('v')} AS cleaned FROM (SELECT unnest({c}) AS v FROM mi) WHERE v IS NOT NULL AND v <> ''"
        for c in LIST_COLS))
    q["load_model"] = with_(_scored(), """SELECT CAST(t AS BIGINT) AS tree_id, CAST(i AS BIGINT) AS node_id, 'leaf' AS kind,
  round(CAST(CAST(((31 * t + 17 * i) % 201 - 100) / 1000 AS FLOAT) AS DOUBLE), 6) AS value, CAST(count(*) AS BIGINT) AS n_rows FROM s3 GROUP BY t, i""")
    q["artifact_integrity"] = with_(ARTIFACTS + """,
held AS (
  SELECT 'normalization' AS artifact, (SELECT CAST(count(*) AS BIGINT) FROM norm) AS n
  UNION ALL SELECT 'schema', (SELECT CAST(count(*) AS BIGINT) FROM cats)
  UNION ALL SELECT 'vocab', (SELECT CAST(count(*) AS BIGINT) FROM voc)
  UNION ALL SELECT 'meta', 1 UNION ALL SELECT 'nodes', 120)""", """SELECT v.version, artifact, n AS expected_rows,
  CASE WHEN v.version = '12' AND artifact = 'nodes' THEN 75 WHEN v.version = '12' AND artifact = 'vocab' THEN 1 ELSE n END AS found_rows,
  CASE WHEN v.version = '12' AND artifact IN ('nodes', 'vocab') THEN 'rows' WHEN v.version = '13' AND artifact = 'normalization' THEN 'content' END AS reason
FROM held CROSS JOIN (VALUES ('10'), ('12'), ('13')) AS v(version)
UNION ALL SELECT '14', 'manifest', NULL, NULL, 'unfinished upload'""")
    q["normalize_minmax"] = with_(ARTIFACTS, "SELECT imdb_id, " + ", ".join(_norm_expr(f) for f in CONTINUOUS_FIELDS) + " FROM mi")
    q["normalize_nulls"] = with_(ARTIFACTS, "SELECT imdb_id, " + ", ".join(_norm_expr(f) for f in ("release_year", "budget", "revenue"))
                                 + " FROM mi WHERE release_year IS NULL OR budget IS NULL OR revenue IS NULL")
    q["normalize_degenerate"] = with_(MEDIA, """SELECT imdb_id, CAST(0.0 AS DOUBLE) AS runtime_norm,
  CASE WHEN runtime IS NOT NULL AND runtime <> 40 THEN 'runtime:degenerate_range' ELSE '' END AS errors FROM mi""")
    act = """act AS (SELECT mem.imdb_id, cats.column_name FROM mem JOIN cats ON mem.oc = cats.oc AND mem.category = cats.category)"""
    q["multi_hot_encode"] = with_(ARTIFACTS + ",\n" + act, """SELECT mi.imdb_id, coalesce(string_agg(act.column_name, '|' ORDER BY act.column_name), '') AS active,
  CAST(count(act.column_name) AS BIGINT) AS n_active FROM mi LEFT JOIN act ON act.imdb_id = mi.imdb_id GROUP BY mi.imdb_id""")
    q["encode_empty_map"] = with_(ARTIFACTS + ",\n" + act, """SELECT mi.imdb_id, (SELECT CAST(count(*) AS BIGINT) FROM cats WHERE oc = 'spoken_languages') AS n_columns,
  CAST(0 AS BIGINT) AS total,
  CAST(count(act.column_name) FILTER (WHERE act.column_name NOT LIKE 'spoken\\_languages\\_%' ESCAPE '\\') AS BIGINT) AS n_active
FROM mi LEFT JOIN act ON act.imdb_id = mi.imdb_id GROUP BY mi.imdb_id""")
    q["encode_missing_column"] = with_(ARTIFACTS + ",\n" + act, """SELECT mi.imdb_id,
  coalesce(string_agg(act.column_name, '|' ORDER BY act.column_name) FILTER (WHERE act.column_name NOT LIKE 'genre\\_%' ESCAPE '\\'), '') AS active,
  CAST(count(act.column_name) FILTER (WHERE act.column_name NOT LIKE 'genre\\_%' ESCAPE '\\') AS BIGINT) AS n_active,
  CAST(0 AS BIGINT) AS genre_total
FROM mi LEFT JOIN act ON act.imdb_id = mi.imdb_id GROUP BY mi.imdb_id""")
    q["drop_unused"] = with_(MEDIA, f"SELECT imdb_id, CAST(17 AS BIGINT) AS n_columns, production_status, original_language, {_j('genre')} FROM mi")
    q["single_value_category"] = with_(ARTIFACTS, """SELECT mi.imdb_id,
  CAST(a.code AS BIGINT) AS production_status, CAST(b.code AS BIGINT) AS original_language
FROM mi LEFT JOIN voc a ON a.col = 'production_status' AND a.v = mi.production_status
        LEFT JOIN voc b ON b.col = 'original_language' AND b.v = mi.original_language""")
    q["fill_numeric"] = with_(MEDIA, """SELECT imdb_id, CAST(coalesce(release_year, 0) AS BIGINT) AS release_year, coalesce(budget, 0) AS budget,
  coalesce(revenue, 0) AS revenue, coalesce(tmdb_votes, 0) AS tmdb_votes, coalesce(imdb_votes, 0) AS imdb_votes FROM mi""")
    q["align_features"] = with_(ARTIFACTS + feature_values(), f"""SELECT imdb_id, feature, value
FROM ({_long_features()}) WHERE feature NOT LIKE 'spoken\\_languages\\_%' ESCAPE '\\' AND feature <> 'original_language'
UNION ALL SELECT imdb_id, 'original_language' AS feature, CAST(NULL AS DOUBLE) AS value FROM mi""")
    q["numeric_coerce"] = with_(ARTIFACTS + feature_values(), """SELECT fidx.name AS feature,
  CAST(count(*) FILTER (WHERE fv.val <> 0) AS BIGINT) AS n_nonzero,
  CAST(CASE WHEN fidx.name IN ('original_language', 'production_status')
            THEN (SELECT count(*) FROM mi) - count(fv.val) ELSE 0 END AS BIGINT) AS n_null,
  round(coalesce(sum(fv.val), 0.0), 6) AS total
FROM fidx LEFT JOIN fv ON fv.name = fidx.name GROUP BY fidx.name""")
    q["preprocess"] = with_(ARTIFACTS + feature_values(), _long_features())
    q["tree_margin"] = with_(_scored(), "SELECT imdb_id, round(margin, 6) AS margin FROM sc")
    q["predict_proba"] = with_(_scored(), f"SELECT imdb_id, round({PROB}, 6) AS probability FROM sc")
    q["predict_label"] = with_(_scored(), f"SELECT imdb_id, {PROB} > 0.5 AS prediction FROM sc")
    q["predict_single"] = with_(_scored(local=True), f"SELECT imdb_id, {PROB} > 0.5 AS prediction, round({PROB}, 6) AS probability FROM sc")
    q["predict_batch"] = with_(_scored(), f"SELECT imdb_id, {PROB} > 0.5 AS prediction, round({PROB}, 6) AS probability FROM sc")
    q["predict_sharded"] = q["predict_batch"]
    q["results_envelope"] = with_(_scored() + RAW_TAIL + ",\n" + f"ev AS (SELECT *, {ALL_ERRORS} AS errors FROM rv)",
        f"""SELECT ev.request_id, ev.pos, ev.imdb_id, {PROB} > 0.5 AS prediction, round({PROB}, 6) AS probability
FROM ev JOIN sc ON sc.imdb_id = ev.imdb_id WHERE ev.request_id IN ({_valid_requests()})
UNION ALL SELECT DISTINCT request_id, NULL, NULL, NULL, NULL FROM ev WHERE {_EMPTY}""")
    q["results_by_envelope"] = with_(EV, f"""SELECT request_id // 2 AS request_id, CAST(count(*) AS BIGINT) AS n_results, string_agg(imdb_id, '|' ORDER BY pos) AS ids
FROM ev WHERE request_id IN ({_valid_requests()}) GROUP BY ev.request_id
UNION ALL SELECT request_id // 2, 0, '' FROM (SELECT DISTINCT request_id FROM ev WHERE {_EMPTY})""")
    failing = """fails AS (SELECT p_partkey // 10 AS request_id, p_partkey % 10 AS pos, imdb_id FROM mi
  WHERE release_year <> (SELECT min(release_year) FROM mi))"""
    q["score_failures"] = with_(MEDIA + ",\n" + failing, """SELECT CAST(request_id AS BIGINT) AS request_id, CAST(pos AS BIGINT) AS pos, imdb_id,
  'release_year:degenerate_range' AS reason FROM fails""")
    constant = ARTIFACTS.replace("norm AS (", "norm0 AS (", 1).replace("mem AS (", """norm AS (
  SELECT feature, mn, CASE WHEN feature = 'release_year' THEN mn ELSE mx END AS mx FROM norm0),
mem AS (""", 1)
    flat = scoring().replace("WHEN nv.x IS NULL THEN", "WHEN nv.x IS NULL OR norm.mx = norm.mn THEN")
    q["score_answers"] = with_(constant + flat + ",\n" + failing, f"""SELECT CAST(mi.p_partkey // 10 AS BIGINT) AS request_id, CAST(mi.p_partkey % 10 AS BIGINT) AS pos,
  mi.imdb_id, {PROB} > 0.5 AS prediction, round({PROB}, 6) AS probability
FROM mi JOIN sc ON sc.imdb_id = mi.imdb_id WHERE mi.p_partkey // 10 NOT IN (SELECT request_id FROM fails)""")
    q["envelope_rejections"] = with_(EV, f"""SELECT request_id, pos, unnest(string_split(errors, '|')) AS rule FROM ev
WHERE errors <> '' AND NOT {_EMPTY} AND request_id NOT IN (SELECT request_id FROM ev GROUP BY request_id HAVING NOT {_is_envelope('breaks_envelope')})
UNION ALL SELECT request_id, NULL, 'envelope:malformed' FROM ev GROUP BY request_id HAVING NOT {_is_envelope('breaks_envelope')}""")
    latest_off = "(SELECT CAST(version AS INTEGER) - 1 FROM latest)"
    q["latest_model_version"] = with_(_scored(latest_off, extra=LATEST),
        f"SELECT imdb_id, (SELECT version FROM latest) AS model_version, round({PROB}, 6) AS probability FROM sc")
    q["pinned_version"] = with_(_scored("8"), f"SELECT imdb_id, '9' AS model_version, round({PROB}, 6) AS probability FROM sc")
    q["model_metadata"] = with_(_scored(latest_off, extra=LATEST), f"""SELECT 'm1' AS model_name, (SELECT version FROM latest) AS version,
  'run-' || (SELECT version FROM latest) AS run_id, 'Production' AS stage, 'READY' AS status,
  'fixture version ' || (SELECT version FROM latest) AS description,
  1700000000000 + (SELECT CAST(version AS BIGINT) FROM latest) * 1000 AS creation_timestamp,
  1700000000000 + (SELECT CAST(version AS BIGINT) FROM latest) * 2000 AS last_updated_timestamp,
  'stage=Production|tree_offset=' || (SELECT version FROM latest) AS tags, 'depth=3.0|n_trees=8.0' AS run_metrics,
  'tree_offset=' || (SELECT version FROM latest) AS run_params, CAST(count(*) AS BIGINT) AS n_scored,
  round(avg(CASE WHEN {PROB} > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM sc""")
    q["artifact_summary"] = with_(ARTIFACTS + """,
per AS (SELECT oc, count(*) AS n FROM cats GROUP BY oc),
v AS (SELECT * FROM (VALUES ('10', 8), ('11', 0)) AS t(version, trees))""", """SELECT version AS model_version, 'run-' || version AS run_id,
  (SELECT CAST(count(*) AS BIGINT) FROM fidx) AS features_count,
  (SELECT CAST(count(*) AS BIGINT) FROM norm) AS normalization_fields,
  (SELECT CAST(count(*) AS BIGINT) FROM per) AS schema_mappings,
  (SELECT string_agg(oc || '=' || CAST(n AS VARCHAR), '|' ORDER BY oc) FROM per) AS categories,
  CAST(trees AS BIGINT) AS n_trees, trees > 0 AS healthy, CASE WHEN trees = 0 THEN 'no model trees' END AS reason FROM v""")
    q["stream_score"] = with_(_scored() + RAW_TAIL + ",\n" + f"ev AS (SELECT *, {ALL_ERRORS} AS errors FROM rv)",
        f"SELECT ev.imdb_id, {PROB} > 0.5 AS prediction, round({PROB}, 6) AS probability FROM ev JOIN sc ON sc.imdb_id = ev.imdb_id WHERE ev.errors = ''")
    # requests of the first third are scored with version 9, the others with 10
    third = "CAST(substr(imdb_id, 3) AS BIGINT) // 10 % 3"
    q["stream_model_refresh"] = with_(_scored(f"(CASE WHEN {third} = 0 THEN 8 ELSE 9 END)") + RAW_TAIL + ",\n" + f"ev AS (SELECT *, {ALL_ERRORS} AS errors FROM rv)",
        f"SELECT ev.imdb_id, CASE WHEN ev.request_id % 3 = 0 THEN '9' ELSE '10' END AS model_version, round({PROB}, 6) AS probability FROM ev JOIN sc ON sc.imdb_id = ev.imdb_id WHERE ev.errors = ''")
    q["stream_envelopes"] = q["results_envelope"]
    q["stream_envelope_rejections"] = q["envelope_rejections"]
    q["registry_metadata"] = """WITH sup AS (
  SELECT 'nation-' || s_nationkey AS model_name, CAST(s_suppkey AS VARCHAR) AS version, 'run-' || (s_suppkey % 50) AS run_id, s_suppkey,
         CASE WHEN s_acctbal > 8000 THEN 'Production' WHEN s_acctbal > 4000 THEN 'Staging' WHEN s_acctbal > 0 THEN 'None' ELSE 'Archived' END AS stage FROM supplier),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY CASE stage WHEN 'Production' THEN 0 WHEN 'Staging' THEN 1 ELSE 2 END, s_suppkey DESC) AS k
  FROM sup WHERE stage <> 'Archived') WHERE k = 1),
ev AS (SELECT *, 'run-' || (user_id % 50) AS run_id, event_id % 97 AS step FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_type ORDER BY step DESC, ts DESC, value DESC) AS k FROM ev WHERE event_type IS NOT NULL) WHERE k = 1),
m AS (SELECT run_id, string_agg(event_type || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '|' ORDER BY event_type || '=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS metrics_x100
  FROM last GROUP BY run_id),
par AS (SELECT 'run-' || (o_custkey % 50) AS run_id, 'priority-' || o_orderstatus || '=' || max(o_orderpriority) AS kv FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1, o_orderstatus),
p AS (SELECT run_id, string_agg(kv, '|' ORDER BY kv) AS run_params FROM par GROUP BY run_id)
SELECT model_name, version, newest.run_id, stage,
  CASE WHEN m.run_id IS NULL AND p.run_id IS NULL THEN NULL ELSE coalesce(metrics_x100, '') END AS metrics_x100,
  CASE WHEN m.run_id IS NULL AND p.run_id IS NULL THEN NULL ELSE coalesce(run_params, '') END AS run_params
FROM newest LEFT JOIN m ON m.run_id = newest.run_id LEFT JOIN p ON p.run_id = newest.run_id"""
    q["stream_refresh_quarantine"] = with_(EV, "SELECT imdb_id, errors FROM ev WHERE errors <> ''")
    return q
