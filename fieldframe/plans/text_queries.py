"""Web page, announcement, claim rule and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.numbers import rounded
from fieldframe.operators import text as T
from fieldframe.plans import inputs as I
from fieldframe.plans.clean_queries import ENGLISH, choose, choose_sql
from fieldframe.plans.inputs import R, with_sql
from fieldframe.plans.panel_queries import show
from fieldframe.plans.registry import query
from fieldframe.functions.names import PROVINCE_NAMES
from fieldframe.sources import files as S

# Written apart from the operator: what the pages hold are these references, some without semicolon.
HTML = r"""pieces AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?[a-z!?](?:"[^"]*"|''[^'']*''|[^''">])*>|[^<]+|<')) AS piece,
    generate_subscripts(regexp_extract_all(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?[a-z!?](?:"[^"]*"|''[^'']*''|[^''">])*>|[^<]+|<'), 1) AS i FROM pages),
shown AS (SELECT page_id, i, CASE WHEN piece ILIKE '<script%' OR piece ILIKE '<style%' THEN regexp_replace(regexp_replace(piece, '^<[^>]*>', ''), '</[^>]*>$', '')
    WHEN piece[1] <> '<' OR piece = '<' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece,
      '&nbsp;?', chr(160), 'g'), '&middot;?', chr(183), 'g'), '&copy;?', chr(169), 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') END AS part FROM pieces),
bare AS (SELECT page_id, i, regexp_replace(part, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g') AS part FROM shown WHERE part IS NOT NULL),
visible AS (SELECT p.page_id, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (part <> ''), '') AS text FROM pages p LEFT JOIN bare b ON p.page_id = b.page_id GROUP BY p.page_id)"""


@query("html_text", with_sql(HTML) + "SELECT page_id, text FROM visible")
def html_text(spark, d):
    return I.table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_SINGLE = ", ".join(f"'{n}'" for n in T.ANNOUNCED if n not in T.SPLIT_NAMES)
_DOUBLE = ", ".join(f"'{n}'" for n in T.SPLIT_NAMES)


@query("announcement_rows", with_sql(HTML, """tab AS (SELECT page_id, text || ' 全国总计 ' || page_id || ' 12.5 x 3,000 北京 1 2 黑 龙江 ' || CAST(page_id % 7 + 4.5 AS DOUBLE) || ' 5 6 7 ' ||
    CASE WHEN page_id % 2 = 0 THEN '河北 1 2 3 河北 9 9 9 ' ELSE '河北 8 9' END AS t FROM visible)""",
  "tok AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(replace(t, chr(160), ' '), '[　,，]', '', 'g'), '\\s+'), lambda x: x <> '') AS ts FROM tab)",
  "word AS (SELECT page_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM tok)",
  "pair AS (SELECT *, w || lead(w) OVER (PARTITION BY page_id ORDER BY i) AS ww FROM word)",
  f"name AS (SELECT page_id, i, i AS last, w AS province FROM pair WHERE w IN ({_SINGLE}) UNION ALL SELECT page_id, i, i + 1, ww FROM pair WHERE ww IN ({_DOUBLE}))",
  "span AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY page_id ORDER BY i), 1000000000) AS stop FROM name)",
  f"number AS (SELECT s.page_id, s.i, s.province, CAST(w.w AS DOUBLE) AS v, row_number() OVER (PARTITION BY s.page_id, s.i ORDER BY w.i) AS k FROM span s JOIN word w ON w.page_id = s.page_id AND w.i > s.last AND w.i < s.stop AND regexp_matches(w.w, '{T.NUMBER}'))",
  "three AS (SELECT page_id, i, province, max(v) FILTER (k = 1) AS a, max(v) FILTER (k = 2) AS p, max(v) FILTER (k = 3) AS y FROM number GROUP BY ALL HAVING count(*) >= 3)",
  "first AS (SELECT *, row_number() OVER (PARTITION BY page_id, province ORDER BY i) AS k FROM three)") + f"""
SELECT page_id, CAST(2000 + page_id % 20 AS INTEGER) AS year, province, CASE WHEN province = '全国总计' THEN 'national' ELSE 'province' END AS admin_level, 'grain' AS crop,
  {R('a * 1000')} AS sown_area_hectare, {R('p * 10000')} AS production_ton, {R('y')} AS yield_kg_per_hectare FROM first WHERE k = 1""")
def announcement_rows(spark, d):
    """Whole page text followed by a table: one region lacks a number, one is split, one repeats."""
    k = F.col("page_id")
    s = k.cast("string")
    table = F.concat(
        F.lit(" 全国总计 "), s, F.lit(" 12.5 x 3,000 北京 1 2 黑 龙江 "), (k % 7 + 4.5).cast("string"), F.lit(" 5 6 7 "),
        F.when(k % 2 == 0, F.lit("河北 1 2 3 河北 9 9 9 ")).otherwise("河北 8 9"))
    pages = I.table(spark, d, "pages").select("page_id", F.concat(T.html_text(F.col("html")), table).alias("t"))
    out = T.announcement_rows(pages, "page_id", F.col("t"), (k % 20 + 2000).cast("int"))
    return show(out, ["page_id", "year", "province", "admin_level", "crop"], ["sown_area_hectare", "production_ton", "yield_kg_per_hectare"])


CATEGORIES = ("Rice production", "Rice sown area", "Total grain production", "Grain sown area", "Wheat production", "Rice price")
_MAP_SQL = ", ".join(f"('{k}', '{v}')" for k, v in PROVINCE_NAMES.items())


@query("ers_measure_pivot", f"""
WITH t AS (SELECT o_orderkey AS k, {choose_sql(ENGLISH, 'o_orderkey')} AS g, CAST(year(o_orderdate) AS INTEGER) AS year, lower({choose_sql(CATEGORIES, 'o_custkey')}) AS c, o_totalprice * 1000 AS v FROM orders),
m AS (SELECT * FROM (VALUES {_MAP_SQL}) x(a, b)),
r AS (SELECT k, coalesce(b, g) AS province, year, CASE WHEN c LIKE '%rice%' THEN 'rice' WHEN c LIKE '%grain%' THEN 'grain' END AS crop,
  CASE WHEN c LIKE '%production%' THEN 'p' WHEN c LIKE '%sown area%' THEN 's' END AS measure, v FROM t LEFT JOIN m ON a = lower(g)),
w AS (SELECT province, year, crop, arg_max(v, k) FILTER (measure = 'p') AS p, arg_max(v, k) FILTER (measure = 's') AS s FROM r WHERE crop IS NOT NULL AND measure IS NOT NULL GROUP BY ALL)
SELECT province, year, crop, {R('p', 2)} AS production_ton, {R('s', 2)} AS sown_area_hectare, {R('CASE WHEN s > 0 THEN p * 1000 / s END')} AS yield_kg_per_hectare FROM w""")
def ers_measure_pivot(spark, d):
    rows = I.table(spark, d, "orders").select(
        "o_orderkey", choose(ENGLISH, F.col("o_orderkey")).alias("geography"), F.year("o_orderdate").alias("year"),
        choose(CATEGORIES, F.col("o_custkey")).alias("category"), F.lit("").alias("commodity"), F.col("o_totalprice").alias("amount"))
    out = T.measure_pivot(rows, ["o_orderkey"])
    return out.select("province", "year", "crop", rounded("production_ton", 2).alias("production_ton"),
                      rounded("sown_area_hectare", 2).alias("sown_area_hectare"), rounded("yield_kg_per_hectare").alias("yield_kg_per_hectare"))


RULES = T.ClaimRules(
    risky={"causal_overclaim": ("license", "ication"), "subprovince_yield_loss_overclaim": ("und ", "Der ")}, safe=("nicht", "the"), impact=("copyright", "email"),
    labels=("the", "der"), scopes=("and",), dated="of", dated_terms=("that", "with"), dated_qualifiers=("was",))
_any = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"
_matched = lambda words: "concat_ws(', ', " + ", ".join(f"CASE WHEN contains(l, '{w.lower()}') THEN '{w}' END" for w in words) + ")"
_strip = lambda text: f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
RISKY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line, '{rule}', {_matched(words)}, '{T.MESSAGES['risky']}' || {_matched(words)}, {_strip('raw')} FROM lines WHERE {_any('l', words)} AND NOT {_any('l', RULES.safe)} AND NOT {_any('l', RULES.impact)}"
    for rule, words in RULES.risky.items())


@query("claim_guardrails", with_sql("docs AS (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN '# ' || text ELSE text END, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) AS text FROM documents)",
  "split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)", "lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS raw, lower(unnest(ls)) AS l FROM split)",
  "isl AS (SELECT *, sum(CASE WHEN trim(raw, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM lines)",
  "paras AS (SELECT doc_id, min(line) AS line, string_agg(raw, chr(10) ORDER BY line) AS body, string_agg(" + _strip("raw") + ", ' ' ORDER BY line) AS shown FROM isl WHERE trim(raw, ' ' || chr(9)) <> '' GROUP BY doc_id, g)") + f"""
SELECT doc_id, CAST(line AS INTEGER) AS line, rule, matched, message, excerpt FROM (SELECT doc_id, line, '' AS rule, '' AS matched, '' AS message, '' AS excerpt FROM lines WHERE false UNION ALL {RISKY_SQL}
UNION ALL SELECT doc_id, line, 'chd_scope_label_missing', '', '{T.MESSAGES['chd_scope_label_missing']}', {_strip('raw')} FROM lines WHERE regexp_matches(trim(raw), '^(#|\\| Figure|\\| Table|\\|\\s*(Figure|Table|\\d+))') AND {_any('l', RULES.labels)} AND NOT {_any('l', RULES.scopes)}
UNION ALL SELECT doc_id, line, 'validation_scope_missing', '', '{T.MESSAGES['validation_scope_missing']}', shown FROM paras WHERE contains(body, 'of') AND {_any('lower(body)', RULES.dated_terms)} AND NOT {_any('lower(body)', RULES.dated_qualifiers)}
UNION ALL SELECT doc_id, 1, 'impact_scope_missing', '', '{T.MESSAGES['impact_scope_missing']}', '' FROM docs WHERE NOT {_any('lower(text)', RULES.impact)})""")
def claim_guardrails(spark, d):
    """Claim rules with words of the test language; every third document starts with a title."""
    titled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    docs = I.table(spark, d, "documents").select("doc_id", F.replace(titled, F.lit(".\n"), F.lit(".\n \n")).alias("text"))
    return T.claim_issues(docs, "doc_id", "text", RULES)


TOKENS = ("retour", "Apache License", "quasi_causal")


@query("forbidden_tokens", "SELECT bool_or(" + " OR ".join(f"contains(text, '{t}')" for t in TOKENS) + ") AS detected FROM documents")
def forbidden_tokens(spark, d):
    return T.forbidden_tokens(I.table(spark, d, "documents"), "text", TOKENS)


# --- files ----------------------------------------------------------------------------------

FOLDERS = ("era5_land/x", "nasa/MOD13Q1", "CHIRPS/clipped", "chirps/full", "ChinaRiceCalendar", "clcd/v1", "asia_rice_yield", "GGCP10/prod", "gleam/raw", "misc")
STEMS = ("early_rice_transplant_", "county_level_rice_maturity_", "ggcp10_production_", "classified-Inner_Mongolia-", "gdhy_yield_", "cropland_", "heading_", "tas_")
ENDS = (".nc", ".tif", ".TIF", ".hdf", ".csv", ".nc4", "")
PATHS = f"""paths AS (SELECT o_orderkey AS file_id, o_custkey AS grp, 'raw/' || {choose_sql(FOLDERS, 'o_orderkey')} || '/' || {choose_sql(STEMS, 'o_orderkey // 10')} || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE CAST(1995 + o_orderkey % 12 AS VARCHAR) END
  || CASE WHEN o_orderkey % 5 = 0 THEN '_' || CAST(2003 + o_orderkey % 7 AS VARCHAR) ELSE '' END || '_' || o_orderkey || {choose_sql(ENDS, 'o_orderkey // 7')} AS path FROM orders)"""


def paths(spark, d):
    """File paths of many naming styles, one per order; customers are the groups."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    path = F.concat(
        F.lit("raw/"), choose(FOLDERS, k), F.lit("/"), choose(STEMS, F.floor(k / 10)), F.when(k % 9 == 0, "x").otherwise(text(k % 12 + 1995)),
        F.when(k % 5 == 0, F.concat(F.lit("_"), text(k % 7 + 2003))).otherwise(""), F.lit("_"), text(k), choose(ENDS, F.floor(k / 7)))
    return I.table(spark, d, "orders").select(k.alias("file_id"), F.col("o_custkey").alias("grp"), path.alias("path"))


_like = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
LOWERED = "low AS (SELECT *, lower(path) AS p, lower(list_last(string_split(path, '/'))) AS n, lower(regexp_extract(list_last(string_split(path, '/')), '(\\.[^.]+)$', 1)) AS s FROM paths)"


@query("path_category", with_sql(PATHS, LOWERED) + f"""
SELECT file_id, CASE WHEN contains(p, 'chinaricecalendar') AND s IN ('.tif', '.tiff') THEN 'phenology' WHEN contains(p, '/clcd/') AND s IN ('.tif', '.tiff') THEN 'crop_mask'
  WHEN {_like('p', ('era5_land', 'cmfd', 'chirps', 'terraclimate'))} AND s IN ('.nc', '.nc4', '.cdf') THEN 'climate'
  WHEN {_like('p', ('nasa', 'mod13q1', 'gleam', 'grace', 'smap'))} AND s IN ('.nc', '.nc4', '.cdf', '.tif', '.tiff', '.hdf', '.h5') THEN 'remote_sensing' END AS category FROM low""")
def path_category(spark, d):
    return paths(spark, d).select("file_id", S.path_category(F.col("path")).alias("category"))


@query("filename_metadata", with_sql(PATHS, LOWERED, """m AS (SELECT *, CASE WHEN contains(p, 'ggcp10') THEN 'ggcp10' WHEN contains(p, 'asia_rice_yield') THEN 'asia_rice_yield_4km' WHEN contains(n, 'gdhy') THEN 'gdhy'
  ELSE 'unknown_yield_proxy' END AS source FROM low)""", """v AS (SELECT *, CASE WHEN contains(n, 'prod') THEN 'production' WHEN contains(n, 'yield') OR source IN ('asia_rice_yield_4km', 'gdhy') THEN 'yield' ELSE 'value' END AS variable FROM m)""") + """
SELECT file_id, source, TRY_CAST(regexp_extract(n, '(?:19|20)\\d{2}', 0) AS INTEGER) AS year, CASE WHEN contains(p, 'rice') THEN 'rice' ELSE 'unknown' END AS crop, variable,
  CASE WHEN source = 'ggcp10' AND variable = 'production' THEN CAST(1000.0 AS DOUBLE) END AS value_to_ton_factor,
  CASE WHEN contains(n, 'transplant') THEN 'transplanting' WHEN contains(n, 'maturity') THEN 'maturity' WHEN contains(n, 'heading') THEN 'heading' END AS stage,
  CASE WHEN contains(n, 'early_rice') THEN 'early' WHEN contains(n, 'rice') THEN 'rice' END AS season,
  CASE WHEN regexp_matches(n, 'classified-inner_mongolia-(?:(?:19|20)\\d{2})') THEN '内蒙古' ELSE '' END AS province FROM v""")
def filename_metadata(spark, d):
    meta = S.filename_metadata(F.col("path"))
    return paths(spark, d).select("file_id", *[c.alias(n) for n, c in meta.items()])


RANKED = """yrs AS (SELECT file_id, grp, path, CAST(unnest(CASE WHEN len(regexp_extract_all(n, '((?:19|20)\\d{2})', 1)) = 0 THEN [NULL] ELSE regexp_extract_all(n, '((?:19|20)\\d{2})', 1) END) AS INTEGER) AS y, CASE WHEN contains(p, 'rice') THEN 0 WHEN contains(p, 'clcd') OR contains(p, 'cropland') THEN 1 ELSE 2 END AS r FROM low)"""


@query("nearest_year_pick", with_sql(PATHS, LOWERED, RANKED) + """
SELECT grp, file_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y IS NULL, CASE WHEN y IS NOT NULL THEN r END, abs(y - 2000), y, path) AS k FROM yrs) WHERE k = 1""")
def nearest_year_pick(spark, d):
    return S.nearest_year(paths(spark, d), ["grp"], 2000).select("grp", "file_id")


@query("nearest_year_ties", with_sql(PATHS, LOWERED, RANKED) + """
SELECT DISTINCT grp, file_id FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY y IS NULL, CASE WHEN y IS NOT NULL THEN r END, abs(y - 2000), CASE WHEN y IS NULL THEN path END) AS k FROM yrs) WHERE k = 1""")
def nearest_year_ties(spark, d):
    return S.nearest_year(paths(spark, d), ["grp"], 2000, ties=True).select("grp", "file_id")


@query("interval_source_pick", with_sql(PATHS, LOWERED, """sp AS (SELECT *, coalesce(list_min(list_transform(regexp_extract_all(n, '((?:19|20)\\d{2})', 1), lambda x: CAST(x AS INTEGER))), 2002) AS a,
  coalesce(list_max(list_transform(regexp_extract_all(n, '((?:19|20)\\d{2})', 1), lambda x: CAST(x AS INTEGER))), 2002) AS b FROM low)""") + """
SELECT grp, file_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN contains(n, 'county_level') THEN 0 ELSE 1 END, b - a, path) AS k FROM sp WHERE 2002 BETWEEN a AND b) WHERE k = 1""")
def interval_source_pick(spark, d):
    return S.covering_interval(paths(spark, d), ["grp"], 2002).select("grp", "file_id")


@query("prefer_variant", with_sql(PATHS, LOWERED) + """
SELECT file_id FROM low WHERE contains(p, '/clipped/') OR NOT (contains(p, 'chirps') AND (SELECT bool_or(contains(p, '/clipped/')) FROM low WHERE contains(p, 'chirps')))""")
def prefer_variant(spark, d):
    return S.prefer_variant(paths(spark, d), ["chirps", "gleam"]).select("file_id")


FROZEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


FROZEN_KEYS = {"orders": ["o_totalprice"], "events": ["value"]}
FROZEN_YEARS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query("freeze_hashes")
def freeze_hashes(spark, d):
    """Content hashes have no SQL; what SQL can measure is in ``freeze_measures``."""
    tables = {n: I.table(spark, d, n) for n in FROZEN}
    return S.freeze(spark, d, tables, FROZEN_KEYS).select(
        S.file_name(F.col("path")).alias("file_name"), "sha256", "row_digest", "length", "rows", "columns", "year_min", "year_max", "key_coverage")


def _measured_sql(table: str) -> str:
    year = FROZEN_YEARS.get(table)
    years = [f"CAST({f}(year({year})) AS INTEGER)" if year else "CAST(NULL AS INTEGER)" for f in ("min", "max")]
    filled = " || ';' || ".join(f"'{c}=' || CAST(round(count({c}) / count(*), 6) AS DOUBLE)" for c in FROZEN_KEYS.get(table, ())) or "''"
    return f"SELECT '{table}' AS name, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {table})) AS columns, {years[0]} AS year_min, {years[1]} AS year_max, {filled} AS key_coverage FROM {table}"


@query("freeze_measures", " UNION ALL ".join(map(_measured_sql, FROZEN)))
def freeze_measures(spark, d):
    """Rows, columns, years and coverage of every table, from the same measures per file."""
    found = S.measures({n: I.table(spark, d, n) for n in FROZEN}, FROZEN_KEYS)
    name = F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return found.groupBy(name.alias("name")).agg(
        F.sum("rows").alias("rows"), F.max("columns").cast("bigint").alias("columns"), F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.max("key_coverage").alias("key_coverage"))
