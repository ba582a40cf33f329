"""Administrative codes over time: validity, succession, crosswalk rows and name matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.names import normalize_admin_name, normalize_place_name
from fieldframe.functions.numbers import parse_year
from fieldframe.functions.similarity import sequence_ratio
from fieldframe.functions.text import blank, clean_text, first_rule, looks_like_code
from fieldframe.operators import succession
from fieldframe.operators.name_search import closest_names
from fieldframe.operators.picks import pick_one
from fieldframe.session import materialize


def is_active(year: Column | int) -> Column:
    """Start inclusive, end exclusive, a missing end is open."""
    y = F.lit(year) if isinstance(year, int) else year
    return F.coalesce((F.col("start_year") <= y) & (F.col("end_year").isNull() | (y < F.col("end_year"))), F.lit(False))


def active_records(rows: DataFrame, records: DataFrame, code: str, year: str) -> DataFrame:
    """Left join of rows to the record of their code that is active in their year (earliest start first).

    The code is the hash key, the interval only a residual test.
    """
    keyed = records.withColumnsRenamed({"code": "_code"})
    same = (F.col(code) == F.col("_code")) & is_active(F.col(year))
    joined = rows.join(keyed, same, "left")
    return pick_one(joined, [code, year], [F.col("start_year").asc_nulls_last()]).drop("_code")


def expand_validity(records: DataFrame, low: int, high: int) -> DataFrame:
    """One row per record and year of validity, clipped to the window; records outside vanish."""
    first = F.greatest(F.col("start_year"), F.lit(low))
    last = F.least(F.coalesce(F.col("end_year") - 1, F.lit(high)), F.lit(high))
    return records.where(F.col("start_year").isNotNull() & (first <= last)).withColumn("year", F.explode(F.sequence(first, last)))


def resolve_succession(records: DataFrame, target_year: int) -> DataFrame:
    """Follow successor codes to those active in the target year: ``(code, standard_code, _order)``."""
    return succession.resolve(records, is_active(target_year))


def standard_codes(resolved: DataFrame) -> DataFrame:
    """Per code its distinct standard codes in order, as array and joined text."""
    return succession.joined_codes(resolved)


def succession_confidence(code: Column, codes: Column, active: Column, start_year: Column, target_year: int) -> tuple[Column, Column]:
    """Method and confidence of a resolved code."""
    one, itself = F.size(codes) == 1, (F.size(codes) == 1) & (codes[0] == code)
    rules = [
        (itself & active, "target_boundary_exact_code", 1.0),
        (one & (codes[0] != code), "target_boundary_explicit_new_code_chain", 0.95),
        (F.size(codes) > 1, "target_boundary_many_to_many_new_code_chain", 0.75),
        (F.coalesce(start_year > target_year, F.lit(False)), "future_record_after_target_boundary", 0.7),
    ]
    method = first_rule([(c, F.lit(m)) for c, m, _ in rules], F.lit("unresolved_to_target_boundary"))
    return method, first_rule([(c, F.lit(v)) for c, _, v in rules], F.lit(0.6))


def succession_crosswalk(records: DataFrame, low: int, high: int, target_year: int) -> DataFrame:
    """Annual crosswalk rows of a code table with validity and successors."""
    resolved = standard_codes(resolve_succession(records, target_year))
    active = records.where(is_active(target_year)).groupBy("code").agg(F.lit(True).alias("_active"))
    annual = expand_validity(records, low, high).join(resolved, "code").join(active, "code", "left")
    method, confidence = succession_confidence(
        F.col("code"), F.col("standard_codes"), F.coalesce("_active", F.lit(False)), F.col("start_year"), target_year
    )
    return annual.select("year", F.col("code").alias("admin_code_original"), "admin_code_standard",
                         confidence.alias("match_confidence"), method.alias("match_method"))


# --- plain old/new code tables --------------------------------------------------------------

def match_method(rows: DataFrame) -> DataFrame:
    """Method and confidence from codes and names; only undecided names reach the similarity function."""
    old, new = F.col("admin_code_original"), F.col("admin_code_standard")
    a, b = F.col("admin_name_original"), F.col("admin_name_standard")
    both = (old != "") & (new != "")
    exact = both & (old == new) & looks_like_code(old)
    explicit = both & F.col("has_new_code")
    same_name = (a != "") & (b != "") & (a == b)
    left, right = F.nullif(normalize_admin_name(a), F.lit("")), F.nullif(normalize_admin_name(b), F.lit(""))
    open_case = ~exact & ~explicit & ~same_name & left.isNotNull() & right.isNotNull()
    names = rows.select(F.when(open_case, left).alias("_l"), F.when(open_case, right).alias("_r")).where("_l is not null").distinct()
    scored = names.withColumn("_ratio", F.round(sequence_ratio("_l", "_r"), 3))
    is_open = F.coalesce(open_case, F.lit(False))
    undecided = rows.where(is_open).withColumns({"_l": left, "_r": right}).join(scored, ["_l", "_r"], "left").drop("_l", "_r")
    joined = undecided.unionByName(rows.where(~is_open).withColumn("_ratio", F.lit(None).cast("double")))
    method = first_rule(
        [(exact, F.lit("exact_admin_code_match")), (explicit, F.lit("explicit_old_new_crosswalk")),
         (same_name, F.lit("exact_name_match")), (F.col("_ratio").isNotNull(), F.lit("normalized_name_fuzzy_match"))],
        F.lit("unmatched"),
    )
    confidence = first_rule([(exact, F.lit(1.0)), (explicit, F.lit(0.95)), (same_name, F.lit(0.9))], F.coalesce("_ratio", F.lit(0.0)))
    return joined.withColumns({"match_method": method, "match_confidence": confidence}).drop("_ratio")


ROLES = ("year", "old_code", "new_code", "code", "name", "province", "prefecture", "county", "status", "change_type")


def standardize_crosswalk(rows: DataFrame, source_name: Column, low: int, high: int) -> DataFrame:
    """Source rows to crosswalk columns; years outside the window drop, unknown years stay."""
    absent = [r for r in ROLES if r not in rows.columns]
    t = rows.withColumns({r: F.lit(None).cast("string") for r in absent}) if absent else rows
    text = lambda r: clean_text(r, ("", "nan", "none", "na"))
    pick = lambda *roles: F.coalesce(*[text(r) for r in roles], F.lit(""))
    year = F.coalesce(parse_year(text("year")), parse_year(source_name))
    named = F.concat_ws(
        "; ", *[F.when(text(r).isNotNull(), F.concat(F.lit(f"{r}="), text(r))) for r in ("status", "change_type")]
    )
    out = t.select(
        *[c for c in rows.columns if c not in ROLES],
        year.alias("year"), pick("old_code", "code").alias("admin_code_original"),
        pick("new_code", "code", "old_code").alias("admin_code_standard"),
        pick("name", "county", "prefecture", "province").alias("admin_name_original"),
        pick("county", "prefecture", "province", "name").alias("admin_name_standard"),
        blank("province").alias("province_standard"), blank("prefecture").alias("prefecture_standard"),
        blank("county").alias("county_standard"), text("new_code").isNotNull().alias("has_new_code"), named.alias("notes"),
    )
    return out.where(F.col("year").isNull() | F.col("year").between(low, high))


CROSSWALK_KEYS = ("year", "admin_code_original", "admin_name_original", "admin_code_standard", "admin_name_standard")


def distinct_crosswalk(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row per crosswalk key in a given order."""
    return pick_one(rows, list(CROSSWALK_KEYS), order)


# --- matching names to the crosswalk --------------------------------------------------------

# Block of the keys without a province; no place has this name.
ANYWHERE = "*"


def _decided(rows: DataFrame, crosswalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct row keys with their exact code, or null, and what to search otherwise; candidates by block and slot)."""
    norm = normalize_place_name
    years = crosswalk.select(F.col("year").alias("_y")).where("_y is not null").distinct()
    keys = rows.select("province", "prefecture", "county", "year").distinct()
    keys = keys.join(years, F.col("year") == F.col("_y"), "left").select(
        "*", F.coalesce(F.nullif(norm("province"), F.lit("")), F.lit(ANYWHERE)).alias("_prov"),
        F.coalesce(norm("prefecture"), F.lit("")).alias("_pref"), F.coalesce(norm("county"), F.lit("")).alias("_coun"))
    keys = materialize(keys.withColumn("_target", F.coalesce(
        F.nullif("_coun", F.lit("")), F.nullif("_pref", F.lit("")), F.nullif("_prov", F.lit(ANYWHERE)))), "match-keys")
    places = crosswalk.select(
        "year", F.col("admin_code_standard").alias("code"), norm("province_standard").alias("p"), norm("prefecture_standard").alias("f"),
        norm("county_standard").alias("c"), norm("admin_name_standard").alias("n"),
    ).distinct()
    # A candidate is reachable under its province, under its own name and from anywhere, in its year and in any year.
    blocks = places.withColumn("block", F.explode(F.array_distinct(F.array("p", "n", F.lit(ANYWHERE))))).where("block <> ''").withColumn(
        "slot", F.explode(F.array(F.coalesce(F.col("year"), F.lit(-1)), F.lit(None).cast("int")))
    )
    blocks = materialize(blocks.where("slot is null or slot = year"), "match-places")
    name = lambda *cols: F.explode(F.array_distinct(F.array(*cols)))

    def found(level: str, block: DataFrame, extra: Sequence[str]) -> DataFrame:
        """Lowest code per key whose candidate carries the level's name exactly."""
        cols = {"_pref": ("f", "n"), "_coun": ("c", "n"), "_prov": ("p", "n")}[level]
        named = block.withColumn("_name", name(*cols)).groupBy("block", "slot", "_name", *extra).agg(F.min("code").alias("_code"))
        return named

    def lookup(named: DataFrame, level: str, extra: Sequence[str] = ()) -> DataFrame:
        base = keys.where(F.col(level) != "") if level != "_prov" else keys
        cond = (F.col("_prov") == F.col("block")) & F.col("_y").eqNullSafe(F.col("slot")) & (F.col(level) == F.col("_name"))
        for e in extra:
            cond = cond & (F.col("_pref") == F.col(e))
        return base.join(named, cond).select("province", "prefecture", "county", "year", "_code")

    same = lambda left, right: [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in MATCH_KEY]

    def attach(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        r = right.withColumnRenamed("_code", column)
        return left.alias("l").join(r.alias("r"), same(left, right), "left").select("l.*", F.col(f"r.{column}").alias(column))

    by_prov = lookup(found("_prov", blocks, ()), "_prov")
    by_pref = lookup(found("_pref", blocks, ()), "_pref")
    by_county = lookup(found("_coun", blocks, ()), "_coun")
    within = blocks.withColumn("_in", name("f", "n")).where("_in <> ''")
    by_both = lookup(found("_coun", within, ("_in",)), "_coun", ("_in",))
    decided = attach(attach(attach(attach(keys, by_prov, "_c_prov"), by_pref, "_c_pref"), by_county, "_c_county"), by_both, "_c_both")
    has_pref = F.col("_c_pref").isNotNull()
    exact = F.when(
        F.col("_coun") != "", F.when(has_pref, F.col("_c_both")).otherwise(F.col("_c_county"))
    ).when(F.col("_pref") != "", F.col("_c_pref")).otherwise(F.col("_c_prov"))
    return materialize(decided.withColumn("_exact", exact).withColumn("_narrow", F.when(has_pref, F.col("_pref"))), "match-exact"), blocks


MATCH_KEY = ("province", "prefecture", "county", "year")


def exact_match(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Row keys ``(province, prefecture, county, year)`` whose name a candidate carries exactly, with its lowest code."""
    decided, _ = _decided(rows, crosswalk)
    return decided.where("_exact is not null").select(*MATCH_KEY, F.col("_exact").alias("admin_code"))


def crosswalk_match(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Best crosswalk code for rows without one: ``(province, prefecture, county, year)`` to code and score.

    Distinct row keys are matched, never raw rows, inside their province (and prefecture
    when it exists there); a key without a province is matched with all candidates. Exact
    names are plain equality joins with score 1. Only the rest is compared by similarity,
    see ``name_search``. Ties go to the lower code.
    """
    decided, blocks = _decided(rows, crosswalk)
    # Similarity for the rest: distinct (block, narrowing, target) against distinct names there.
    open_keys = decided.where("_exact is null").select("_prov", "_y", "_narrow", "_target").distinct()
    asked = open_keys.select(F.col("_prov").alias("_b"), F.col("_y").alias("_s")).distinct()
    reached = blocks.join(asked, (F.col("block") == F.col("_b")) & F.col("slot").eqNullSafe(F.col("_s")), "left_semi").where("code is not null")
    wide = reached.withColumn("_in", F.explode(F.array_union(
        F.array(F.lit(None).cast("string")), F.filter(F.array_distinct(F.array("f", "n")), lambda v: v != ""))))
    names = wide.withColumn("_name", F.explode(F.array_distinct(F.array("c", "f", "p", "n")))).where("_name <> ''").groupBy("block", "slot", "_in", "_name").agg(F.min("code").alias("_code"))
    best = closest_names(open_keys.where("_target is not null"), names, {"_prov": "block", "_y": "slot", "_narrow": "_in"})
    group = ["_prov", "_y", "_narrow", "_target"]
    again = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    final = decided.alias("l").join(best.alias("r"), again, "left").select(
        *[F.col(f"l.{k}") for k in MATCH_KEY],
        F.coalesce("l._exact", "r._code").alias("admin_code"),
        F.round(F.when(F.col("l._exact").isNotNull(), 1.0).otherwise(F.col("r._score")), 6).alias("match_confidence"),
    )
    return final.where("admin_code is not null").withColumn("match_method", F.lit("crosswalk_exact_or_fuzzy_name"))
