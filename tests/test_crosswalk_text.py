"""Succession, name matching, page text, announcements, claim rules and files."""

import html
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from fieldframe.functions import names as N
from fieldframe.functions import units as U
from fieldframe.operators import crosswalk as K
from fieldframe.operators import text as T
from fieldframe.plans import crosswalk_queries as KQ
from fieldframe.sources import files as S
from fieldframe.sources import tables as TB
from fieldframe.functions.roles import CODE_FIELDS, ZONE_FIELDS, conform, match_fields

SMALL = "/root/testdata/sf0.001"


def test_succession_chain_and_cycle(spark):
    rows = [("110103", 1980, 2010, ["110101"]), ("110101", 1980, None, []), ("1", 1980, 1990, ["2"]), ("2", 1990, 1995, ["1"]), ("3", 1980, 1990, ["110101", "4"]), ("5", 2030, None, [])]
    records = spark.createDataFrame(rows, "code string, start_year int, end_year int, new_codes array<string>")
    out = {r["code"]: r["admin_code_standard"] for r in K.standard_codes(K.resolve_succession(records, 2022)).collect()}
    assert out["110103"] == "110101" and out["110101"] == "110101" and out["5"] == "5"
    assert out["1"] == "1" and out["2"] == "2" and out["3"] == "110101;4"
    panel = K.succession_crosswalk(records, 2009, 2011, 2022).where("admin_code_original = '110103'").collect()
    assert [(r["year"], r["match_method"], r["match_confidence"]) for r in panel] == [(2009, "target_boundary_explicit_new_code_chain", 0.95)]


def test_succession_long_ladder_and_undated(spark):
    """A chain past any step limit, forks that meet again at every step, and groups without dated files."""
    chain = [(f"c{i}", 1980, 1990, [f"c{i + 1}"]) for i in range(60)] + [("c60", 1980, None, [])]
    ladder = [(f"{s}{i}", 1980, 1990, [f"a{i + 1}", f"b{i + 1}"]) for i in range(25) for s in "ab"] + [("a25", 1980, None, []), ("b25", 1980, None, [])]
    records = spark.createDataFrame(chain + ladder, "code string, start_year int, end_year int, new_codes array<string>")
    out = {r["code"]: r["admin_code_standard"] for r in K.standard_codes(K.resolve_succession(records, 2022)).collect()}
    assert out["c0"] == "c60" and out["a0"] == out["b0"] == "a25;b25" and len(out) == len(chain) + len(ladder)
    files = spark.createDataFrame([(1, "x/b.tif"), (1, "x/a_rice.tif"), (2, "x/none.tif"), (2, "x/m_1999.tif")], "g int, path string")
    assert sorted(tuple(r) for r in S.nearest_year(files, ["g"], 2000).collect()) == [(1, "x/a_rice.tif"), (2, "x/m_1999.tif")]
    assert S.nearest_year(files, ["g"], 2000, ties=True).count() == 2


def plain(name):
    return re.sub("(?:%s)+$" % "|".join(N.PLACE_SUFFIXES), "", (name or "").strip())


def brute_force(row, candidates):
    """All candidates of the province, narrowed by exact names, best ratio, lower code on ties."""
    same = [c for c in candidates if c["year"] == row["year"]]
    pool = same or candidates
    prov, pref, county = plain(row["province"]), plain(row["prefecture"]), plain(row["county"])
    place = lambda c: {k: plain(c[v]) for k, v in (("p", "province_standard"), ("f", "prefecture_standard"), ("c", "county_standard"), ("n", "admin_name_standard"))}
    pool = [(c, place(c)) for c in pool]
    pool = [(c, n) for c, n in pool if not prov or prov in (n["p"], n["n"])]
    for wanted, key in ((pref, "f"), (county, "c")):
        if wanted:
            exact = [(c, n) for c, n in pool if wanted in (n[key], n["n"])]
            pool = exact or pool
    target = county or pref or prov
    if not target:
        return None
    best = None
    for c, n in pool:
        score = max((SequenceMatcher(None, target, v).ratio() for v in n.values() if v), default=0.0)
        if score > 0 and (best is None or (-score, c["admin_code_standard"]) < (-best[0], best[1])):
            best = (score, c["admin_code_standard"])
    return None if best is None else (best[1], round(best[0], 6))


def test_crosswalk_match_equals_brute_force(spark):
    rows, crosswalk = KQ.match_inputs(spark, SMALL)
    candidates = [r.asDict() for r in crosswalk.collect()]
    got = {r["row_id"]: None if r["admin_code"] is None else (r["admin_code"], r["match_confidence"]) for r in KQ.crosswalk_match(spark, SMALL).collect()}
    wanted = {r["row_id"]: brute_force(r.asDict(), candidates) for r in rows.collect()}
    assert got == wanted
    assert sum(v is not None and v[1] < 1 for v in wanted.values()) > 20


def test_match_methods(spark):
    rows = [("110101", "110101", "a", "b", False), ("110101", "110102", "a", "b", True), ("", "1", "甲县", "甲县", False), ("", "1", "东乡县", "东乡族区", False), ("", "1", "", "b", False)]
    df = spark.createDataFrame(rows, "admin_code_original string, admin_code_standard string, admin_name_original string, admin_name_standard string, has_new_code boolean")
    got = sorted((r["match_method"], r["match_confidence"]) for r in K.match_method(df).collect())
    ratio = round(SequenceMatcher(None, "东乡", "东乡族").ratio(), 3)
    assert got == sorted([("exact_admin_code_match", 1.0), ("explicit_old_new_crosswalk", 0.95), ("exact_name_match", 0.9), ("normalized_name_fuzzy_match", ratio), ("unmatched", 0.0)])


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())


def test_page_text_equals_a_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["t"] for r in pages.select("page_id", T.html_text(F.col("html")).alias("t")).collect()}
    for row in pages.collect():
        parser = Visible()
        parser.feed(row["html"])
        parser.close()
        assert re.sub(r"\s+", "", got[row["page_id"]]) == re.sub(r"\s+", "", "".join(parser.parts)), row["page_id"]


def test_long_broken_and_referenced_pages(spark):
    """Tags of any length and unclosed parts; references equal the standard library's."""
    tag = "<p title='" + "x" * 400_000 + "' " + "y" * 400_000 + ">after</p>"
    pages = [tag, "a < b", "<p title='open>text</p>", "x<!-- open", "<script>never", "<" * 3000, '"' * 5000 + "<a " + "'" * 5001 + ">t"]
    refs = ["&#160;a&#20013;", "&eacute;&mdash;&amp;amp;", "&notit; &not &notin; &copy2024 &AMP", "&#x4e2d;&#X41;&#65 &#0;&#xD800;&#1114112;&#99999999999999;", "&#128;&#150;", "&unknown; & &; &#; &#x;", "&frac12;&NotEqualTilde;"]
    df = spark.createDataFrame(list(enumerate(pages + refs)), "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", T.html_text(F.col("h")).alias("t")).collect()}
    assert got[0] == "after" and "".join(got[1].split()) == "a<b" and "text" in got[2] and got[3].startswith("x")
    for i, text in enumerate(refs, len(pages)):
        assert "".join(got[i].split()) == "".join(html.unescape(text).split()), text


def test_announcement(spark):
    text = "标题 2023 全国总计 118,968.5 69541.0 5845.3 北京 89.6 47.8 5332.8 内 蒙古 6984.7 3957.8 5666.4 天津 1 北京 1 2 3"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "nothing here")], "id int, t string")
    rows = T.announcement_rows(df, "id", F.col("t"), F.lit(2023)).collect()
    got = {r["province"]: (r["sown_area_hectare"], r["production_ton"], r["yield_kg_per_hectare"], r["admin_level"]) for r in rows}
    assert got == {
        "全国总计": (pytest.approx(118968500.0), pytest.approx(695410000.0), 5845.3, "national"),
        "北京": (pytest.approx(89600.0), pytest.approx(478000.0), 5332.8, "province"),
        "内蒙古": (pytest.approx(6984700.0), pytest.approx(39578000.0), 5666.4, "province")}


def test_claims(spark):
    text = "# CHD 排名\n\n结果证明因果效应。\n不构成因果识别。\n\n2024 年验证结果良好。\n\n2024 年描述性验证。\n| 1 | chd_annual 省级 |\n"
    df = spark.createDataFrame([(1, text), (2, "影响评估 only"), (3, None)], "id int, t string")
    rows = T.claim_issues(df, "id", "t").collect()
    got = {(r["id"], r["line"], r["rule"]) for r in rows}
    shown = {(r["id"], r["rule"]): (r["message"], r["excerpt"]) for r in rows}
    assert shown[1, "causal_overclaim"] == ("High-risk term must be negated or bounded: 因果效应", "结果证明因果效应。") and shown[1, "chd_scope_label_missing"][1] == "# CHD 排名"
    assert shown[1, "validation_scope_missing"][1] == "2024 年验证结果良好。" and shown[3, "impact_scope_missing"][1] == "" and all(m.endswith((".", "因果效应")) or "/" in m for m, _ in shown.values())
    assert got == {(1, 1, "chd_scope_label_missing"), (1, 3, "causal_overclaim"), (1, 6, "validation_scope_missing"),
                   (1, 1, "impact_scope_missing"), (3, 1, "impact_scope_missing")}
    assert T.forbidden_tokens(df, "t", ["证明"]).first()["detected"] and not T.forbidden_tokens(df, "t", ["zzz"]).first()["detected"]


def test_units_match_whole_tokens(spark):
    units = ["mg", "g", "100g", "grain weight", "in kg", "kg", "10000 t", "万吨", "千克", "mushroom", "mu", "公斤/亩", "kg per mu", "grams"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string")
    got = {r["u"]: (r["t"], r["h"], r["y"]) for r in df.select("u", U.production_to_ton(F.lit("1"), "u").alias("t"), U.area_to_hectare(F.lit("1"), "u").alias("h"), U.yield_to_kg_ha(F.lit("1"), "u").alias("y")).collect()}
    assert {u: t for u, (t, _, _) in got.items()} == {
        "mg": 1.0, "g": 1e-6, "100g": 1e-6, "grain weight": 1.0, "in kg": 1e-3, "kg": 1e-3, "10000 t": 1e4, "万吨": 1e4, "千克": 1e-3, "mushroom": 1.0, "mu": 1.0,
        "公斤/亩": 1e-3, "kg per mu": 1e-3, "grams": 1e-6}
    assert got["mu"][1] == pytest.approx(1 / 15) and got["mushroom"][1] == 1.0
    assert got["kg per mu"][2] == 15.0 and got["公斤/亩"][2] == 15.0 and got["kg"][2] == 1.0


def test_field_roles(spark):
    found = match_fields(spark, ["年份", "省份", "水稻单产(公斤/亩)", "播种面积（千公顷）", "产量"])
    assert found["year"] == "年份" and found["rice_yield"] == "水稻单产(公斤/亩)" and found["sown_area"] == "播种面积（千公顷）"
    assert "yield" not in found and found["production"] == "产量"
    assert match_fields(spark, ["统计年份", "地区", "州"]) == {"year": "统计年份", "province": "地区", "prefecture": "州"}
    assert match_fields(spark, ["year", "region", "省"]) == {"year": "year", "province": "region"}
    codes = match_fields(spark, ["年度", "原代码", "新代码", "行政区划代码", "名称", "省份", "变更类型"], CODE_FIELDS)
    assert codes == {"year": "年度", "old_code": "原代码", "new_code": "新代码", "code": "行政区划代码", "name": "名称", "province": "省份", "change_type": "变更类型"}
    assert match_fields(spark, ["NAME_1", "name_3", "gbcode", "old city"], ZONE_FIELDS, partial=False) == {"province": "NAME_1", "county": "name_3", "code": "gbcode"}
    assert conform(spark.createDataFrame([(2000, "a", 1)], "`统计年份` int, `地区` string, other int")).columns == ["year", "province"]


def test_tables_and_files(spark, tmp_path):
    gb = tmp_path / "raw" / "statistics" / "a.csv"
    gb.parent.mkdir(parents=True)
    gb.write_bytes("年份,省份\n2000,河北\n".encode("gb18030"))
    assert TB.read_csv_any(spark, str(gb)).first().asDict() == {"年份": "2000", "省份": "河北"}
    out = str(tmp_path / "panel")
    TB.write_panel(spark.createDataFrame([(1, 2000)], "a int, year int"), out, ["year"], csv_companion=True)
    assert TB.first_table(spark, [str(tmp_path / "none"), out]).count() == 1
    assert TB.first_table(spark, [str(tmp_path / "none")]) is None
    assert TB.conform(spark.range(1), ["x", "id"]).columns == ["x", "id"]
    files = S.listing(spark, str(tmp_path / "raw"))
    assert S.inventory(files, ["statistics"], len(tmp_path.parts) + 2).count() == 1
    assert S.file_catalog(files, [".csv"], ignored=("statistics",)).count() == 0
    local, other = files, files.withColumn("path", F.lit("x"))
    assert S.local_first(local, other).count() == 1 and S.local_first(local.limit(0), other).first()["path"] == "x"
