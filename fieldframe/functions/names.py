"""Administrative names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions.numbers import as_number, col
from fieldframe.functions.text import blank, clean_text, contains_any, first_rule

# Administrative suffixes, longest first, per normaliser.
STATISTICS_SUFFIXES = (
    "特别行政区", "自治县", "自治州", "自治旗", "自治区", "市辖区", "县级市", "新区", "地区", "林区",
    "市", "县", "区", "旗", "州", "盟",
)
CODE_TABLE_SUFFIXES = (
    "特别行政区", "自治县", "自治州", "自治旗", "自治区", "市辖区", "县级市", "新区", "地区",
    "省", "市", "县", "区", "州", "盟", "旗",
)
PLACE_SUFFIXES = (
    "壮族自治区", "回族自治区", "维吾尔自治区", "自治县", "自治州", "地区", "省", "市", "县", "区", "盟",
)
PROVINCE_SUFFIXES = ("壮族自治区", "回族自治区", "维吾尔自治区", "自治区", "省", "市")
ENGLISH_SUFFIXES = (
    " special administrative region", " zhuang autonomous region", " hui autonomous region",
    " uyghur autonomous region", " autonomous region", " municipality", " province",
)

# English to Chinese province names.
PROVINCE_NAMES = {
    "anhui": "安徽", "beijing": "北京", "chongqing": "重庆", "fujian": "福建", "gansu": "甘肃",
    "guangdong": "广东", "guangzhou": "广东", "guangxi": "广西", "guizhou": "贵州", "hainan": "海南",
    "hebei": "河北", "heilongjiang": "黑龙江", "henan": "河南", "hubei": "湖北", "hunan": "湖南",
    "inner mongolia": "内蒙古", "jiangsu": "江苏", "jiangxi": "江西", "jilin": "吉林", "liaoning": "辽宁",
    "ningxia": "宁夏", "qinghai": "青海", "shaanxi": "陕西", "shandong": "山东", "shanghai": "上海",
    "shanxi": "山西", "sichuan": "四川", "tianjin": "天津", "tibet": "西藏", "xinjiang": "新疆",
    "yunnan": "云南", "zhejiang": "浙江", "taiwan": "台湾", "hong kong": "香港", "macao": "澳门",
}


def _one_suffix(c: Column | str, suffixes) -> Column:
    """Drop the longest suffix once, never the whole name."""
    kept = F.regexp_extract(blank(c), f"^(.+?)(?:{'|'.join(suffixes)})$", 1)
    return F.when(kept != "", F.trim(kept)).otherwise(blank(c))


def clean_admin_name(c: Column | str) -> Column:
    """Statistics tables: one suffix, provinces keep theirs."""
    return _one_suffix(c, STATISTICS_SUFFIXES)


def normalize_admin_name(c: Column | str) -> Column:
    """Code tables: one suffix, province suffix included."""
    return _one_suffix(c, CODE_TABLE_SUFFIXES)


def normalize_place_name(c: Column | str) -> Column:
    """Entry templates: suffixes dropped until none is left."""
    return F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), f"(?:{'|'.join(PLACE_SUFFIXES)})+$", "")


def normalize_province_name(c: Column | str) -> Column:
    """Join keys: each suffix tried once, in order."""
    name = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    for suffix in PROVINCE_SUFFIXES:
        name = F.regexp_replace(name, f"{suffix}$", "")
    return name


def map_province_name(c: Column | str) -> Column:
    """Chinese name of an English province name; unknown names stay as they are."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    bare = F.lower(text)
    for suffix in ENGLISH_SUFFIXES:
        bare = F.replace(bare, F.lit(suffix), F.lit(""))
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    pairs = [F.lit(x) for pair in PROVINCE_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), bare), text)


def normalize_admin_code(c: Column | str) -> Column:
    """Digits only; a trailing ``.0`` from numeric reading is dropped; else empty."""
    return F.regexp_extract(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))), r"^(\d+)(\.0)?$", 1)


def infer_admin_level(level: Column, county: Column, prefecture: Column, province: Column) -> Column:
    given = F.lower(blank(level))
    return first_rule(
        [
            (given.isin("county", "prefecture", "province"), given),
            (clean_text(county).isNotNull(), F.lit("county")),
            (clean_text(prefecture).isNotNull(), F.lit("prefecture")),
            (clean_text(province).isNotNull(), F.lit("province")),
        ],
        F.lit("unknown"),
    )


# Crop words in order of precedence.
CROP_WORDS = (
    ("early_rice", ("早稻", "early rice")),
    ("single_rice", ("中稻", "一季稻", "单季稻", "single rice")),
    ("late_rice", ("晚稻", "late rice")),
    ("rice", ("水稻", "稻谷", "rice")),
    ("grain", ("粮食", "谷物", "grain")),
)


def infer_crop(text_columns, rice_value: Column | None = None, grain_value: Column | None = None) -> Column:
    """Crop class from label words; a filled rice or grain yield column counts as its word."""
    text = F.concat_ws(" ", *[F.lower(blank(c)) for c in text_columns])
    filled = {"rice": rice_value, "grain": grain_value}
    rules = []
    for crop, words in CROP_WORDS:
        hit = contains_any(text, words)
        if filled.get(crop) is not None:
            hit = hit | clean_text(filled[crop]).isNotNull()
        rules.append((hit, F.lit(crop)))
    return first_rule(rules, F.lit("unknown"))


def admin_key(code: Column, names, clean_name: Column) -> Column:
    """Code, else the non-blank names joined by ``|``, else the cleaned name, else empty."""
    joined = F.concat_ws("|", *[clean_text(n) for n in names])
    return F.coalesce(clean_text(code), F.nullif(joined, F.lit("")), clean_text(clean_name), F.lit(""))


# Words of a source and their rank; the first row with a word applies.
SOURCE_PRIORITIES = (
    (("official", "统计局", "调查总队", "government"), 100),
    (("yearbook", "年鉴"), 90),
    (("cnki", "csyd", "eps"), 80),
    (("third", "第三方", "tjnj", "yougis"), 30),
)


def source_priority(source_type: Column, source_name: Column) -> Column:
    """Rank of a source from its words; official before yearbook before database before third party."""
    text = F.lower(F.concat_ws(" ", F.coalesce(source_type, F.lit("")), F.coalesce(source_name, F.lit(""))))
    return first_rule([(contains_any(text, words), F.lit(rank)) for words, rank in SOURCE_PRIORITIES], F.lit(50))


def direction(c: Column | str) -> Column:
    """Sign of an estimate as a word."""
    value = as_number(c)
    return first_rule(
        [(value < 0, F.lit("negative")), (value > 0, F.lit("positive")), (value == 0, F.lit("zero"))],
        F.lit("unavailable"),
    )


def significance(c: Column | str) -> Column:
    """Label of a p value."""
    value = as_number(c)
    return first_rule(
        [(value < 0.05, F.lit("significant_at_5pct")), (value < 0.10, F.lit("significant_at_10pct")),
         (value.isNotNull(), F.lit("not_significant"))],
        F.lit("unavailable"),
    )
