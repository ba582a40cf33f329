"""Text operators: visible text of web pages, announcement tables, claim rules.

All work is per row with array expressions: no shuffle, no Python, whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.names import PROVINCE_NAMES
from fieldframe.functions.numbers import ratio
from fieldframe.functions.text import contains_any, let
from fieldframe.operators.picks import pick_one

# Pieces of a page: a script or style element, a comment, a tag (quoted attributes may hold
# ">"), a run of text, or a lone "<". Possessive parts never go back, so a long tag costs no stack.
PIECES = (
    r"(?is)<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>|<!--.*?-->"
    r"|</?[a-z!?](?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>|[^<]++|<"
)
WRAPPED = r"(?is)^<(?:script|style)\b[^>]*+>|</(?:script|style)\s*+>$"
# The named references of HTML 5 come from the standard library: those that end with a semicolon,
# and the older ones that are also read without one.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
UNCLOSED = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
# Numbers 128 to 159 are read as that code page does; numbers of no character give the replacement character.
OLD_NUMBERS = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
REFERENCE = rf"(&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:{'|'.join(UNCLOSED)})|[^&]++|&)"
SPACE = r"[\s\u00a0]"


def _table(values: dict[str, str]) -> Column:
    """A fixed table as one constant."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point as decimal text; null if it has no valid one."""
    n = F.try_to_number(number, F.lit("9" * 12)).cast("bigint")
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_references(text: Column) -> Column:
    """Text with numeric and named character references decoded; what is no reference stays."""

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*+);?$", 1)
        start = F.regexp_extract(piece, rf"^&({'|'.join(UNCLOSED)})", 1)
        digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]++);?$", 1)
        # more than twelve digits are no character; leading zeros do not count
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        number = F.when(F.length(short) <= 12, F.when(piece.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short))
        numeric = F.coalesce(F.try_element_at(_table(OLD_NUMBERS), number), _character(number), F.lit("\ufffd"))
        named = F.coalesce(
            F.try_element_at(_table(NAMED), name),
            F.when(start != "", F.concat(F.try_element_at(_table(NAMED), start), F.substr(piece, F.length(start) + 2))), piece)
        return F.when(~piece.startswith("&"), piece).when(digits != "", numeric).otherwise(named)

    decoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), one), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def html_parts(html: Column) -> Column:
    """Non-blank text chunks of a page, in order; script and style contents count as text."""
    pieces = F.regexp_extract_all(html, F.lit(f"({PIECES})"), 1)

    def visible(piece: Column) -> Column:
        raw = piece.rlike(r"(?is)^<(?:script|style)\b.*</(?:script|style)\s*+>$")
        markup = piece.rlike(r"(?is)^<[a-z/!?].*>$")
        text = F.when(raw, F.regexp_replace(piece, WRAPPED, "")).when(~markup, decode_references(piece))
        return F.regexp_replace(text, f"^{SPACE}++|{SPACE}++$", "")

    return F.filter(F.transform(pieces, visible), lambda p: p.isNotNull() & (p != ""))


def html_text(html: Column) -> Column:
    """Newline-joined visible text."""
    return F.array_join(html_parts(html), "\n")


# Names of an announcement table in page order.
ANNOUNCED = (
    "全国总计", "北京", "天津", "河北", "山西", "内蒙古", "辽宁", "吉林", "黑龙江", "上海", "江苏", "浙江", "安徽", "福建", "江西", "山东",
    "河南", "湖北", "湖南", "广东", "广西", "海南", "重庆", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆",
)
SPLIT_NAMES = ("内蒙古", "黑龙江")  # printed as two tokens
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def announcement_tokens(text: Column) -> Column:
    cleaned = F.regexp_replace(F.translate(text, " \r", " \n"), "[　,，]", "")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")


def announcement_rows(pages: DataFrame, key: str, text: Column, year: Column, names: Sequence[str] = ANNOUNCED) -> DataFrame:
    """Area, production and yield per named region of an announcement.

    A region takes the first three numbers between its name and the next name; with
    fewer it gives no row. Of repeated regions of a page the first counts.
    """
    single = [n for n in names if n not in SPLIT_NAMES]
    double = [n for n in names if n in SPLIT_NAMES]

    def found(t: Column) -> Column:
        two = lambda i: F.concat(F.element_at(t, i), F.coalesce(F.try_element_at(t, i + 1), F.lit("")))
        split = lambda i: two(i).isin(*double) if double else F.lit(False)
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.element_at(t, i).isin(*single) | split(i))

        def regions(s: Column) -> Column:
            def region(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(s, k + 1), F.size(t) + 1)
                numbers = F.filter(F.slice(t, start + 1, end - start - 1), lambda v: v.rlike(NUMBER))
                return F.struct(
                    k.alias("i"), F.when(split(start), two(start)).otherwise(F.element_at(t, start)).alias("province"),
                    F.transform(F.slice(numbers, 1, 3), lambda v: v.cast("double")).alias("n"))

            return F.transform(s, region)

        return let(starts, regions)

    tokens = announcement_tokens(text)
    rows = pages.select(
        key, year.alias("year"), F.inline(F.filter(let(tokens, lambda t: F.when(F.size(t) > 0, found(t))), lambda r: F.size(r["n"]) == 3))
    ).withColumnsRenamed({"i": "_i", "n": "_n"})
    first = pick_one(rows, [key, "year", "province"], [F.col("_i")])
    return first.select(
        key, "year", "province", F.when(F.col("province") == ANNOUNCED[0], "national").otherwise("province").alias("admin_level"),
        F.lit("grain").alias("crop"), (F.col("_n")[0] * 1000.0).alias("sown_area_hectare"),
        (F.col("_n")[1] * 10000.0).alias("production_ton"), F.col("_n")[2].alias("yield_kg_per_hectare"),
    )


def measure_pivot(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Long official records to one row per province, year and crop; the last record of a measure wins."""
    category, commodity = F.lower(F.trim(F.coalesce("category", F.lit("")))), F.lower(F.trim(F.coalesce("commodity", F.lit(""))))
    crop = F.when(category.contains("rice") | (commodity == "rice"), "rice").when(
        category.contains("grain") | commodity.contains("total grain"), "grain")
    measure = F.when(category.contains("production"), "production_ton").when(category.contains("sown area"), "sown_area_hectare")
    pairs = [F.lit(x) for pair in PROVINCE_NAMES.items() for x in pair]
    name = F.trim(F.coalesce("geography", F.lit("")))
    province = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_replace(name, r"\s+", " "))), name)
    long = rows.select(
        province.alias("province"), F.col("year"), crop.alias("crop"), measure.alias("measure"),
        (F.col("amount") * 1000.0).alias("v"), F.struct(*order).alias("o"),
    ).where("province <> '' and year is not null and crop is not null and measure is not null and v is not null")
    wide = long.groupBy("province", "year", "crop").pivot("measure", ["production_ton", "sown_area_hectare"]).agg(F.max_by("v", "o"))
    area = F.when(F.col("sown_area_hectare") > 0, F.col("sown_area_hectare"))
    return wide.withColumn("yield_kg_per_hectare", ratio(F.col("production_ton") * 1000.0, area))


@dataclass(frozen=True)
class ClaimRules:
    """Words of the claim rules; every list is a parameter of the project's language."""

    risky: dict[str, Sequence[str]]
    safe: Sequence[str]
    impact: Sequence[str]
    labels: Sequence[str]
    scopes: Sequence[str]
    dated: str
    dated_terms: Sequence[str]
    dated_qualifiers: Sequence[str]


# Words of the report language policy.
REPORT_RULES = ClaimRules(
    risky={
        "causal_overclaim": ("准因果", "quasi_causal", "quasi-causal", "因果识别", "因果效应", "causal identification", "causal effect"),
        "subprovince_yield_loss_overclaim": (
            "县域官方减产", "县级官方减产", "地市官方减产", "市县级产量损失", "县级产量损失", "地级市产量损失",
            "county official yield loss", "prefecture official yield loss"),
        "paddy_weighted_overclaim": ("paddy-weighted", "paddy weighted", "稻田像元加权暴露", "稻田加权暴露", "稻田暴露"),
        "balanced_panel_overclaim": ("完全平衡面板", "完美平衡", "perfectly balanced"),
        "treatment_effect_overclaim": ("处理效应", "treatment effect", "导致减产", "归因于", "attributed to"),
    },
    safe=("不", "不能", "不可", "不得", "未", "非", "不是", "不作", "不做", "不写", "不构成", "不等同", "禁止", "避免", "限制", "仅", "只",
          "rather than", "not ", "cannot", "should not"),
    impact=("impact_assessment", "影响评估", "风险识别", "统计关联"),
    labels=("CHD", "chd_annual", "复合热旱暴露", "暴露指数"),
    scopes=("省域平均", "省级", "省域尺度", "province-average", "province average"),
    dated="2024",
    dated_terms=("验证", "validation", "检验"),
    dated_qualifiers=("描述性", "外部一致性", "辅助", "对照", "不作为", "external consistency", "descriptive"),
)

# Messages of the claim rules; the matched words follow the first.
MESSAGES = {
    "risky": "High-risk term must be negated or bounded: ",
    "chd_scope_label_missing": "CHD figure/table/headline labels must state province-average or province-scale scope.",
    "validation_scope_missing": "2024 validation language must be framed as descriptive external consistency or auxiliary evidence.",
    "impact_scope_missing": "Report should explicitly state the current conclusion strength as impact assessment / risk identification.",
}

LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
TITLE_OR_TABLE = r"^(#|\| Figure|\| Table|\|\s*(Figure|Table|\d+))"


def claim_issues(documents: DataFrame, key: str, text: str, rules: ClaimRules = REPORT_RULES) -> DataFrame:
    """Rule violations ``(key, line, rule, matched, message, excerpt)`` of report texts, one pass per document.

    Risky words need a safe or impact word on their line; titles and table rows with an
    exposure label need a scope word; a dated paragraph about validation needs a
    qualifier; a document needs an impact word somewhere. The excerpt is the line without the
    white space around it, or the paragraph's lines joined by spaces; a whole document has none.
    """
    low = lambda words: [w.lower() for w in words]
    has = lambda value, words: contains_any(value, low(words))
    none = F.lit("")
    strip = lambda value: F.regexp_replace(value, r"(?U)^\s+|\s+$", "")

    def issue(line: Column, rule: str, matched: Column = none, excerpt: Column = none) -> Column:
        message = F.lit(MESSAGES[rule]) if rule in MESSAGES else F.concat(F.lit(MESSAGES["risky"]), matched)
        return F.struct(line.cast("int").alias("line"), F.lit(rule).alias("rule"), matched.alias("matched"), message.alias("message"), excerpt.alias("excerpt"))

    def of_line(line: Column, index: Column) -> Column:
        def check(lower: Column) -> Column:
            fine = has(lower, rules.safe) | has(lower, rules.impact)
            found = [
                F.when(has(lower, words) & ~fine, issue(index + 1, rule, F.concat_ws(
                    ", ", *[F.when(lower.contains(w.lower()), F.lit(w)) for w in words]), strip(line)))
                for rule, words in rules.risky.items()
            ]
            label = F.trim(line).rlike(TITLE_OR_TABLE) & has(lower, rules.labels) & ~has(lower, rules.scopes)
            found.append(F.when(label, issue(index + 1, "chd_scope_label_missing", excerpt=strip(line))))
            return F.array_compact(F.array(*found))

        return let(F.lower(line), check)

    def paragraphs(ls: Column) -> Column:
        filled = lambda i: F.coalesce(~F.get(ls, i).rlike(r"^\s*$"), F.lit(False))
        positions = F.sequence(F.lit(0), F.size(ls) - 1)
        first = F.filter(positions, lambda i: filled(i) & ~filled(i - 1))
        last = F.filter(positions, lambda i: filled(i) & ~filled(i + 1))

        def of_paragraph(a: Column, b: Column) -> Column:
            def check(body: Column) -> Column:
                lower = F.lower(body)
                bad = body.contains(rules.dated) & has(lower, rules.dated_terms) & ~has(lower, rules.dated_qualifiers)
                return F.when(bad, issue(a + 1, "validation_scope_missing", excerpt=F.array_join(F.transform(F.split(body, "\n"), strip), " ")))

            return let(F.array_join(F.slice(ls, a + 1, b - a + 1), "\n"), check)

        return F.array_compact(F.zip_with(first, last, of_paragraph))

    body = F.coalesce(F.col(text), F.lit(""))
    unmarked = F.when(~has(F.lower(body), rules.impact), issue(F.lit(1), "impact_scope_missing"))
    per_line = let(F.split(body, LINE_BREAK), lambda ls: F.concat(
        F.flatten(F.transform(ls, of_line)),
        # The dated rule can only apply to a document that has the date at all.
        F.when(body.contains(rules.dated), paragraphs(ls)).otherwise(F.filter(F.array(issue(F.lit(1), "")), lambda x: F.lit(False))),
    ))
    return documents.select(key, F.inline(F.concat(per_line, F.array_compact(F.array(unmarked)))))


def forbidden_tokens(documents: DataFrame, text: str, tokens: Sequence[str]) -> DataFrame:
    """Whether any document holds one of the tokens."""
    return documents.agg(F.coalesce(F.bool_or(contains_any(F.col(text), tokens)), F.lit(False)).alias("detected"))
