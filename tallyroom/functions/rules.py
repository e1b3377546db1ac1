"""Ordered rule tables compiled into one CASE expression, and the scores that rules give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which words put a remark into which bucket; the first rule that matches wins.
REMARK_RULES = [
    ("(?i)ดอกเบี้ย|กนง|ปรับขึ้นดอกเบี้ย|ปรับลงดอกเบี้ย", "macro"),
    (r"(?i)การเมือง|เลือกตั้ง|กกต|ทักษิณ|นายก|สภา|โหวต|เศรษฐา|ครม\.|รัฐบาล", "macro"),
    ("(?i)แผ่นดินไหว|เศรษฐกิจ|เปิดประเทศ|สคบ|ปิดแคมป์|GDP|inflation|export|นำเข้า", "macro"),
    ("(?i)condo|คอนโด|ที่ดิน|Bangkok condo|property developer|Bangkok real estate|LH|SPALI|AP|QH|SIRI|NOBLE|ORI|ANAN|LPN|WHA", "sector"),
    ("(?i)โครงการ|talis|wellness|arbor|title|kave|embryo|honor|atmoz|jv|openday|site visit|oppday|เปิดโครงการ|ยอดจอง|presale", "company"),
    ("(?i)งบ|ปันผล|จ่ายเงินปันผล|รางวัล|q1|q2|q3|q4|AGM|oppday|XD", "company"),
]
#: Event classes of a remark.
EVENT_RULES = [
    ("(?i)ดอกเบี้ย|กนง|ปรับขึ้นดอกเบี้ย", "interest"),
    ("(?i)presale", "presale"),
    ("(?i)งบ|ปันผล|รางวัล|จ่ายเงินปันผล", "earnings"),
    ("(?i)โครงการ|เปิดโครงการ|ยอดจอง|openday|site visit|oppday|jv|atmoz|talis|kave|embryo|honor", "project"),
    ("(?i)การเมือง|เลือกตั้ง|กกต|ทักษิณ|นายก|สภา|โหวต|เศรษฐา", "political"),
]


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule whose pattern the text has."""
    cases = reduce(lambda w, r: w.when(c.rlike(r[0]), r[1]), rules[1:], F.when(c.rlike(rules[0][0]), rules[0][1]))
    return cases.otherwise(otherwise)


def remark_bucket(c: Column, otherwise: str = "other") -> Column:
    """Bucket of a remark, otherwise without a rule; null for an empty one."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", first_match(F.trim(c), REMARK_RULES, otherwise))


def remark_columns(c: Column) -> Column:
    """One remark as three columns (company, sector, macro): it stands in its bucket's, in the company's where no rule matches."""
    bucket = remark_bucket(c, "company")
    return F.struct(*(F.when(bucket == k, F.trim(c)).alias(k) for k in ("company", "sector", "macro")))


def event_type(c: Column) -> Column:
    return first_match(F.coalesce(c, F.lit("")), EVENT_RULES)


def item_priority(severity: Column, impact: Column, pinned: Column) -> Column:
    """Points for severity, impact and pin."""
    s = F.when(severity == "high", 100).when(severity == "medium", 50).otherwise(25)
    i = F.when(impact == "positive", 25).when(impact == "negative", 15).otherwise(5)
    return s + i + F.when(pinned, 10).otherwise(0)


def display_priority(given: Column, score: Column, severity: Column, impact: Column, pinned: Column) -> Column:
    """A positive given value wins; then min(50 + score, 125); then the item's points."""
    return F.when(given > 0, given).when(score.isNotNull(), F.least(50 + score, F.lit(125))).otherwise(item_priority(severity, impact, pinned))


def impact_level(severity: Column) -> Column:
    return F.when(severity == "high", "HIGH").when(severity == "medium", "MEDIUM").when(severity == "low", "LOW")


def severity_of(impact_level: Column) -> Column:
    """The severity that an impact level stands for; null for unknown levels."""
    low = F.lower(F.trim(impact_level))
    return F.when(low.isin("high", "medium", "low"), low)


def filled_levels(severity: Column, level: Column) -> Column:
    """Severity and impact level, each filled from the other where it is missing, and medium where both are."""
    known = F.coalesce(severity, severity_of(level), F.lit("medium"))
    return F.struct(known.alias("severity"), F.coalesce(level, impact_level(known)).alias("impact_level"))


def keyword_score(c: Column, boosts: list[tuple[str, int]], base: Column, drops: list[str] = (), direct: Column | None = None) -> Column:
    """Sum of the boosts of the keywords that the text has, plus base; 0 with a drop word, unless it is a direct mention."""
    total = reduce(lambda t, b: t + F.when(F.contains(c, F.lit(b[0])), b[1]).otherwise(0), boosts, base)
    if not drops:
        return total
    dropped = reduce(lambda t, w: t | F.contains(c, F.lit(w)), drops, F.lit(False))
    return F.when(dropped & ~(direct if direct is not None else F.lit(False)), 0).otherwise(total)


#: What a headline's words are worth (direct: the company or its subsidiary itself), and words of other sectors, which drop
#: it: tickers as they are written, brand names in any case, Thai words anywhere.
DIRECT_BOOSTS = [("ASW", 50), ("Assetwise", 50), ("แอสเซทไวส์", 50), ("ร่มโพธิ์", 50), ("rhom bho", 50), ("เดอะ ไทเทิล", 40)]
BOOSTS = [
    ("อสังหาริมทรัพย์", 25), ("อสังหาฯ", 25), ("ที่อยู่อาศัย", 25), ("บ้านจัดสรร", 20), ("คอนโดมิเนียม", 25), ("คอนโด", 15), ("ทาวน์เฮาส์", 20), ("หมู่บ้าน", 10), ("ที่ดิน", 15),
    ("ดีเวลลอปเปอร์", 20), ("โครงการบ้าน", 15), ("ราคาบ้าน", 15),
    ("แลนด์แอนด์เฮ้าส์", 20), ("เอพี", 20), ("ศุภาลัย", 20), ("สิริ เวนเชอร์", 20), ("โนเบิล", 20), ("ออริจิ้น", 20), ("อนันดา", 20), ("แอล.พี.เอ็น", 20), ("ควอลิตี้เฮาส์", 20), ("ดับบลิวเอชเอ", 20),
    ("กนง.", 20), ("คณะกรรมการนโยบายการเงิน", 25), ("ดอกเบี้ยนโยบาย", 20), ("สินเชื่อบ้าน", 20), ("LTV", 25), ("อัตราดอกเบี้ย", 15),
    ("ครม.", 15), ("คณะรัฐมนตรี", 15), ("เงินเฟ้อ", 10), ("GDP", 10), ("ภาวะเศรษฐกิจ", 10), ("REIC", 25), ("ดัชนีความเชื่อมั่น", 10),
]
DROP_TICKERS = [
    "BAY", "KBANK", "SCB", "KTB", "TTB", "TISCO", "KKP", "KTC", "AEONTS", "PTT", "PTTEP", "TOP", "BANPU", "BCP", "IRPC", "ESSO", "SPRC", "GPSC", "AIS", "DTAC", "TRUE", "INTUCH", "JAS", "NT",
    "CPF", "CPALL", "OISHI", "TU", "MINT", "STA", "HMPRO", "MAKRO", "CRC", "RS", "COM7", "BJC", "GLOBAL", "BDMS", "BH", "CHG", "SCC", "TOA",
]
DROP_BRANDS = ["KBank", "Krungsri", "cardX", "Bitcoin", "Crypto"]
DROP_WORDS = [
    "กสิกรไทย", "กรุงศรี", "กรุงไทย", "ไทยพาณิชย์", "ทหารไทยธนชาต", "บัตรเครดิต", "สินเชื่อส่วนบุคคล", "สินเชื่อรายย่อย", "น้ำมัน", "ปิโตรเคมี", "โรงกลั่น", "ก๊าซธรรมชาติ", "LNG", "โทรคมนาคม",
    "อาหารแช่แข็ง", "อาหารสัตว์", "ค้าปลีก", "ห้างสรรพสินค้า", "โรงพยาบาล", "น้ำตาล", "เหล็ก", "ปูนซิเมนต์", "ทองคำ", "คริปโต", "กองทุนรวม", "ประกันภัย",
]


def whole_word(words: list[str], flags: str = "") -> str:
    """A pattern for any of the words, between characters that are not Latin letters, digits or underscores."""
    return rf"{flags}(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def relevance_score(title: Column, base: Column | int = 0) -> Column:
    """base and the boosts of all keywords in the title, in any case; 0 if a word of another sector is in it and no direct mention. A null title counts as empty."""
    text = F.coalesce(title, F.lit(""))
    low = F.lower(text)
    total = lambda table: reduce(lambda t, b: t + F.when(F.contains(low, F.lit(b[0].lower())), b[1]).otherwise(0), table, F.lit(0))
    direct = total(DIRECT_BOOSTS)
    dropped = reduce(lambda t, w: t | F.contains(low, F.lit(w.lower())), DROP_WORDS, text.rlike(whole_word(DROP_TICKERS)) | text.rlike(whole_word(DROP_BRANDS, "(?i)")))
    base = base if isinstance(base, Column) else F.lit(base)
    return F.when(dropped & (direct == 0), 0).otherwise(base + direct + total(BOOSTS))
