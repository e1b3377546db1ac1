"""Headline classes: categories by ordered rules, mentions, event fingerprints, entities and typed numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.functions.rules import first_match

#: Names of the first panel's company, of the second's, and of competitors, with their tickers.
COMPANY_NAMES = ["asw", "assetwise", "แอสเซทไวส์", "แอสเสทไวส์"]
TITLE_NAMES = ["ร่มโพธิ์", "เดอะ ไทเทิล", "เดอะไทเทิล"]
TITLE_DEED = r"(?i)title[\s.-]?deeds?|โฉนด\s*TITLE|TITLE\s*โฉนด"
TITLE_CUE = "(?i)หุ้น|ภูเก็ต|Phuket|อสังหา|คอนโด|วิลล่า|villa|condo|ผลประกอบการ|งบ|กำไร|รายได้|ปันผล|เทรด|ตลาดหลักทรัพย์|ร่มโพธิ์"
COMPETITOR_NAMES = ["แลนด์แอนด์เฮ้าส์", "แลนด์ แอนด์ เฮ้าส์", "เอพี", "ศุภาลัย", "สิริ เวนเชอร์", "สิริวงศ์พร็อพเพอร์ตี้", "โนเบิล", "ออริจิ้น", "อนันดา", "แอล.พี.เอ็น", "แอลพีเอ็น", "ควอลิตี้เฮาส์", "ดับบลิวเอชเอ"]
COMPETITOR_TICKERS = ["SPALI", "SIRI", "NOBLE", "ORI", "ANAN", "LPN", "WHA", "QH"]

#: Patterns of the categories, in the order in which they are tried.
RATES = r"กนง\.|ดอกเบี้ยนโยบาย|อัตราดอกเบี้ย"
TITLE_RULES = [
    (RATES, "RATES"),
    ("(?i)LTV|ค่าโอน|ค่าจดจำนอง|โควตาต่างชาติ|ต่างชาติถือครอง|นอมินี|nominee|ลีสโฮลด์|leasehold|เช่าระยะยาว|มาตรการอสังหาฯ|ลดค่าธรรมเนียม.*(โอน|จดจำนอง)", "GOV_POLICY"),
    ("(?i)วีซ่า|visa|นักท่องเที่ยว|เที่ยวบิน|สายการบิน|สนามบิน|ท่องเที่ยว|tourist|flight|airport|arrival", "TOURISM"),
    ("(?i)น้ำมันดิบ|ราคาน้ำมัน|Urals|Brent|WTI|OPEC|โอเปก", "OIL"),
    (r"ค่าเงินบาท|เงินบาท|บาทแข็ง|บาทอ่อน|รูเบิล|เงินหยวน|อัตราแลกเปลี่ยน|โอนเงิน(ระหว่าง|ต่าง)ประเทศ|USD/THB|(?<![A-Za-z])(RUB|CNY)(?![A-Za-z])|SWIFT", "FX"),
    ("(?i)สงคราม|ยูเครน|รัสเซีย|เครมลิน|คว่ำบาตร|หยุดยิง|เจรจาสันติภาพ|ceasefire|sanction|(?<![A-Za-z])war(?![A-Za-z])|Ukraine|Russia|Kremlin|NATO|ตะวันออกกลาง|อิสราเอล|Israel", "GEOPOLITICS"),
]
TITLE_HINTS = {"tourism": "TOURISM", "foreign_demand": "INDUSTRY", "phuket_sector": "INDUSTRY", "sector_policy": "GOV_POLICY", "interest_rate": "RATES", "macro_fx": "FX", "sector_data": "INDUSTRY", "peer_news": "INDUSTRY"}
TITLE_INDUSTRY = "(?i)อสังหา|ที่อยู่อาศัย|คอนโด|วิลล่า|บ้านจัดสรร|ภูเก็ต|Phuket|ต่างชาติ.*(ซื้อ|โอน|ถือครอง)"
ASW_RULES = [
    (RATES, "RATES"),
    ("LTV|ค่าโอน|ค่าจดจำนอง|สมาคมบ้านจัดสรร|มาตรการอสังหาฯ", "GOV_POLICY"),
    ("ลดค่าธรรมเนียม.*(โอน|จดจำนอง|จดทะเบียน|อสังหาฯ|ที่อยู่อาศัย)", "GOV_POLICY"),
    ("ค่าธรรมเนียม.*(โอน|จดจำนอง|จดทะเบียน).*(อสังหาฯ|ที่อยู่อาศัย)", "GOV_POLICY"),
    ("มาตรการกระตุ้นอสังหาฯ", "GOV_POLICY"),
]
ASW_HINTS = {"sector_policy": "GOV_POLICY", "interest_rate": "RATES", "political": "POLITICS", "sector_data": "INDUSTRY", "peer_news": "INDUSTRY"}
ASW_INDUSTRY = "อสังหา|ที่อยู่อาศัย|คอนโด|บ้านจัดสรร"

#: Measures, actors, stages and revisions of a policy event, in the order in which they are tried.
MEASURES = [
    ("ค่าโอน|ค่าธรรมเนียมการโอน|จดจำนอง|จำนอง", "TRANSFER_FEE"),
    (r"(?i)(?<![A-Za-z0-9_])LTV(?![A-Za-z0-9_])|มาตรการ\s*LTV|loan.?to.?value", "LTV"),
    ("ดอกเบี้ยนโยบาย|อัตราดอกเบี้ยนโยบาย|กนง", "POLICY_RATE"),
    ("ภาษีที่ดิน|ภาษีโรงเรือน", "LAND_TAX"),
    ("บ้านล้านหลัง|บ้านเพื่อคนไทย|ที่อยู่อาศัยผู้มีรายได้น้อย", "HOUSING_SCHEME"),
    ("กระตุ้นอสังหา|มาตรการอสังหา", "PROPERTY_STIMULUS"),
    (r"ต่างชาติ.*(?:ถือครอง|ซื้อ).*(?:คอนโด|ที่ดิน)|เช่าที่ดิน\s*99\s*ปี", "FOREIGN_OWNERSHIP"),
    ("ค่าแรงขั้นต่ำ", "MIN_WAGE"),
    ("ดิจิทัลวอลเล็ต|เงินดิจิทัล", "DIGITAL_WALLET"),
]
ACTORS = [
    (r"ธปท\.?|ธนาคารแห่งประเทศไทย|แบงก์ชาติ|ผู้ว่าฯ?\s*ธปท", "BOT"),
    (r"ธอส\.?|ธนาคารอาคารสงเคราะห์", "GHB"),
    (r"กนง\.?", "MPC"),
    ("กรมที่ดิน", "DOL"),
    (r"ครม\.?|คณะรัฐมนตรี|ที่ประชุมคณะรัฐมนตรี", "CABINET"),
    ("รัฐบาล|ภาครัฐ|รัฐ(?![ก-ฮ])", "CABINET"),
    (r"กระทรวงการคลัง|ก\.?คลัง|คลัง(?![ก-ฮ])", "CABINET"),
]
STAGES = [
    ("ราชกิจจา|ประกาศราชกิจจา", "GAZETTE"),
    ("กรมที่ดิน|เริ่มใช้|มีผลบังคับ|พร้อมให้บริการ|เริ่มแล้ว", "IN_FORCE"),
    ("สิ้นสุด|หมดอายุ|ครบกำหนด|ยุติ|ไม่ต่ออายุ", "EXPIRY"),
    ("สูตรคำนวณ|วิธีคำนวณ|เช็คสิทธิ|คู่มือ|ตอบข้อสงสัย|อย่างไร|คืออะไร|ทำความเข้าใจ", "EXPLAINER"),
    ("เตรียมเสนอ|จ่อเสนอ|เตรียมชง|เสนอ ครม|จ่อขยาย|เตรียมขยาย", "PROPOSED"),
    ("ชี้|มอง|เผย|ระบุ|คาดว่า|ห่วง|กังวล|ประเมิน|วิเคราะห์|แนะ|อุ้ม", "COMMENTARY"),
]
REVISIONS = "ปรับ|เปลี่ยน|แก้ไข|ยกเลิก|ทบทวน|ลดวงเงิน|เพิ่มวงเงิน"
#: Units of amounts, in millions.
UNITS = {"หมื่นล้าน": 10000.0, "พันล้าน": 1000.0, "ล้าน": 1.0, "แสน": 0.1, "หมื่น": 0.01, "พัน": 0.001}


def _has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words[1:], F.contains(c, F.lit(words[0])))


def mentions_title(c: Column) -> Column:
    """A local name or brand form, or the upper-case ticker next to a context cue; land-title phrases don't count."""
    scrubbed = F.regexp_replace(c, TITLE_DEED, " ")
    brand = scrubbed.rlike(r"(?<![A-Za-z])The Title\s+[A-Z\x{0E00}-\x{0E7F}]")
    ticker = scrubbed.rlike("(?<![A-Za-z])TITLE(?![A-Za-z])") & scrubbed.rlike(TITLE_CUE)
    return F.coalesce(_has_any(c, TITLE_NAMES) | c.rlike(r"(?i)rhom\s*bho") | brand | ticker, F.lit(False))


def mentions_company(c: Column) -> Column:
    return F.coalesce(_has_any(F.lower(c), COMPANY_NAMES), F.lit(False))


def mentions_competitor(c: Column) -> Column:
    """A name in any case, or a ticker in capitals."""
    return F.coalesce(_has_any(F.lower(c), COMPETITOR_NAMES) | c.rlike(f"(?<![A-Za-z])({'|'.join(COMPETITOR_TICKERS)})(?![A-Za-z])"), F.lit(False))


def _by_hint(hint: Column, hints: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in hints.items() for x in kv)), F.coalesce(hint, F.lit("")))


def category(title: Column, hint: Column, panel: Column, title_panel: str = "TITLE") -> Column:
    """The category of a headline on its panel: mentions, then ordered patterns, then the query's hint, then the sector's words."""
    empty = F.coalesce(title, F.lit("")) == ""
    second = F.coalesce(F.when(mentions_title(title), "COMPANY"), first_match(title, TITLE_RULES), _by_hint(hint, TITLE_HINTS), F.when(title.rlike(TITLE_INDUSTRY), "INDUSTRY"), F.lit("MACRO"))
    first = F.coalesce(
        F.when(mentions_company(title) | mentions_title(title), "COMPANY"),
        first_match(title, ASW_RULES),
        F.when(mentions_competitor(title), "COMPETITOR"),
        _by_hint(hint, ASW_HINTS),
        F.when(title.rlike(ASW_INDUSTRY), "INDUSTRY"),
        F.lit("MACRO"),
    )
    return F.when(empty, "MACRO").when(panel == title_panel, second).otherwise(first)


def _found(c: Column, pattern: str, prefix: str, value=lambda x: x) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(prefix), value(x)))


_EDGE = "(?<![A-Za-z0-9_])"
_END = "(?![A-Za-z0-9_])"


def _era(x: Column) -> Column:
    return (x.cast("int") + 2500).cast("string")


def event_parameters(c: Column) -> Column:
    """Percentages, amounts in millions and years of a headline: what tells versions of a measure apart."""
    parts = [
        _found(c, r"([0-9]+(?:\.[0-9]+)?)\s*%", "p"),
        _found(c, r"([0-9]+(?:[.,][0-9]+)?)\s*ล้าน", "m", lambda x: F.replace(x, F.lit(","), F.lit(""))),
        _found(c, rf"{_EDGE}(25[0-9]{{2}}){_END}", "y"),
        _found(c, rf"ปี\s*([0-9]{{2}}){_END}", "y", _era),
        _found(c, rf"[ก-ฮ]{{1,2}}\.\s?[ก-ฮ]\.\s*([0-9]{{2}}){_END}", "y", _era),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def event_fingerprint(c: Column) -> Column:
    """measure|actor|stage|revision|parameters of a policy headline; null if it names no measure."""
    parts = [first_match(c, MEASURES), first_match(c, ACTORS, "UNSPEC"), first_match(c, STAGES, "ANNOUNCE"), F.when(c.rlike(REVISIONS), "REVISED").otherwise("SAME"), F.array_join(event_parameters(c), ",")]
    return F.when(parts[0].isNotNull(), F.concat_ws("|", *parts))


def numbers_in(c: Column) -> Column:
    """Typed numbers: pct:, yr: (era folded), amt: (in millions), num: (grouped digits)."""
    pairs = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.,][0-9]+)?\s*(?:หมื่นล้าน|พันล้าน|ล้าน|แสน|หมื่น|พัน))"), F.lit(1))
    unit = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv)), F.regexp_extract(x, r"([^0-9.,\s]+)$", 1))
    value = lambda x: F.round(F.replace(F.regexp_extract(x, r"^([0-9.,]+)", 1), F.lit(","), F.lit("")).try_cast("double") * unit(x), 3)
    amounts = F.transform(pairs, lambda x: F.concat(F.lit("amt:"), F.regexp_replace(value(x).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")))
    year = lambda x: (x.cast("int") - 543).cast("string")
    parts = [
        _found(c, r"([0-9]+(?:[.,][0-9]+)?)\s*%", "pct:", lambda x: F.replace(x, F.lit(","), F.lit("."))),
        _found(c, rf"{_EDGE}(25[0-9]{{2}}){_END}", "yr:", year),
        _found(c, rf"ปี\s*([0-9]{{2}}){_END}", "yr:", lambda x: year(_era(x))),
        _found(c, rf"{_EDGE}(20[0-9]{{2}}){_END}", "yr:"),
        amounts,
        _found(c, rf"{_EDGE}([0-9]{{1,3}}(?:,[0-9]{{3}})+){_END}", "num:", lambda x: F.replace(x, F.lit(","), F.lit(""))),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def strip_site_suffix(c: Column) -> Column:
    """Without a site's name after a spaced dash or a bar, if at least eight characters stay."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s|｜\-–—:]+$", ""), r"^[\s|｜\-–—:]+", "")
    head = F.trim(F.regexp_extract(t, r"^(.*?)(?:\s+[\-–—]\s+|\s*[|｜]\s*)([^|｜]{2,40})$", 1))
    return F.when(F.length(head) >= 8, head).otherwise(t)


def compare_form(c: Column) -> Column:
    """Lower-case Latin letters, digits and Thai alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\x{0E00}-\x{0E7F}]", "")


def remarks(company: Column, sector: Column, macro: Column) -> Column:
    """One remark of three legacy columns, the company's first, with its bucket."""
    pick = lambda c: F.nullif(F.trim(c), F.lit(""))
    bucket = F.when(pick(company).isNotNull(), "company").when(pick(sector).isNotNull(), "sector").when(pick(macro).isNotNull(), "macro")
    return F.struct(F.coalesce(pick(company), pick(sector), pick(macro)).alias("remark"), bucket.alias("category"))


_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Which company a headline names, and the spellings of which a result must have one; the first that matches.
ALIAS_RULES = [
    ("(?i)ASW|Assetwise|แอสเซทไวส์|แอสเสทไวส์", ["ASW", "Assetwise", "แอสเซทไวส์", "แอสเสทไวส์"]),
    (rf"(?i){_B}AP{_E}.*Thailand|เอพี\s*ไทยแลนด์|แอ็น\s*ไทยแลนด์", ["AP", "เอพี", "แอ็น"]),
    (f"(?i){_B}LH{_E}|แลนด์แอนด์เฮ้าส์", ["LH", "แลนด์แอนด์เฮ้าส์", "แลนด์ แอนด์ เฮ้าส์"]),
    (rf"(?i){_B}ORN{_E}|นาวี่\s*แอสเซท", ["ORN", "นาวี่"]),
    ("(?i)SPALI|ศุภาลัย", ["SPALI", "ศุภาลัย"]),
    ("(?i)SIRI|แสนสิริ", ["SIRI", "แสนสิริ"]),
    ("(?i)NOBLE|โนเบล|โนเบิล", ["NOBLE", "โนเบล", "โนเบิล"]),
    (f"(?i){_B}ORI{_E}|ออริจิ้น", ["ORI", "ออริจิ้น"]),
    (f"(?i){_B}QH{_E}|ควอลิตี้เฮ้าส์|ควอลิตี้เฮาส์", ["QH", "ควอลิตี้เฮ้าส์", "ควอลิตี้เฮาส์"]),
    ("(?i)PRUK|พฤกษา", ["PRUK", "PSH", "พฤกษา"]),
    ("(?i)PROUD|พรู๊ด", ["PROUD", "พรู๊ด"]),
    (rf"(?i){_B}PS{_E}\s*Property|เพอร์เฟค|Perfect", ["PF", "เพอร์เฟค", "Perfect"]),
    ("(?i)SENA|เซนา", ["SENA", "เซนา"]),
    (f"(?i){_B}BTS{_E}|บีทีเอส", ["BTS", "บีทีเอส"]),
    ("(?i)ANAN|อนันดา", ["ANAN", "อนันดา"]),
    (rf"(?i){_B}LPN{_E}|แอล\.พี\.เอ็น|ลาดพร้าว\s*เน็ท", ["LPN", "แอล.พี.เอ็น", "แอลพีเอ็น"]),
    (f"(?i){_B}SPF{_E}|ศรีสวัสดิ์", ["SPF", "ศรีสวัสดิ์"]),
    (f"(?i){_B}AF{_E}|อาร์เอฟ", ["RF", "AF", "อาร์เอฟ"]),
    (f"(?i){_B}DRE{_E}|ดิแอสเซท", ["DRE", "ดิแอสเซท"]),
    (rf"(?i){_B}RML{_E}|ราชมงคล\s*พร็อพเพอร์ตี้", ["RML", "ราชมงคล"]),
    (rf"(?i){_B}B\*M{_E}|แบม", ["BM", "แบม"]),
    (rf"(?i){_B}LALIN{_E}|ลลิล\s*พร็อพเพอร์ตี้", ["LALIN", "ลลิล"]),
    (f"(?i){_B}MBK{_E}|เอ็มบีเค", ["MBK", "เอ็มบีเค"]),
    (rf"(?i){_B}S&P{_E}|ศุภกิจ\s*พร็อพเพอร์ตี้", ["SP", "ศุภกิจ"]),
    (rf"(?i){_B}STEC{_E}|สิงหะ\s*พร็อพเพอร์ตี้", ["STEC", "สิงหะ"]),
    (f"(?i){_B}CHAN{_E}|ชน", ["CHAN", "ชน"]),
    (f"(?i){_B}RABBIT{_E}|แรบบิท", ["RABBIT", "แรบบิท"]),
    (f"(?i){_B}ROJANA{_E}|โรจนะ", ["ROJANA", "โรจนะ"]),
    ("(?i)TRIS|ทริส", ["TRIS", "ทริส"]),
    (f"(?i)ธปท|BOT{_E}", ["ธปท", "BOT", "ธนาคารแห่งประเทศไทย"]),
    ("(?i)กนง", ["กนง"]),
    ("(?i)Fed|เฟด", ["Fed", "เฟด"]),
]


def required_aliases(c: Column) -> Column:
    """Spellings of the company that a headline names; none if it names no known one."""
    cases = [F.when(c.rlike(p), F.array(*map(F.lit, names))) for p, names in ALIAS_RULES]
    return F.coalesce(*cases, F.array().cast("array<string>"))
