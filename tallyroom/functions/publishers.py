"""Publishers: which host belongs to whom, by the longest known suffix of the host, and who carries other publishers' stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hosts and the names that label them, the usual one first.
NAMES = {
    "bangkokbiznews.com": ["กรุงเทพธุรกิจ", "Krungthep Turakij", "Bangkok Biz News", "bangkokbiznews"],
    "siamrath.co.th": ["สยามรัฐ", "Siam Rath", "siamrath"],
    "naewna.com": ["แนวหน้า", "Naewna"],
    "thansettakij.com": ["ฐานเศรษฐกิจ", "Thansettakij"],
    "dailynews.co.th": ["เดลินิวส์", "Daily News", "Dailynews"],
    "thaipost.net": ["ไทยโพสต์", "Thai Post", "Thaipost"],
    "prachachat.net": ["ประชาชาติธุรกิจ", "Prachachat", "Prachachat Turakij"],
    "matichon.co.th": ["มติชน", "Matichon"],
    "khaosod.co.th": ["ข่าวสด", "Khaosod"],
    "thairath.co.th": ["ไทยรัฐ", "Thairath"],
    "posttoday.com": ["โพสต์ทูเดย์", "Post Today"],
    "kaohoon.com": ["ข่าวหุ้น", "ข่าวหุ้นธุรกิจ", "Kaohoon"],
    "hooninside.com": ["หุ้นอินไซด์", "Hooninside", "HoonInside"],
    "hoonsmart.com": ["หุ้นสมาร์ท", "HoonSmart", "Hoonsmart"],
    "ryt9.com": ["RYT9", "ryt9", "อาร์วายที9"],
    "set.or.th": ["SET", "ตลาดหลักทรัพย์", "ตลาดหลักทรัพย์แห่งประเทศไทย", "SETTRADE"],
    "settrade.com": ["Settrade", "สยามทรัพย์"],
    "reic.or.th": ["REIC", "ศูนย์ข้อมูลอสังหาริมทรัพย์"],
    "bot.or.th": ["ธปท.", "ธปท", "ธนาคารแห่งประเทศไทย", "BOT", "Bank of Thailand"],
    "thinkofliving.com": ["ThinkOfLiving", "thinkofliving", "ธิงค์ออฟลิฟวิ่ง"],
    "ddproperty.com": ["DDproperty", "ddproperty"],
    "terrabkk.com": ["TerraBKK", "terrabkk"],
    "bangkokpost.com": ["Bangkok Post", "บางกอกโพสต์"],
    "nationthailand.com": ["The Nation", "Nation Thailand"],
    "nationtv.tv": ["NationTV", "เนชั่นทีวี", "Nation TV"],
    "thebangkokinsight.com": ["The Bangkok Insight", "Bangkok Insight"],
    "wealthythai.com": ["Wealthy Thai", "WealthyThai"],
    "moneyandbanking.co.th": ["การเงินธนาคาร", "Money and Banking"],
    "thestandard.co": ["THE STANDARD", "The Standard"],
    "thecoverage.info": ["The Coverage"],
    "infoquest.co.th": ["InfoQuest", "อินโฟเควสท์"],
    "mgronline.com": ["ผู้จัดการ", "MGR Online", "Manager Online"],
    "thaipr.net": ["ThaiPR", "thaipr"],
    "assetwise.co.th": ["AssetWise", "แอสเซทไวส์", "ASW"],
    "prd.go.th": ["กรมประชาสัมพันธ์", "PRD"],
    "aec10news.com": ["AEC10News"],
    "thephuketnews.com": ["The Phuket News"],
    "investing.com": ["Investing.com", "Investing"],
    "banmuang.co.th": ["บ้านเมือง", "Banmuang"],
    "thaipbs.or.th": ["Thai PBS", "ไทยพีบีเอส", "Thai PBS News"],
    "share2trade.com": ["Share2Trade", "แชร์ทูเทรด"],
    "efinancethai.com": ["eFinanceThai", "อีไฟแนนซ์ไทย", "สำนักข่าวอีไฟแนนซ์ไทย"],
    "positioningmag.com": ["Positioning", "Positioning Magazine"],
    "brandbuffet.in.th": ["Brand Buffet", "BrandBuffet"],
    "innovestx.co.th": ["InnovestX", "InnovestX Research"],
    "kasikornresearch.com": ["KASIKORN RESEARCH CENTER", "ศูนย์วิจัยกสิกรไทย", "K-Research"],
    "krungsri.com": ["Krungsri", "กรุงศรี", "Krungsri The COACH"],
    "pi.financial": ["Pi Securities", "Pi Financial"],
    "bbc.com": ["BBC", "BBC News", "บีบีซี"],
    "workpointtoday.com": ["workpointTODAY", "Workpoint Today"],
    "thaihometown.com": ["Thaihometown"],
    "aio.panphol.com": ["AiO"],
    "insiderscreener.com": ["InsiderScreener"],
    "thebetter.co.th": ["The Better"],
    "innnews.co.th": ["สำนักข่าว INN", "INN News", "ไอเอ็นเอ็น"],
    "amarintv.com": ["AmarinTV", "อมรินทร์ทีวี"],
}
#: Hosts that carry other publishers' stories.
CARRIERS = ["msn.com", "news.line.me", "line.me", "flipboard.com", "finance.yahoo.com", "thaipr.net", "today.line.me", "ryt9.com", "newswit.com", "prnewswire.com", "businesswire.com"]


def alias_table(spark: SparkSession) -> DataFrame:
    """(host, alias, position) of NAMES, for callers that have no table of their own."""
    return spark.createDataFrame([(h, a, i) for h, names in NAMES.items() for i, a in enumerate(names)], "host string, alias string, position int")


def carrier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in CARRIERS], "host string")


def suffixes(host: Column) -> Column:
    """The host and its parents down to two labels, longest first; a host of one label has none."""
    labels = F.split(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), r"\.")
    climb = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.size(labels) > 1, climb).otherwise(F.array().cast("array<string>"))


def publisher_of(rows: DataFrame, aliases: DataFrame, host: str = "host", key: str = "id") -> DataFrame:
    """(key, publisher): the first name of the deepest known parent of each row's host; rows without one have null.

    A table of any size: parents are looked up by an equi-join, and the deepest hit wins. Aliases without a position come in name order.
    """
    order = F.col("position") if "position" in aliases.columns else F.col("alias")
    names = aliases.groupBy(F.col("host").alias("_parent")).agg(F.min_by("alias", order).alias("_name"))
    parents = rows.select(key, F.posexplode(suffixes(F.col(host))).alias("_i", "_parent"))
    found = parents.join(names, "_parent").groupBy(key).agg(F.min_by("_name", "_i").alias("publisher"))
    return rows.select(key).distinct().join(found, key, "left")


def is_publisher_name(title: Column) -> Column:
    """A title that is nothing but a known publisher's name, in any case."""
    return F.lower(title).isin(sorted({a.lower() for names in NAMES.values() for a in names}))
