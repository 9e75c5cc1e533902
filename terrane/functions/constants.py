"""Fixed values of the address model: sentinels, levels, scores."""

# Sentinels that stand for separators and special tokens in normalised text.
DASH = "@"
SPACE = "␣"
BANGAICHI = "<BG>"
MUBANCHI = "<MB>"
OAZA_BANCHO = "<OB>"
OAZA_CENTER = "<OC>"
FUZZY = "?"

# Characters that are read as dashes.
DASHES = "－-−‐‒–—─━―ーｰ⏤⎯﹘‑⁃﹣"

# Kanji numerals and their digits.
KANJI_DIGITS = {
    "〇": 0, "零": 0, "一": 1, "壱": 1, "二": 2, "ニ": 2, "弐": 2, "三": 3, "参": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
}
TEN = "十"
# A numeral is read as a number only before one of these, or at the end.
COUNTERS = "軒通丁町字番部所社線号条里" + DASH + SPACE + "の之ノ丿"

# Islands that lines name and the registry doesn't.
ISLANDS = ("八丈島", "三宅島")

# Old and variant forms, each before its usual form. A registry's own
# table, which may be larger, is a parameter of the geocoder.
VARIANTS = {
    "淵": "渕", "曾": "会", "亞": "亜", "圍": "囲", "壹": "壱", "榮": "栄", "驛": "駅", "應": "応", "櫻": "桜", "假": "仮",
    "會": "会", "懷": "懐", "覺": "覚", "樂": "楽", "陷": "陥", "歡": "歓", "氣": "気", "戲": "戯", "據": "拠", "挾": "挟",
    "區": "区", "徑": "径", "溪": "渓", "輕": "軽", "藝": "芸", "儉": "倹", "圈": "圏", "權": "権", "嚴": "厳", "恆": "恒",
    "國": "国", "齋": "斎", "雜": "雑", "蠶": "蚕", "殘": "残", "兒": "児", "實": "実", "釋": "釈", "從": "従", "縱": "縦",
    "敍": "叙", "燒": "焼", "條": "条", "剩": "剰", "壤": "壌", "釀": "醸", "眞": "真", "盡": "尽", "醉": "酔", "髓": "髄",
    "聲": "声", "竊": "窃", "淺": "浅", "錢": "銭", "禪": "禅", "爭": "争", "插": "挿", "騷": "騒", "屬": "属", "對": "対",
    "滯": "滞", "擇": "択", "單": "単", "斷": "断", "癡": "痴", "鑄": "鋳", "敕": "勅", "鐵": "鉄", "傳": "伝", "黨": "党",
    "鬪": "闘", "屆": "届", "腦": "脳", "廢": "廃", "發": "発", "蠻": "蛮", "拂": "払", "邊": "辺", "瓣": "弁", "寶": "宝",
    "沒": "没", "滿": "満", "藥": "薬", "餘": "余", "樣": "様", "亂": "乱", "兩": "両", "禮": "礼", "靈": "霊", "爐": "炉",
    "灣": "湾", "惡": "悪", "醫": "医", "飮": "飲", "營": "営", "圓": "円", "歐": "欧", "奧": "奥", "價": "価", "繪": "絵",
    "擴": "拡", "學": "学", "勸": "勧", "關": "関", "觀": "観", "歸": "帰", "犧": "犠", "擧": "挙", "狹": "狭", "驅": "駆",
    "莖": "茎", "經": "経", "缺": "欠", "險": "険", "檢": "検", "驗": "験", "廣": "広", "碎": "砕", "劑": "剤", "參": "参",
    "絲": "糸", "辭": "辞", "舍": "舎", "壽": "寿", "澁": "渋", "肅": "粛", "將": "将", "證": "証", "乘": "乗", "淨": "浄",
    "疊": "畳", "囑": "嘱", "寢": "寝", "圖": "図", "隨": "随", "數": "数", "靜": "静", "專": "専", "戰": "戦", "潛": "潜",
    "雙": "双", "莊": "荘", "裝": "装", "藏": "蔵", "續": "続", "體": "体", "臺": "台", "澤": "沢", "膽": "胆", "彈": "弾",
    "晝": "昼", "廳": "庁", "聽": "聴", "鹽": "塩", "點": "点", "燈": "灯", "獨": "独", "貳": "弐", "霸": "覇", "麥": "麦",
    "濱": "浜", "竝": "並", "變": "変", "舖": "舗", "萬": "万", "默": "黙", "譯": "訳", "豫": "予", "謠": "謡", "來": "来",
    "龍": "竜", "壘": "塁", "隸": "隷", "勞": "労", "樓": "楼", "桒": "桑", "糀": "麹", "樟": "楠", "冶": "治", "鸙": "雲雀", "楠木": "楠",
}

# Match levels.
LEVELS = {
    -1: "error", 0: "unknown", 1: "prefecture", 2: "city", 3: "machiaza", 4: "machiaza_detail",
    5: "residential_block", 6: "residential_detail", 7: "parcel",
}

#: Words that may be missing from a written address, by level.
MISSING_WORDS = {"pref": ["道", "都", "府", "県"], "city": ["郡", "市", "町", "村"], "ward": ["市", "区"]}

#: Columns of the CSV output, in order.
CSV_COLUMNS = [
    "input", "output", "score", "match_level", "coordinate_level", "lat", "lon", "others", "lg_code", "machiaza_id",
    "rsdt_addr_flg", "blk_id", "rsdt_id", "rsdt2_id", "prc_id", "pref", "county", "city", "ward", "oaza_cho", "chome",
    "koaza", "blk_num", "rsdt_num", "rsdt_num2", "prc_num1", "prc_num2", "prc_num3",
]
