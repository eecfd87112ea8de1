"""Fixed values of the text core: character classes, patterns, marker lists and tables, as plain text."""

# Character ranges (regular-expression class bodies).
HAN_CORE = r"\x{4E00}-\x{9FFF}\x{3105}-\x{3129}\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
HAN_TRAIN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
HAN_PIPE = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
HAN_TERMS = r"\x{3400}-\x{9FFF}"
ALNUM = "A-Za-z0-9&/_"
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCT = r"\x{21}-\x{7E}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2000}-\x{206F}"
QTY_SURFACE = rf"^[{HAN_TRAIN}\p{{L}}\p{{N}}.,:/%％+$＄¥￥-]+\z"
HAN_NUMERALS = "〇零一二兩三四五六七八九十百千萬億兆壹貳參肆伍陸柒捌玖拾佰仟"

# ASCII lower case and the one-to-one variant map.
NORM_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ臺"
NORM_TO = "abcdefghijklmnopqrstuvwxyz台"

# Scan patterns, by priority.
EMAIL = r"(?i)[a-z0-9_\-.]+@(?:\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.|(?:[a-z0-9\-]+\.)+)(?:[a-z][a-z0-9\-]{1,62}|[0-9]{1,3})\]?"
URL = (
    r"(?i)(?:https?://|ftps?://)?(?:(?:[0-9a-z_!~*'().&=+$%\-]+: )?[0-9a-z_!~*'().&=+$%\-]+@)?"
    r"(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9a-z_!~*'()\-]+\.)*(?:[0-9a-z][0-9a-z\-]{0,61})?[0-9a-z]\.[a-z][a-z0-9\-]{1,62})"
    r"(?::[0-9]{1,4})?(?:/[0-9a-z_!~*'().;?:@&=+$,%#\-]+)*/?"
)
MODEL_ID = r"(?i)[a-z][a-z0-9]*(?:-[a-z0-9]+)+"
CN_TIME = rf"[{HAN_NUMERALS}]+(?:個)?(?:星期|禮拜|年|月|週|周|天|日|季)"
CN_QTY = rf"[{HAN_NUMERALS}]+[個人隻]"
NUM_TIME = r"[0-9]+(?:[.,/][0-9]+)*(?:個)?[年月日號]"
ORDINAL = r"第[0-9]+[年季月週周天日期]"
NUMBER = r"[0-9]+(?:[.,/][0-9]+)*(?:[十百千萬億兆])?(?:[%％])?"
PRIORITIES = {"email": 600, "url": 500, "model_id": 400, "cn_time": 360, "ordinal": 350, "cn_qty": 340, "num_time": 300, "number": 100}
KINDS = {"email": "Email", "url": "Url", "model_id": "Eng", "cn_time": "Time", "ordinal": "Time", "cn_qty": "Num", "num_time": "Time", "number": "Num"}
TAIWAN = "臺灣|台灣|臺北|台北|新北|桃園|臺中|台中|彰化|南投|雲林|嘉義|臺南|台南|高雄|屏東|基隆|新竹|苗栗|宜蘭|花蓮|臺東|台東|澎湖|金門|馬祖"
HTML_TAGS = "address|article|aside|base|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"

# Signal patterns. Digits are ASCII here; \d of other scripts is not in the data.
NUM_BODY = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)"
SIGNALS = {
    "number": rf"[+-]?{NUM_BODY}",
    "date": r"(?i)(?:民國\s*)?[0-9]{2,4}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?|[0-9]{4}[-/.][0-9]{1,2}(?:[-/.][0-9]{1,2})?|[0-9]{1,2}月[0-9]{1,2}日|\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-9]{1,2}(?:,\s*)?[0-9]{4}\b",
    "money": rf"(?i)(?:(?:NT|US)?[$€£¥￥]\s*[+-]?{NUM_BODY}|(?:TWD|NTD|USD|EUR|JPY|CNY|RMB)\s*[+-]?{NUM_BODY}|[+-]?{NUM_BODY}\s*(?:元|萬元|億元|兆元|美元|美金|歐元|日圓|人民幣|TWD|NTD|USD|EUR|JPY|CNY|RMB))",
    "quantity": rf"(?i)[+-]?{NUM_BODY}\s*(?:%|％|bps|ms|毫秒|秒|分鐘|小時|天|週|周|月|季|年|公斤|公克|克|kg|g|公里|公尺|公分|毫米|km|m|cm|mm|公升|毫升|l|ml|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|mw|v|kv|a|ma|°c|℃|°f)",
    "object": r"`[^`\r\n]+`|(?:[A-Za-z][A-Za-z0-9_-]*\.)+[A-Za-z_][A-Za-z0-9_-]*|\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b|\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+\b",
    "acronym": r"\b[A-Z][A-Z0-9&./-]{1,11}\b",
    "proper_en": r"\b(?:[A-Z][a-z]+(?:\s+(?:of|the|and|&|[A-Z][a-z]+)){1,5}|[A-Z][A-Z0-9&./-]{1,11})\b",
    "proper_cjk": r"""[\p{Han}]{2,20}(?:公司|集團|大學|學院|政府|委員會|基金會|協會|銀行|醫院|研究院|法院|市|縣|國)|[「『“"]([^」』”"\r\n]{2,30})[」』”"]""",
    "emphasis": r"\*\*[^*\r\n]+\*\*|（[^）\r\n]+）|\([^\)\r\n]+\)",
}
NEGATION_CHARS = "不未無沒非否勿莫"
NEGATION_EXCLUDED = ("不只", "不僅", "不但", "非常", "是否", "未來", "無論", "否則")
NEGATION_EN = r"\b(?:not|no|never|without|cannot|can't|won't|neither|nor|prohibit(?:ed|s|ing)?|forbid(?:den|s|ding)?|avoid(?:ed|s|ing)?)\b"
DISCOURSE_1 = ("研究核心發現", "核心發現", "研究結論", "主要結論", "是指", "定義為", "key finding", "main finding", "research conclusion", "main conclusion", "is defined as", "refers to")
DISCOURSE_2 = ("結果顯示", "結果指出", "結論", "建議", "因此", "所以", "results show", "results indicate", "conclusion", "recommend", "therefore")

# Sentence markers.
TERMINALS = "。！？!?…"
CLOSERS = "\"'”’」』》〉）)】]〕"
DEPENDENT_ANYWHERE = ("不只", "不僅", "不但")
DEPENDENT_PREFIX = ("如果", "若", "倘若", "只要", "除非", "一旦", "當", "雖然", "儘管", "即使", "由於", "因為", "除了")
CONDITION = ("超過", "高於", "低於", "少於", "未滿", "達到", "多於")
CONDITION_UNITS = ("毫秒", "秒", "分鐘", "小時", "天", "日", "週", "周", "月", "季", "年", "%", "％", "元", "萬元", "億元", "公里", "公尺", "公分", "公斤", "GB", "MB", "TB")
DEFINITION = ("是指", "意指", "指的是", "定義為", "也就是", "換言之")
BULLETS = "-*+•‧▪◦"

# Tag mapping of the external tagger.
TAG_EXACT = {"A": "a", "Caa": "c", "Cab": "c", "Cba": "c", "Cbb": "c", "D": "d", "I": "e", "Na": "n", "Nd": "t", "Neu": "m", "Nf": "q", "Nh": "r", "Nv": "vn", "P": "p", "V_2": "v", "FW": "x"}
TAG_BROAD = {
    "Da": "d", "Dfa": "d", "Dfb": "d", "Dk": "d", "Nc": "ns", "Ncd": "s", "Nep": "r", "Neqa": "m", "Neqb": "m", "Nes": "r", "SHI": "v", "T": "u",
    "VA": "v", "VAC": "v", "VB": "v", "VC": "v", "VCL": "v", "VD": "v", "VE": "v", "VF": "v", "VG": "v", "VI": "v", "VJ": "v", "VK": "v", "VL": "v",
}
TAG_AMBIGUOUS = {"DE": ("uj", "ud", "uv"), "Di": ("u", "d"), "DM": ("m", "d"), "Nb": ("nr", "ns", "nt", "nz"), "Ng": ("f", "u"), "VH": ("a", "v"), "VHC": ("a", "v")}
TAG_SKIP = (
    "COLONCATEGORY", "COMMACATEGORY", "DASHCATEGORY", "ETCCATEGORY", "EXCLAMATIONCATEGORY", "PARENTHESISCATEGORY", "PAUSECATEGORY", "PERIODCATEGORY",
    "QUESTIONCATEGORY", "SEMICOLONCATEGORY", "SPCHANGECATEGORY", "WHITESPACE",
)
NAMED_ENTITIES = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE")
QUANTITY_ENTITIES = ("CARDINAL", "ORDINAL", "QUANTITY", "MONEY", "PERCENT", "DATE", "TIME")
NOUN_SUFFIXES = "師員家者手"
QUANTITY_TAG = {"DATE": "Nd", "TIME": "Nd", "CARDINAL": "Neu", "ORDINAL": "Neu", "QUANTITY": "Neu", "MONEY": "Neu", "PERCENT": "Neu"}
MEASURE_CROSSING = ("本書", "封信", "層樓")
CROSSING_NUMERALS = "〇零一二三四五六七八九十百千萬億兆兩"
ENTITY_TAG = {"PERSON": "Nb", "ORG": "Nc", "GPE": "Nc", "LOC": "Nc", "FAC": "Nc"}

# Suspected personal data; the second form is for engines without look-around.
PII = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|(?<![0-9])09[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}(?![0-9])|(?<![A-Z0-9])[A-Z][12][0-9]{8}(?![0-9])"
PII_PLAIN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|(^|[^0-9])09[0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}($|[^0-9])|(^|[^A-Z0-9])[A-Z][12][0-9]{8}($|[^0-9])"

# Curated dictionary entries (word, frequency, tag).
CURATED = [
    ("AV女優", 1, "Na"), ("PDF檔", 1, "Na"), ("陳先生", 1, "Nb"), ("行政院", 1, "Nc"), ("研究", 10, "VC"), ("生命", 1000000, "Na"), ("擺攤", 1, "VC"),
    ("第2季", 1, "Nd"), ("一起", 100000000, "D"), ("人工智慧", 1, "Na"), ("南港", 200000, "Nb"), ("左營", 200000, "Nb"), ("珍珠奶茶", 1, "Na"),
    ("發表聲明", 1, "VC"), ("物價指數", 1, "Na"), ("嫌犯", 1000000, "Na"), ("捷運", 10000000, "Na"), ("發生爭執", 1, "VA"), ("板南線", 100000, "Nb"),
    ("接種", 1000000, "VC"), ("呵呵呵", 100000, "I"),
]
# Anchors of three words that are protected as they stand.
ANCHOR_WORDS = ("行政院", "生命", "擺攤")
# Legacy emotion codes and what they became.
LEGACY_EMOTIONS = {
    "Happy": ("emotion", "joy.joy"), "Confidence": ("emotion", "outlook.confidence"), "Sad": ("emotion", "sadness.sadness"), "Annoyed": ("emotion", "anger.annoyance"),
    "Unlike": ("emotion", "aversion.dislike"), "NoChoice": ("emotion", "powerlessness.helplessness"), "Inferior": ("emotion", "self_conscious.inferiority"),
    "Regret": ("emotion", "self_conscious.regret"), "Blame": ("appraisal", "blame"), "Indifferent": ("emotion", "detachment.indifference"),
    "Disappointed": ("emotion", "sadness.disappointment"), "Doubt": ("emotion", "cognition.doubt"), "Despise": ("emotion", "aversion.contempt"),
    "Worried": ("emotion", "fear.worry"), "Fake": ("flag", "deception"), "Fear": ("emotion", "fear.fear"), "Angry": ("emotion", "anger.anger"), "Dangerous": ("flag", "threat"),
}
# Punctuation and quote labels.
PUNCTUATION = {"，": 1, ",": 1, "。": 2, ".": 2, "．": 2, "？": 3, "?": 3, "！": 4, "!": 4, "：": 5, ":": 5, "；": 6, ";": 6, "、": 7}
MARK_GLYPHS = {"full": ("", "，", "。", "？", "！", "：", "；", "、"), "half": ("", ",", ".", "?", "!", ":", ";", ",")}
QUOTE_GLYPHS = {"full": ("「", "」"), "half": ('"', '"')}
# Spans whose punctuation is no mark: addresses (without the marks at their end), acronyms, numbers.
PROTECTED_PUNCTUATION = (
    r"(?i:\b(?:https?://|www\.)[^\s，。；：！？、「」『』“”]+)(?<![,.;:!?，。；：！？、」』”])",
    r"(?i:\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b)",
    r"\b(?:[A-Za-z]\.){2,}",
    r"(?<!\w)[0-9]{1,3}(?:[,，][0-9]{3})+(?:[.．][0-9]+)*|[0-9]+(?:[.．][0-9]+)+",
)
OPEN_QUOTES, CLOSE_QUOTES = "「『“", "」』”"

# Function words that carry meaning, and interjections.
MEANING_WORDS = tuple("不 未 無 沒 非 否 勿 莫 最 至少 至多 約 近 僅 只 仍 仍然 已 已經 將 曾 可能 必須 應 應該 如果 若 除非 即使 雖然 但是 但 因為 所以 因此 否則 不但 不僅".split())
INTERJECTIONS = tuple("啊 呀 喔 哦 唉 哎 哇 欸 誒".split())
KEYWORD_TAGS = ("Na", "Nb", "Nc", "Ncd", "Nv", "FW")
