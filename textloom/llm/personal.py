"""Problem 3: personal information in free text, as typed spans and as text with placeholders.

Regular expressions propose spans on the folded text (width, look-alike letters and invisible characters aside),
checksums confirm numbers that carry one, and nearby context words raise or lower the score; a span is kept from
``MIN_SCORE`` on, and of two that overlap the better-scored, then the longer. Offsets are those of the stored text.

Whether Han characters behind a surname are a given name is scored from the words around them and from each character's
rate: of its occurrences behind a surname in the whole corpus, the share that stand as a given name between cue words. A
short list of usual characters is only the prior of that rate.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.aligned import Aligned
from textloom.session import table

MIN_SCORE = 0.5
HAN = "一-鿿㐀-䶿"
NUM = "[0-9零〇一二三四五六七八九十百]"

# Common surnames of Taiwan, of two characters and of one.
SURNAMES_2 = "歐陽 張簡 司馬 上官 諸葛 東方 皇甫 尉遲 公孫 令狐 慕容 司徒 范姜 張廖"
SURNAMES_1 = "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾游彭詹胡施沈余盧梁趙顏柯翁魏孫戴范方宋鄧杜傅侯曹薛丁卓阮馬董温溫唐藍石蔣古紀姚連馮歐程湯田康姜白汪尤鄒巫龔嚴涂黎韓袁金童陸夏柳凃邵錢伍倪溥于譚駱熊任甘秦章華俞樊毛湛辛管"
# Characters of given names that have been frequent in Taiwan, by generation, from general knowledge.
GIVEN = "淑芬惠美玲麗華貞秀英琴珠雪玉蘭鳳梅雲霞娟敏慧志明輝雄榮財進成金龍建國文勝義信宏俊傑偉賢德福隆昌 雅婷雯怡君欣宜佳蓉穎鈺郁萱筑詩涵佩珊瑜純潔靜芳家豪瑋宗翰憲冠宇廷彥霖儒賓銘嘉凱哲維倫諺勳 承恩宥辰品睿柏祐翊子晴詠禹彤羽苡芯語妍妤芸瑄甄軒皓丞恆均晨浩宸"
#: How many occurrences the prior of a character's rate weighs, and the prior of listed and of other characters.
PRIOR_WEIGHT, PRIOR_LISTED, PRIOR_OTHER = 20.0, 0.3, 0.02
#: The rate from which a character counts in full as one of given names, and that below which the corpus speaks against it.
FULL_RATE, LOW_RATE = 0.15, 0.01
# Characters with which Formosan names are written.
FORMOSAN = "阿比布丹迪督法菲夫嘎古哈胡伊巴卡可庫拉雷里羅洛馬瑪麥美莫穆那娜奈尼諾努帕皮普撒薩賽沙蘇塔達泰特圖娃瓦汪威烏武希夏雅尤優約魯鲁恩林安"
# Titles before a Latin name, and words that are no part of a person's name.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir"
PLACE_WORDS = frozenset("Bay Port Lower Upper North South East West Street Road Ave Avenue Lane City County Island Hill River Lake Mount New Old Saint St Rd Dist Ln No The A An In On At By Of With And Or But For After Before Despite Why What How When Where Who Have Has Is Was Are Were Do They He She We It This That You I My Our Your His Her Their Ask Dear Contact Please Call Email Meet See Visit Thank Thanks Good Best Kind Happy Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December University College School Hospital Bank Company Inc Ltd Corp Park Museum Hotel Station Airport Center Centre Square Bridge Half".split())

_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.A | re.I)

_EXT = r"(?:\s?(?:#|分機\s?|轉\s?|ext\.?\s?|x)\d{1,6})?"
PHONE = re.compile(
    r"(?<![\dA-Za-z第.])(?<![A-Za-z\d]-)(?:"
    r"(?:\+886[ .-]?\(?0?\)?9\d{2}|09\d{2})[ .-]?\d{3}[ .-]?\d{3}"  # mobile
    rf"|(?:\+886[ .-]?[2-8]\d?|\(0[2-8]\d{{0,2}}\)|0[2-8]\d{{0,2}}[ -])[ .-]?\d{{3,4}}[ -]?\d{{3,4}}{_EXT}"  # land line
    r"|\+(?!886)\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"  # other countries
    r"|\([2-9]\d{2}\) ?[2-9]\d{2}[ .-]\d{4}|[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}"  # North America
    r"|零九[零〇一二三四五六七八九]{8}"
    r")(?![\d零〇一二三四五六七八九]|[.-]\d)"
)
NATIONAL = re.compile(r"(?<![A-Za-z0-9-])[A-Za-z](?:[1289A-Da-d]\d{8}|[1289]\d{2}([ -])\d{3}\1\d{3}|[1289]([ -])\d{4}\2\d{4})(?![A-Za-z0-9]|-\d)", re.A)
SOCIAL = re.compile(r"(?<![\d-])(?!000|666)\d{3}([ -])(?!00)\d{2}\1(?!0000)\d{4}(?![\d-])", re.A)
LUHN_NUMBER = re.compile(r"(?<![\d-])\d{3}([ -])\d{3}\1\d{3}(?![\d-])", re.A)
CARD = re.compile(r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\d-])", re.A)
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)
MOD97_NUMBER = re.compile(r"(?<!\d)[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\d)", re.A)
CARD_WORDS = re.compile(r"卡|card|visa|master", re.I)
ID_WORDS = re.compile(r"證|身分|\bID\b|\bSSN\b|\bSIN\b|NIR|identity|social", re.I)

_HOUSE = rf"{NUM}{{1,6}}(?:[之-]{NUM}{{1,4}})?號(?:之{NUM}{{1,4}})?"
_FLOOR = rf"(?:,? ?(?:地下)?{NUM}{{1,4}}樓(?:之{NUM}{{1,4}})?|,? ?{NUM}{{1,4}}[Ff](?:[之-]{NUM}{{1,4}})?)?(?:{NUM}{{1,5}}室)?"
_ROAD = rf"(?:[{HAN}]{{2}}里)?(?:{NUM}{{1,4}}鄰)?(?:[{HAN}]{{1,4}}?(?:大道|路|街)(?:{NUM}{{1,3}}段)?)(?:{NUM}{{1,4}}巷)?(?:{NUM}{{1,4}}弄)?"
_VILLAGE = rf"[{HAN}]{{2,3}}?[里村]{NUM}{{1,4}}鄰(?:[{HAN}]{{1,4}}?(?:大道|路|街))?"
ADDRESS_CITY = re.compile(rf"(?:\(?\d{{3}}(?:\d{{2,3}})?\)? ?)?[{HAN}]{{2}}[市縣] ?(?:[{HAN}]{{1,3}}?[區鄉鎮市] ?)?(?:{_VILLAGE}|{_ROAD}){_HOUSE}{_FLOOR}")
ADDRESS_ROAD = re.compile(rf"(?:\(?\d{{3}}(?:\d{{2,3}})?\)? ?)?(?:[{HAN}]{{2}}區 ?)?[{HAN}]{{2}}(?:大道|路|街)(?:{NUM}{{1,3}}段)?(?:{NUM}{{1,4}}巷)?(?:{NUM}{{1,4}}弄)?{_HOUSE}{_FLOOR}")
ADDRESS_VILLAGE = re.compile(rf"(?:\(?\d{{3}}(?:\d{{2,3}})?\)? ?)?[{HAN}]{{2}}[里村]{NUM}{{1,4}}鄰{_HOUSE}{_FLOOR}")
ADDRESS_LATIN = re.compile(
    r"(?<![\w.-])\d{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'-]+ ){1,3}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Way|Court|Ct\.?|Place|Square)(?![A-Za-z])"
    r"(?:,? (?:Apt\.?|Suite|Unit|#) ?\w+)?(?:, [A-Z][a-z'-]+(?: [A-Z][a-z'-]+)?)?(?:,? [A-Z]{2} \d{5})?"
)
ADDRESS_NUMBERED = re.compile(
    r"(?<![\w.-])(?:\d{1,3}F\.?, ?)?No\. ?\d{1,5}(?:-\d{1,4})?,(?: ?(?:Ln|Aly)\. ?\d{1,4},)* ?(?:Sec\. ?\d,? )?(?:[A-Z][\w'-]+ ){1,3}(?:Rd|St|Ave|Blvd)\.?"
    r"(?:, ?[A-Z][\w'-]+(?: [A-Z][\w'-]+)? (?:Dist\.|District|Township|City|County))*(?:,? \d{3,6})?"
)

_STRONG_CUES = "申請人|更正[:：]|請洽|洽詢|請找|聯絡人[:：]?|聯繫|作者|證人|被害人|患者|病患|我是|我叫|名叫|叫做|姓名[:：為]?|名單[:：]|看到|找|致電"
_STRONG_ENDS = "[(（]身分證|的證號|的身分證|的電話|的手機|住在|住於|現居|居住|皆稱|[,， ]\\s?電話|[,， ]\\s?手機|先生|小姐|女士|太太|同學|老師"
_CUE_BEFORE = re.compile(rf"(?:{_STRONG_CUES}|本人|[、與和及由]|[，,。!！\n：:「 ]|^|住戶|家屬)\s?$")
_CUE_AFTER = re.compile(rf"\s?(?:{_STRONG_ENDS}|昨天|，昨天|想|，想|在|再|[、與及和，,。!！)）\n「」 ]|$)")
_STRONG_BEFORE = re.compile(rf"(?:{_STRONG_CUES})\s?$")
_STRONG_AFTER = re.compile(rf"\s?(?:{_STRONG_ENDS})")
_SURNAME = rf"(?:{'|'.join(SURNAMES_2.split())}|[{SURNAMES_1}])"
NAME_HAN = re.compile(rf"(?=({_SURNAME})([{HAN}]{{1,2}}))")
# Names that tell about their characters: between a strong cue and a boundary.
NAME_CUED = re.compile(rf"(?:{_STRONG_CUES})\s?{_SURNAME}([{HAN}]{{2}})(?=\s?(?:{_STRONG_ENDS}|[、與和，,。()（）\n]|$))")
NAME_FORMOSAN = re.compile(rf"[{FORMOSAN}]{{2,4}}[‧·・•][{FORMOSAN}]{{2,4}}")
NAME_LATIN = re.compile(r"(?<![A-Za-z'’-])([A-Z][a-zà-ÿ]+) ((?:[A-Z]\. ){0,2})([A-Z][a-zà-ÿ]+(?:-[A-Z][a-zà-ÿ]+)?)(?![A-Za-z-])")
_TITLES = frozenset(TITLES.split("|"))
_LATIN_CUE = re.compile(rf"(?:\b(?:{TITLES})\.? |[Nn]ame is |[Nn]ame: ?|I am |I'm |[Ss]igned,? |by |[Cc]ontact |Dear |Attn:? |[Aa]sk for |[Ss]peak (?:to|with) |[Ss]poke (?:to|with) |[Mm]et |[Ss]incerely, ?|[Rr]egards, ?|[Pp]atient |[Aa]pplicant |[Tt]enant )$")
_LATIN_AFTER = re.compile(r"(?: (?:called|said|says|wrote|writes|lives|lived|signed|phoned|told|asked|replied|emailed|applied|works|worked|was born|can be reached)\b|'s (?:phone|number|email|address|passport|ID)\b|,? \(?(?:phone|tel|email|born|aged?)\b|, (?:phone|tel|email)\b)")
_LIST = ("、", "與", "和", "及")
_HAN_END = re.compile(rf"[{HAN}、：:，,]\s?$")

# Place of a letter in the weights of the national identity number.
_LETTERS = "ABCDEFGHJKLMNPQRSTUVXYWZIO"


def national_id_valid(number: str) -> bool:
    """The weighted checksum modulo 10 of Taiwan's identity and residence numbers."""
    s = re.sub(r"[ -]", "", number).upper()
    if len(s) != 10 or s[0] not in _LETTERS:
        return False
    first = _LETTERS.index(s[0]) + 10
    second = int(s[1]) if s[1].isdigit() else (_LETTERS.index(s[1]) + 10) % 10
    digits = [first // 10, first % 10, second, *map(int, s[2:])]
    return sum(d * w for d, w in zip(digits, (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1))) % 10 == 0


def luhn_valid(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return len(digits) > 1 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def mod97_valid(number: str) -> bool:
    """A number whose last two digits complete the rest to a multiple of 97."""
    digits = "".join(c for c in number if c.isdigit())
    return len(digits) > 2 and (int(digits[:-2]) + int(digits[-2:])) % 97 == 0


def account_valid(number: str) -> bool:
    """An international account number: its digits, country and check digits last, leave 1 modulo 97."""
    s = number.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _near(s: str, a: int, b: int, words: re.Pattern, reach: int = 24) -> bool:
    return words.search(s, max(0, a - reach), min(len(s), b + reach)) is not None


def _numbers(s: str, add: Callable) -> None:
    for m in NATIONAL.finditer(s):
        if national_id_valid(m[0]):
            add("id_number", m.start(), m.end(), 0.9)
        elif _near(s, m.start(), m.end(), ID_WORDS, 12):
            add("id_number", m.start(), m.end(), 0.55)
    if "-" in s or " " in s:
        for m in SOCIAL.finditer(s):
            add("id_number", m.start(), m.end(), 0.3 + 0.4 * _near(s, m.start(), m.end(), ID_WORDS))
    # A checksum decides: without it context is not enough. One in ten numbers passes Luhn, so that it needs a context
    # word beside it, or sixteen digits in groups; one in 97 passes the other, so that it stands for itself.
    for m in LUHN_NUMBER.finditer(s):
        add("id_number", m.start(), m.end(), 0.1 + 0.35 * luhn_valid(m[0]) + 0.3 * _near(s, m.start(), m.end(), ID_WORDS))
    for m in MOD97_NUMBER.finditer(s):
        add("id_number", m.start(), m.end(), 0.1 + 0.45 * mod97_valid(m[0]) + 0.3 * _near(s, m.start(), m.end(), ID_WORDS))
    for m in CARD.finditer(s):
        add("id_number", m.start(), m.end(), 0.1 + luhn_valid(m[0]) * (0.3 + 0.3 * bool(m[1]) + 0.4 * _near(s, m.start(), m.end(), CARD_WORDS)))
    for m in ACCOUNT.finditer(s):
        add("id_number", m.start(), m.end(), 0.1 + 0.8 * account_valid(m[0]))
    for m in PHONE.finditer(s):
        digits = sum(c.isdigit() or c in "零〇一二三四五六七八九" for c in m[0].split("#")[0])
        if digits < 8 or digits > 15 + 6:
            continue
        after = s[m.end() : m.end() + 1]
        add("phone", m.start(), m.end(), 0.7 - 0.5 * (after in ("號", "元")))


def _addresses(s: str, add: Callable) -> None:
    if "號" in s:
        for pattern, score in ((ADDRESS_CITY, 0.9), (ADDRESS_ROAD, 0.8), (ADDRESS_VILLAGE, 0.75)):
            for m in pattern.finditer(s):
                a = m.start()
                while a < m.end() and s[a] in " )":
                    a += 1
                if s[a].isdigit() and s[a - 1 : a] == "(" and ")" in s[a : a + 7]:
                    a -= 1
                add("address", a, m.end(), score)
    for pattern in (ADDRESS_LATIN, ADDRESS_NUMBERED):
        for m in pattern.finditer(s):
            add("address", m.start(), m.end(), 0.8)


class Rates:
    """The rate of each character as one of given names: ``counts`` of a corpus (character: cued, all) over the prior."""

    __slots__ = ("known",)

    def __init__(self, counts: dict[str, tuple[int, int]] | None = None):
        known = dict.fromkeys(GIVEN.replace(" ", ""), PRIOR_LISTED)
        for c, (cued, uses) in (counts or {}).items():
            known[c] = (cued + PRIOR_WEIGHT * known.get(c, PRIOR_OTHER)) / (uses + PRIOR_WEIGHT)
        self.known = known

    def full(self, given: str) -> float:
        """How far the characters are those of given names, from 0 to 1; -0.5 if the corpus speaks against one."""
        rate = min(self.known.get(c, PRIOR_OTHER) for c in given)
        return min(1.0, rate / FULL_RATE) if rate >= LOW_RATE else -0.5


_SURNAME_POINTS = np.zeros(0x10000, bool)
_SURNAME_POINTS[[ord(c) for c in SURNAMES_1 + SURNAMES_2 if c != " "]] = True


def behind_surnames(folded: str) -> np.ndarray:
    """The code points of the first plane that stand one or two places behind a surname."""
    points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 0x10000, points, 0)
    surname = _SURNAME_POINTS[points]
    at = np.zeros(len(points), bool)
    at[1:] |= surname[:-1]
    at[2:] |= surname[:-2]
    return points[at]


def cued_characters(folded: str) -> list[str]:
    """The characters of given names that stand between cue words."""
    return [c for m in NAME_CUED.finditer(folded) for c in m[1]]


def _names(s: str, add: Callable, rates: Rates) -> None:
    weak, certain = [], []
    for m in NAME_HAN.finditer(s):
        a, given = m.start(), m[2]
        before = s[max(0, a - 6) : a]
        strong, weakly = bool(_STRONG_BEFORE.search(before)), bool(_CUE_BEFORE.search(before))
        for size in range(1, len(given) + 1):
            b = m.end(1) + size
            after = s[b : b + 6]
            full = rates.full(given[:size])
            if full <= 0 and not strong and not _STRONG_AFTER.match(after):
                continue
            score = 0.1 + (0.3 if size == 2 else 0.15) * full + 0.25 * (strong + bool(_STRONG_AFTER.match(after))) + 0.1 * weakly + 0.1 * bool(_CUE_AFTER.match(after))
            if score >= 0.5:
                certain.append((a, b))
            elif full >= 0.5:
                weak.append((a, b))
            add("name", a, b, score)
    if "‧" in s or "·" in s or "・" in s or "•" in s:
        for m in NAME_FORMOSAN.finditer(s):
            certain.append(m.span())
            add("name", m.start(), m.end(), 0.8)
    at = 0
    while m := NAME_LATIN.search(s, at):
        first, middle, last = m.groups()
        if first in PLACE_WORDS or first in _TITLES:
            at = m.end(1)  # the name may begin with the next word
            continue
        at = m.end()
        if last in PLACE_WORDS:
            continue
        before = s[max(0, m.start() - 14) : m.start()]
        score = 0.2 + 0.35 * bool(middle) + 0.5 * bool(_LATIN_CUE.search(before)) + 0.35 * bool(_HAN_END.search(before)) + 0.35 * bool(_LATIN_AFTER.match(s, m.end()))
        if score >= 0.5:
            certain.append(m.span())
        add("name", m.start(), m.end(), score)
    if weak and certain:  # names stand in lists beside names
        starts, ends = {a for a, _ in certain}, {b for _, b in certain}
        changed = True
        while changed:
            changed = False
            for a, b in list(weak):
                if (s[b : b + 1] in _LIST and b + 1 in starts) or (s[a - 1 : a] in _LIST and a - 1 in ends):
                    add("name", a, b, 0.6)
                    weak.remove((a, b))
                    starts.add(a)
                    ends.add(b)
                    changed = True


def find_personal(stored: str, min_score: float = MIN_SCORE, rates: Rates = Rates()) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points of the stored text, in order, without overlaps."""
    folded = Aligned(stored)
    s = folded.text
    found: list[tuple[float, int, int, str]] = []

    def add(kind: str, a: int, b: int, score: float) -> None:
        if score >= min_score:
            found.append((score, a, b, kind))

    if "@" in s or "at" in s or "AT" in s:
        for m in EMAIL.finditer(s):
            add("email", m.start(), m.end(), 0.95)
    _numbers(s, add)
    _addresses(s, add)
    _names(s, add, rates)
    if not found:
        return []
    found.sort(key=lambda x: (-x[0], x[1] - x[2], x[1]))
    kept: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for _, a, b, kind in found:
        i = bisect.bisect_left(starts, a)
        if (i < len(kept) and kept[i][0] < b) or (i and kept[i - 1][1] > a):
            continue
        starts.insert(i, a)
        kept.insert(i, (a, b, kind))
    return [(kind, folded.at(a), folded.end(b)) for a, b, kind in kept]


def redact(stored: str, min_score: float = MIN_SCORE, rates: Rates = Rates()) -> str:
    """The text with each span replaced by its kind in angle brackets, otherwise unchanged."""
    out, last = [], 0
    for kind, a, b in find_personal(stored, min_score, rates):
        out += [stored[last:a], f"<{kind}>"]
        last = b
    return "".join([*out, stored[last:]])


def name_rates(df: DataFrame, text: str) -> Rates:
    """The rates of all characters over all texts. Counted a batch at a time, then by hash aggregate with map-side
    combine; what the driver gets is one row for each Han character at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses, cued = np.zeros(0x10000, np.int64), np.zeros(0x10000, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                s = Aligned(t).text
                if s.isascii():
                    continue
                np.add.at(uses, behind_surnames(s), 1)
                for c in cued_characters(s):
                    cued[ord(c)] += ord(c) < 0x10000
        some = np.flatnonzero(uses[0x3400:0xA000]) + 0x3400
        yield pd.DataFrame({"c": some, "cued": cued[some], "uses": uses[some]})

    source = df.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    counts = source.mapInPandas(run, "c int, cued bigint, uses bigint").groupBy("c").agg(F.sum("cued").alias("cued"), F.sum("uses").alias("uses"))
    return Rates({chr(r["c"]): (r["cued"], r["uses"]) for r in counts.where("c < 40960").collect()})  # Han characters of the first plane


def personal_spans(df: DataFrame, key: str, text: str, min_score: float = MIN_SCORE, rates: Rates | None = None) -> DataFrame:
    """Rows (key, kind, char_start, char_end); offsets in code points of the stored text, end exclusive.

    ``rates`` are by default those of all texts of ``df``. Row by row, without a shuffle, over whole texts of any length. Null and empty texts give no rows, repeated
    rows give theirs again, spans of equal score and length that overlap: the first; other columns play no part.
    """
    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rates = name_rates(df, text) if rates is None else rates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [find_personal(t, min_score, rates) for t in pdf["text"]]
            flat = [x for s in spans for x in s]
            sizes = np.fromiter((len(x) for x in spans), np.int64, len(spans))
            yield pd.DataFrame(
                {"key": pdf["key"].repeat(sizes).reset_index(drop=True), "kind": [x[0] for x in flat], "char_start": np.fromiter((x[1] for x in flat), np.int64, len(flat)), "char_end": np.fromiter((x[2] for x in flat), np.int64, len(flat))}
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return source.mapInPandas(run, f"key {kind}, kind string, char_start bigint, char_end bigint")


def redacted(column, min_score: float = MIN_SCORE, rates: Rates = Rates()):
    """``redact`` as a column; null stays null."""

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else redact(x, min_score, rates) for x in s], index=s.index, dtype=object)

    return run(column)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "reviewed"), "row_id", "text").withColumnRenamed("key", "row_id")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = table(spark, sf_dir, "reviewed")
    return reviewed.select("row_id", redacted(F.col("text"), rates=name_rates(reviewed, "text")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_redacted": p3_redacted}
ORACLES: dict[str, str] = {}
