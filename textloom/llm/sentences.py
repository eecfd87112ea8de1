"""Problem 2: sentence units of documents in any language and script.

Document-centred disambiguation: whether ``word.`` before a capital ends a sentence is decided from unambiguous
occurrences of the word and of its neighbour in the same document (followed by a lower-case letter or comma: an
abbreviation; capitalised after a lower-case word: a proper name), then from the same evidence over the whole
corpus, then from a short list of fixed abbreviations. Terminators are those of each script; a line break always
ends a unit; quoted speech is never cut and stays with the words that introduce or follow it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.aligned import _ALIGNED, Aligned
from textloom.session import cut_lineage, table

# Abbreviations that stand before the word they belong to, so that they never end a sentence.
PREPOSITIVE = frozenset(
    Aligned(w).text
    for w in "mr mrs ms dr st prof rev gen col capt lt sgt hon sr sra srta fr hr nr no nos vol vols fig figs vs ver art sec ch pp e.g i.e cf approx ca z b bzw usw d.h z.b mme mlle m dra dña av avda pág núm ул пл пер им стр рис проф акад κ κα κος δρ".split()
)
# Abbreviations that may also end a sentence.
ABBREVIATIONS = frozenset("a.m p.m etc jr inc ltd co corp ave blvd rd u.s u.k u.n ph.d b.c a.d est dept al op ed eds jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Month names that follow an ordinal number with a period.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner leden únor enero".split())
# Thai particles that end a statement.
THAI_END = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า", "นะ", "ฮะ", "ครับผม")

OPEN = {"「": "」", "『": "』", "“": "”", "《": "》", "〈": "〉", "（": "）", "(": ")", "【": "】", "«": "»", "„": "“", '"': '"'}
QUOTES = "「『“«„\""
CLOSERS = "」』”》〉）)】]»\"'’"
TERMINATORS = "。｡！？!?؟۔।॥‽⁇⁈⁉։።。།၊။។"
_NO_PERIOD_SCRIPT = re.compile("[ऀ-෿ก-๿]")  # a period there only shortens a word
_GREEK = re.compile("[ά-ώβγδεζηθλμξπστφχψω]")
_CANDIDATE = re.compile(rf"[{TERMINATORS}.．…]+|;|[{re.escape(''.join({*OPEN, *OPEN.values()}))}]|(?<=[ก-๿])[ 　]+")
_BREAK = re.compile("[\n\r\v\f\x1c-\x1e\x85  ]+")
_WORD_BEFORE = re.compile(r"[^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_]))*$")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
def _class(kind: Callable[[str], bool]) -> str:
    """The characters of the first plane of a kind, as the inside of a character class."""
    runs: list[list[int]] = []
    for c in filter(lambda c: kind(chr(c)), range(0x10000)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(re.escape(chr(x)) + "-" + re.escape(chr(y)) for x, y in runs)


_DOTTED_USE = re.compile(r"(?<![^\W_.])(?<![\u0300-\u036f])((?:[^\W\d_]\.?){1,12})\.(?=([,;:)]| ?[^\W\d_]| \d|\s*\Z|[ \t]*[\n\r]))")
# Words of the scripts with capitals; not inside names, addresses or shortened forms.
_CASED_USE = re.compile(rf"(?<![\w@./'’-])[{_class(lambda c: c.lower() != c.upper())}]+(?![\w@/-])(?!\.\w)")
_ASKED = re.compile(rf"[.．][{re.escape(CLOSERS)} \t　]*(?=[^\W_])")
_PERIODS = _class(lambda c: any(x in _ALIGNED[ord(c)] for x in ".．"))
_SPACES = " \t　"
_LATIN_LEAD = re.compile(r"[A-Za-zÀ-ɏ0-9_.@+()\[\]-]+(?: [A-Za-zÀ-ɏ0-9_.@+()\[\]-]+){0,7} ?")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿가-힣]")


class Corpus:
    """Words with unambiguous occurrences in a document or in the whole corpus: ``abbreviations`` and ordinary ``words``
    in lower case (a word in both is ambiguous), ``proper`` names as written, ``common`` words in lower case."""

    __slots__ = ("abbreviations", "proper", "words", "common")

    def __init__(self, abbreviations=frozenset(), proper=frozenset(), words=frozenset(), common=frozenset()):
        self.abbreviations, self.proper, self.words, self.common = abbreviations, proper, words, common


# What is counted of a word: with a period before a lower-case letter or comma; before a digit; before these or a capital;
# before anything else or nothing; capitalised after a lower-case word; in lower case; in lower case without a period; in any
# case without a period.
COUNTS = ("inside", "number", "dotted", "other", "up", "low", "plain", "bare")


def add_uses(text: str, uses: dict[str, list[int]]) -> None:
    """Adds the ``COUNTS`` of the words of a folded text to ``uses``."""
    if "." in text:
        for m in _DOTTED_USE.finditer(text):
            c, n = m[2][-1:].strip(), uses.setdefault(m[1].lower(), [0] * len(COUNTS))
            n[0] += c.islower() or c != "" and c in ",;:)"
            n[1] += c.isdigit()
            tells = c != "" and (not c.isalpha() or c.islower() or c.isupper())
            n[2] += tells
            n[3] += not tells
    for m in _CASED_USE.finditer(text):
        w, a = m[0], m.start()
        n = uses.setdefault(w.lower(), [0] * len(COUNTS))
        bare = text[m.end() : m.end() + 1] != "."
        n[7] += bare
        if w.islower():
            n[5] += 1
            n[6] += bare
        elif w[0].isupper() and len(w) > 1 and a > 1 and text[a - 1] == " " and text[a - 3 if text[a - 2] == "," and a > 2 else a - 2].islower():
            n[4] += 1


def asked(text: str) -> set[str]:
    """The words, in lower case, that decide about the periods of a folded text: those before and behind them."""
    out = set()
    for m in _ASKED.finditer(text):
        before, behind = _WORD_BEFORE.search(text, max(0, m.start() - 40), m.start()), _NEXT_WORD.match(text, m.end())
        if before:
            out.add(before[0].lower())
            if behind:
                out.add(behind[0].lower())
    return out


# Evidence as bits: abbreviation, ordinary word, proper name, common word. One use is enough in a document; a digit may
# open a sentence, so that it tells only of words that never stand with a period elsewhere.
IN_DOCUMENT = "IF(inside > 0 OR number > 0 AND number = dotted AND other = 0, 1, 0) + IF(plain > 0, 2, 0) + IF(up > 0 AND low = 0, 4, 0) + IF(low > 0, 8, 0)"


def _from_bits(bits: dict[str, int]) -> Corpus:
    kind = lambda b: frozenset(w for w, x in bits.items() if x & b)
    return Corpus(kind(1), kind(4), kind(2), kind(8))


def _own_evidence(text: str) -> Corpus:
    """The evidence of a folded text that is a document of its own."""
    uses: dict[str, list[int]] = {}
    add_uses(text, uses)
    return _from_bits({w: (i > 0 or 0 < number == dotted and not other) + 2 * (plain > 0) + 4 * (up > 0 and not low) + 8 * (low > 0) for w, (i, number, dotted, other, up, low, plain, _) in uses.items()})


def _abbreviation(word: str, doc: Corpus, corpus: Corpus) -> bool | None:
    """Whether a word is an abbreviation or an ordinary word; None if neither document nor corpus says."""
    for scope in (doc, corpus):
        if (word in scope.abbreviations) != (word in scope.words):
            return word in scope.abbreviations
    return None


def _name(word: str, doc: Corpus, corpus: Corpus) -> bool | None:
    """Whether a capitalised word is a proper name or a common word; None if neither document nor corpus says."""
    for scope in (doc, corpus):
        if word.lower() in scope.common:
            return False
        if word in scope.proper or word.lower() in scope.proper:
            return True
    return None


def _period_ends(s: str, unit: int, at: int, after: int, b: int, doc: Corpus, corpus: Corpus) -> bool:
    """Whether the single period at ``at`` ends a unit; ``after`` is the offset behind it and any closers."""
    if after >= b:
        return True
    nxt = s[after]
    space = nxt in _SPACES
    k = after
    while k < b and s[k] in _SPACES:
        k += 1
    if k >= b:
        return True
    c = s[k]
    before = s[at - 1] if at > unit else ""
    if not space:
        if nxt in ",;:，；：、)" or nxt.isdigit() or "a" <= nxt.lower() <= "z" or nxt in "/-_@%":
            return False  # inside a number, a name or an abbreviation
    if _NO_PERIOD_SCRIPT.match(before or " "):
        return False
    if c in ",;:，；：、)":
        return False
    m = _WORD_BEFORE.search(s, max(unit, at - 40), at)
    word = m[0].lower() if m else ""
    if c.islower():
        return word not in PREPOSITIVE and _switches(s, k, b)
    if before.isdigit():
        if s[unit:at].strip().isdigit():
            return False  # a list number
        word = _NEXT_WORD.match(s, k)
        return not (word and word[0].lower() in MONTHS)
    if not word:
        return True
    if len(word) == 1 and m[0].isupper() and c.isupper() and at - 2 >= unit and s[at - 2] in _SPACES:
        return False  # an initial
    title = word in PREPOSITIVE
    capital = m[0][0].isupper()
    opens = not any(x.isalnum() for x in s[unit : m.start()])
    if title and (c.isdigit() or capital and not opens or word not in doc.words and word not in corpus.words):
        return False  # no ordinary use of the word is known, or it is not written as one
    short = _abbreviation(word, doc, corpus)
    if short is False and not (title and capital):
        return True
    if short is None and not title and word not in ABBREVIATIONS:
        return True
    if c.isdigit():
        return False
    following = _NEXT_WORD.match(s, k)
    if following and following[0][0].isupper():
        if following[0].lower() in PREPOSITIVE:
            return True  # a title opens a sentence
        name = _name(following[0], doc, corpus)
        if name is not None:
            return not name  # a common word with a capital opens a sentence
        return word in ABBREVIATIONS
    return word in ABBREVIATIONS or not following


def _switches(s: str, k: int, b: int) -> bool:
    """Whether lower-case words at ``k`` open a statement in a script without capitals."""
    m = _LATIN_LEAD.match(s, k, b)
    return m is not None and m.end() < b and _CJK.match(s, m.end()) is not None


def _line_ends(s: str, a: int, b: int, doc: Corpus, corpus: Corpus, out: list[int]) -> None:
    """Appends the ends of the units of the line ``s[a:b]``."""
    while b > a and s[b - 1].isspace():
        b -= 1
    while a < b and s[a].isspace():
        a += 1
    if a == b:
        return
    unit, spoken, stack, last = a, False, [], {}
    skip = a
    for m in _CANDIDATE.finditer(s, a, b):
        i, j = m.span()
        if j <= skip:
            continue
        c = s[i]
        if stack and c == stack[-1][0]:
            _, opened, quote = stack.pop()
            if stack or not quote:
                continue
            inner = s[j - 2] if j - 2 > opened else ""
            if inner not in TERMINATORS and inner not in ".…" or not inner:
                spoken = True
                continue
            while j < b and s[j] in CLOSERS:
                j += 1
            k = j
            while k < b and s[k] in _SPACES:
                k += 1
            introduced = _introduced(s, unit, opened, spoken)
            spoken = True
            if k >= b:
                continue
            n = s[k]
            if n in ",;:，；：、。.！？!?…～" or (c in '"”' and n.islower() and not _switches(s, k, b)):
                continue
            if introduced or (c in '"”' and (n.isupper() or _CJK.match(n))):
                out.append(j)
                unit, spoken, skip = k, False, j
        elif c in OPEN:
            closer = OPEN[c]
            if closer not in last:
                last[closer] = s.rfind(closer, a, b)
            if last[closer] > i:
                stack.append((closer, i, c in QUOTES))
        elif c == ";":
            k = j
            while k < b and s[k] in _SPACES:
                k += 1
            if not stack and k > j and k < b and s[k].isupper() and 4 * len(_GREEK.findall(s, unit, i)) > i - unit:
                out.append(j)  # the question mark of Greek
                unit, spoken, skip = k, False, j
        elif c in _SPACES:
            if not stack and s.endswith(THAI_END, unit, i):
                out.append(i)
                unit, spoken, skip = j, False, j
        elif c in CLOSERS or stack:
            continue
        else:
            while j < b and s[j] in CLOSERS and (s[j] != '"' or s.find('"', j + 1, b) < 0):  # a last, unpaired one closes
                j += 1
            run = m[0]
            if run == "." or run == "．":
                if not _period_ends(s, unit, i, j, b, doc, corpus):
                    continue
            else:
                k = j
                while k < b and s[k] in _SPACES:
                    k += 1
                n = s[k] if k < b else ""
                if n and n in ",;:，；：、":
                    continue
                if n.islower() and all(x in "!?.…．" for x in run) and not _switches(s, k, b):
                    continue
                if n and all(x in ".…．" for x in run) and not n.isupper():
                    continue  # an ellipsis inside a statement
            k = j
            while k < b and s[k] in _SPACES:
                k += 1
            if k < b:
                out.append(j)
                unit, spoken, skip = k, False, j
    out.append(b)


def _introduced(s: str, unit: int, opened: int, spoken: bool) -> bool:
    """Whether words before a quotation announce it: a colon, or a comma after an earlier part of the speech."""
    k = opened - 1
    while k >= unit and s[k] in _SPACES:
        k -= 1
    return k >= unit and (s[k] in ":：" or spoken)


def sentence_ends(stored: str, corpus: Corpus = Corpus(), doc: Corpus | None = None) -> list[int]:
    """Offsets (code points) behind the last character of each unit of a text; empty and blank texts have none.
    ``doc`` is the evidence of the document the text belongs to; without it, the text is the document."""
    folded = Aligned(stored)
    s = folded.text
    doc, out, a = _own_evidence(s) if doc is None else doc, [], 0
    for m in _BREAK.finditer(s):
        _line_ends(s, a, m.start(), doc, corpus, out)
        a = m.end()
    _line_ends(s, a, len(s), doc, corpus, out)
    return [folded.end(e) for e in out]


def corpus_evidence(uses: DataFrame, min_count: int = 5, min_share: float = 0.1) -> DataFrame:
    """The corpus fallback (word, bits) from the uses of all documents, counted over all texts: words of up to six
    letters that stand with a period before a lower-case letter, comma or digit in at least ``min_share`` of their dotted
    occurrences, or, of up to three, hardly ever (``min_share``) stand without one, words at least as often without a period as with one, words capitalised inside sentences and never
    in lower case, and words more often in lower case than capitalised there; ``min_count`` such uses at least."""
    n = uses.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))
    inside = f"inside + number >= {min_count} AND inside + number >= {min_share} * dotted"
    always = f"dotted + other >= {min_count} AND bare <= {min_share} * (dotted + other) AND length(word) <= 3 AND lower(word) <> upper(word)"
    short = f"({inside} OR {always}) AND length(replace(word, '.', '')) <= 6"
    word = f"plain >= {min_count} AND plain >= dotted + other"
    return n.select("word", F.expr(f"IF({short}, 1, 0) + IF({word}, 2, 0) + IF(up >= {min_count} AND low = 0, 4, 0) + IF(low >= {min_count} AND low > up, 8, 0)").alias("c")).where("c > 0")


def document_uses(rows: DataFrame) -> DataFrame:
    """(scope, word, ``COUNTS``) of rows (scope, text): counted a batch at a time, then by hash aggregate with map-side
    combine, so that a large document is no group in any one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scopes: dict[str, dict[str, list[int]]] = {}
            for scope, t in zip(pdf["scope"], pdf["text"]):
                add_uses(Aligned(t).text, scopes.setdefault(scope, {}))
            out = [(scope, w, *n) for scope, uses in scopes.items() for w, n in uses.items()]
            yield pd.DataFrame(out, columns=["scope", "word", *COUNTS])

    uses = rows.select("scope", "text").mapInPandas(run, "scope string, word string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return uses.groupBy("scope", "word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _questions(rows: DataFrame) -> DataFrame:
    """(scope, digest, word) of the words that rows (scope, digest, text) ask for, once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {(scope, digest, w) for scope, digest, t in zip(pdf["scope"], pdf["digest"], pdf["text"]) for w in asked(Aligned(t).text)}
            yield pd.DataFrame(list(out), columns=["scope", "digest", "word"])

    return rows.select("scope", "digest", "text").mapInPandas(run, "scope string, digest binary, word string").distinct()


def sentence_units(df: DataFrame, key: str, text: str, corpus: Corpus | None = None, document: str | None = None) -> DataFrame:
    """Rows (key, sent_no, sent_end): the units of each text in order, ends in code points, exclusive.

    Rows of one ``document`` share their evidence; without it, or where it is null, each text is its own document. The
    fallback is ``corpus``, or by default what all rows say together.
    Evidence is joined to the words that a text asks for, and only texts with a period before other characters are
    shuffled to their answers; all others are split in the row's own task. Null, empty and blank texts give no rows;
    repeated rows give their units again; other columns play no part.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (F.col(document).cast("string") if document else F.lit(None).cast("string")).alias("d")).where("text IS NOT NULL")
    digest = F.unhex(F.md5("text"))
    rows = rows.select("key", "text", F.coalesce(F.concat(F.lit("d"), "d"), F.concat(F.lit("t"), F.md5("text"))).alias("scope"), F.col("text").rlike(f"(?s)[{_PERIODS}].").alias("asks"))
    asking = rows.where("asks").withColumn("digest", digest)
    uses = cut_lineage(document_uses(rows))
    answers = _questions(asking).join(uses.select("scope", "word", F.expr(IN_DOCUMENT).alias("d")), ["scope", "word"], "left")
    answers = answers.join(cut_lineage(corpus_evidence(uses)), "word", "left") if corpus is None else answers.withColumn("c", F.lit(0))
    answers = answers.select("scope", "digest", F.concat_ws(" ", "word", F.coalesce("d", F.lit(0)), F.coalesce("c", F.lit(0))).alias("a"))
    answers = answers.groupBy("scope", "digest").agg(F.array_join(F.collect_list("a"), "\n").alias("a"))
    asking = asking.join(answers, ["scope", "digest"], "left").select("key", "text", "a")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = []
            for t, a in zip(pdf["text"], pdf["a"]):
                bits = [x.split(" ") for x in a.split("\n")] if a else []
                doc = _from_bits({w: int(d) for w, d, _ in bits})
                ends.append(sentence_ends(t, corpus or _from_bits({w: int(c) for w, _, c in bits}), doc))
            sizes = np.fromiter((len(e) for e in ends), np.int64, len(ends))
            total = int(sizes.sum())
            number = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pd.DataFrame({"key": pdf["key"].repeat(sizes).reset_index(drop=True), "sent_no": number, "sent_end": np.fromiter((x for e in ends for x in e), np.int64, total)})

    return rows.where("NOT asks").select("key", "text", F.lit(None).cast("string").alias("a")).unionByName(asking).mapInPandas(run, f"key {kind}, sent_no bigint, sent_end bigint")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = sentence_units(table(spark, sf_dir, "reviewed"), "row_id", "text", document="document_id")
    return units.select(F.col("key").alias("row_id"), "sent_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
