"""Structure of documents: sentences, clauses, blocks, ranking and extractive summaries.

The automata over lines and brackets are sequential within a document, so they run in Arrow batches; everything before
and after (signals, ranks, joins) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spec

_LEAD = re.compile("^[0-9.)）、]*")
_ACRONYM = re.compile(r"^[A-Z0-9&\-./]{1,12}$")
_FIRST_THEN = re.compile("先(?![生進前祖])")


def depends(candidate: str) -> bool:
    """Whether the words before a comma cannot stand alone."""
    c = _LEAD.sub("", candidate.strip().rstrip("，,")).strip()
    if any(m in c for m in spec.DEPENDENT_ANYWHERE) or c.startswith(spec.DEPENDENT_PREFIX):
        return True
    if any(m in c for m in spec.CONDITION) and c.endswith(spec.CONDITION_UNITS):
        return True
    for a, b in ("（）", "()"):
        i = c.rfind(a)
        j = c.find(b, i + 1)
        if i >= 0 and j > i and _ACRONYM.match(c[i + 1 : j]) and sum(x.isupper() for x in c[i + 1 : j]) >= 2:
            return True
    return any(m in c for m in spec.DEFINITION) or _FIRST_THEN.search(c) is not None


def depends_sql(column: str) -> Column:
    """The same test as an expression."""
    c = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.col(column)), "[，,]+$", "")), "^[0-9.)）、]*", "")
    return (
        c.rlike("|".join(spec.DEPENDENT_ANYWHERE))
        | c.rlike(f"^(?:{'|'.join(spec.DEPENDENT_PREFIX)})")
        | (c.rlike("|".join(spec.CONDITION)) & c.rlike(f"(?:{'|'.join(spec.CONDITION_UNITS)})\\z"))
        | c.rlike("|".join(spec.DEFINITION))
        | c.rlike("先(?![生進前祖])")
        | c.rlike(r"（(?=[^）]*[A-Z][^）]*[A-Z])[A-Z0-9&./-]{1,12}）[^（]*\z")
        | c.rlike(r"\((?=[^)]*[A-Z][^)]*[A-Z])[A-Z0-9&./-]{1,12}\)[^(]*\z")
    )


def split_sentences(text: str, semicolon: bool = False, period: bool = False) -> list[tuple[int, int]]:
    """Spans of sentences: terminals and the closers behind them; a line break ends one unless its comma depends."""
    ends = spec.TERMINALS + ("；;" if semicolon else "")
    out, start, i, n = [], 0, 0, len(text)

    def push(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    while i < n:
        c = text[i]
        if c in "\r\n":
            candidate = text[start:i].rstrip()
            if not (candidate.endswith(("，", ",")) and depends(candidate)):
                push(start, i)
                start = i + 1
            i += 1
        elif c in ends or (period and c == "." and not (i + 1 < n and text[i + 1].isdigit() and i and text[i - 1].isdigit())):
            i += 1
            while i < n and (text[i] in ends or text[i] in spec.CLOSERS):
                i += 1
            push(start, i)
            start = i
        else:
            i += 1
    push(start, n)
    return out


_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "{": "}", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "‘": "’"}


def split_clauses(text: str, comma: bool = True, semicolon: bool = True, colon: bool = True) -> list[tuple[int, int, int]]:
    """(sentence, start, end): sentences cut at commas, semicolons and colons outside brackets, quotes, code and bold."""
    marks = ("，,、" if comma else "") + ("；;" if semicolon else "") + ("：:" if colon else "")
    out = []
    for k, (a, b) in enumerate(split_sentences(text)):
        stack, quote, code, bold, start, i = [], False, False, False, a, a
        while i < b:
            c = text[i]
            if c == "`":
                code = not code
            elif text.startswith("**", i):
                bold = not bold
                i += 1
            elif c == '"':
                quote = not quote
            elif c in _PAIRS:
                stack.append(_PAIRS[c])
            elif stack and c == stack[-1]:
                stack.pop()
            elif c in marks and not (stack or quote or code or bold):
                digits = c == "," and i > a and i + 1 < b and text[i - 1].isdigit() and text[i + 1].isdigit()
                if not digits and not (c in "，," and depends(text[start : i + 1])):
                    out.append((k, start, i + 1))
                    start = i + 1
            i += 1
        if start < b:
            out.append((k, start, b))
    return out


# ---------------------------------------------------------------- blocks
_ATX, _SETEXT, _TABLE, _BREAK = re.compile(r" {0,3}#{1,6}(?:\s|$)"), re.compile(r" {0,3}(?:={3,}|-{3,})\s*$"), re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$"), re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_LIST, _FENCE, _HTML = re.compile(rf"(\s*)(?:([{re.escape(spec.BULLETS)}]) |([0-9一二三四五六七八九十]+)(?:\. |\) |） |、))"), re.compile(r" {0,3}(`{3,}|~{3,})"), re.compile(rf"\s*(?:<!--|<!DOCTYPE|<\?|</?(?:{spec.HTML_TAGS})(?:\s|>|/))")


def list_parents(blocks: list[tuple[str, int, int, int]]) -> list[int]:
    """For each block the list item it is a child of, or -1: the nearest earlier item of less depth, if no other item under
    that one is of less depth than the child."""
    out, open_, least = [-1] * len(blocks), [], {}
    for i, (kind, _, _, depth) in enumerate(blocks):
        if kind.endswith("list-item"):
            while open_ and blocks[open_[-1]][3] >= depth:
                open_.pop()
            if open_:
                out[i] = open_[-1]
                least[open_[-1]] = min(depth, least.get(open_[-1], depth))
            open_.append(i)
    return [p if p >= 0 and blocks[i][3] == least[p] else -1 for i, p in enumerate(out)]


def embedded_code(text: str) -> bool:
    """Whether a list item holds code or HTML on its lines."""
    lines = text.splitlines()
    return any(_FENCE.match(x) for x in lines) or any(x.startswith(("    ", "\t")) or _HTML.match(x) for x in lines[1:])


def block_rows(text: str) -> list[tuple[str, int, int, int, int, str, bool]]:
    """(kind, start, end, depth, parent, gap, embedded) of the blocks: with the list item above, the white space before, and
    whether it is a list item with code. Ends are before the last line break."""
    blocks = [(k, a, a + len(text[a:b].rstrip("\r\n")), d) for k, a, b, d in parse_blocks(text)]
    ends = [0, *(b for _, _, b, _ in blocks)]
    return [(k, a, b, d, p, text[e:a], k.endswith("list-item") and embedded_code(text[a:b])) for (k, a, b, d), p, e in zip(blocks, list_parents(blocks), ends)]


def parse_blocks(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) of the blocks, by an ordered machine over lines."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line.rstrip("\r\n")))
        at += len(line)
    out, i, n = [], 0, len(lines)
    blank = lambda k: not lines[k][2].strip()

    def starts(k: int) -> bool:
        s = lines[k][2]
        return bool(_FENCE.match(s) or _ATX.match(s) or _BREAK.match(s) or _LIST.match(s) or s.lstrip().startswith(">") or _HTML.match(s))

    while i < n:
        a, _, s = lines[i]
        j, depth = i + 1, 0
        following = lines[i + 1][2] if i + 1 < n else ""
        if blank(i):
            i += 1
            continue
        if m := _FENCE.match(s):
            kind = "fenced-code"
            while j < n and not (lines[j][2].strip().startswith(m[1]) and not lines[j][2].strip().strip(m[1][0])):
                j += 1
            j = min(n, j + 1)
        elif s.startswith(("    ", "\t")):
            kind = "indented-code"
            while j < n and (blank(j) or lines[j][2].startswith(("    ", "\t"))):
                j += 1
        elif _ATX.match(s):
            kind, depth = "heading", len(s.lstrip()) - len(s.lstrip().lstrip("#"))
        elif following and _SETEXT.match(following):
            kind, depth, j = "heading", 1 if "=" in following else 2, i + 2
        elif "|" in s and following and _TABLE.match(following):
            kind = "table"
            while j < n and not blank(j) and "|" in lines[j][2]:
                j += 1
        elif _BREAK.match(s):
            kind = "thematic-break"
        elif m := _LIST.match(s):
            kind, depth = ("unordered-list-item" if m[2] else "ordered-list-item"), len(m[1].expandtabs(4)) // 2
            while j < n and not _LIST.match(lines[j][2]) and (blank(j) or len(lines[j][2]) - len(lines[j][2].lstrip()) > len(m[1])):
                j += 1
        elif s.lstrip().startswith(">"):
            kind = "blockquote"
            while j < n and lines[j][2].lstrip().startswith(">"):
                j += 1
        elif _HTML.match(s):
            kind = "html"
            while j < n and not blank(j):
                j += 1
        else:
            kind = "paragraph"
            while j < n and not blank(j) and not starts(j) and not (j + 1 < n and (_SETEXT.match(lines[j + 1][2]) or ("|" in lines[j][2] and _TABLE.match(lines[j + 1][2])))):
                j += 1
        out.append((kind, a, lines[j - 1][1], depth))
        i = j
    return out


def _spans(kind_schema: str, f):
    def column(c, *args):
        @F.pandas_udf(f"array<struct<{kind_schema}>>")
        def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
            names = [x.split(":")[0] for x in kind_schema.split(",")]
            for s in values:
                yield pd.Series([None if x is None else [dict(zip(names, r)) for r in f(x, *args)] for x in s], index=s.index, dtype=object)

        return run(c)

    return column


sentences_column = _spans("start:int,end:int", split_sentences)
clauses_column = _spans("sentence:int,start:int,end:int", split_clauses)
blocks_column = _spans("kind:string,start:int,end:int,depth:int,parent:int,gap:string,embedded:boolean", block_rows)
whole_clauses_column = _spans("sentence:int,start:int,end:int", lambda t: split_clauses(t, comma=False, semicolon=False, colon=False))


# ---------------------------------------------------------------- signals as spans
_HAN_NOT = re.compile(f"(?!{'|'.join(spec.NEGATION_EXCLUDED)})(?:[{spec.NEGATION_CHARS.replace('否', '')}]|(?<!是)否)")
_LATIN_NOT = re.compile(spec.NEGATION_EN, re.I)
_SIGNAL_PATTERNS = {name: re.compile(p.replace(r"\p{Han}", "㐀-鿿豈-﫿")) for name, p in spec.SIGNALS.items()}


def negation_spans(text: str) -> list[tuple[int, int]]:
    """Han and English negations that are not part of another construction."""
    out = [m.span() for m in _HAN_NOT.finditer(text)]
    for m in _LATIN_NOT.finditer(text):
        word, before, after = m[0].lower(), text[max(0, m.start() - 11) : m.start()].lower(), text[m.end() : m.end() + 5].lower()
        if not (word == "not" and (after == " only" or before.endswith("whether or ")) or word == "nor" and before.endswith("neither ")):
            out.append(m.span())
    return out


def signal_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every signal; both proper-noun patterns are one kind."""
    found = [("proper" if name.startswith("proper") else name, *m.span()) for name, p in _SIGNAL_PATTERNS.items() for m in p.finditer(text)]
    return found + [("negation", a, b) for a, b in negation_spans(text)]


_raw_signals = _spans("kind:string,start:int,end:int", signal_spans)
SIGNAL_KINDS = ("proper", "money", "date", "quantity", "number", "acronym", "object", "emphasis", "negation")


def with_signals(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """``df`` with all signals of a text: spans by start, end and kind, once each, without quantities inside a date or money."""
    raw = F.col("_raw")
    outer = F.filter(raw, lambda x: x["kind"].isin("date", "money"))
    kept = F.filter(raw, lambda x: (x["kind"] != "quantity") | ~F.exists(outer, lambda o: (x["start"] >= o["start"]) & (x["end"] <= o["end"])))
    spans = F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    return df.withColumn("_raw", _raw_signals(F.col(text))).withColumn(out, spans).drop("_raw")


def signal_counts(spans: Column) -> list[Column]:
    of = lambda k: F.filter(spans, lambda x: x["kind"] == k)
    return [F.size(of(k)).cast("long").alias(k) for k in SIGNAL_KINDS]


# ---------------------------------------------------------------- ranking and summaries
def page_rank(weights: dict[tuple[int, int], float], n: int, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-4) -> list[float]:
    """Jacobi iterations over symmetric weights; dangling mass is spread evenly."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (a, b), w in sorted(weights.items()):
        near[a].append((b, w))
        near[b].append((a, w))
    total = [sum(w for _, w in x) for x in near]
    ranks = [1 / n] * n
    for _ in range(iterations):
        loose = sum(r for r, t in zip(ranks, total) if t <= 0) / n
        new = [(1 - damping) / n + damping * (loose + sum(ranks[j] * w / total[j] for j, w in x)) for x in near]
        if sum(abs(a - b) for a, b in zip(new, ranks)) < tolerance:
            return new
        ranks = new
    return ranks


def block_ranks(blocks: DataFrame, sims: DataFrame) -> DataFrame:
    """(doc, block, rank) of blocks (doc, block) by the similarities (block, a, b, sim) within their documents."""
    kind = blocks.schema["doc"].dataType.simpleString()
    b = blocks.groupBy("doc").agg(F.sort_array(F.collect_set("block")).alias("items"))
    p = sims.groupBy(F.col("block").alias("doc")).agg(F.collect_list(F.struct("a", "b", "sim")).alias("pairs"))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, items, pairs in zip(pdf["doc"], pdf["items"], pdf["pairs"]):
                at = {x: i for i, x in enumerate(items)}
                weights = {(at[r["a"]], at[r["b"]]): r["sim"] for r in (pairs if pairs is not None else []) if r["a"] in at and r["b"] in at}
                out += [(doc, x, round(r, 6)) for x, r in zip(items, page_rank(weights, len(items)))]
            yield pd.DataFrame(out, columns=["doc", "block", "rank"])

    return b.join(p, "doc", "left").mapInPandas(rank, f"doc {kind}, block bigint, rank double")


def select_diverse(items: list[dict], sims: dict[tuple[int, int], float], limit: int, redundancy: float = 0.8, threshold: float = 0.35, weights: tuple[float, ...] = (0.50, 0.0, 0.25, 0.15, 0.10)) -> list[tuple[int, float]]:
    """Greedy choice by relevance, newly covered terms, novelty and signals; too similar or too weak items are left out."""
    chosen: list[tuple[int, float]] = []
    covered: set[str] = set()
    left = set(range(len(items)))
    sim = lambda a, b: sims.get((min(a, b), max(a, b)), 0.0)
    while left and len(chosen) < limit:
        best = None
        for i in sorted(left):
            close = max((sim(i, j) for j, _ in chosen), default=0.0)
            if close >= redundancy:
                continue
            terms = items[i]["terms"]
            gain = len(terms - covered) / len(terms) if terms else 0.0
            score = weights[0] * items[i]["relevance"] + weights[1] * items[i].get("discourse", 0.0) + weights[2] * gain + weights[3] * (1 - close) + weights[4] * items[i]["signal"]
            if best is None or score > best[1]:
                best = (i, score)
        if best is None or best[1] < threshold:
            break
        chosen.append(best)
        covered |= items[best[0]]["terms"]
        left.discard(best[0])
    return sorted(chosen)


def summarise(blocks: DataFrame, sims: DataFrame, limit: int = 3, threshold: float = 0.35, relevance: tuple[float, float] | None = None, final: tuple[float, ...] = (0.50, 0.0, 0.25, 0.15, 0.10)) -> DataFrame:
    """(doc, block, score) of the chosen paragraphs. ``blocks``: (doc, block, terms, discourse, signal), ``sims``:
    (block, a, b, sim) within documents. ``final`` weighs relevance, discourse, new terms, novelty and signals; ``relevance`` weighs rank and discourse
    (by default the greater of 0.8 rank and discourse). A document is one group: its paragraphs and their pairs only."""
    kind = blocks.schema["doc"].dataType.simpleString()
    b = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("block", "terms", "discourse", "signal"))).alias("items"))
    p = sims.groupBy(F.col("block").alias("doc")).agg(F.collect_list(F.struct("a", "b", "sim")).alias("pairs"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, items, pairs in zip(pdf["doc"], pdf["items"], pdf["pairs"]):
                at = {r["block"]: i for i, r in enumerate(items)}
                weights = {(at[r["a"]], at[r["b"]]): r["sim"] for r in (pairs if pairs is not None else []) if r["a"] in at and r["b"] in at}
                rank = page_rank(weights, len(items))
                top = max(rank)
                mix = lambda x, d: max(0.8 * x, d) if relevance is None else relevance[0] * x + relevance[1] * d
                rows = [{"relevance": mix(x / top, r["discourse"]), "discourse": r["discourse"], "signal": r["signal"], "terms": set(r["terms"])} for x, r in zip(rank, items)]
                out += [(doc, items[i]["block"], round(s, 6)) for i, s in select_diverse(rows, weights, limit, threshold=threshold, weights=final)]
            yield pd.DataFrame(out, columns=["doc", "block", "score"])

    return b.join(p, "doc", "left").mapInPandas(choose, f"doc {kind}, block bigint, score double")


# ---------------------------------------------------------------- documents of blocks
PROTECTED = ("fenced-code", "indented-code", "table", "html")
#: Defaults: a block is long from these clauses, and above these characters or Latin words; clauses kept of a long one.
MIN_CLAUSES, LONG_CHARS, LONG_WORDS, KEPT_CLAUSES = 3, 240, 60, 2
_LATIN_WORD = "[A-Za-z0-9']*[A-Za-z][A-Za-z0-9']*"
_LIST_MARK = rf"^\s*(?:[{re.escape(spec.BULLETS)}] |[0-9一二三四五六七八九十]+(?:\. |\) |） |、))"


def document_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, block, kind, depth, parent, gap, embedded, body) of the blocks of every document."""
    t = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    r = t.select("doc", "text", F.posexplode(blocks_column(F.col("text"))).alias("block", "r"))
    return r.select("doc", F.col("block").cast("long").alias("block"), "r.kind", "r.depth", F.col("r.parent").cast("long").alias("parent"), "r.gap", "r.embedded", F.expr("substring(text, r.start + 1, r.end - r.start)").alias("body"))


def is_long(body: Column, clauses: Column) -> Column:
    return (clauses >= MIN_CLAUSES) & ((F.length(body) > LONG_CHARS) | (F.regexp_count(body, F.lit(_LATIN_WORD)) > LONG_WORDS))


def kept_headings(blocks: DataFrame) -> DataFrame:
    """(doc, block) of the headings with a retained block before the next heading of their depth or less. ``blocks``: (doc, block,
    kind, depth, retained).

    For each retained block the last heading of each of the six depths is a running maximum; it stands above the block unless
    one of less or the same depth came after it. Linear in the blocks, no range join.
    """
    so_far = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.coalesce(F.max(F.when((F.col("kind") == "heading") & (F.least("depth", F.lit(6)) == d), F.col("block"))).over(so_far), F.lit(-1)).alias(f"h{d}") for d in range(1, 7)]
    rows = blocks.select("doc", "block", "kind", "retained", *last).where("retained AND kind <> 'heading'")
    above = F.array(*[F.when(F.col(f"h{d}") > F.greatest(F.lit(-1), *[F.col(f"h{e}") for e in range(1, d)], F.lit(-1)), F.col(f"h{d}")) for d in range(1, 7)])
    return rows.select("doc", F.explode(F.filter(above, lambda x: x.isNotNull())).alias("block")).distinct()


def kept_breaks(blocks: DataFrame) -> DataFrame:
    """(doc, block) of the thematic breaks with a retained block on both sides. ``blocks`` as above."""
    w = Window.partitionBy("doc").orderBy("block")
    side = lambda frame: F.coalesce(F.max((F.col("retained") & (F.col("kind") != "thematic-break")).cast("int")).over(frame), F.lit(0))
    rows = blocks.select("doc", "block", "kind", side(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), side(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return rows.where("kind = 'thematic-break' AND before = 1 AND after = 1").select("doc", "block")


def ranked_clauses(blocks: DataFrame, limit: int = KEPT_CLAUSES) -> DataFrame:
    """(doc, block, clause, clause_text, score, rank, negated, kept) of the clauses of long blocks (doc, block, body): by discourse, signals and
    position; the best ``limit`` are kept, and every negated one."""
    from textloom.functions.signals import discourse_score, negations, signal_score

    c = blocks.select("doc", "block", "body", whole_clauses_column(F.col("body")).alias("c")).withColumn("n", F.size("c")).where(is_long(F.col("body"), F.col("n")))
    c = c.select("doc", "block", "body", "n", F.posexplode("c").alias("clause", "r")).withColumn("clause_text", F.expr("trim(substring(body, r.start + 1, r.end - r.start))"))
    score = 0.60 * discourse_score(F.col("clause_text")) + 0.25 * signal_score(F.col("clause_text")) + 0.15 * (1 - 0.25 * F.col("clause") / F.col("n"))
    han, english = negations(F.col("clause_text"))
    c = c.select("doc", "block", "clause", "clause_text", F.round(score, 6).alias("score"), ((han + english) > 0).alias("negated"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "block").orderBy(F.desc("score"), "clause")))
    return c.withColumn("kept", (F.col("rank") <= limit) | F.col("negated"))


def decided(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """``blocks`` with (decision, output, score, forced): what of every block goes into the summary. ``chosen``: (doc, block, score) of the
    ranked blocks. Code, tables and HTML stay as they are, list items too unless long; long blocks give their
    best clauses; headings and breaks stay where something around them does."""
    item = F.col("kind").isin("ordered-list-item", "unordered-list-item")
    b = blocks.join(chosen.select("doc", "block", "score"), ["doc", "block"], "left")
    open_ = (item & ~F.col("embedded")) | F.col("score").isNotNull()
    kept = ranked_clauses(b.where(open_).select("doc", "block", "body")).where("kept")
    parts = kept.groupBy("doc", "block").agg(F.array_sort(F.collect_list(F.struct("clause", "clause_text"))).alias("parts"), F.count(F.when(F.col("rank") > KEPT_CLAUSES, 1)).alias("forced"))
    b = b.join(parts, ["doc", "block"], "left")
    mark = F.when(item & (F.col("parts")[0]["clause"] > 0), F.regexp_extract("body", _LIST_MARK, 0)).otherwise("")
    within = F.concat(mark, F.array_join(F.transform("parts", lambda p: p["clause_text"]), " "))
    first = F.when(F.col("kind").isin(*PROTECTED) | F.col("embedded"), "preserve_exact").when(F.col("parts").isNotNull(), "summarize_within").when(item, "preserve_exact").when(F.col("score").isNotNull(), "select_exact")
    b = b.withColumn("decision", first).withColumn("output", F.when(F.col("decision") == "summarize_within", within).when(F.col("decision").isNotNull(), F.col("body")))
    state = b.select("doc", "block", "kind", "depth", F.col("decision").isNotNull().alias("retained"))
    headings = kept_headings(state)
    with_headings = state.join(headings.withColumn("context", F.lit(True)), ["doc", "block"], "left").withColumn("retained", F.col("retained") | F.coalesce("context", F.lit(False)))
    context = headings.unionByName(kept_breaks(with_headings)).withColumn("context", F.lit(True))
    b = b.join(context, ["doc", "block"], "left")
    return b.select(
        "doc", "block", "kind", "depth", "parent", "gap", "body", "score", F.coalesce("forced", F.lit(0)).alias("forced"),
        F.coalesce("decision", F.when(F.col("context"), "context_only"), F.lit("omit")).alias("decision"), F.coalesce("output", F.when(F.col("context"), F.col("body")), F.lit("")).alias("output"),
    )


def assembled(blocks: DataFrame) -> DataFrame:
    """(doc, summary): what was decided, in order; between neighbours the white space that stood there, else a blank line."""
    w = Window.partitionBy("doc").orderBy("block")
    kept = blocks.where("output <> ''").withColumn("last", F.lag("block").over(w)).withColumn("before", F.lag("output").over(w))
    gap = F.when(F.col("last").isNull(), "").when((F.col("last") == F.col("block") - 1) & (F.col("gap") != ""), F.col("gap")).when(F.col("before").endswith("\n"), "").otherwise("\n\n")
    return kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("block", F.concat(gap, "output").alias("x")))).alias("x")).select("doc", F.array_join(F.transform("x", lambda r: r["x"]), "").alias("summary"))


def ranked_blocks(blocks: DataFrame) -> DataFrame:
    """Paragraphs and quotations with terms: (doc, block, text, terms, n_terms, discourse, signal)."""
    from textloom.functions.signals import discourse_score, signal_score
    from textloom.operators.similarity import term_array

    some = F.col("body").rlike(f"[A-Za-z0-9_.-]|[{spec.HAN_TERMS}]")  # a text with any term; a filter on the terms would have them made twice
    p = blocks.where(F.col("kind").isin("paragraph", "blockquote") & some).select("doc", "block", F.col("body").alias("text"), term_array(F.col("body")).alias("all_terms"))
    return p.select("doc", "block", "text", F.array_distinct("all_terms").alias("terms"), F.size("all_terms").alias("n_terms"), discourse_score(F.col("text")).alias("discourse"), signal_score(F.col("text")).alias("signal"))


def bounded(ranked: DataFrame, max_blocks: int) -> DataFrame:
    """Candidates for pairwise ranking. Of documents with more than 256 of them (twice ``max_blocks``, up to 1,024, if that is more) three quarters
    are the best by a proxy and a quarter evenly spaced: the definition of the summary, not a limit of the engine."""
    cap = max(256, min(2 * max_blocks, 1024))
    best, spaced = cap * 3 // 4, cap - cap * 3 // 4
    w = Window.partitionBy("doc")
    proxy = 0.6 * F.col("discourse") + 0.3 * F.col("signal") + 0.1 * F.least("n_terms", F.lit(100)) / 100
    p = ranked.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(proxy.desc(), "block"))).withColumn("at", F.row_number().over(w.orderBy("block")) - 1)
    # at = floor(k (n - 1) / (spaced - 1)) for some k: the least k that reaches ``at`` gives it
    k = F.ceil(F.col("at") * (spaced - 1) / (F.col("n") - 1))
    even = (k <= spaced - 1) & (F.floor(k * (F.col("n") - 1) / (spaced - 1)) == F.col("at"))
    return p.where((F.col("n") <= cap) | (F.col("place") <= best) | even).drop("n", "place", "at")


def summary_documents(df: DataFrame, key: str, text: str, max_blocks: int = 3, threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(decided blocks, documents): the summary of every document with at least one block. Documents: (doc, schema_version, summary, selected, preserved,
    forced, output_blocks, candidates, bounded, input_chars, output_chars, reduction). Null texts give no rows; a document without
    candidates keeps its code, lists and their headings."""
    from textloom.functions.text import reduction
    from textloom.operators.similarity import bm25_pairs
    from textloom.session import cut_lineage

    blocks = cut_lineage(document_blocks(df, key, text))
    ranked = ranked_blocks(blocks)
    some = cut_lineage(bounded(ranked, max_blocks))
    sims = bm25_pairs(some.select(F.col("doc").alias("block"), F.col("block").alias("id"), "text"))
    chosen = summarise(some.select("doc", "block", "terms", "discourse", "signal"), sims, max_blocks, threshold)
    out = cut_lineage(decided(blocks, chosen))
    count = lambda c: F.count(F.when(c, 1))
    budget = out.groupBy("doc").agg(
        count(F.col("score").isNotNull()).alias("selected"),
        count(F.col("kind").isin(*PROTECTED, "ordered-list-item", "unordered-list-item")).alias("preserved"),
        F.sum("forced").alias("forced"),
        count(F.col("decision") != "omit").alias("output_blocks"),
    )
    had = ranked.groupBy("doc").agg(F.count(F.lit(1)).alias("candidates")).join(some.groupBy("doc").agg(F.count(F.lit(1)).alias("bounded")), "doc")
    source = df.select(F.col(key).alias("doc"), F.length(text).cast("long").alias("input_chars")).where("input_chars IS NOT NULL")
    d = budget.join(source, "doc").join(assembled(out), "doc", "left").join(had, "doc", "left").fillna("", ["summary"]).fillna(0, ["candidates", "bounded"])
    chars = F.length("summary").cast("long")
    return out, d.select("doc", F.lit(2).alias("schema_version"), "summary", "selected", "preserved", "forced", "output_blocks", "candidates", "bounded", "input_chars", chars.alias("output_chars"), F.round(reduction(F.col("input_chars"), chars), 6).alias("reduction"))
