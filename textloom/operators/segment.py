"""Segmentation and tagging: rule chunks, dictionary and second-order BMES decoding, second-order tag decoding.

The decoders are sequential, so they run in Arrow batches over plain model tables that the driver loads; their size is
bounded by the dictionary and the character inventory and is checked before they are sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import spec

MIN_LOG = -1e30
MAX_WORD = 255
#: Between the joint states of a key.
SEP = "\x1f"
#: Entries of a model that may be sent to the tasks.
MAX_MODEL_ENTRIES = 5_000_000

_RANGE = re.compile(r"\\x\{([0-9A-F]+)\}")


def _python_class(body: str) -> str:
    return _RANGE.sub(lambda m: f"\\U{int(m[1], 16):08X}", body)


_HAN, _ALNUM, _SPACE, _PUNCT = (_python_class(x) for x in (spec.HAN_CORE, spec.ALNUM, spec.SPACE, spec.PUNCT))
_HAN_RE = re.compile(f"[{_HAN}]+")
_NUM, _ENG, _SPC = re.compile("[0-9]+"), re.compile(f"[{_ALNUM}]+"), re.compile(f"[{_SPACE}]+")
_SCAN = re.compile(f"(?P<Eng>[{_ALNUM}]+)|(?P<Han>[{_HAN}]+)|(?P<Space>[{_SPACE}]+)|(?P<Punct>(?P<p>[{_PUNCT}])(?P=p)*)|(?P<Other>[^{_ALNUM}{_HAN}{_SPACE}{_PUNCT}]+)")
_PLAIN = re.compile(f"[{_ALNUM}]")
_PATTERNS = {
    name: re.compile(_python_class(p), re.A)
    for name, p in {"email": spec.EMAIL, "url": spec.URL, "model_id": spec.MODEL_ID, "cn_time": spec.CN_TIME, "ordinal": spec.ORDINAL, "cn_qty": spec.CN_QTY, "num_time": spec.NUM_TIME, "number": spec.NUMBER}.items()
}
FIXED_TAGS = {"Url": "FW", "Email": "FW", "Eng": "FW", "Space": "FW", "Other": "FW", "Num": "Neu", "Time": "Nd", "Punct": "PUNCTUATIONCATEGORY"}
_TRANSLATE = str.maketrans(spec.NORM_FROM, spec.NORM_TO)


def protected(text: str) -> list[tuple[int, int, str, str]]:
    """Non-overlapping pattern matches (start, end, kind, rule): found leftmost, rejected by context, then chosen by
    start, priority, end."""
    found = []
    for rule, pattern in _PATTERNS.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            before, after = text[a - 1 : a] if a else "", text[b : b + 1]
            if rule in ("cn_time", "cn_qty") and before == "第":
                continue
            if rule == "num_time" and before and _PLAIN.match(before):
                continue
            if rule == "number" and ((before and _PLAIN.match(before)) or (after and _PLAIN.match(after))):
                continue
            if rule == "url" and len(m[0].encode()) < 4:
                continue
            found.append((a, -spec.PRIORITIES[rule], b, rule))
    out, cursor = [], 0
    for a, _, b, rule in sorted(found):
        if a >= cursor:
            out.append((a, b, spec.KINDS[rule], rule))
            cursor = b
    return out


def scan_plain(text: str, base: int = 0) -> list[tuple[int, int, str]]:
    """Maximal runs of one character class; punctuation only merges with itself."""
    out = []
    for m in _SCAN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "p" else "Punct"
        if kind == "Eng" and _NUM.fullmatch(m[0]):
            kind = "Num"
        out.append((base + m.start(), base + m.end(), kind))
    return out


def chunks(text: str) -> list[tuple[int, int, str]]:
    """Protected spans with the gaps between them scanned: a total cover of the text."""
    out, cursor = [], 0
    for a, b, kind, _ in protected(text):
        out += scan_plain(text[cursor:a], cursor)
        out.append((a, b, kind))
        cursor = b
    return out + scan_plain(text[cursor:], cursor)


# ---------------------------------------------------------------- decoding
@dataclass
class BmesModel:
    """Log probabilities by state; missing pairs take the unknown rows."""

    start: dict[str, float]
    trans1: dict[str, float]
    trans2: dict[str, float]
    emit1: dict[str, float]
    emit2: dict[str, float]
    unk1: dict[str, float]
    unk2: dict[str, float]
    words: dict[str, float] = field(default_factory=dict)
    custom: dict[str, float] = field(default_factory=dict)
    mixed: dict[str, float] = field(default_factory=dict)  # words of letters or digits with Han, and the protected ones
    tags: dict[str, dict[str, float]] = field(default_factory=dict)  # log P(tag | word)
    tag_start: dict[str, float] = field(default_factory=dict)  # of joint states, as "B-n"
    tag_trans1: dict[str, float] = field(default_factory=dict)  # two of them with SEP between
    tag_trans2: dict[str, float] = field(default_factory=dict)
    tag_emit: dict[str, float] = field(default_factory=dict)  # joint state and character
    tag_unk: dict[str, float] = field(default_factory=dict)
    tag_floor: float = -12.0  # of a legal transition that was never seen

    def size(self) -> int:
        return sum(len(getattr(self, f)) for f in self.__dataclass_fields__)

    def boundary(self, ctx: str, s: str) -> float:
        if not ctx:
            return self.start.get(s, MIN_LOG)
        return self.trans1.get(ctx + s, MIN_LOG) if len(ctx) == 1 else self.trans2.get(ctx + s, MIN_LOG)

    def emission(self, prev: str, s: str, ch: str) -> float:
        if not prev:
            return self.emit1.get(s + ch, self.unk1.get(s, MIN_LOG))
        return self.emit2.get(prev + s + ch, self.unk2.get(prev + s, MIN_LOG))


def shape(n: int) -> str:
    return "S" if n == 1 else "B" + "M" * (n - 2) + "E"


def span_score(model: BmesModel, ctx: str, word: str) -> float:
    """BMES score of one token after the states ``ctx``; the plain form that the fast scorer is tested against."""
    total = 0.0
    for s, ch in zip(shape(len(word)), word):
        total += model.boundary(ctx, s) + model.emission(ctx[-1:], s, ch)
        ctx = (ctx + s)[-2:]
    return total


def decode(model: BmesModel, text: str, max_word: int = MAX_WORD) -> list[str]:
    """The best segmentation of a Han chunk: second-order BMES over spans. A dictionary span (two characters or
    more) replaces the character score, a custom one adds its bias to it; ties go to the earliest boundary.

    Inner M runs are prefix sums. A span of two characters or more hides the states before its first one, so for each
    start only the best context is taken, separately for an E next, an M next and a dictionary reading; a pair of
    start and end then costs a constant. Paths are chains of back-pointers (path before, end), so that memory grows with
    the chunk and not with its square.
    """
    n = len(text)
    if not n:
        return []
    start, trans1, trans2, words, custom = model.start, model.trans1, model.trans2, model.words, model.custom
    emit1, emit2, unk1, unk2 = model.emit1, model.emit2, model.unk1, model.unk2
    mmm, bmm, bme, mme = (trans2.get(k, MIN_LOG) for k in ("MMM", "BMM", "BME", "MME"))
    rows = {k: [emit2.get(k + ch, unk2.get(k, MIN_LOG)) for ch in text] for k in ("MM", "BM", "BE", "ME")}
    m_after_m, m_after_b, e_after_b, e_after_m = rows["MM"], rows["BM"], rows["BE"], rows["ME"]
    mid = [0.0] * (n + 1)  # sum of M after M, M for characters up to i
    for i in range(n):
        mid[i + 1] = mid[i] + mmm + m_after_m[i]
    best: list[dict[str, tuple[float, tuple]]] = [{} for _ in range(n + 1)]
    best[0][""] = (0.0, ())
    for i in range(n):
        to_e = to_m = to_word = None
        ch = text[i]
        for ctx, (score, path) in best[i].items():
            table = trans2 if len(ctx) == 2 else trans1 if ctx else start
            if ctx:
                single, begin = emit2.get(ctx[-1] + "S" + ch, unk2.get(ctx[-1] + "S", MIN_LOG)), emit2.get(ctx[-1] + "B" + ch, unk2.get(ctx[-1] + "B", MIN_LOG))
            else:
                single, begin = emit1.get("S" + ch, unk1.get("S", MIN_LOG)), emit1.get("B" + ch, unk1.get("B", MIN_LOG))
            _keep(best[i + 1], (ctx + "S")[-2:], score + table.get(ctx + "S", MIN_LOG) + single, (path, i + 1))
            first = score + table.get(ctx + "B", MIN_LOG)
            begun, last = first + begin, (ctx + "B")[-2:]
            inner = trans2 if len(last) == 2 else trans1
            to_e = _better(to_e, begun + inner.get(last + "E", MIN_LOG), path)
            to_m = _better(to_m, begun + inner.get(last + "M", MIN_LOG), path)
            to_word = _better(to_word, first, path)
        for j in range(i + 2, min(n, i + max_word) + 1):
            if j == i + 2:
                score, path, state = to_e[0] + e_after_b[j - 1], to_e[1], "BE"
            else:
                score, path, state = to_m[0] + m_after_b[i + 1], to_m[1], "ME"
                if j > i + 3:
                    score += bmm + m_after_m[i + 2] + mid[j - 1] - mid[i + 3]
                score += (bme if j == i + 3 else mme) + e_after_m[j - 1]
            word = text[i:j]
            if word in custom:
                score += custom[word]
            elif word in words:
                score, path = to_word[0] + words[word], to_word[1]
            _keep(best[j], state, score, (path, j))
    _, ends = min((-s, _ends(p)) for s, p in best[n].values())
    return [text[a:b] for a, b in zip((0, *ends), ends)]


def _ends(path: tuple) -> tuple[int, ...]:
    out = []
    while path:
        path, end = path
        out.append(end)
    return tuple(reversed(out))


def _better(old: tuple[float, tuple] | None, score: float, path: tuple) -> tuple[float, tuple]:
    return (score, path) if old is None or score > old[0] or (score == old[0] and _ends(path) < _ends(old[1])) else old


def _keep(slot: dict, ctx: str, score: float, path: tuple) -> None:
    old = slot.get(ctx)
    if old is None or score > old[0] or (score == old[0] and _ends(path) < _ends(old[1])):
        slot[ctx] = (score, path)


def joint_states(tag: str, size: int) -> list[str]:
    return [f"{x}-{tag}" for x in shape(size)]


def tag_score(model: BmesModel, word: str, tag: str, lexical: float | None, context: tuple[str, ...]) -> tuple[float, tuple[str, ...]]:
    """The score of one tag of a word behind the joint states ``context``, and the states behind it. A word with a lexical
    probability counts that and the transition into it; any other its characters and the transitions inside."""
    states, total = joint_states(tag, len(word)), 0.0
    for k, state in enumerate(states):
        if not k or lexical is None:
            if not context:
                total += model.tag_start.get(state, model.tag_floor)
            else:
                total += (model.tag_trans1 if len(context) == 1 else model.tag_trans2).get(SEP.join((*context, state)), model.tag_floor)
        if lexical is None:
            total += model.tag_emit.get(state + word[k], model.tag_unk.get(state, MIN_LOG))
        context = (*context, state)[-2:]
    return total + (lexical or 0.0), context


class TagArrays:
    """The tag tables of a model as arrays. State ``none`` stands before the first word, so that starts and first-order
    transitions are rows of the second-order table."""

    def __init__(self, model: BmesModel):
        self.tags = sorted({k.partition("-")[2] for k in model.tag_unk} | {t for o in model.tags.values() for t in o}) or ["Na"]
        self.at = {t: i for i, t in enumerate(self.tags)}
        count = 4 * len(self.tags)
        self.none = count
        state = {f"{x}-{t}": 4 * i + k for i, t in enumerate(self.tags) for k, x in enumerate("BMES")}
        self.trans = np.full((count + 1,) * 3, model.tag_floor)
        for table, lead in ((model.tag_start, (count, count)), (model.tag_trans1, (count,)), (model.tag_trans2, ())):
            for key, value in table.items():
                self.trans[(*lead, *(state[x] for x in key.split(SEP)))] = value
        self.unknown = np.full(count, MIN_LOG)
        for key, value in model.tag_unk.items():
            self.unknown[state[key]] = value
        self.emit: dict[str, list[tuple[int, float]]] = {}
        for key, value in model.tag_emit.items():
            self.emit.setdefault(key[-1], []).append((state[key[:-1]], value))
        self.every = np.arange(len(self.tags))
        self.rows: dict[str, np.ndarray] = {}
        self.flat, self.size = memoryview(self.trans.ravel()), count + 1
        # Views: a word's first state behind two states, its second behind one, and what follows inside, over all tags.
        at = 4 * self.every
        self.single, self.begin = self.trans[:, :, 3:count:4], self.trans[:, :, 0:count:4]
        self.second = {k: self.trans[:, at, at + k] for k in (1, 2)}
        self.inner = {(i, k): self.trans[at + i, at + 1, at + k] for i in (0, 1) for k in (1, 2)}
        self.known = {w: ([self.at[t] for t in sorted(o)], [o[t] for t in sorted(o)]) for w, o in model.tags.items()}

    def emissions(self, ch: str) -> np.ndarray:
        if ch not in self.rows:
            row = self.unknown.copy()
            for state, value in self.emit.get(ch, ()):
                row[state] = value
            self.rows[ch] = row
        return self.rows[ch]


def tag_words(model: BmesModel, words: list[str]) -> list[str]:
    """The best tags of a run of words: second-order transitions over joint states of position and tag. Known words
    take their lexical probabilities, others every tag by their characters. Equal scores: the first context, then tag.

    A step scores all contexts (pairs of states) against all tags of the word at once. Behind a word of one
    character the context keeps the state before it, so the best of each such state goes on; behind a longer one it is
    the word's own, so the best of all does.
    """
    if not words:
        return []
    a = model.__dict__.get("_arrays") or model.__dict__.setdefault("_arrays", TagArrays(model))
    before, last, score = [a.none], [a.none], [0.0]
    steps = []
    for word in words:
        known = a.known.get(word)
        if known and len(score) * len(known[0]) <= FEW:
            if not isinstance(score, list):
                before, last, score = before.tolist(), last.tolist(), score.tolist()
            parent, tags, before, last, score = _few(a, word, known, before, last, score)
        else:
            parent, tags, before, last, score = _many(a, word, known, np.asarray(before), np.asarray(last), np.asarray(score))
        steps.append((parent, tags))
    i, out = int(np.argmax(score)), []
    for parent, tags in reversed(steps):
        out.append(a.tags[tags[i]])
        i = parent[i]
    return out[::-1]


#: Pairs of contexts and tags up to which plain loops are faster than arrays.
FEW = 24


def _few(a: TagArrays, word: str, known: tuple[list[int], list[float]], before: list[int], last: list[int], score: list[float]) -> tuple[list, ...]:
    """One step over a known word: (parents, tags, before, last, score), as ``_many`` gives them."""
    single, flat, size = len(word) == 1, a.flat, a.size
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for at, (p, c, total) in enumerate(zip(before, last, score)):
        row = (p * size + c) * size
        for k, (tag, lexical) in enumerate(zip(*known)):
            value, key = total + flat[row + 4 * tag + (3 if single else 0)] + lexical, (c if single else 0, k)
            if key not in best or value > best[key][0]:
                best[key] = (value, at)
    keys = sorted(best)
    tags = [known[0][k] for _, k in keys]
    state = (lambda c, t: (c, 4 * t + 3)) if single else (lambda c, t: (4 * t + (0 if len(word) == 2 else 1), 4 * t + 2))
    pairs = [state(c, t) for (c, _), t in zip(keys, tags)]
    return [best[k][1] for k in keys], tags, [p for p, _ in pairs], [c for _, c in pairs], [best[k][0] for k in keys]


def _many(a: TagArrays, word: str, known: tuple[list[int], list[float]] | None, before: np.ndarray, last: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    one = len(word) == 1
    tags = np.array(known[0]) if known else a.every
    first = 4 * tags + (3 if one else 0)
    if known:
        each = score[:, None] + a.trans[before[:, None], last[:, None], first[None, :]]
        each += np.array(known[1])
    else:
        each = (a.single if one else a.begin)[before, last]
        each += score[:, None]
        each += a.emissions(word[0])[3 if one else 0 :: 4]
        for k, ch in enumerate(word[1:], 1):
            state = 2 if k == len(word) - 1 else 1
            each += a.second[state][last] if k == 1 else a.inner[min(k - 2, 1), state]
            each += a.emissions(ch)[state::4]
    if not one:
        parent = each.argmax(axis=0)
        return parent, tags, 4 * tags + (0 if len(word) == 2 else 1), 4 * tags + 2, each[parent, np.arange(len(tags))]
    order = np.argsort(last, kind="stable")
    starts = np.flatnonzero(np.diff(last[order], prepend=-1))
    ordered = each[order]
    best = np.maximum.reduceat(ordered, starts, axis=0)
    sizes = np.diff(starts, append=len(order))
    at = np.where(ordered == np.repeat(best, sizes, axis=0), np.arange(len(order))[:, None], len(order))
    parent = order[np.minimum.reduceat(at, starts, axis=0)]  # of equal ones the first
    return parent.ravel(), np.tile(tags, len(starts)), np.repeat(last[order][starts], len(tags)), np.tile(first, len(starts)), best.ravel()


def anchors(model: BmesModel, text: str) -> list[tuple[int, int]]:
    """Spans of dictionary words that mix letters or digits with Han, and of the protected words: leftmost, then longest."""
    if not model.mixed:
        return []
    if "_heads" not in model.__dict__:
        sizes: dict[str, set[int]] = {}
        for w in model.mixed:
            sizes.setdefault(w[0], set()).add(len(w))
        model.__dict__["_heads"] = re.compile("[" + "".join(map(re.escape, sizes)) + "]"), {h: sorted(x, reverse=True) for h, x in sizes.items()}
    heads, lengths = model.__dict__["_heads"]
    out, cursor = [], 0
    for m in heads.finditer(text):
        i = m.start()
        if i >= cursor:
            cursor = next((i + k for k in lengths[m[0]] if i + k <= len(text) and text[i : i + k] in model.mixed), cursor)
            if cursor > i:
                out.append((i, cursor))
    return out


#: Answers that a model keeps: runs of text come again and again, and the answer depends on the run alone.
KEPT = 5_000


def _kept(model: BmesModel, f, key):
    """``f(model, key)``, kept with the model; when it holds too many, it begins anew."""
    kept = model.__dict__.setdefault("_kept_" + f.__name__, {})
    answer = kept.get(key)
    if answer is None:
        if len(kept) >= KEPT:
            kept.clear()
        answer = kept[key] = f(model, key)
    return answer


def cut_plain(model: BmesModel | None, plain: str) -> list[tuple[int, int, str]]:
    """Segments (start, end, kind) of a normalised text before merges: anchors, and between them chunks, Han ones decoded."""
    out: list[tuple[int, int, str]] = []

    def gap(start: int, end: int) -> None:
        for a, b, kind in chunks(plain[start:end]):
            a, b = a + start, b + start
            if kind == "Han" and model is not None:
                for w in _kept(model, decode, plain[a:b]):
                    out.append((a, a + len(w), "Word"))
                    a += len(w)
            else:
                out.append((a, b, "Word" if kind == "Han" else kind))

    cursor = 0
    for a, b in anchors(model, plain) if model is not None else ():
        gap(cursor, a)
        out.append((a, b, "Word"))
        cursor = b
    gap(cursor, len(plain))
    return out


def cut(model: BmesModel | None, text: str, measure: bool = False) -> list[tuple[int, int, str]]:
    """Segments (start, end, kind) of a text; Han chunks are decoded if there is a model. They cover the text."""
    plain = text.translate(_TRANSLATE)
    return post_merge(plain, cut_plain(model, plain), measure)


_NUMERAL = re.compile(f"第?[{spec.HAN_NUMERALS}]+個?")
_UNITS = frozenset("年 季 月 週 周 天 日 號 期 星期 禮拜".split())
_GE_UNITS = frozenset("年 月 星期 禮拜".split())
#: Priorities of the merges behind segmentation.
TIME_PRIORITY, MEASURE_PRIORITY = 300, 200


def time_merges(text: str, segments: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(first segment, end, kind, priority): Han numerals with a unit of time, in two or three segments."""
    out = []
    for i in range(len(segments) - 1):
        part = segments[i : i + 3]
        if part[0][2] != "Word" or part[1][2] != "Word":
            continue
        for size in (3, 2):
            if len(part) >= size and all(k == "Word" for *_, k in part[:size]):
                words = [text[a:b] for a, b, _ in part[:size]]
                head, unit = "".join(words[:-1]), words[-1]
                if unit in _UNITS and _NUMERAL.fullmatch(head) and (not head.endswith("個") or unit in _GE_UNITS) and (size == 2 or words[1] == "個" or words[0] == "第"):
                    out.append((i, i + size, "Time", TIME_PRIORITY))
                    break
    return out


def measure_merges(text: str, segments: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """A Han numeral with the measure word 個 behind it."""
    return [(i, i + 2, "Num", MEASURE_PRIORITY) for i, ((a, b, _), (c, d, _)) in enumerate(zip(segments, segments[1:])) if text[c:d] == "個" and all(x in spec.HAN_NUMERALS for x in text[a:b])]


def select_merges(candidates: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Candidates that do not overlap: by first segment, higher priority, later end."""
    out, cursor = [], 0
    for c in sorted(candidates, key=lambda c: (c[0], -c[3], -c[1])):
        if c[0] >= cursor:
            out.append(c)
            cursor = c[1]
    return out


def post_merge(text: str, segments: list[tuple[int, int, str]], measure: bool = False) -> list[tuple[int, int, str]]:
    """The segments with the selected merges made; merging of numeral and measure word is off by default."""
    edits = select_merges(time_merges(text, segments) + (measure_merges(text, segments) if measure else []))
    out, cursor = [], 0
    for first, end, kind, _ in edits:
        out += segments[cursor:first]
        out.append((segments[first][0], segments[end - 1][1], kind))
        cursor = end
    return out + segments[cursor:]


def merge_time(text: str, segments: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return post_merge(text, segments)


def tokenize(model: BmesModel | None, text: str) -> list[tuple[str, str, int, int, str]]:
    """(word, tag, start, end, kind): runs of words are tagged one by one, other kinds have a fixed tag."""
    segments, out, run = cut(model, text), [], []
    tags: dict[int, str] = {}

    def flush() -> None:
        for (a, _, _), t in zip(run, _kept(model, tag_words, tuple(text[a:b].translate(_TRANSLATE) for a, b, _ in run)) if model else ["Na"] * len(run)):
            tags[a] = t
        run.clear()

    for seg in segments:
        if seg[2] == "Word":
            run.append(seg)
        else:
            flush()
    flush()
    for a, b, kind in segments:
        out.append((text[a:b], tags[a] if a in tags else FIXED_TAGS[kind], a, b, kind))
    return out


# ---------------------------------------------------------------- DataFrame operators
def load_model(counts: DataFrame, alpha: float = 0.1) -> BmesModel:
    """Smoothed tables from counts (kind, key, n), read in one job. Kinds: start, trans1, trans2, emit1, emit2 (keys of
    joined states and a character), word, mixed, tag (word, tab, tag), pstart, ptrans1, ptrans2 (joint states with ``SEP``
    between) and pemit (joint state and character). A model of more than
    ``MAX_MODEL_ENTRIES`` entries is refused: raise the support of its words."""
    read = counts.select("kind", "key", "n").limit(MAX_MODEL_ENTRIES + 1).toPandas()
    if len(read) > MAX_MODEL_ENTRIES:
        raise ValueError(f"the model has more than {MAX_MODEL_ENTRIES} entries")
    by: dict[str, dict[str, int]] = {}
    for kind, key, n in zip(read["kind"], read["key"], read["n"]):
        by.setdefault(kind, {})[key] = int(n)

    def smooth(table: dict[str, int], head: int, options: int) -> dict[str, float]:
        sums: dict[str, int] = {}
        for k, n in table.items():
            sums[k[:head]] = sums.get(k[:head], 0) + n
        return {k: math.log((n + alpha) / (sums[k[:head]] + alpha * options)) for k, n in table.items()}

    def unknown(table: dict[str, int], head: int) -> dict[str, float]:
        sums: dict[str, int] = {}
        for k, n in table.items():
            sums[k[:head]] = sums.get(k[:head], 0) + n
        return {h: math.log(alpha / (n + alpha * vocabulary)) for h, n in sums.items()}

    def joint(table: dict[str, int], options: int) -> dict[str, float]:
        sums: dict[str, int] = {}
        for k, n in table.items():
            head = k.rpartition(SEP)[0]
            sums[head] = sums.get(head, 0) + n
        return {k: math.log((n + alpha) / (sums[k.rpartition(SEP)[0]] + alpha * options)) for k, n in table.items()}

    e1, e2, freq, mixed = by.get("emit1", {}), by.get("emit2", {}), by.get("word", {}), by.get("mixed", {})
    vocabulary = len({k[-1] for k in e1}) + 1
    whole = math.log(sum(freq.values()) + sum(mixed.values()) or 1)
    tags: dict[str, dict[str, float]] = {}
    for k, n in by.get("tag", {}).items():
        w, t = k.split("\t")
        tags.setdefault(w, {})[t] = n
    for w, t in tags.items():
        total = sum(t.values())
        tags[w] = {k: math.log(n / total) for k, n in t.items()}
    emitted = by.get("pemit", {})
    states: dict[str, int] = {}
    for k, n in emitted.items():
        states[k[:-1]] = states.get(k[:-1], 0) + n
    options = max(1, len(states) // 2)  # about half of the states may follow another
    words = {w: math.log(n) - whole for w, n in freq.items() if len(w) >= 2}
    mixed = {w: math.log(n) - whole for w, n in mixed.items()} | {w: words[w] for w in spec.ANCHOR_WORDS if w in words}
    return BmesModel(
        smooth(by.get("start", {}), 0, 2), smooth(by.get("trans1", {}), 1, 2), smooth(by.get("trans2", {}), 2, 2), smooth(e1, 1, vocabulary), smooth(e2, 2, vocabulary), unknown(e1, 1), unknown(e2, 2), words,
        mixed=mixed, tags=tags, tag_start=joint(by.get("pstart", {}), options), tag_trans1=joint(by.get("ptrans1", {}), options), tag_trans2=joint(by.get("ptrans2", {}), options),
        tag_emit={k: math.log((n + alpha) / (states[k[:-1]] + alpha * vocabulary)) for k, n in emitted.items()}, tag_unk={k: math.log(alpha / (n + alpha * vocabulary)) for k, n in states.items()},
        tag_floor=math.log(alpha / (sum(states.values()) / max(1, len(states)) + alpha * options)),
    )


TOKEN = "array<struct<word:string,tag:string,start:int,end:int,kind:string>>"


def tokens_column(column, model: BmesModel | None = None):
    """``tokenize`` as a column of structs; null texts give null."""

    @F.pandas_udf(TOKEN)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [{"word": w, "tag": t, "start": a, "end": b, "kind": k} for w, t, a, b, k in tokenize(model, x)] for x in s], index=s.index, dtype=object)

    return run(column)


def cut_column(column, model: BmesModel | None = None):
    """Words only: cheaper than tokens, since nothing is tagged."""

    @F.pandas_udf("array<string>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [x[a:b] for a, b, _ in cut(model, x)] for x in s], index=s.index, dtype=object)

    return run(column)


def trace_column(column):
    """Rule applications (rule, kind, start, end) of a text."""

    @F.pandas_udf("array<struct<rule:string,kind:string,start:int,end:int>>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [{"rule": r, "kind": k, "start": a, "end": b} for a, b, k, r in protected(x.translate(_TRANSLATE))] for x in s], index=s.index, dtype=object)

    return run(column)


def path_column(column, model: BmesModel):
    """The segments of a text with, for words, their score behind the words before them in the same run."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,score:double>>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def path(text: str) -> list[dict]:
            plain, out, ctx = text.translate(_TRANSLATE), [], ""
            for a, b, kind in cut(model, text):
                score = None
                if kind == "Word":
                    word = plain[a:b]
                    score = model.boundary(ctx, "B") + model.words[word] if word in model.words and word not in model.custom else span_score(model, ctx, word) + model.custom.get(word, 0.0)
                    ctx = (ctx + shape(b - a))[-2:]
                else:
                    ctx = ""
                out.append({"start": a, "end": b, "kind": kind, "score": score})
            return out

        for s in values:
            yield pd.Series([None if x is None else path(x) for x in s], index=s.index, dtype=object)

    return run(column)


def spans_column(column, f):
    """Spans (start, end, kind) that ``f`` finds in a normalised text."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [{"start": a, "end": b, "kind": k} for a, b, k in f(x.translate(_TRANSLATE))] for x in s], index=s.index, dtype=object)

    return run(column)


def edits(model: BmesModel | None, text: str, measure: bool = False) -> list[tuple[int, int, str]]:
    """The merges that are made behind segmentation, as spans."""
    segments = cut_plain(model, text)
    chosen = select_merges(time_merges(text, segments) + (measure_merges(text, segments) if measure else []))
    return [(segments[first][0], segments[end - 1][1], kind) for first, end, kind, _ in chosen]


def span_score_column(column, model: BmesModel):
    """The character score of a word on its own."""

    @F.pandas_udf("double")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else span_score(model, "", x.translate(_TRANSLATE)) for x in s], index=s.index, dtype=float)

    return run(column)
