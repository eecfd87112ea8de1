import itertools

import pytest

from textloom.operators.segment import SEP, BmesModel, anchors, chunks, cut, decode, merge_time, post_merge, protected, scan_plain, select_merges, shape, span_score, tag_score, tag_words, tokenize

STATES = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def toy(words=None, custom=None):
    def h(key):  # any fixed numbers
        return -((sum((i + 3) * ord(c) for i, c in enumerate(key)) * 7919) % 997) / 211 - 0.05

    chars = "甲乙"
    trans2 = {a + b + c: h("t" + a + b + c) for a in STATES for b in STATES[a] for c in STATES[b]}
    trans1 = {a + b: h("u" + a + b) for a in STATES for b in STATES[a]}
    emit1 = {s + c: h("e" + s + c) for s in STATES for c in chars}
    emit2 = {p + s + c: h("f" + p + s + c) for p in STATES for s in STATES[p] for c in chars}
    return BmesModel({"B": -0.6, "S": -0.9}, trans1, trans2, emit1, emit2, {}, {}, words or {}, custom or {})


def brute(model, text):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        ends = tuple(i + 1 for i, c in enumerate(cuts) if c) + (len(text),)
        words, a, score, ctx = [], 0, 0.0, ""
        for e in ends:
            w = text[a:e]
            if len(w) > 1 and w in model.custom:
                score += span_score(model, ctx, w) + model.custom[w]
            elif len(w) > 1 and w in model.words:
                score += model.boundary(ctx, "B") + model.words[w]
            else:
                score += span_score(model, ctx, w)
            ctx = (ctx + shape(len(w)))[-2:]
            words.append(w)
            a = e
        key = (-round(score, 9), ends)
        if best is None or key < best[0]:
            best = (key, words)
    return best[1]


@pytest.mark.parametrize("words,custom", [({}, {}), ({"甲乙": -1.0, "乙甲乙": -2.0, "甲": 5.0}, {}), ({"甲乙": -1.0}, {"甲乙": 6.0, "乙乙甲": 7.5})])
def test_decoder_against_every_segmentation(words, custom):
    model = toy(words, custom)
    for n in range(1, 7):
        for text in map("".join, itertools.product("甲乙", repeat=n)):
            assert decode(model, text) == brute(model, text)


CHUNKS = [
    ("特斯拉第2季資本支出", [("特斯拉", "Han"), ("第2季", "Time"), ("資本支出", "Han")]),
    ("1200億美元", [("1200億", "Num"), ("美元", "Han")]),
    ("成長57.16%", [("成長", "Han"), ("57.16%", "Num")]),
    ("S-400與F-35", [("S-400", "Eng"), ("與", "Han"), ("F-35", "Eng")]),
    ("a！！？ b", [("a", "Eng"), ("！！", "Punct"), ("？", "Punct"), (" ", "Space"), ("b", "Eng")]),
    ("2014年3月29日", [("2014年", "Time"), ("3月", "Time"), ("29日", "Time")]),
    ("第二十年", [("第二十年", "Han")]),
    ("a@b.example", [("a@b.example", "Email")]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", CHUNKS)
def test_chunks(text, expected):
    assert [(text[a:b], k) for a, b, k in chunks(text)] == expected


def test_cover_and_fixed_tags():
    text = "臺北HELLO 世界！１２３ 3個月 ❤❤"
    assert "".join(text[a:b] for a, b, _ in cut(None, text)) == text
    assert [(w, t) for w, t, *_ in tokenize(None, "GPU 12，好")] == [("GPU", "FW"), (" ", "FW"), ("12", "Neu"), ("，", "PUNCTUATIONCATEGORY"), ("好", "Na")]
    assert scan_plain("ab12 34") == [(0, 4, "Eng"), (4, 5, "Space"), (5, 7, "Num")]


def test_time_merge():
    text = "三個月一起"
    segments = [(0, 1, "Word"), (1, 2, "Word"), (2, 3, "Word"), (3, 5, "Word")]
    assert merge_time(text, segments) == [(0, 3, "Time"), (3, 5, "Word")]


def test_priorities():
    assert [(r, k) for *_, k, r in protected("寫信到a-b@c.example或看x-1")] == [("email", "Email"), ("model_id", "Eng")]


def test_long_runs_are_decoded_as_a_whole():
    long = "甲乙乙甲乙" * 4
    model = toy({"乙甲乙": -1.0}, {long: 400.0})
    for text in ("乙甲" * 40 + long + "甲乙" * 20, "乙" * 60 + long + "乙"):
        got = [text[a:b] for a, b, _ in cut(model, text)]
        assert got == decode(model, text) and long in got


def joint_toy():
    tags, chars = ("n", "v"), "甲乙"
    states = [f"{x}-{t}" for t in tags for x in "BMES"]

    def h(key):
        return -((sum((i + 5) * ord(c) for i, c in enumerate(key)) * 6571) % 983) / 197 - 0.05

    follows = lambda a, b: b[0] in STATES[a[0]] and (a[0] in "ES" or a[2:] == b[2:])
    model = toy()
    model.tag_start = {s: h("p" + s) for s in states if s[0] in "BS"}
    model.tag_trans1 = {f"{a}{SEP}{b}": h("q" + a + b) for a in states for b in states if follows(a, b)}
    model.tag_trans2 = {f"{a}{SEP}{b}{SEP}{c}": h("r" + a + b + c) for a in states for b in states for c in states if follows(a, b) and follows(b, c)}
    model.tag_emit = {s + c: h("x" + s + c) for s in states for c in chars}
    model.tag_unk = {s: -9.0 for s in states}
    model.tags = {"甲乙": {"n": -0.3, "v": -1.4}, "乙": {"v": -0.1}}
    return model


def test_tagger_against_every_assignment():
    model = joint_toy()
    for words in (w for n in range(1, 5) for w in itertools.product(("甲", "乙", "甲乙", "乙甲", "乙甲乙"), repeat=n)):
        best = None
        for tags in itertools.product(*(sorted(model.tags.get(w, {"n": 0, "v": 0})) for w in words)):
            score, ctx = 0.0, ()
            for w, t in zip(words, tags):
                inside, ctx = tag_score(model, w, t, model.tags[w][t] if w in model.tags else None, ctx)
                score += inside
            if best is None or score > best[0] + 1e-12:
                best = (score, list(tags))
        assert tag_words(model, list(words)) == best[1]


def test_second_order_context_decides():
    """Equal in the first order; only the pair of states before favours n, v, n."""
    model = BmesModel({}, {}, {}, {}, {}, {}, {})
    model.tags = {w: {"n": 0.0, "v": 0.0} for w in "甲乙丙"}
    model.tag_start = {"S-n": 0.0, "S-v": -1.0}
    model.tag_trans1 = {f"S-{a}{SEP}S-{b}": 0.0 for a in "nv" for b in "nv"} | {f"S-n{SEP}S-v": 0.1}
    model.tag_trans2 = {f"S-{a}{SEP}S-{b}{SEP}S-{c}": -1.0 for a in "nv" for b in "nv" for c in "nv"} | {f"S-n{SEP}S-v{SEP}S-n": 0.0}
    assert tag_words(model, list("甲乙丙")) == ["n", "v", "n"]


def test_anchors_and_merges():
    model = toy({"甲乙": -1.0})
    model.mixed = {"a甲": -2.0, "a甲乙": -9.0, "甲乙甲": -1.0}
    assert [(t, k) for t, k in ((x[0], x[4]) for x in [("xa甲乙甲"[a:b], None, a, b, k) for a, b, k in cut(model, "xa甲乙甲")])][:2] == [("x", "Eng"), ("a甲乙", "Word")]
    assert anchors(model, "甲乙甲乙甲") == [(0, 3)] and anchors(toy(), "a甲") == []
    words = lambda *x: [(sum(map(len, x[:i])), sum(map(len, x[: i + 1])), "Word") for i in range(len(x))]
    text = "三個月"
    assert post_merge(text, words("三", "個", "月"), measure=True) == [(0, 3, "Time")]  # the higher priority wins
    assert post_merge("三個人", words("三", "個", "人")) == words("三", "個", "人")
    assert post_merge("三個人", words("三", "個", "人"), measure=True) == [(0, 2, "Num"), (2, 3, "Word")]
    assert select_merges([(0, 2, "a", 200), (0, 3, "b", 300), (2, 4, "c", 300), (3, 5, "d", 200)]) == [(0, 3, "b", 300), (3, 5, "d", 200)]
    for w in (("一起",), ("十分",), ("唯一", "年度")):
        assert post_merge("".join(w), words(*w)) == words(*w)
