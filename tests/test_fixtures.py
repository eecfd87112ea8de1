"""Operators without an SQL twin, and rules the twins cannot say, against plain Python on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.signals import SCORE_WEIGHTS, signal_count, signal_score
from textloom.operators import documents as D
from textloom.operators.lexicon import dict_matches

TEXTS = [
    "使用GPU加速 GPU 與 CPU、NT$5,000元，2024年3月5日，約30 kg", "Jan 5, 2024 at New York City and `code.py`", "呼叫 foo_bar 與 std::io，台灣大學的a.b.c", "完全沒有信號的句子", "API", "中API文 (WHO) 3%", "", "Ünited Nations Übung ABC",
]


def _python(name):
    return re.compile(spec.SIGNALS[name].replace(r"\p{Han}", "㐀-鿿豈-﫿"))


def test_signals_have_word_boundaries_of_all_scripts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for name in spec.SIGNALS:
        got = {r[0]: r[1] for r in df.select("i", signal_count(F.col("t"), name)).collect()}
        assert got == {i: sum(1 for _ in _python(name).finditer(t)) for i, t in enumerate(TEXTS)}, name


def test_signal_score_uses_all_weights(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    has = lambda t, *names: any(_python(n).search(t) for n in names)
    want = {i: round(min(1.0, sum(w for n, w in SCORE_WEIGHTS.items() if has(t, *(("proper_en", "proper_cjk") if n == "proper" else (n,))))), 6) for i, t in enumerate(TEXTS)}
    assert {r[0]: round(r[1], 6) for r in df.select("i", signal_score(F.col("t"))).collect()} == want


def test_a_comma_before_a_line_break(spark):
    texts = ["如果下雨，\n我們就不去。", "今天下雨，\n我們不去。", "世界衛生組織（WHO），\n發表聲明。", "甲，\n\n乙"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: [texts[r[0]][x["start"] : x["end"]] for x in r[1]] for r in df.select("i", D.sentences_column(F.col("t"))).collect()}
    assert got == {0: ["如果下雨，\n我們就不去。"], 1: ["今天下雨，", "我們不去。"], 2: ["世界衛生組織（WHO），\n發表聲明。"], 3: ["甲，", "乙"]}
    dependent = [r[0] for r in spark.createDataFrame([(x,) for x in ("世界衛生組織（WHO），", "組織（W1），", "先生說，", "先走，", "今天，")], "x string").select(D.depends_sql("x")).collect()]
    assert dependent == [D.depends(x) for x in ("世界衛生組織（WHO），", "組織（W1），", "先生說，", "先走，", "今天，")] == [True, False, False, True, False]


def test_dictionary_words_of_any_length(spark):
    words = ["台灣", "台灣大學", "國立台灣大學附屬醫院癌症中心", "大學", "甲" * 255]
    texts = [(1, "臺灣大學在國立臺灣大學附屬醫院癌症中心旁"), (2, None), (3, ""), (4, "甲" * 256)]
    got = sorted((r["k"], r["start"], r["word"]) for r in dict_matches(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(w,) for w in words], "word string")).collect())
    want = sorted((k, i, w) for k, t in texts if t for w in words for i in range(len(t)) if t.replace("臺", "台").startswith(w, i))
    assert got == want and any(len(w) == 255 for *_, w in got)


# ---------------------------------------------------------------- summaries
NOTES = "# Notes\n\nResearch conclusion: Data must not leave.\n\n```ts\nconst x = 1;\n```\n\n- Keep USD 20."


def _documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_summary_contract(spark):
    blocks, docs = D.summary_documents(_documents(spark, [NOTES, None, "", "   \n\n"]), "id", "text", max_blocks=1, threshold=0.0)
    b = blocks.orderBy("block").collect()
    assert [r["kind"] for r in b] == ["heading", "paragraph", "fenced-code", "unordered-list-item"]
    assert [r["decision"] for r in b] == ["context_only", "select_exact", "preserve_exact", "preserve_exact"]
    d = docs.collect()
    assert [(r["doc"], r["summary"], r["selected"], r["preserved"], r["forced"], r["output_blocks"], r["reduction"]) for r in d] == [(0, NOTES, 1, 2, 0, 4, 0.0)]
    counts = D.with_signals(blocks, "body").select("block", *D.signal_counts(F.col("spans"))).orderBy("block").collect()
    assert [r["negation"] for r in counts] == [0, 1, 0, 0] and [r["money"] for r in counts] == [0, 0, 0, 1]


def test_long_blocks_give_their_best_clauses(spark):
    filler = "這一句話只是普通的敘述缺少任何重點而且寫得相當長，主要是為了讓整個段落超過規定的字數限制才寫在這裡的。"
    text = f"{filler}因此結論是收入增加了NT$5,000元。{filler}{filler}結果顯示市府計畫有效。絕對不要忘記這一點。{filler}{filler}"
    item = "- 短項目\n\n---\n\n"
    blocks, docs = D.summary_documents(_documents(spark, [item + text]), "id", "text", max_blocks=2, threshold=0.0)
    rows = {r["block"]: r for r in blocks.collect()}
    assert rows[0]["decision"] == "preserve_exact" and rows[1]["decision"] == "context_only" and rows[2]["decision"] == "summarize_within"
    assert rows[2]["output"] == "因此結論是收入增加了NT$5,000元。 結果顯示市府計畫有效。 絕對不要忘記這一點。"
    d = docs.first()
    assert d["summary"] == "- 短項目\n\n---\n\n" + rows[2]["output"] and d["output_chars"] == len(d["summary"]) < d["input_chars"] and d["forced"] >= 1


def _plain_headings(blocks):
    """(kind, depth, retained) -> kept headings, by scanning ahead."""
    out = []
    for i, (kind, depth, _) in enumerate(blocks):
        if kind == "heading":
            for other, d, retained in blocks[i + 1 :]:
                if other == "heading" and d <= depth:
                    break
                if retained:
                    out.append(i)
                    break
    return out


def test_headings_and_breaks_stay_with_what_they_belong_to(spark):
    rng = random.Random(7)
    docs = [[(k := rng.choice(["heading", "heading", "paragraph", "paragraph", "thematic-break"]), rng.randint(1, 4) if k == "heading" else 0, k == "paragraph" and rng.random() < 0.4) for _ in range(rng.randint(0, 14))] for _ in range(120)]
    df = spark.createDataFrame([(n, i, *b) for n, d in enumerate(docs) for i, b in enumerate(d)], "doc int, block long, kind string, depth int, retained boolean")
    assert sorted(map(tuple, D.kept_headings(df).collect())) == sorted((n, i) for n, d in enumerate(docs) for i in _plain_headings(d))
    want = [(n, i) for n, d in enumerate(docs) for i, b in enumerate(d) if b[0] == "thematic-break" and any(r for *_, r in d[:i]) and any(r for *_, r in d[i + 1 :])]
    assert sorted(map(tuple, D.kept_breaks(df).collect())) == want and want


def test_children_of_list_items():
    rng = random.Random(3)
    for _ in range(300):
        blocks = [("unordered-list-item" if rng.random() < 0.8 else "paragraph", 0, 0, rng.randint(0, 3)) for _ in range(rng.randint(0, 12))]
        want = [-1] * len(blocks)
        for i, (kind, _, _, depth) in enumerate(blocks):
            if kind == "paragraph":
                continue
            under = []
            for j in range(i + 1, len(blocks)):
                if blocks[j][0] != "paragraph":
                    if blocks[j][3] <= depth:
                        break
                    under.append(j)
            for j in under:
                if blocks[j][3] == min(blocks[k][3] for k in under):
                    want[j] = i
        assert D.list_parents(blocks) == want


def test_candidates_beyond_the_cap(spark):
    n, cap = 1000, 256
    df = spark.createDataFrame([(1, i, "x", (i * 37) % 90, float((i * 7) % 5) / 5, 0.0) for i in range(n)], "doc int, block long, text string, n_terms int, discourse double, signal double")
    got = {r["block"] for r in D.bounded(df, 3).collect()}
    proxy = lambda i: -(0.6 * ((i * 7) % 5) / 5 + 0.1 * min((i * 37) % 90, 100) / 100)
    best = sorted(range(n), key=lambda i: (round(proxy(i), 9), i))[: cap * 3 // 4]
    assert got >= {k * (n - 1) // 63 for k in range(64)} and len(got - {k * (n - 1) // 63 for k in range(64)} - set(best)) <= 3 and len(got) <= cap


def test_signals_as_spans(spark):
    text = "2024年3月5日收入NT$5,000元，成長30 %，不得外洩；不只如此，not only but never。"
    spans = [(r["start"], r["end"], r["kind"]) for r in D.with_signals(_documents(spark, [text]), "text").first()["spans"]]
    assert spans == sorted(set(spans)) and [text[a:b] for a, b, k in spans if k == "negation"] == ["不", "never"]
    quantities = [text[a:b] for a, b, k in spans if k == "quantity"]
    assert quantities == ["30 %"] and [text[a:b] for a, b, k in spans if k == "money"] == ["NT$5,000"]


def test_embedded_code():
    assert D.embedded_code("- a\n    code") and D.embedded_code("- a\n  ```\n  x") and D.embedded_code("- a\n<div>") and not D.embedded_code("- a\n  b") and not D.embedded_code("    a")


def test_keep_first_over_the_folded_key(spark):
    from textloom.functions.text import dedupe_key
    from textloom.operators.corpus import dedup

    df = spark.createDataFrame([(1, "ＡＢＣ 文字"), (2, "abc文字"), (3, "Abc　文 字"), (4, "其他")], "row_id long, text string")
    assert sorted(map(tuple, dedup(df, dedupe_key(F.col("text")), "row_id").collect())) == [(1, 3), (4, 1)]


def test_running_sums_over_the_whole_order(spark):
    from textloom.operators.similarity import global_running

    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    got = sorted((r["rank"], r["i"], r["run"], r["total"]) for r in global_running(spark.createDataFrame(rows, "i int, x int"), [F.desc("x"), F.col("i")], "x").collect())
    want, run = [], 0
    for k, (i, x) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        run += x
        want.append((k, i, run, sum(x for _, x in rows)))
    assert got == want
    assert global_running(spark.createDataFrame([], "i int, x int"), [F.col("i")], "x").count() == 0


# ---------------------------------------------------------------- canonical tokens
def _plain_canonical(tokens, spans, approved, suffixes):
    taken = []
    cand = []
    for s, t, first, last, label, surface in spans:
        if label in spec.NAMED_ENTITIES and approved.get(surface) == label and last > first:
            cand.append((-300, s - t, s, t, first, last, label, surface, "named-entity"))
        elif label in spec.QUANTITY_ENTITIES:
            cand.append((-200, s - t, s, t, first, last, label, surface, "quantity"))
    for c in sorted(cand):
        if all(not (c[2] < o[3] and o[2] < c[3]) for o in taken):
            taken.append(c)
    by_first = {c[4]: c for c in taken}
    out, i = [], 0
    while i < len(tokens):
        if i in by_first:
            _, _, s, t, first, last, label, surface, reason = by_first[i]
            tags = [tag for _, tag, _, _ in tokens[first : last + 1] if tag]
            tag = spec.QUANTITY_TAG[label] if reason == "quantity" else "Nb" if label == "PERSON" or not tags else tags[-1]
            out.append([surface, tag, s, t, reason])
            i = last + 1
        else:
            out.append([*tokens[i], "original"])
            i += 1
    merged = []
    for x in out:
        p = merged[-1] if merged else None
        if p and p[4] == x[4] == "original" and x[0] in spec.NOUN_SUFFIXES and (x[1] or "").startswith("N") and p[0] + x[0] in suffixes:
            merged[-1] = [p[0] + x[0], x[1], p[2], x[3], "noun-suffix"]
        else:
            merged.append(x)
    return [tuple(x) for x in merged]


def test_canonical_tokens(spark):
    from textloom.operators import retokenize as R

    rng = random.Random(9)
    words, tags = ["工程", "師", "員", "家", "三", "隻", "長榮", "公司", "者"], ["Na", "Nb", None, "VC", "Neu"]
    suffixes = {"工程師", "師員", "員家", "家者", "公司員", "三家"}
    approved = {"長榮公司": "ORG", "工程師": "PERSON", "三隻": "ORG", "公司員": "ORG"}
    token_rows, span_rows, want = [], [], {}
    for rid in range(150):
        tokens, at = [], 0
        for _ in range(rng.randint(1, 9)):
            w = rng.choice(words)
            tokens.append((w, rng.choice(tags), at, at + len(w)))
            at += len(w)
        spans = set()
        for _ in range(rng.randint(0, 4)):
            first = rng.randrange(len(tokens))
            last = min(len(tokens) - 1, first + rng.randint(0, 2))
            spans.add((tokens[first][2], tokens[last][3], first, last, rng.choice(["ORG", "PERSON", "CARDINAL", "DATE"]), "".join(t[0] for t in tokens[first : last + 1])))
        token_rows += [(str(rid), i, w, tag, s, t) for i, (w, tag, s, t) in enumerate(tokens)]
        span_rows += [(str(rid), *x) for x in spans]
        want[str(rid)] = _plain_canonical(tokens, spans, approved, suffixes)
    t = spark.createDataFrame(token_rows, "rid string, i long, word string, tag string, s long, t long")
    e = spark.createDataFrame(span_rows, "rid string, s long, t long, first long, last long, label string, surface string")
    a = spark.createDataFrame(list(approved.items()), "surface string, label string")
    selected = R.selected_spans(R.span_candidates(e, a, lambda c: F.lit(True)))
    got = {}
    for r in R.canonical_tokens(t, selected, spark.createDataFrame([(x,) for x in suffixes], "surface string")).orderBy("rid", "position").collect():
        got.setdefault(r["rid"], []).append((r["word"], r["tag"], r["s"], r["t"], r["reason"]))
        assert r["eligible"] == (r["reason"] != "quantity") and (r["canonical"] is not None) == (r["reason"] == "quantity")
    assert got == want and any(x[4] == "noun-suffix" for v in want.values() for x in v)


# ---------------------------------------------------------------- annotators and the second profile
def test_annotators(spark):
    from textloom.operators import annotate as A

    df = spark.createDataFrame([(1, "甲乙"), (2, None), (3, "丙"), (4, "丁")], "id int, text string")
    answers = {"甲乙": (["甲", "乙"], ["n", "v"]), "丙": (["丙", "x"], ["n", "n"]), "丁": (["丁"], [])}
    got = {r["id"]: (r["tokens"], r["error"]) for r in A.preannotated(df, "id", "text", lambda ts: [answers[t] for t in ts], batch=2).collect()}
    assert [(k["text"], k["pos"]) for k in got[1][0]] == [("甲", "n"), ("乙", "v")] and got[1][1] is None
    assert got[2] == (None, "no text") and got[3] == (None, "words do not join to the text") and got[4][1] == "1 words but 0 tags"
    s = A.silver(df.where("id = 1"), "id", "text", lambda ts: [list(t) for t in ts], lambda ws: [["n"] * len(w) for w in ws], lambda ts: [[(1, 2, "X", "乙"), (0, 1, "X", "甲"), (0, 1, "X", "甲"), (2, 2, "X", "")]] * len(ts)).first()
    assert [(e["start"], e["end"]) for e in s["entities"]] == [(0, 1), (1, 2)] and len(s["tokens"]) == 2


def test_second_profile(spark):
    from textloom.operators import profile as R

    rows = [("a", i, w, t) for i, (w, t) in enumerate([("他", "Nh"), ("非常", "Dfa"), ("不", "D"), ("高興", "VH"), ("啊", "T"), ("的", "T")])] + [("b", 0, "很", "Dfa")]
    t = spark.createDataFrame(rows, "rid string, i long, word string, tag string")
    assert sorted(map(tuple, R.compacted(t).collect())) == [("a", "他不高興的", 2), ("b", "很", 0)]
    parts = spark.createDataFrame([("a", i, x, n) for i, (x, n) in enumerate([("p0，", False), ("p1，", False), ("n1、", True), ("n2，", True), ("p2，", False), ("n3、", True), ("n4。", True), ("p3", False), ("n5", True)])], "rid string, part long, text string, nominal boolean")
    assert [(r["first"], r["last"]) for r in R.merged_enumerations(parts).orderBy("first").collect()] == [(0, 0), (1, 6), (7, 7), (8, 8)]
    texts = spark.createDataFrame([("a", i, "一二三四五六七八九十" * 3, s) for i, s in enumerate([0.0, 1.0, 0.5, 0.0])] + [("b", i, "短", 1.0) for i in range(4)], "rid string, part int, text string, signal double")
    got = R.compressed(texts).orderBy("part").collect()
    assert [r["kept"] for r in got] == [False, True, True, False] and {r["rid"] for r in got} == {"a"}
