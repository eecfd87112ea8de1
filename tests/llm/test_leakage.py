import itertools
import random

import numpy as np

from textloom.llm.leakage import BROADCAST_SEEDS, MASKS, Scanner, bare_tokens, leaked_items, least_hits, mask_of, seed_hashes, token_hashes, without_instruction

ITEM = "據里長轉述，望潮里的夜間圖書館將在十二月重新開放，屆時會展示一百二十件地方手稿，並且邀請三位館長輪流導覽，為期兩個月。"
ENGLISH = "Why was the outdoor permit repaired before the winter lexicon in Port Essel? Half of the annual dictionary had been rejected by the uneven ledger crew, and nobody asked the librarian about it."


def found(text, items=(ITEM, ENGLISH)):
    return [(k, round(s, 2)) for _, k, s, _ in Scanner(list(range(len(items))), list(items), 0.5, 0.15).scan([text])]


def test_whole_and_disguised():
    assert found("前文。" + ITEM + "後文。") == [(0, 1.0)]
    assert found("前文" + ITEM.replace("，", " \n").replace("十", "⼗") + "後文") == [(0, 1.0)]
    assert found("x " + ENGLISH.upper().replace(" ", "").replace("?", "") + " y") == [(1, 1.0)]
    assert found("z" + ENGLISH.replace("outdoor", "open-air").replace("librarian", "keeper").replace("a", "а"))[0][1] >= 0.9


def test_half_and_less():
    assert [k for k, _ in found("無關的開頭。" + ITEM[: int(len(ITEM) * 0.6)] + "無關的結尾。")] == [0]
    assert found("無關的開頭。" + ITEM[: int(len(ITEM) * 0.3)] + "無關的結尾。") == []
    assert found("無關的文字，沒有任何題目。") == [] and found("") == []


def test_scattered_pieces_are_no_passage():
    pieces = [ITEM[i : i + 12] for i in range(0, len(ITEM) - 12, 12)]
    random.Random(3).shuffle(pieces)
    assert found("。完全無關的填充文字在這裡，內容很長很長，一直說個不停，真的沒有結束的時候，還要再說一些別的話才行。".join(pieces)) == []


def test_holes_hide_changes():
    mask = MASKS[0][1]
    for one, other in (("一二三四五六", "一二變四五六"), ("one two three four five six", "one two CHANGED four, five six!")):
        a, b = (token_hashes(*bare_tokens(x)) for x in (one, other))
        assert len(a) == 6 and mask[2] == "0" and np.array_equal(seed_hashes(a, mask), seed_hashes(b, mask))


def test_no_passage_leaves_fewer_hits():
    """Every placement of the allowed changes for small passages, random ones for large."""
    rng = random.Random(1)
    for size in range(1, 260):
        mask, least, want = mask_of(size), least_hits(size, 0.5, 0.15), -(-size // 2)
        for n in range(want, min(size, want + 8) + 1):
            k = int(n * 0.15)
            places = itertools.combinations(range(n), k) if n < 18 else ([i * n // k for i in range(k)] if t == 0 else rng.sample(range(n), k) for t in range(30))
            for place in places:
                changed = set(place)
                hits = sum(all(i + j not in changed for j, bit in enumerate(mask) if bit == "1") for i in range(n - len(mask) + 1))
                assert hits >= least or size < 7 and hits >= 1, (size, n, place)


def _changed(text, every, rng):
    out = list(text)
    for i in [i for i, c in enumerate(out) if c != " "][every - 1 :: every]:
        out[i] = rng.choice("甲乙丙丁戊己庚辛") if ord(out[i]) > 0x2E80 else rng.choice("qzxj")
    return "".join(out)


def test_recall_up_to_the_limit():
    """Passages of a bit over half an item, with changes up to 15 % spread evenly, at random and in clusters."""
    rng = random.Random(5)
    han, words = "據里長轉述望潮的夜間圖書館將在十二月重新開放屆時會展示一百件地方手稿並且邀請三位輪流導覽", "the outdoor permit was repaired before winter lexicon in port half of annual dictionary had been rejected by uneven ledger crew nobody asked about it".split()
    items = ["".join(rng.choices(han, k=rng.randint(60, 120))) for _ in range(30)] + [" ".join(rng.choices(words, k=rng.randint(55, 90))) for _ in range(30)]
    scanner = Scanner(list(range(60)), items, 0.5, 0.15)
    for kind in ("even 7", "even 8", "even 10", "random", "clustered"):
        texts = []
        for t in items:
            part = t[len(t) // 5 : len(t) // 5 + int(len(t) * 0.58)]
            if kind.startswith("even"):
                part = _changed(part, int(kind[5:]), rng)
            else:
                k = int(len(part) * 0.13)
                at = rng.sample(range(len(part)), k) if kind == "random" else [x for b in rng.sample(range(0, len(part) - 4, 4), k // 4) for x in range(b, b + 4)]
                part = "".join(rng.choice("甲乙丙丁" if ord(c) > 0x2E80 else "qzxj") if i in set(at) and c != " " else c for i, c in enumerate(part))
            texts.append("無關的前文。" + part + "。無關的後文")
        got = {(r, k) for r, k, _, _ in scanner.scan(texts)}
        recall = sum((i, i) in got for i in range(60)) / 60
        assert recall >= 0.9, (kind, recall)


def test_tables(spark):
    lead = "請為下文撰寫摘要："
    items = spark.createDataFrame([(1, lead + ITEM, "x"), (2, lead + "甲" * 60, "x"), (3, lead + "乙丙" * 30, "x"), (4, None, "x"), (None, "丁", "x"), (5, "短", "x")], "key long, text string, item_id string")
    assert {r["key"]: r["text"] for r in without_instruction(items, "key", "text").collect()}[1] == ITEM
    docs = spark.createDataFrame([(7, "開頭" + ITEM, "x"), (7, "開頭" + ITEM, "x"), (8, None, "x"), (9, "", "x"), (10, lead + "別的內容", "x"), (11, "長" * 300000 + ITEM, "x")], "key long, text string, item_id string")
    for bound in (BROADCAST_SEEDS, 0):  # seeds sent to the tasks, and seeds joined
        got = sorted((r["key"], r["item_id"]) for r in leaked_items(docs, "key", "text", items, "key", "text", broadcast_seeds=bound).collect())
        assert got == [(7, 1), (7, 1), (11, 1)]
        short = spark.createDataFrame([(1, "短 文"), (2, "one two three four five")], "key long, text string")
        some = spark.createDataFrame([(1, "很短文字"), (2, "One two, three. four FIVE six"), (3, "one two four")], "key long, text string")
        assert sorted((r["key"], r["item_id"]) for r in leaked_items(some, "key", "text", short, "key", "text", broadcast_seeds=bound).collect()) == [(1, 1), (2, 2)]
    assert leaked_items(docs.where("false"), "key", "text", items, "key", "text").count() == 0
    assert leaked_items(docs, "key", "text", items.where("false"), "key", "text").count() == 0
