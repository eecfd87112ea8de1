import pytest

from textloom.llm.sentences import Corpus, sentence_ends, sentence_units

CASES = [
    ("今天下雨。我們在家！真的嗎？", ["今天下雨。", "我們在家！", "真的嗎？"]),
    ("里長說：「我們取消了。明天再來。」大家散了。", ["里長說：「我們取消了。明天再來。」", "大家散了。"]),
    ("「好嗎？」他反問，「那就是了！」票價漲了。", ["「好嗎？」他反問，「那就是了！」", "票價漲了。"]),
    ("『不是這個。』這句話是他寫的。", ["『不是這個。』這句話是他寫的。"]),
    ("最後……，還是走了。", ["最後……，還是走了。"]),
    ("沒有標點 也算一句\n第二行；同一句", ["沒有標點 也算一句", "第二行；同一句"]),
    ("1. 第一項。2. 第二項。", ["1. 第一項。", "2. 第二項。"]),
    ("走了。ver.3.32の表は便利です！", ["走了。", "ver.3.32の表は便利です！"]),
    ('He said: "We left. It was late." Dr. Hall\'s team stayed until 6 p.m. before noon.', ['He said: "We left. It was late."', "Dr. Hall's team stayed until 6 p.m. before noon."]),
    ('"We never left," said the clerk, "but it was ours." On Monday it closed.', ['"We never left," said the clerk, "but it was ours."', "On Monday it closed."]),
    ('"Is it ready?" asked the keeper. No.', ['"Is it ready?" asked the keeper.', "No."]),
    ("It closes at 9 p.m. Prices rose 84.33 percent, i.e. more. By 8 p.m., we left. Prices fell.", ["It closes at 9 p.m.", "Prices rose 84.33 percent, i.e. more.", "By 8 p.m., we left.", "Prices fell."]),
    ("The U.S. edition, vol. 3, sold approx. 5 at No. 2. Mr. Bell vs. St. Orla... not now.", ["The U.S. edition, vol. 3, sold approx. 5 at No. 2.", "Mr. Bell vs. St. Orla... not now."]),
    ("Am 3. Mai kam z. B. Nr. 5. Wo ist er?", ["Am 3. Mai kam z. B. Nr. 5.", "Wo ist er?"]),
    ("¿Dónde está? ¡Qué guía! El Sr. guía vio 3.", ["¿Dónde está?", "¡Qué guía!", "El Sr. guía vio 3."]),
    ("أين السوق؟ فتحت في 40377. ثم السوق!", ["أين السوق؟", "فتحت في 40377.", "ثم السوق!"]),
    ("डॉ. साहब ने देखा। कहाँ है?", ["डॉ. साहब ने देखा।", "कहाँ है?"]),
    ("วันนี้ปิดครับ ราคา 67 บาทค่ะ", ["วันนี้ปิดครับ", "ราคา 67 บาทค่ะ"]),
    ("3.5배 늘었다. 언제 여나요?", ["3.5배 늘었다.", "언제 여나요?"]),
    ("未閉合「引號。下一句。", ["未閉合「引號。", "下一句。"]),
    ("ａ　ｐ.ｍ​.　", ["ａ　ｐ.ｍ​."]),
    ("", []),
    (" \n\t ", []),
]


@pytest.mark.parametrize("text,units", CASES)
def test_units(text, units):
    got, a = [], 0
    for e in sentence_ends(text):
        got.append(text[a:e].strip())
        a = e
    assert got == units


def test_corpus_fallback():
    text = "They met at the dept. Kestrel hall."
    assert len(sentence_ends(text)) == 2
    assert len(sentence_ends(text, Corpus(frozenset(["dept"]), frozenset(["Kestrel"])))) == 1


def test_table(spark):
    rows = [(1, "甲。乙。", "x"), (1, "甲。乙。", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (4, "長。" * 50000, "x")]
    df = spark.createDataFrame(rows, "key long, text string, sent_no string")
    got = [tuple(r) for r in sentence_units(df, "key", "text").collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 2), (1, 0, 2), (1, 1, 4), (1, 1, 4)]
    assert sum(x[0] == 4 for x in got) == 50000 and (None, 0, 1) in got and not any(x[0] in (2, 3) for x in got)
    assert sentence_units(df.where("false"), "key", "text").count() == 0

def test_document_evidence(spark):
    rows = [(1, "d", "See the tel. of Kestrel, or ask."), (2, "d", "Their tel. Kestrel hall."), (3, "e", "Their tel. Kestrel hall."), (4, None, "Their tel. Kestrel hall.")]
    df = spark.createDataFrame(rows, "key long, doc string, text string")
    got = sentence_units(df, "key", "text", Corpus(), "doc").groupBy("key").count().collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 1, 3: 2, 4: 2}


def test_evidence_before_the_fixed_list():
    assert len(sentence_ends("There is no way. He said no. We left.")) == 3
    assert len(sentence_ends("There is no way. See No. 5. Mr. Bell rang the bell.")) == 3


def test_a_number_may_open_a_sentence():
    assert len(sentence_ends("So the paper claims. 3 rows came. So it claims. We left.")) == 4


def test_corpus_counts_all_rows(spark):
    # Neighbouring words count both, as do rows without a period and words of other scripts.
    rows = [(f"t{i}", "They saw the dept. of all.") for i in range(5)] + [(f"n{i}", "we met, Kestrel Orlan and Marlow") for i in range(5)]
    rows += [("veto", "a marlow there"), ("x", "Their dept. Orlan hall."), ("y", "Their dept. Marlow hall.")]
    rows += [(f"c{i}", "они жили на ул. у реки, где Ленский") for i in range(5)] + [("z", "Его ул. Ленский дом.")]
    rows += [(f"w{i}", "there is no way") for i in range(5)] + [("no", "He said no. We left.")]
    df = spark.createDataFrame(rows, "key string, text string")
    got = dict(map(tuple, sentence_units(df, "key", "text").groupBy("key").count().collect()))
    assert (got["x"], got["y"], got["z"], got["no"]) == (1, 2, 1, 2)


@pytest.mark.parametrize(
    "text,units",
    [
        ("Я живу на ул. Ленина. Там тихо.", 2), ("Ο κ. Παπαδόπουλος ήρθε. Μετά έφυγε.", 2), ("La Dra. Pérez llegó. Luego salió.", 2), ("Vivo en Av. Juárez. Es lejos.", 2),
        ("Τι κάνεις; Είμαι καλά.", 2), ("Was it late; It was not.", 1), ("One; Two; Three.", 1),
    ],
)
def test_other_scripts(text, units):
    assert len(sentence_ends(text)) == units
