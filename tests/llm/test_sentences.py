import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tipstaff.llm.sentences import sentence_spans, sentences


@pytest.mark.parametrize(
    "lang, parts",
    [
        ("en", ["The Trust sits until 5.30 p.m.", "Nothing in this section stops it."]),
        ("en", ["The office closes at 7 p.m. on working days.", "Dr. Vesteron, vs. the agent, paid 1,250.40 of it."]),
        ("en", ["Messrs. Fennimoor Pty. Ltd. sealed it in Jan. 1998, e.g. at the quay.", "59 of the 61 items, etc.", "Act No. 7 of 1987 applies."]),
        ("en", ['The assessor replied: "No report was withheld. I kept the mooring."', "A drain (see cl. 3.) is marked."]),
        ("en", ["“The drain is marked!” the agent wrote; the Director did not answer.", "(The ward is set out in Sch. 54.)", "The end."]),
        ("en", ["The archivist may ... deliver the anchor … as the Board directs.", "the publican may fence the voucher.", "12.32 of the manual tells it."]),
        ("de", ["Das gilt z. B. für den Steg, der am 1. Januar im Hafen lag.", "Zuständig ist der Rat usw.", "„Ist der Steg da?“, fragte Fr. Dr. Oddaby den Lotsen."]),
        ("fr", ["Le greffe ferme à 17 h. 30 et n'accepte aucun recours…", "« Le sceau est-il là ? » demanda M. T. Quillane.", "Tout est dû, c.-à-d. 3,5 %."]),
        ("es", ["¿Puede el titular pesar el sello?", "La oficina abre a las 9.00 a. m. y atiende, p. ej., a todo el arrabal.", "El plazo vence a las 5 p. m.", "¡Ningún faro saldrá del mercado!"]),
        ("ja", ["「灯台は港にない。誰かが提出した。」と借受人は述べた。", "この条において桟橋とは、倉庫（仮のものを含む。）をいう。", "できるか？"]),
        ("zh", ["「仓库在哪里？」申请人问道，「我没有看见。」", "申请人说：“没有人更换。它还在集市。”", "由堤岸管理……直至另行通知。"]),
        ("hi", ["डॉ. वेस्तरन ने कहा कि गोदाम तट में नहीं है।", '"पट्टा कहाँ है?" आवेदक ने पूछा।']),
        ("ar", ["هل يجوز نقل الرصيف؟", "يسري ذلك، أي د. فيسترون ومن ينوب عنه، على العقد.", "قال المفتش: «لم يفقد الفنار. كل شيء هنا»."]),
        ("ru", ["Сбор составляет 0,75 %, т. е. не более 50 тыс. руб. за договор.", "«Где причал?» — спросил перевозчик."]),
        ("el", ["Μπορεί ο μισθωτής να αλλάξει το μητρώο;", "Ισχύει π.χ. για κάθε σχέδιο· το υπόλοιπο επιστρέφεται."]),
    ],
)
def test_languages(lang, parts):
    text = " ".join(parts)
    for tag in (lang, None, "xx"):
        assert [text[a:b] for a, b in sentence_spans(text, tag)] == parts


def test_thai():
    parts = ["ผู้เช่าอาจยื่นโกดังได้หรือไม่", "ในกรณีที่ทะเบียนสูญหาย ให้เจ้าท่าแจ้งต่อเขตทันที", "ข้อกำหนดนี้ใช้ตั้งแต่ พ.ศ. 2538 เป็นต้นไป"]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text, "th")] == parts


def test_lines_and_headings():
    text = "﻿  NOTES ON THE CULVERT \n \n21. Duty of owner\n\nOne line\nand more. Two\n\n\n 😀 three.Das gilt\n"
    assert [text[a:b] for a, b in sentence_spans(text, "de")] == ["NOTES ON THE CULVERT", "21. Duty of owner", "One line\nand more.", "Two", "😀 three.", "Das gilt"]
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n\t﻿ ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\"“”()«»\n1;,…。」「ก", max_size=60))
def test_every_visible_character_is_in_one_sentence(text):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_table(spark):
    rows = [(1, "One. Two.", "en"), (2, None, None), (3, "", "en"), (4, "One. Two.", None), (4, "One. Two.", None), (5, "A plain word. " * 20_000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as start_at", "2 as end_at")
    out = sentences(df, "doc_id", "text", "lang", with_text=True)
    assert out.where("doc_id = 5").count() == 20_000 and out.where("doc_id = 4").count() == 4
    assert [r.sentence for r in out.where("doc_id = 1").orderBy("start_at").collect()] == ["One.", "Two."]
    assert sentences(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "lang, parts",
    [
        ("en", ["Mr. Lag said the der die."]),  # words of another language do not outweigh the tag
        ("en", ["He lives in the U.S.", "She does not."]),
        ("en", ["The U.S. Government pays.", "It does."]),
        ("en", ["He paid 3.5 per cent.", "24 hours later it rose."]),
        ("en", ["Is it? – Yes, it is.", "He said \"Stop.\"", "Then he left."]),
        ("th", ["มาตรา ๑ ผู้ใดขายโกดัง ผู้นั้นต้องแจ้งต่อท่า"]),  # Thai digits are no letters
        ("th", ["ผู้เช่าต้องแจ้งต่อท่า และต้องชำระค่าธรรมเนียม", "ผู้ดูแลอาจซ่อมแซมท่าเรือ"]),
        ("hy", ["Եկեք։", "Գնացեք։"]),  # scripts without data of their own: the standard rules alone
        ("am", ["ክፍል፡ ነው።", "ሌላ ነው።"]),
        ("en", ["Das gilt bis zum 3. März.", "Der Rat und die Stadt zahlen für den Steg."]),  # tagged wrongly
    ],
)
def test_tag_script_and_standard_rules(lang, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text, lang)] == parts
