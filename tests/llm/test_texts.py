import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import pieces, sentences

WHITE = "\t-\r \x85\xa0  -     　"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "End.", "Mr.", "what?", "\n\n", "\n", " ", " ", "x", "</p>", "e.g.", "A", "¿Y"]), max_size=120), st.integers(5, 20), st.integers(0, 4))
def test_pieces_cover_and_overlap(parts, limit, overlap):
    text = " ".join(parts)
    starts, ends = pieces.word_spans(text)
    words = re.findall(rf"[^{WHITE}]+", text)
    assert [text[a:b] for a, b in zip(starts, ends)] == words
    spans = pieces.cut(text, limit, overlap)
    assert bool(spans) == (len(words) > limit)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(words) and all(0 < b - a <= limit for a, b in spans)
        assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(spans, spans[1:]))


def test_cut_prefers_paragraphs_then_sentences():
    text = "aa bb cc.\n\ndd ee ff. Gg h i j k l m n"
    assert pieces.cut(text, 8, 2)[0] == (0, 3)
    assert pieces.cut("aa bb cc dd. Ee f g h i j k l m n", 8, 2)[0] == (0, 4)
    assert pieces.cut("a b c d e f g h i j k l", 8, 2)[0] == (0, 8)
    assert pieces.cut("to Mr. B c d e f g h i j", 8, 2)[0] == (0, 8)


def test_piece_rows(spark):
    rows = [("a", "w " * 801, 5), ("a", "w " * 801, 5), ("b", "w " * 800, 9999), ("c", None, None), ("d", "", 0), ("e", "x" * 5000, 1)]
    df = spark.createDataFrame(rows, "id string, content string, word_count int")
    assert [r["chapter_id"] for r in pieces.oversized(df).collect()] == ["a"]
    got = pieces.chapter_pieces(df).orderBy("piece_no").collect()
    assert [(r["piece_no"], r["word_count"]) for r in got] == [(0, 800), (1, 51)]
    assert pieces.oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(df, limit=5, overlap=5)


CASES = [
    ('"It is late. We must go," said Ann, closing the box. They left.', ['"It is late. We must go," said Ann, closing the box.', "They left."]),
    ('"Stop! Come back!" cried Ann. What?! The cat left?!', ['"Stop! Come back!" cried Ann.', "What?!", "The cat left?!"]),
    ("The sign read “Roth & Sons, Inc.” The file map.v2.txt is at shelf.example.It rained.", ["The sign read “Roth & Sons, Inc.”", "The file map.v2.txt is at shelf.example.", "It rained."]),
    ("Mr. Roth paid 3.50, i.e. a lot... and left. We met at 6 a.m. near it. It ended at 5 p.m. The U.K. team won.", ["Mr. Roth paid 3.50, i.e. a lot... and left.", "We met at 6 a.m. near it.", "It ended at 5 p.m.", "The U.K. team won."]),
    ("He sat (the day was hot!) and slept. (It was late.) J. R. Roth woke.", ["He sat (the day was hot!) and slept.", "(It was late.)", "J. R. Roth woke."]),
    ("Title\n\nDear Dr. Roth,\n\nOne line\nbreak. Two.\n\nYours, Ann", ["Title", "Dear Dr. Roth,", "One line\nbreak.", "Two.", "Yours, Ann"]),
    ("1. “Ann sat.” Why is that?\n2) puzzle: a thing.\n(3) Why?", ["1. “Ann sat.”", "Why is that?", "2) puzzle: a thing.", "(3) Why?"]),
    ("Am 3. Mai fand Jo die 2. Karte. Dr. Jo trug z. B. eine, d. h. mehr. „Komm! Es ist spät“, rief Jo. „Das war es.“ Ende.", ["Am 3. Mai fand Jo die 2. Karte.", "Dr. Jo trug z. B. eine, d. h. mehr.", "„Komm! Es ist spät“, rief Jo.", "„Das war es.“", "Ende."]),
    ("« Viens ! Il est tard », dit Jo. Quelle lune ! « Où ? » demanda Jo. Jo cria : « La clé ! » Voir p. 12, oui.", ["« Viens ! Il est tard », dit Jo.", "Quelle lune !", "« Où ? » demanda Jo.", "Jo cria : « La clé ! »", "Voir p. 12, oui."]),
    ("¡Ay!, ¿Y la luna? —¿Vienes? —preguntó Jo. El Sr. Jo fue. A las 8 a. m. Jo dormía.", ["¡Ay!, ¿Y la luna?", "—¿Vienes? —preguntó Jo.", "El Sr. Jo fue.", "A las 8 a. m. Jo dormía."]),
    ("«Где река?» — спросила Аня. В 1820 г. Аня пела. Весит 2,5 кг. Стр. 14.", ["«Где река?» — спросила Аня.", "В 1820 г. Аня пела.", "Весит 2,5 кг.", "Стр. 14."]),
    ("乔林说：“你好。我是米卡。”塔雅……停下了。“快来！天黑了。”米卡说。“花园！”塔雅问：“是吗？”真的吗？！2.5米长。", ["乔林说：“你好。我是米卡。”", "塔雅……停下了。", "“快来！天黑了。”米卡说。", "“花园！”", "塔雅问：“是吗？”", "真的吗？！", "2.5米长。"]),
    ("「早く来て。もう遅いよ。」とベノが言った。「橋だ！」ミルカは「ありがとう！」と笑った。", ["「早く来て。もう遅いよ。」とベノが言った。", "「橋だ！」", "ミルカは「ありがとう！」と笑った。"]),
    ("ตะเกียงหนัก 2.5 กิโลกรัม เรืออยู่ที่ไหน", ["ตะเกียงหนัก 2.5 กิโลกรัม", "เรืออยู่ที่ไหน"]),
    ("डॉ. मिरका ने 3.5 किलो उठाया। “आओ! देर हो गई,” बेनो ने कहा। नाव कहाँ है?", ["डॉ. मिरका ने 3.5 किलो उठाया।", "“आओ! देर हो गई,” बेनो ने कहा।", "नाव कहाँ है?"]),
    ("قال ميركا: «تعال! تأخر الوقت». وجد د. بينو الكتاب. أين الجسر؟ «القارب!» نام.", ["قال ميركا: «تعال! تأخر الوقت».", "وجد د. بينو الكتاب.", "أين الجسر؟", "«القارب!»", "نام."]),
    ("Πού είναι; Ο κ. Βενώ, κ.λπ. ήταν εδώ· ναι. Τέλος", ["Πού είναι;", "Ο κ. Βενώ, κ.λπ. ήταν εδώ· ναι.", "Τέλος"]),
    ("No mark at the end", ["No mark at the end"]),
    ("  \n \t ", []),
    ("", []),
    (None, []),
    ("\ue000 private\ue010 use. Ends", ["\ue000 private\ue010 use.", "Ends"]),
    ("𝒜bc 🙂. Next one", ["𝒜bc 🙂.", "Next one"]),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string, sentence string")
    got = {}
    for r in sentences.document_sentences(df).orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (text, want) in enumerate(CASES):
        rows = got.get(i, [])
        assert [r["sentence"] for r in rows] == want, text
        assert [text[r["start_pos"] : r["end_pos"]] for r in rows] == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list('ab. AB!?"“”«»()\n　。、；;…0')), max_size=80), min_size=20, max_size=20))
def test_sentences_cover_everything(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    covered = {i: "" for i in range(len(texts))}
    for r in sentences.found(df).orderBy("doc_id", "start_pos").collect():
        piece = texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]
        assert piece == piece.strip() and piece
        covered[r["doc_id"]] += piece
    for i, text in enumerate(texts):
        assert re.sub(r"\s", "", covered[i]) == re.sub(r"\s", "", text)


def test_long_document(spark):
    text = "One sentence here. " * 4000 + "\n\n" + "x" * 20000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert sentences.found(df).count() == 4001
