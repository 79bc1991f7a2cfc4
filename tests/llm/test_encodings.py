import pytest

from codeloom.llm.encodings import damaged_words, read_as, restore
from tests.conftest import rows

SCHEMA = "doc_id long, text string, source string, word string, cipher int"
CLEAN = ["Die Übergabe löscht größere Änderungen für spätere Prüfung", "la requête répète chaque clé déjà vue à l’étape légère", "La función añadió más líneas según la petición única", "Каждая задача пишет новую запись после ошибки", "ścieżka zwróciła więcej błędów niż zależność", "この設定は古い索引を更新する。"]


def wrong(t, true, page):
    return t.encode(true).decode(page, errors="ignore" if page == "x" else "strict")


def corpus(spark, extra):
    docs = [(i, CLEAN[i % len(CLEAN)] + f" {i}", "docs" if i % 2 else None) for i in range(600)]
    return spark.createDataFrame([(*x, "clash", 1) for x in docs + extra], SCHEMA)


def test_found_and_restored(spark):
    bad = [(9001, wrong(CLEAN[0], "utf-8", "latin-1"), "docs"), (9002, wrong(CLEAN[1], "utf-8", "mac_roman"), "docs"), (9003, wrong(wrong(CLEAN[2], "utf-8", "latin-1"), "utf-8", "latin-1").replace("\x83", "ƒ").replace("\x82", "‚"), None), (9004, wrong(CLEAN[3], "koi8_r", "cp1251"), "docs"), (9005, wrong(CLEAN[3], "cp1251", "cp1252"), "docs"), (9006, wrong(CLEAN[3], "utf-8", "cp866"), None), (9007, "l�schen und weiter", "docs"), (9008, wrong(CLEAN[5], "euc_jp", "latin-1"), "docs"), (9009, "clean words, then " + wrong("größere", "utf-8", "cp1252"), "docs")]
    good = [(8001, "café ± 5 °C at §4 — ½ done", "docs"), (8002, "├── tree.py\n└── leaf.py", "docs"), (8003, "", "docs"), (8004, None, "docs"), (8005, "is it x?y:z and page?id=3", "docs"), (8006, "ÓRFÃ ATÉ AMANHÃ", "docs")]
    docs = corpus(spark, bad + good + bad[:1])
    words = damaged_words(docs)
    assert {r.doc_id for r in words.select("doc_id").distinct().collect()} == {b[0] for b in bad}
    fixed = {r.doc_id: r.text for r in restore(docs, words).collect()}
    assert fixed[9001] == CLEAN[0] and fixed[9002] == CLEAN[1] and fixed[9004] == fixed[9005] == fixed[9006] == CLEAN[3] and fixed[9009] == "clean words, then größere"
    assert fixed[9007] == "l�schen und weiter" and fixed[9008] == CLEAN[5]


def test_one_word_under_a_weak_cipher(spark):
    bad = [(9001, "see " + wrong("zależność", "iso8859_2", "cp1252"), "docs"), (9002, "alone: " + wrong("błędów", "cp1250", "cp1252") + ", " + wrong("błędów", "cp1250", "cp1252") + ",", None), (9003, "and " + wrong("Каждая", "koi8_r", "cp1251"), "docs")]
    bad += [(9004, "new " + wrong("запише", "cp1251", "cp1252"), "docs"), (9005, wrong("größere", "utf-8", "cp1252") + " next to " + wrong("błędów", "cp1250", "cp1252"), "docs")]
    good = [(8001, "ÓRFÃ", "docs"), (8002, "± 5 °C", "docs"), (8003, "£20 ¿no?", None), (8004, "naïve façade", "docs"), (8005, "crème brûlée", "docs")]
    docs = corpus(spark, bad + good)
    words = damaged_words(docs)
    fixed = {r.doc_id: r.text for r in restore(docs, words).collect()}
    assert fixed == {9001: "see zależność", 9002: "alone: błędów, błędów,", 9003: "and Каждая", 9004: "new запише", 9005: "größere next to błędów"}


def test_damage_in_a_part_of_a_word(spark):
    bad = CLEAN[5] + wrong("設定", "utf-8", "cp1251") + CLEAN[5]
    docs = corpus(spark, [(9001, bad, "docs"), (8001, CLEAN[5] + "25°C" + CLEAN[5] + "«é»" + CLEAN[5], "docs")])
    words = damaged_words(docs)
    assert {r.doc_id: r.text for r in restore(docs, words).collect()} == {9001: CLEAN[5] + "設定" + CLEAN[5]}


def test_no_damage_and_empty(spark):
    assert rows(damaged_words(corpus(spark, []))) == []
    assert rows(damaged_words(corpus(spark, []).where("doc_id < 0"))) == []


def test_long_text(spark):
    docs = corpus(spark, [(9001, "plain words " * 100_000 + wrong("größere", "utf-8", "cp1252"), "docs")])
    assert rows(damaged_words(docs), "doc_id", "reading") == [(9001, "größere")]


@pytest.mark.parametrize("word,cipher,expected", [("Ã¤", "utf_8>cp1252", "ä"), ("√§", "utf_8>mac_roman", "ä"), ("plain", "utf_8>cp1252", None), ("hiddenÂ", "utf_8>cp1252", "hidden\xa0"), ("日", "utf_8>cp1252", None)])
def test_read_as(word, cipher, expected):
    got = read_as(word, cipher)
    assert got == expected or (expected is None and (got is None or got == word))
