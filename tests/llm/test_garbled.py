"""Garbled texts found and restored, clean ones left alone."""

import random

import pytest

from keyfold.llm import chains, garbled

WORDS = {
    "de": "prüft ob der Schlüssel gültig ist Größe des Puffers für Länge über Änderung Straße löschen",
    "fr": "vérifie que la clé a déjà été écrite à supprimer dès que sera prêt donnée précédente",
    "ru": "проверить если новый поток значение сервер запись ошибка данных строка перед после",
    "pl": "sprawdź czy bufor jest już pełny źródło współdzielone między wątkami błąd żądanie",
    "zh": "返回已提交的最大索引 检查键是否已经写入 旧版本的兼容代码 此函数不是线程安全的",
}
GARBLE = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("pl", "cp1250", "cp1252"), ("zh", "gbk", "latin-1"), ("ru", "koi8-r", "cp1251"), ("de", "utf-8", "cp437"), ("fr", "utf-8", "mac_roman")]


def line(rng, lang):
    w = WORDS[lang].split()
    return "// " + " ".join(rng.choices(w, k=7))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs, bad, clean = [], {}, {}
    for i in range(900):
        lang = rng.choice(list(WORDS))
        text = "\n".join(["int x = 1;", *(line(rng, lang) for _ in range(4)), "return x;"])
        docs.append((i, text, rng.choice(["a", "b", None])))
    for j, (lang, true, wrong) in enumerate(GARBLE * 4):
        text = "\n".join(["int x = 1;", *(line(rng, lang) for _ in range(3))])
        raw = text.encode(true)
        broken = raw.decode(wrong, "replace") if wrong == "cp1252" else raw.decode(wrong)
        if broken != text:
            docs.append((1000 + j, broken, "a"))
            bad[1000 + j] = text
            clean[1000 + j] = "�" not in broken
    docs.append((2000, "if ch == \"�\" { bad++ }", "a"))
    docs.append((2001, '"Ã©": "é",\n"Ã¼": "ü",', "a"))
    docs.append((2002, "// Â, Ã and Ä sort after A here", "b"))
    docs.append((2003, "// ├── tree/ ╔══════╗ ╚══════╝ → ≤ ≈ µs", "b"))
    docs.append((2004, None, "b"))
    docs.append((2005, "", None))
    docs.append((2006, "plain ascii only", "b"))
    docs.append((None, "vérifiÃ©", "b"))
    docs.append((3000, "// wird gem�� �ber mehr", "b"))
    docs.append((3001, "# Code generated by a tool, do not edit".encode().decode("utf-16-le", "ignore"), "b"))
    return docs, bad, clean


@pytest.fixture(scope="module")
def found(spark, corpus):
    df = spark.createDataFrame(corpus[0], "doc_id bigint, text string, source string")
    return df, garbled.find(df)


def test_finds_exactly_the_garbled(found, corpus):
    ids = {r.doc_id for r in found[1].records.collect()}
    assert ids == set(corpus[1]) | {3000, 3001}


def test_restores(found, corpus):
    df, g = found
    got = {r.doc_id: r for r in garbled.restore(df, g).collect()}
    right = [i for i, text in corpus[1].items() if got[i].restored == text]
    whole = [i for i, ok in corpus[2].items() if ok]
    assert len(set(right) & set(whole)) >= 0.9 * len(whole)
    assert not got[3000].complete
    assert got[3001].restored.startswith("# Code generated")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    g = garbled.find(df)
    assert g.records.count() == 0 and garbled.restore(df, g).count() == 0


def test_words_contexts_and_quotations():
    got = [(w, c, q) for w, c, _, _, q in chains.words('takes ≈ 5 µs\n"é" x "ü"\n«été» \'Ã©\' 3 € if')]
    assert got == [("≈", "takes<", None), ("µs", "", None), ("é", '"', ("ü",)), ("ü", '"', ("é",)), ("«été»", "", None), ("Ã©", '"', ()), ("€", ">if", None)]
    far = "word" + " " * 500 + "≈"
    assert [c for _, c, _, _, _ in chains.words(far)] == ["word<"]
    text = "a é\nbé, cé\x85dé"
    for w, _, a, b, _ in chains.words(text):
        assert text[a:b] == w


def test_chains_undo_repeated_decoding():
    twice = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert ("utf-8<cp1252", "é") in [(c, r) for c, r, _ in chains.candidates(twice)]
    assert [c for c, _, _ in chains.candidates("a�b")][:1] == [chains.LOSSY]
    dropped = "αφαιρεθεί".encode().decode("cp1252", "ignore")
    assert ("utf-8<cp1252", "αφαι�εθεί") in [(c, r) for c, r, _ in chains.candidates(dropped)]
    assert not any(c.startswith("utf-16") for c, _, _ in chains.candidates("╔══════╗"))
    assert chains.candidates("x" * 100_000 + "é")


def test_utf16_with_bytes_outside_ascii():
    text = "// Copyright \xa9 2012 the heron authors, see the file.\nint main;"
    assert len(text) % 2 == 0
    for raw in (text.encode("latin-1"), "# prüft ob der Schlüssel gültig ist und weiter".encode()):
        for e in chains.UTF16:
            read = {c: (r, w) for c, r, w in chains.candidates(raw[: len(raw) // 2 * 2].decode(e))}
            assert read[e][0][:20] == (text if b"heron" in raw else "# prüft ob der Schlüssel")[:20]
    clean, odd = ({c: w for c, _, w in chains.candidates(x.encode("latin-1").decode("utf-16-le"))} for x in (text.replace("\xa9", "c"), text))
    assert 0 < odd["utf-16-le"] < clean["utf-16-le"]
    assert not any(c.startswith("utf-16") for c, _, _ in chains.candidates("最大索引检查键是否已经写入旧版本"))


def test_finds_utf16_with_a_byte_outside_ascii(spark):
    text = "// Copyright \xa9 2012 the heron authors, see the file.\nint main;"
    df = spark.createDataFrame([(1, text.encode("latin-1").decode("utf-16-le"), "a"), (2, text, "a")], "doc_id bigint, text string, source string")
    got = garbled.restore(df, garbled.find(df)).collect()
    assert [(r.doc_id, r.restored, r.complete) for r in got] == [(1, text, True)]


def test_incomplete_if_something_stays_garbled(spark):
    odd = "// Copyright 2012 the heron authors, see the file.x"
    line = "// prüft ob der Schlüssel gültig ist, Größe für Länge über Straße"
    mojibake = line.encode().decode("cp1252")
    rows = [
        (1, odd[:-1].encode("latin-1").decode("utf-16-le") + "\ufffd", "a"),
        (2, mojibake, "a"),
        (3, mojibake + '\nx = "MÃ¤rz";', "a"),
        (4, mojibake + "\nx = \"März\";", "a"),
    ] + [(10 + i, line, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in garbled.restore(df, garbled.find(df)).collect()}
    assert got[1].restored == odd[:-1] + "\ufffd" and got[2].restored == line
    assert {i: got[i].complete for i in (1, 2, 3, 4)} == {1: False, 2: True, 3: True, 4: True}
    assert got[3].restored == line + '\nx = "März";'


def test_quoted_words_are_evidence_unless_quoted_on_purpose(spark):
    fine = "Il dit été et forêt et café hier."
    odd = fine.encode().decode("cp1252")
    quoted = 'Il dit "été" et "forêt" et "café" hier.'
    pairs = '"Ã©tÃ©": "été", "forÃªt": "forêt", "cafÃ©": "café"'
    docs = [(i, fine, "a") for i in range(300)] + [(1000, odd, "a"), (1001, quoted.encode().decode("cp1252"), "a"), (1002, pairs, "a"), (1003, "Il dit " + "cafÃ© " * 40, "a"), (1004, 'ch == "\ufffd"', "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in garbled.restore(df, garbled.find(df)).collect()}
    assert sorted(got) == [1000, 1001, 1003]
    assert (got[1000].restored, got[1001].restored, got[1003].restored) == (fine, quoted, "Il dit " + "café " * 40)
    assert all(r.complete for r in got.values())


def test_legacy_bytes_read_as_several_per_character():
    text = "проверить"
    for wrong in ("gbk", "big5"):
        try:
            read = text.encode("cp1251").decode(wrong)
        except UnicodeDecodeError:
            read = text[:8].encode("cp1251").decode(wrong)
        assert (f"cp1251<{wrong}", text[: 2 * len(read)]) in [(c, r) for c, r, _ in chains.candidates(read)]
    deep = "é"
    for _ in range(9):
        deep = deep.encode().decode("latin-1")
    assert ("utf-8<latin-1", "é") in [(c, r) for c, r, _ in chains.candidates(deep)]
