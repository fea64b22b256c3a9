import pytest

from passagery.llm.mojibake import garbled_documents, repair

POLISH = "Każdy fragment ma własną ścieżkę nagłówków i źródło żądań."
GERMAN = "Die Änderung wird erst später für alle Häuser gültig, größere Stücke zählen."


@pytest.mark.parametrize("layers", [1, 2])
@pytest.mark.parametrize("text", [POLISH, GERMAN, "Use “strict” mode; the reader’s default isn’t 5 € — no."])
@pytest.mark.parametrize("read_as", ["latin-1", "cp1252", "cp1250"])
def test_round_trip_utf8(text, read_as, layers):
    bad = text
    for _ in range(layers):
        bad = "".join(bytes([b]).decode(read_as, "strict") if _ok(b, read_as) else chr(b) for b in bad.encode("utf-8"))
    got, found, _ = repair(bad)
    assert found and got == text


def _ok(b, enc):
    try:
        bytes([b]).decode(enc)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("meant, read_as, text", [("iso8859-2", "latin-1", POLISH), ("cp1250", "cp1252", POLISH), ("cp1252", "cp437", GERMAN), ("cp1252", "cp850", GERMAN)])
def test_round_trip_one_byte(meant, read_as, text):
    got, found, _ = repair(text.encode(meant).decode(read_as))
    assert found and got == text


@pytest.mark.parametrize(
    "text",
    [
        None, "", "plain ascii", POLISH, GERMAN, "L’âge du câble et la forêt: Â, Ê, Î.", "A BRAÇÃO de São Tomé é só um NÃO em maiúsculas.",
        "ÅNGSTRÖM is written in capitals; so is ŁÓDŹ.", "Footnotes¹ ² ³ follow, ¿no?, with a ± margin and ¶ marks.", "Prices: 5 €, 7 £, 9 ¥; the mark ™ and ‰ stay.",
        'A reader who sees "â€™" instead of an apostrophe should report it.', "It shows “Ã©” where “é” belongs.", "The sequence `Å‚` stands for ł.",
        "Ελληνικά και русский текст 中文",
    ],
)
def test_good_text_stays(text):
    assert repair(text) == (text, False, "")


def test_lost_characters_are_found_but_not_repairable(spark):
    schema = "id string, content string, document_id string, restored string"
    half = "Good żółty line.\nZÅ\x82a linia."
    rows = [("a", "Krak��w", "x", "y"), ("b", half, "x", "y"), ("c", None, "x", "y"), ("d", POLISH, "x", "y"), (None, "naÃ¯ve", "x", "y"), ("b", half, "x", "y")]
    rows.append(("long", "dobrze " * 100_000 + "Å¼le " + "中" * 10_000, "x", "y"))
    got = {r["document_id"]: r for r in garbled_documents(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a", "b", "long", None}
    assert not got["a"]["repairable"] and got["b"]["restored"] == "Good żółty line.\nZła linia." and "źle" not in got["long"]["restored"]
    assert got["long"]["restored"].count("żle") == 1
    assert garbled_documents(spark.createDataFrame([], schema)).count() == 0
