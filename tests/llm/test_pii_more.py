"""Cards and IBANs beside other digits and words."""

import pytest

from quadloom.llm import pii

CARD, IBAN = "4111111111111111", "BE68 5390 0754 7034"
TEXTS = {
    1: f"{CARD} 12/27",
    2: "4111 1111 1111 1111 123",
    3: f"no 12 {CARD}",
    4: f"{IBAN} AND more",
    5: f"{IBAN} 4111 1111 1111 1111",
    6: "4111 1111 1111 1111 5500-0000-0000-0004 9",
    7: "rows 12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60",
    8: "+1 4111 1111 1111 1111",
    9: "77 1990-12-24 555",
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}


def test_cards_beside_digits(got):
    for i in (1, 2, 3, 5, 6, 8):
        assert CARD not in got[i].text.replace(" ", "") and "card" in got[i].kinds, got[i]
    assert got[1].text.endswith(" 12/27") and got[2].text.endswith(" 123") and got[3].text.startswith("no 12 ")
    assert got[6].n_private == 2 and got[6].text.endswith(" 9") and "5500" not in got[6].text
    assert got[2].text[:19].replace(" ", "") == got[1].text[:16]
    assert got[7].text == TEXTS[7] and got[9].kinds == "date"


def test_iban_before_a_word(got):
    for i in (4, 5):
        assert IBAN not in got[i].text and got[i].text.startswith("BE") and "iban" in got[i].kinds
    assert got[4].text.endswith(" AND more") and len(got[4].text) == len(TEXTS[4])
