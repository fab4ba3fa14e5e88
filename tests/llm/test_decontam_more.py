"""Leaks with names at the start of sentences, and word-for-word leaks of items that are mostly slots."""

from quadloom.llm import decontam

TOM = "Tom has 5 apples. Tom gives 2 apples to Mary. How many apples does Tom have left?"
CAPITAL = "What is the capital city of the northern province?"
GRADES = "Alice, Bob, Carol, Dave, Erin, Frank and Grace scored 12, 15, 17, 19, 21, 23 and 25 points respectively."


def found(item, text):
    return bool(decontam.Matcher([(1, item)], decontam.Settings()).find(decontam.Canonical(), text))


def test_names_that_begin_sentences():
    assert found(TOM, "Anna has 7 apples. Anna gives 3 apples to Bob. How many apples does Anna have left?")
    assert found(TOM, "intro\nAnna has 7 apples\n- Anna gives 3 apples to Bob\nHow many apples does Anna have left")
    basket = "Tom has 5 apples in a basket. Tom gives most apples to Mary."
    assert found(basket, "Anna has 7 apples in a basket. Anna gives most apples to Bob.")
    assert not found(basket, "Anna has 7 apples in a basket. Carl gives most apples to Bob.")
    assert not found(TOM, "Anna has 7 pears. Anna eats 3 pears with Bob. How many pears does Anna have left?")


def test_context_and_case_do_not_matter():
    for text in ("Question\n" + CAPITAL, "Question " + CAPITAL, CAPITAL.upper(), CAPITAL.lower(), CAPITAL.title()):
        assert found(CAPITAL, text)


def test_items_of_slots_word_for_word():
    assert found(GRADES, "intro. " + GRADES + " outro")
    assert found(GRADES, GRADES.lower())
    other = "Peter, Quinn, Ralph, Steve, Tina, Uma and Viola scored 1, 2, 3, 4, 5, 6 and 7 points respectively."
    assert not found(GRADES, other)


def test_short_items_as_whole_passages():
    assert found("Define entropy briefly.", "Questions:\ndefine entropy briefly\nnext")
    assert not found("Define entropy briefly.", "please define entropy briefly and move on")
    assert not found("tiny", "tiny")
