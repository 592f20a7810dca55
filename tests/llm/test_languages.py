from millrace.llm.languages import language


def test_a_foreign_opening_does_not_decide():
    opening = "the house of the king is in the valley and it was old " * 40
    assert language(opening) == "en"
    assert language(opening + "der Turm und die Stadt sind nicht mit dem Auto zu sehen " * 200) == "de"
    assert language("") == ""
