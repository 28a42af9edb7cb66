from __future__ import annotations

import pytest

from ruzi import EngineError, parse, sql_literal, sql_name, tokenize
from ruzi.plans import ast


def refused(source, params=None):
    with pytest.raises(EngineError) as caught:
        parse(source, params)
    return caught.value


def test_tokens_have_places():
    found = tokenize("hitamo *\n  muri t # rest\n-- all\n'a\\n'")
    assert [(t.kind, t.place) for t in found] == [("hitamo", "1:1"), ("*", "1:8"), ("muri", "2:3"), ("name", "2:8"), ("string", "4:1"), ("end", "4:6")]
    assert found[4].value == "a\n"


@pytest.mark.parametrize("source", ["hitamo", "hitamo * muri", "shira muri t {", "shira muri t { a: 1", "hindura t shyira a = 1", "siba muri t", "kora itsinda t (", "hitamo * muri t aho", "hitamo * muri t imipaka", 'hitamo * muri t aho a = "x'])
def test_what_stops_early_is_incomplete(source):
    error = refused(source)
    assert error.code == "E_SYNTAX" and error.incomplete


@pytest.mark.parametrize(
    ("source", "said"),
    [
        ("hitamo * muri t aho a != 1", "!"),
        ("hitamo * muri t aho a <> 1", "<>"),
        ("hitamo * muri t aho a = 1 cyangwa b = 2", "no OR"),
        ("hitamo * muri t aho a = 1 | b", "kandi"),
        ("hitamo a + 1 muri t", "+"),
        ("hitamo * muri t imipaka -1", "whole number"),
        ("hitamo * muri t imipaka 1.5", "whole number"),
        ("hitamo * muri t imipaka $n", "whole number"),
        ("hitamo * muri t tondeka a aho b = 1", "a statement begins"),
        ("hitamo * muri t imipaka 1 tondeka a", "out of order"),
        ("hitamo teranya(*) muri t", "needs a column"),
        ("kora itsinda aho", "word of the language"),
        ("kora urutonde i muri t (a, b)", "one column"),
        ("shira muri t (a, b) agaciro (1)", "2 columns but 1 values"),
        ("shira muri t (a, a) agaciro (1, 2)", "duplicate"),
        ("shira muri t { a: 1, a: 2 }", "duplicate"),
        ("hindura t shyira a == 1 aho b = 1", "single"),
        ('hitamo * muri t aho a < "5"', "expects a number"),
        ("hitamo * muri t aho a ni nibyo", "expects a number"),
        ('hitamo * muri t aho a = "\\q"', "escape"),
        ("hitamo * muri t aho a = $x", "no value was passed"),
        ("hitamo * muri t aho a = --1", "expected a value"),
        ("1", "a statement begins"),
    ],
)
def test_refusals(source, said):
    error = refused(source)
    assert error.code == "E_SYNTAX" and said in error.message


def test_unknown_type_word():
    assert refused("kora itsinda t (a inyuguti)").code == "E_TYPE"


def test_unreserved_words_are_names():
    (found,) = parse("hitamo urutonde, bara, t.tondeka muri t koranya urutonde tondeka bara(manuka) manuka imipaka -0")
    assert found.columns[:2] == (ast.ColumnRef("urutonde"), ast.ColumnRef("bara"))
    assert found.order == (ast.OrderKey(ast.Aggregate("count", ast.ColumnRef("manuka")), True),)
    assert found.limit == 0
    (found,) = parse("HITAMO * MURI koranya koranya a")
    assert found.tables == (ast.TableRef("koranya"),) and found.group == (ast.ColumnRef("a"),)


def test_parameters_hold_any_json_but_nothing_else():
    (found,) = parse("shira muri t { a: $a }", {"a": {"x": [1, None, "aho"]}})
    assert found.row == {"a": {"x": [1.0, None, "aho"]}}
    for bad in (float("nan"), float("inf"), object(), {1: 2}):
        with pytest.raises(EngineError, match="E_TYPE"):
            parse("shira muri t { a: $a }", {"a": bad})


@pytest.mark.parametrize("value", [0, -0.0, 1.5, -2, 1e21, 1e-7, 123456789012345680000.0, "", "it's \"x\"\n\t\\", True, False, None])
def test_literals_round_trip(value):
    (found,) = parse(f"shira muri t {{ a: {sql_literal(value)} }}")
    assert found.row["a"] == value and str(found.row["a"]) == str(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value)


def test_names():
    assert sql_name("urutonde") == "urutonde"
    for bad in ("aho", "AHO", "1a", "a b", "", None):
        with pytest.raises(EngineError, match="E_TYPE"):
            sql_name(bad)
