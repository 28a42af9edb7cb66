from __future__ import annotations

import pytest

from ruzi import Database, EngineError, is_engine_error, model, table_text
from ruzi.cli import Repl, main


def code(call, *args, **more):
    with pytest.raises(EngineError) as caught:
        call(*args, **more)
    return caught.value.code


def test_table_text():
    assert table_text([]) == "(0 rows)\n"
    assert table_text([{}, {}]) == "(2 rows)\n"
    rows = [{"id": 1, "izina": "Inzia", "x": None}, {"id": 10.5, "izina": "a\tb\n", "sawa": True}]
    assert table_text(rows) == (
        "┌──────┬────────┬──────┬──────┐\n"
        "│   id │ izina  │ x    │ sawa │\n"
        "├──────┼────────┼──────┼──────┤\n"
        "│    1 │ Inzia  │ null │ null │\n"
        "│ 10.5 │ a\\tb\\n │ null │ true │\n"
        "└──────┴────────┴──────┴──────┘\n"
        "(2 rows)\n"
    )
    assert "(1 row)" in table_text([{"v": {"a": [1, "é"]}}]) and '{"a":[1,"é"]}' in table_text([{"v": {"a": [1, "é"]}}])


def test_models(spark):
    db = Database.memory(spark)
    people = model("people", {"id": "number", "name": "ijambo", "ok": "ukuri", "note": "any"})
    on = people.on(db)
    on.kora()
    assert code(on.kora) == "E_COLLECTION_EXISTS"
    assert on.shira({"id": 1, "name": "a", "note": {"k": [1]}}) == {"id": 1, "name": "a", "note": {"k": [1]}}
    on.shira({"id": 2, "ok": None})
    assert on.hitamo({"id": {"gte": 1}}, limit=1) == [{"id": 1, "name": "a", "note": {"k": [1]}}]
    for bad in ({"x": 1}, {"id": "1"}, {"ok": 1}, {"name": 5}):
        assert code(on.shira, bad) == "E_TYPE"
    assert code(on.hitamo, {"x": 1}) == "E_TYPE"
    assert code(on.hindura, {"id": 1}, {"x": 1}) == "E_TYPE"
    on.hindura({"id": 2}, {"ok": True})
    assert on.siba({"id": 1}) == 1
    assert on.hitamo() == [{"id": 2, "ok": True}]
    assert db.transaction(lambda tx: people.on(tx).shira({"id": 3})) == {"id": 3}
    for name, fields in (("aho", {}), ("t", {"aho": "number"}), ("t", {"a": "date"}), ("t", {"a": 1}), ("t", [])):
        assert code(model, name, fields) == "E_TYPE"


def test_command_line(spark, tmp_path, capsys):
    path, script = str(tmp_path / "a.db"), tmp_path / "a.textdb"
    script.write_text('kora itsinda t shira muri t { id: 1, n: "x" } hitamo * muri t')
    assert main(["version"], spark) == 0 and main(["help"], spark) == 0
    assert main(["init", path], spark) == 0
    assert main(["init", path], spark) == 1
    capsys.readouterr()
    assert main(["exec", "hitamo n muri t", "--db", path], spark) == 0
    assert "│ x │" in capsys.readouterr().out
    assert main(["run", str(script)], spark) == 0
    assert "(1 row)" in capsys.readouterr().out
    assert main(["run", str(script), "--db", path], spark) == 1
    assert "E_COLLECTION_EXISTS" in capsys.readouterr().err
    assert main(["exec", "hitamo 1", "--db", str(tmp_path / "none.db"), "--no-create"], spark) == 1
    assert main(["exec", " "], spark) == 1
    assert main(["run", str(tmp_path / "none")], spark) == 1
    outcome = Database.run_file(spark, str(script), str(tmp_path / "b.db"))
    assert outcome.last == [{"id": 1, "n": "x"}]
    assert code(Database.run_file, spark, str(tmp_path / "none")) == "E_IO"


def test_prompt_waits_for_the_rest(spark):
    loop = Repl(Database.memory(spark))
    assert loop.push("kora itsinda t").prompt == "ruzi> "
    assert loop.push("shira muri t {").prompt == "...> "
    assert loop.push(" id: 1 }").error == ""
    assert "│  1 │" in loop.push("hitamo * muri t").output
    assert "E_SYNTAX" in loop.push("hitamo * muri t aho id != 1").error
    assert loop.push("").output == "" and loop.push(".exit").exit


def test_errors():
    assert is_engine_error(EngineError("E_IO", "x")) and not is_engine_error(ValueError())
    assert is_engine_error(EngineError("E_IO", "x"), "E_IO") and not is_engine_error(EngineError("E_IO", "x"), "E_TYPE")
    with pytest.raises(ValueError, match="E_NONE"):
        EngineError("E_NONE", "x")
