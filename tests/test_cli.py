import json

from tessella import cli
from tessella.executor import QueryExecutor, ResultSet


def test_ingest_query_and_demo(spark, small, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps([{"k": "x", "v": 2}, {"k": "y", "v": 3}]))
    table = str(tmp_path / "t")
    assert cli.main(["ingest", "-d", table, "-s", str(tmp_path / "a.json"), "--segments", "2"], spark) == 0
    assert "2 rows, 2 columns, 2 segments" in capsys.readouterr().out
    assert cli.main(["query", "-d", table, "SELECT k, SUM(v) GROUP BY k ORDER BY k", "-v"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["k  SUM(v)", "-  ------", "x  2", "y  3"]
    assert cli.main(["query", "-d", table, "SELECT nope"], spark) == 1
    assert "Unknown column 'nope'" in capsys.readouterr().err
    assert cli.main(["demo"], spark) == 0
    assert "menus = menuitem" in capsys.readouterr().out
    for _ in range(2):
        assert cli.main(["demo", "wiki", "-d", str(tmp_path), "--source", small, "--segments", "3"], spark) == 0
        assert "3 segments" in capsys.readouterr().out
    assert cli.main(["demo", "nothing", "-d", str(tmp_path)], spark) == 1


def test_console(spark, tmp_path, capsys):
    from tessella.table import Table

    executor = QueryExecutor(Table.write(spark.range(60), str(tmp_path / "t")))
    lines = iter(["SELECT COUNT(*) AS c", "", "SELECT nope", "SELECT a JOIN b", "SELECT id ORDER BY id LIMIT 60", "quit"])
    cli.console(executor, lambda _: next(lines))
    out = capsys.readouterr().out
    assert "60" in out and "1 rows," in out and "Unknown column" in out and "JOIN is not supported" in out and "60 rows," in out


def test_display_is_capped():
    assert cli.render(ResultSet(["n"], [[i] for i in range(1002)])).endswith("... 2 more rows")
