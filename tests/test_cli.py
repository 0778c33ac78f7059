"""The command line on a store."""

from keyfold.__main__ import main
from keyfold.session import shared_path


def test_commands(spark, capsys):
    path = shared_path(spark, "cli")
    run = lambda *a: main(["--store", path, *a])
    assert run("put", "apple", "1") == run("put", "beta", "2") == run("delete", "beta") == 0
    capsys.readouterr()
    assert run("get", "apple") == 0 and capsys.readouterr().out == "1\n"
    assert run("scan", "a", "--limit", "5") == 0 and capsys.readouterr().out == "apple\t1\n"
    assert run("get", "beta") == 0 and capsys.readouterr().out == "\n"
    assert run("compact") == 0 and run("regions") == 0
    assert "3 't' +inf" in capsys.readouterr().out
    assert run("scan", "a", "--limit", "-1") == 1 and "invalid_argument" in capsys.readouterr().err
