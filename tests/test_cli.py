import json

import pytest

from sheetloom.cli import main
from sheetloom.plans import prose

DIRTY = ".a { color: red; }\n.b { color: red; }\n"
BLOCKED = ".a { top: 1px; }\n.x { top: 2px; }\n.b { top: 1px; }\n"


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)

    def go(*argv, stdin=None):
        status = main(list(argv), spark, stdin)
        out = capsys.readouterr()
        return status, out.out, out.err

    return go


def test_report(run, tmp_path):
    (tmp_path / "a.css").write_text(DIRTY)
    (tmp_path / "clean.css").write_text(".a { top: 0; }\n")
    status, out, _ = run("a.css")
    assert status == 1 and "(root)\n  duplicate   color: red\n    .a (line 1)\n    .b (line 2)\n" in out
    assert "1 (1)" in out and "Legend" in out
    assert run("clean.css")[:2] == (0, "No duplicate declarations found.\n")
    assert run("-z", "a.css")[0] == 0
    status, out, _ = run("-q", ".")
    assert status == 1 and "Summary for all files:" in out and "  duplicate " not in out and "\nTotal" in out


def test_fix(run, tmp_path):
    (tmp_path / "a.css").write_text(DIRTY)
    status, out, _ = run("-f", "a.css")
    assert status == 0 and (tmp_path / "a.css").read_text() == ".a, .b { color: red; }\n"
    assert "* 1 declaration consolidated: Reduced duplication and saved 15 bytes (38 → 23 bytes, -39.5%)\n* Wrote a.css" in out
    (tmp_path / "b.css").write_text(BLOCKED)
    status, out, _ = run("-f", "b.css")
    assert status == 1 and "intervening `top` declaration in `.x` (line 2)" in out and "(may merge with `--aggressive`)" in out


def test_stdin(run):
    status, out, err = run("-f", "-", stdin=DIRTY)
    assert (status, out) == (0, ".a, .b { color: red; }\n") and "1 declaration consolidated" in err
    assert run("-f", "-", stdin="a { top: 0 }")[1] == "a { top: 0 }"


def test_errors(run, tmp_path):
    (tmp_path / "bad.css").write_text("a {")
    (tmp_path / "ok.css").write_text(DIRTY)
    (tmp_path / "x.scss").write_text("")
    status, out, err = run("-z", ".")
    assert status == 1 and "Unclosed block" in err and "(1 file could not be processed; see errors above)" in out
    assert "1 | " in err and "^" in err and "Unclosed block" not in out
    assert run("x.scss")[0] == 1 and run("none.css")[0] == 1
    assert "excluded" in run("-p", "css", ".")[2]
    assert run("-fix", "ok.css")[2].startswith("Unknown option `-fix`. Did you mean `--fix`?")
    assert "only applies together" in run("-s", "ok.css")[2]
    assert "Cannot combine" in run("-", "ok.css")[2]
    assert "Invalid `--ignore-selector`" in run("-i", "(", "ok.css")[2]


def test_config(run, tmp_path):
    (tmp_path / "a.css").write_text(DIRTY)
    (tmp_path / "sheetloom.config.json").write_text(json.dumps({"exitZero": True, "ignoreSelectors": [r"\.nothing"]}))
    assert run("a.css")[0] == 0
    assert run("-e", "a.css")[0] == 1
    assert "Could not load" in run("-c", "no.json", "a.css")[2]


def test_prose():
    assert prose.size(40) == "40 B" and prose.size(1234) == "1.2 KB" and prose.size(2_500_000) == "2.5 MB"
    assert prose.savings_cell(0, 10) == "0 B (0%)" and prose.savings_cell(-1500, 3000) == "+1.5 KB (+50.0%)" and prose.savings_cell(1, 2, True) == "n/a"
    assert prose.short_labels(["a/x.css", "b/x.css", "c/y.css"]) == ["a/x.css", "b/x.css", "y.css"]
    assert prose.reduced(63, 53) == "Reduced duplication and saved 10 bytes (63 → 53 bytes, -15.9%)"
    mixed = prose.outcome("3 declarations consolidated", True, (1, 45), (1, 18), 159)
    assert mixed == ["* 3 declarations consolidated: Reduced duplication, shrinking 1 file by 45 bytes (-28.3%) and growing 1 file by 18 bytes (+11.3%) (total: -27 bytes / -17.0%)"]
    assert len(prose.outcome("x", False, (1, 1), (1, 1), 9, "-f", "-s")) == 2 and prose.outcome("x", True, (0, 0), (0, 0), 9) == []
    lines = prose.table(["File", "N"], [["very/long/path/of/a/file.css", "1"], ["b.css", "22"]], wrap=0, width=20)
    assert lines[1].endswith("/") and len({line.find(n) for line, n in zip([lines[0], *lines[2:]], ["N", "1", "22"])}) == 1
