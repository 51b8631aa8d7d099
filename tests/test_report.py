import subprocess

import pytest

from graphloom.plans import report
from graphloom.sources import git

DEPS = "source string, target string, compiler long, lexical long, heuristic long, total long, evidence string"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("src/a", "src/b", 4, 0, 1, 5, "resolved"), ("src/b", "src/c|d", 0, 1, 2, 3, "weak"), ("src/a", "src/e", 0, 0, 9, 9, "unverified")]
    counts = [("src/a", 2, 9, 0), ("src/b", 1, 4, 1), ("src/c|d", 1, 1, 0), ("src/e", 1, 0, 0)]
    names = spark.createDataFrame([("src/b", "run,stop")], "module string, names string")
    return spark.createDataFrame(rows, DEPS), spark.createDataFrame(counts, "module string, files long, symbols long, test_symbols long"), names


def test_document_tells_what_it_leaves_out(graph):
    text = report.document("T", *graph, state="now", diagram=1, table=2)
    assert "m0 -->|5| m1" in text and "-.->" not in text
    assert "leaves out 1 dependencies with resolved uses" in text and "The table leaves out 1 dependencies" in text
    assert "1 dependencies rest on heuristics alone" in text and "the 2 largest modules" in text
    assert "| src/b | src/c\\|d | 0 | 1 | 2 | weak |" in text and "| src/b | 1 | 4 | 1 | run,stop |" in text


def test_document_of_nothing(graph):
    deps, counts, names = graph
    assert "## Modules" in report.document("T", deps.limit(0), counts.limit(0), names)
    assert report.layout(deps.limit(0), counts.limit(0)) == ([], [])
    assert report.svg([], []).startswith("<svg")


def test_map_places_by_rank(graph):
    placed, links = report.layout(*graph[:2])
    assert [(p["module"], p["column"], p["row"]) for p in placed] == [("src/a", 0, 0), ("src/b", 1, 0), ("src/c|d", 2, 0), ("src/e", 0, 1)]
    assert [(x["source"], x["weight"]) for x in links] == [("src/a", 6.0), ("src/b", 2.25)]
    assert report.svg(placed, links).count("<line") == 2


def test_save_refuses_others_files(graph, tmp_path):
    path = str(tmp_path / "doc.md")
    first = report.document("T", *graph, state="one")
    assert report.save(path, first) == "created"
    assert report.save(path, report.document("T", *graph, state="two")) == "unchanged"
    assert report.save(path, report.document("U", *graph)) == "updated"
    (tmp_path / "mine.md").write_text("mine")
    assert report.save(str(tmp_path / "mine.md"), first) == "refused" and (tmp_path / "mine.md").read_text() == "mine"


def test_git_unknown_is_not_empty(spark, tmp_path):
    assert git.state(str(tmp_path)) == (None, None) and git.changed(spark, str(tmp_path)) is None
    run = lambda *words: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *words], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "a.py")
    run("commit", "-qm", "one")
    revision, dirty = git.state(str(tmp_path))
    assert len(revision) == 40 and dirty is False and git.changed(spark, str(tmp_path)).collect() == []
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b c.py").write_text("")
    assert [r.path for r in git.changed(spark, str(tmp_path)).collect()] == ["a.py", "b c.py"] and git.state(str(tmp_path))[1]
    assert git.changed(spark, str(tmp_path), "no-such-revision") is None
    with pytest.raises(ValueError):
        git.changed(spark, str(tmp_path), "--output=x")
