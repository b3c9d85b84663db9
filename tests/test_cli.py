"""The command line over a small corpus on disk."""

import json

from quire.__main__ import main
from quire.config import DEFAULTS
from quire.sources import pages
from quire.sources.registry_file import read_registry, read_registry_lines, read_settings, write_registry

BODY = "Crosstalk between neighbouring lines grows with the length over which they run side by side. " * 8


def test_commands(spark, tmp_path, capsys):
    registry = tmp_path / "corpus.json"
    doc = {"pdf": "j/a.pdf", "title": "On Lines", "kind": "article", "source": "J / 2024", "slot": 2, "skip_pages": [[1, 1]], "auto": []}
    registry.write_text(json.dumps({"banner_patterns": ["^BANNER"], "documents": {"a": doc, "b": {"title": "Book", "slot": 0}}}))
    text = f"[PAGE 1]\ncontents\n[PAGE 2]\nBANNER here\nI. Introduction\n{BODY}\n\n{BODY}"
    pages.write_marked_text(spark.createDataFrame([("a", text), ("b", text)], "key string, text string"), str(tmp_path / "texts"))
    index = ["--index", str(tmp_path / "index")]

    main(["build", *index, "--registry", str(registry), "--texts", str(tmp_path / "texts")])
    assert "2 points" in capsys.readouterr().out
    main(["search", *index, "crosstalk between lines", "-k", "1", "--kind", "article"])
    out = capsys.readouterr().out
    assert "[1] 1.0000  On Lines | J / 2024 | SI Introduction | p.2" in out and "BANNER" not in out
    main(["context", *index, str(2 << 20)])
    assert "<- requested On Lines" in capsys.readouterr().out
    main(["books", *index, "--registry", str(registry)])
    assert "papers_by_source" in capsys.readouterr().out
    (tmp_path / "original" / "j").mkdir(parents=True)
    for name in ("j/a.pdf", "j/new.pdf"):
        (tmp_path / "original" / name).write_text("x")
    main(["status", *index, "--registry", str(registry), "--files", str(tmp_path / "original")])
    out = capsys.readouterr().out
    assert "j/new.pdf" in out and "j/a.pdf" not in out and "TOTAL" in out
    main(["migrate", *index, "--to", str(tmp_path / "copy")])
    assert "copied 2 points and 2" in capsys.readouterr().out
    main(["remove", *index, "--registry", str(registry), "a"])
    assert "1 points left" in capsys.readouterr().out


def test_registry_file(spark, tmp_path):
    file = tmp_path / "corpus.json"
    file.write_text(json.dumps({"banner_patterns": ["^B"], "documents": {"k": {"pdf": "i.pdf", "title": "T", "slot": 4, "pages": [3, 9], "skip_pages": [[1, 2], [5, 5]]}}}))
    assert read_settings(str(file)).banner_patterns == ("^B",) and read_settings(str(tmp_path / "corpus")).banner_patterns == ("^B",)
    assert read_settings(str(tmp_path / "none.json")) == DEFAULTS
    rows = read_registry(spark, str(file))
    row = rows.first()
    assert (row["pages"], row["skip_pages"], row["kind"], row["source"]) == ((3, 9), [(1, 2), (5, 5)], "book", "")
    write_registry(rows, str(tmp_path / "lines"))
    assert read_registry_lines(spark, str(tmp_path / "lines")).select(*rows.columns).collect() == rows.collect()
