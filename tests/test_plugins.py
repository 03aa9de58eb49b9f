"""Detectors of one's own: a folder's modules, and installed ones."""

import sys
from importlib import metadata

import pytest

from inkgauge.functions import features as X
from inkgauge.operators.registry import Registry

GOOD = """
def shouting(text):
    return sum(c.isupper() for c in text) / max(1, len(text))

class Short:
    name = "Short_Text"
    family = "stylometric"
    def score(self, text):
        return 1.0 if len(text) < 10 else 1 / 0

DETECTORS = [shouting, Short]
"""


@pytest.fixture
def folder(tmp_path):
    files = {
        "inkgauge_test_good": GOOD, "inkgauge_test_exit": "raise SystemExit(3)", "inkgauge_test_broken": "import nothing_of_that_name", "_inkgauge_test_hidden": "1 / 0",
        "inkgauge_test_builtin": "class Plugin:\n    name = 'classical'\n    def score(self, text):\n        return 1.0", "json": "DETECTORS = [len]", "inkgauge_test_odd": "DETECTORS = [7]",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.py").write_text(text)
    yield tmp_path
    for name in files:
        if name.startswith("inkgauge_test"):
            sys.modules.pop(name, None)


def test_folder(spark, folder, caplog):
    r = Registry({"the": 1})
    built_in = dict(r.known)
    assert r.load_folder(spark, folder) == ["shouting", "short_text"]
    assert {n: r.known[n] for n in built_in} == built_in and r.load_folder(spark, folder / "none") == []
    for name in ("exit", "broken", "odd"):
        assert f"inkgauge_test_{name}.py can't be loaded" in caplog.text
    assert "json.py can't be loaded" in caplog.text and "detector classical of" in caplog.text and "hidden" not in caplog.text
    docs = spark.createDataFrame([(1, "ABCD efgh"), (2, "a text of more characters"), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    rows = {x.doc_id: x for x in r.detect(X.parsed(docs), ["shouting", "short_text", "absent"]).collect()}
    assert rows[1].shouting_score == pytest.approx(4 / 9) and rows[1].short_text_score == 1.0
    assert rows[2].short_text_score == 0.0 and rows[2].short_text_error.startswith("ZeroDivisionError") and rows[2].short_text_confidence == 0.0
    assert rows[3].short_text_score == rows[4].short_text_score == 1.0


def test_installed(monkeypatch, caplog):
    class Entry:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if self.value is None:
                raise ImportError("broken")
            return self.value

    same = lambda d: d
    monkeypatch.setattr(metadata, "entry_points", lambda group: [Entry("mine", same), Entry("classical", same), Entry("bad", None)])
    r = Registry({})
    before = r.known["classical"]
    r.load_entry_points()
    assert r.create("mine") is same and r.known["classical"] is before and "bad" not in r.known and "bad can't be loaded" in caplog.text
