"""Settings files."""

import pytest

from pagewright.sources import settings


def write(folder, name, text):
    path = folder / name
    path.write_text(text, "utf-8")
    return str(path)


def test_config(tmp_path):
    assert settings.config(str(tmp_path / "none.yaml")) == {} and settings.config(write(tmp_path, "empty.yaml", "")) == {}
    assert settings.config(write(tmp_path, "a.yaml", "a: {b: 1}")) == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        settings.config(write(tmp_path, "list.yaml", "- a"))


def test_merged():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert settings.merged(base, {"a": {"b": 9}, "d": {"e": 1}, "f": None}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}, "f": None}
    assert base == {"a": {"b": 1, "c": 2}, "d": 3}
    assert settings.signature({"a": 1, "b": "ã"}) == settings.signature({"b": "ã", "a": 1}) != settings.signature({})


def test_glossary(tmp_path):
    assert settings.glossary(write(tmp_path, "g.yaml", "pump: bomba\nnone: null\n7: 8")) == {"pump": "bomba", "7": "8"}
    assert settings.glossary(write(tmp_path, "g.json", '{"a": "b"}')) == {"a": "b"}
    with pytest.raises(ValueError):
        settings.glossary(write(tmp_path, "g.txt", "a=b"))


@pytest.mark.parametrize(("name", "text"), [("t.txt", "# names\nAPI\n  CLI \n\nAPI\n"), ("t.yaml", "terms: [API, ' CLI ', '', API]"), ("t.json", '["API", "CLI"]')])
def test_terms(tmp_path, name, text):
    assert settings.terms(write(tmp_path, name, text)) == ["API", "CLI"]
