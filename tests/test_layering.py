"""The library does not import its test data or their expected results."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_library_does_not_import_fixtures():
    for source in (ROOT / "clickflow").rglob("*.py"):
        assert "clickflow_fixtures" not in source.read_text(), source
