"""Passages that cross slices of few words."""

from framequery.llm import decontam


def test_windows_cross_slices_of_few_words(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 40)
    words = [f"word{i}" for i in range(10)]  # about six in a slice
    matcher = decontam.Matcher([("item", " ".join(words).encode())], 10)
    for pad in range(40):
        n, spans, items = matcher.scan(" ".join(["z" * pad, *words]).encode())
        assert items == {"item"} and spans == [(n - 10, n)]
