"""Freed memory goes back to the system, and nothing fails where the C library cannot."""

import ctypes

import pytest

from fieldframe.llm import tokens


@pytest.mark.parametrize("able", [True, False])
def test_forget_gives_memory_back(monkeypatch, able):
    calls = []
    library = type("Library", (), {"malloc_trim": staticmethod(calls.append)} if able else {})
    monkeypatch.setattr(ctypes, "CDLL", lambda name: library)
    monkeypatch.setitem(tokens._encoders, "some", object())
    tokens.forget()
    assert not tokens._encoders and calls == [0] * able
