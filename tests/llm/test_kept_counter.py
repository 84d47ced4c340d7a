"""The token counter that a process keeps."""

import sys

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from tests.llm.cases import prose  # noqa: E402
from tidewater.llm import token_counts  # noqa: E402


def test_a_process_keeps_its_counter_until_it_is_large(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = token_counts.counter_of(path)
    assert token_counts.counter_of(path) is first
    want = first.count(prose(200, 3))
    monkeypatch.setattr(sys.modules["tidewater.llm.token_counts"], "STATES", 10)
    fresh = token_counts.counter_of(path)
    assert fresh is not first and fresh.count(prose(200, 3)) == want
