"""Disguises beside plain parts of the same identifier."""

import pytest

from sourcelens.llm import pii


@pytest.mark.parametrize(
    ("text", "whole"),
    [
        ("x jоhn.smith@example.com y", "jоhn.smith@example.com"),
        ("x john@example.cоm y", "john@example.cоm"),
        ("x john dot doe@example.com y", "john dot doe@example.com"),
        ("x john@mail.example dot com y", "john@mail.example dot com"),
        ("x john@mail.example dot nl y", "john@mail.example dot nl"),
        ("x +1 555 123 456７ y", "+1 555 123 456７"),
    ],
)
def test_a_base_span_within_a_disguise(text, whole):
    base, found = pii.spans(text)
    kind = base[0][0]
    assert len(base) == 1 and set(base) < set(found)
    assert [text[a:b] for k, a, b in found if (k, a, b) not in base] == [whole]
    assert pii.redact(text) == f"x [{kind.upper()}] y"


@pytest.mark.parametrize("text", ["x john@example.com\u200b y", "the dot john@example.com"])
def test_a_base_span_that_covers_all(text):
    base, found = pii.spans(text)
    assert len(base) == 1 and found == base


#: Addresses with a spelled at, and prose that looks like them: spelled dots, plain dots.
ADDRESSES = [
    "jane at example dot nl", "Jane at example dot ca", "write to ivan dot petrov at pochta dot ru", "ask jane at mail dot example dot app", "jane dot doe at example.nl",
    "jane at example.com", "name: jane at example.com", "contact jane at example.com", "email Jane at example.co.uk", "see jane.doe at example.com", "j_doe at example.org", "jane42 at example.com",
]
PROSE = [
    "look at the dot below", "look at polka dot dresses", "point at a dot in space", "more at example.com", "see the page at example.com", "the office at example.com opened", "we met at noon. Then", "Mail us at example.com",
    "Engineers at example.com said", "arrived at 10.30", "it ended at St.Gallen", "5 at example.com",
]


@pytest.mark.parametrize("text", ADDRESSES)
def test_spelled_at(text):
    found = pii.spans(text)[1]
    assert len(found) == 1 and found[0][0] == "email" and found[0][2] == len(text)
    assert " at " in text[found[0][1] :] and not any(w in text[found[0][1] :] for w in ("name", "contact", "email", "see", "write", "ask"))


@pytest.mark.parametrize("text", PROSE)
def test_prose_with_at(text):
    assert pii.spans(text)[1] == []


@pytest.mark.parametrize("text", ["a at b.cd " * 5_000, "a at " * 10_000, " at a dot bc" * 5_000, "a." * 20_000 + " at b.cd"])
def test_spelled_at_is_linear(text):
    import time

    began = time.time()
    pii.spans(text)
    assert time.time() - began < 5
