"""Links of op 8 between parts longer than the reach."""

import pytest

from tidewater.llm import secrets

LONG = "token=" + "aZ9." * 100


@pytest.mark.parametrize("text", [f"{LONG} user=bob", f"user=bob {LONG}", f"https://h.example.com/{'q' * 300} secret=abcdef user=bob", "f" * 300 + " x" * 100 + " login=bobby", "f" * 300 + " x" * 140 + " login=bobby"])
def test_links_by_overlap_are_those_of_all_pairs(text):
    spans = secrets.base_spans(text) + secrets.weak_spans(text)
    kind = lambda s: secrets.KINDS[s[1]]
    want = set()
    for one in (s for s in spans if kind(s) in secrets.IDENTIFIERS):
        near = [s for s in spans if s[0] <= one[2] + secrets.REACH and s[2] >= one[0] - secrets.REACH]
        if any(kind(s) in secrets.SECRETS for s in near):
            want |= {s for s in [one, *near] if s[1] >= 3 and (s == one or kind(s) != "account")}
    assert secrets.link(spans)[0] == sorted(want)
    assert bool(want) == (" x" * 140 not in text)
