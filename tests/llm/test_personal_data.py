"""Disguises of identifiers: each is found with its source span, alone and inside prose of any
script, and base spans stay as the plain patterns have them."""

from __future__ import annotations

import pytest

from ludex.llm import pii
from tests.llm import fixtures as X

DISGUISES = [
    ("email", "jane_AT_example_DOT_com"), ("email", "j.doe_at_mail_dot_example_dot_org"), ("email", "jane&#64;example&#46;com"),
    ("email", "jane&#x40;example.com"), ("email", "jane&commat;example&period;com"), ("email", "j a n e @ e x a m p l e . c o m"),
    ("phone", "five five five one two three four five six seven"), ("phone", "plus four four two zero seven nine four six zero one two three"),
    ("phone", "cinco cinco cinco uno dos tres cuatro cinco seis siete"), ("phone", "null eins sieben sechs drei vier fünf sechs sieben acht neun"),
    ("phone", "zéro six un deux trois quatre cinq six sept huit")]
PROSE = ["look_at_me and x_dot_y", "a &#64; b &#46; c", "a b c d e f g h i", "one two three", "&#999999999; x", "meet at noon",
         "un deux trois", "six or seven people at the door", "first_at_last"]


@pytest.mark.parametrize(("kind", "text"), DISGUISES)
@pytest.mark.parametrize("frame", ["{}", "Write now: {} (soon)", "Écrire à {} vite", "中文 {} 字符"])
def test_disguise_is_found_where_it_stands(kind, text, frame):
    whole = frame.format(text)
    base = pii.find_base(whole)
    assert not any(base.values())
    found = pii.find_disguised(whole, base)
    at = whole.index(text)
    assert found == {k: [(at, at + len(text))] if k == kind else [] for k in pii.KINDS}


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_left_alone(text):
    assert not any(pii.find_disguised(text, pii.find_base(text)).values())


def test_numbers_of_any_length(spark):
    """Longer than an integer conversion allows: zeros in front count for nothing."""
    zeros = "0" * 5000
    texts = [f"{zeros}.1.1.1", f"{zeros}255.1.1.1", f"{zeros}256.1.1.1", "1" * 6000 + ".1.1.1", "x" * 400_000 + " a@b.co", None, ""]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.scan(X.with_clashes(X.frame(spark, rows))).collect()}
    assert [got[i].n_ip for i in range(7)] == [1, 1, 0, 0, 0, 0, 0] and got[4].n_email == 1
    assert got[0].spans == "ip:0:5006"
