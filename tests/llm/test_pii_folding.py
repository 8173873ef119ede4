"""op6: identifiers in any alphabet that folds; offsets, redaction, and the columns of the query."""

import hashlib
import random
import re
import unicodedata

import pytest

from codeloom.llm import pii
from codeloom.llm.queries_pii import QUERIES


def written_as(plain):
    """Every single character that folds to the ASCII one."""
    return [c for c, to in pii._ALIKE.items() if to == plain]


def test_every_alphabet_is_folded():
    for base in range(0x1D400, 0x1D6A4):
        plain = unicodedata.normalize("NFKC", chr(base))
        if plain != chr(base) and plain.isascii():
            assert pii._ALIKE[chr(base)] == plain
    assert all(pii._ALIKE[c] == "a" for c in "ⓐａ𝒶𝔞𝕒𝖆𝘢𝙖𝚊ªɑа")


def test_addresses_in_any_alphabet_give_the_same_span():
    rng = random.Random(3)
    for _ in range(400):
        plain = rng.choice(["john@example.com", "mary.poppins7@mail-1.example.org"])
        shown = "".join(rng.choice([c, *written_as(c)]) if c.isalnum() and rng.random() < 0.7 else c for c in plain)
        lead, tail = rng.choice(["", "see ", "é "]), rng.choice(["", " now", ", ok"])
        text = lead + shown + tail
        _, spans = pii.spans_of(text)
        assert ("email", len(lead), len(lead) + len(shown)) in spans, text
        assert pii.redacted(text) == lead + "<EMAIL>" + tail, text


@pytest.mark.parametrize("text,kind,of", [("jօhn@example.com", "email", None), ("john@exɑmple.com", "email", None), ("john&#64;example&#46;com", "email", None), ("john&commat;example.com", "email", None), ("ip ⑩.①.⑫.③ here", "ip", "⑩.①.⑫.③"), ("john ⓐⓣ example ⓓⓞⓣ com", "email", None), ("🅹🅾🅷🅽@example.com", "email", None)])
def test_disguises(text, kind, of):
    of = of or text
    assert (kind, text.index(of), text.index(of) + len(of)) in pii.spans_of(text)[1]


def test_clean_texts_stay():
    for text in ("№ 5 … ﬁnd the ﬂag at home. Dot the i.", "AT&T; x &amp; y &#65; at 3 ½ m² dot", "Ⅻ. Ludwig ⅰⅰ"):
        assert pii.spans_of(text) == ([], []) and pii.redacted(text) == text


def test_query_columns(spark, tmp_path):
    rows = [(1, "john@example.com and jօhn@example.com"), (2, None), (3, ""), (None, "call +1 (136) 555-7479"), (4, "4111 1111 1111 1111 at 10.0.0.1 or 300.1.1.1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        base, every = pii.spans_of(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(pii.written_spans(base).encode()).hexdigest() and r.spans == pii.written_spans(every)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in every) for kind in pii.KINDS]
    assert [re.sub(r":.*", "", x) for x in got[4].spans.split(",")] == ["card", "ip"]
