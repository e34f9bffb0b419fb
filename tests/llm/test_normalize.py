import random
import unicodedata

import pyarrow as pa
import pytest

from loomspan.llm import normalize

TO = {x: k for k, several in normalize.LOOKALIKES.items() for x in several}


def expand(c):
    rule = unicodedata.decomposition(c).split()
    if rule and rule[0][0] == "<":
        if rule[0] in normalize.SAME_LOOK or 0xFB00 <= ord(c) <= 0xFB06:
            return "".join(expand(chr(int(x, 16))) for x in rule[1:])
        return c
    return c


def brute(text):
    """The same form, one character at a time (without joiners)."""
    text = "".join(c for c in text if ord(c) not in normalize.INVISIBLE)
    spaced = "".join(" " if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" else unicodedata.normalize("NFD", expand(c)) for c in text)
    mapped = "".join(TO.get(c, c) for c in spaced)
    return unicodedata.normalize("NFC", " ".join(x for x in mapped.split(" ") if x))


RANGES = [(0x20, 0x250), (0x300, 0x530), (0x900, 0xE00), (0x1100, 0x1200), (0x1E00, 0x2070), (0x3040, 0x3100), (0xAC00, 0xAD00), (0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x1F300, 0x1F400), (0x11080, 0x110C0)]


def test_against_brute_force():
    rng = random.Random(1)
    pool = [chr(c) for a, b in RANGES for c in range(a, b) if c not in normalize.JOINERS]
    marks = [chr(c) for c in range(0x300, 0x345)]
    texts = ["".join(rng.choice(pool if rng.random() < 0.6 else marks) for _ in range(rng.randrange(12))) for _ in range(8000)]
    texts += [None, "", "   ", "́a", "e" + "̣́" * 300, "\U00010400" * 5, "x" * 200_000 + "́"]
    got = normalize.normalized_array(pa.array(texts))
    assert got.to_pylist() == [None if t is None else brute(t) for t in texts]
    assert normalize.normalized_array(pa.array(texts).slice(3, 50)).to_pylist() == got.to_pylist()[3:53]
    assert normalize.normalized_array(got).to_pylist() == got.to_pylist()


SAME = [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("сору", "copy"), ("ό", "ó"), ("t​hat⁠.", "that."), ("a  b", "a b"), ("ﬁrst", "first"), ("ậ", "ậ"), ("co‐op", "co-op"), ("ｶﾞ", "ガ"), ("‍👩‍💻", "👩‍💻"), ("x‍y", "xy"), ("ё", "ë")]
DIFFERENT = [("cafe", "café"), ("x²", "x2"), ("①", "1"), ("A", "a"), ("I", "l"), ("0", "O"), ("👩💻", "👩‍💻"), ("a b", "ab"), ("в", "b"), ("½", "1/2"), ("!", "."), ("می‌خواهم", "میخواهم")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    x, y = normalize.normalized_array(pa.array([a, b])).to_pylist()
    assert x == y


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    x, y = normalize.normalized_array(pa.array([a, b])).to_pylist()
    assert x != y


def test_frames(spark):
    df = spark.createDataFrame([("1", "аb", "ab"), ("2", "ab", "ab"), ("3", None, "x"), ("4", "a", "b"), ("5", "", " "), ("1", "аb", "ab")], "id string, quote string, verbatim string")
    assert sorted(r["id"] for r in normalize.look_alikes(df, "quote", "verbatim").collect()) == ["1", "1", "5"]
    assert normalize.look_alikes(df.limit(0), "quote", "verbatim").count() == 0
    clashing = df.selectExpr("id", "quote", "verbatim", "'x' AS quote_form", "1 AS verbatim_form")
    assert sorted(r["id"] for r in normalize.look_alikes(clashing, "quote", "verbatim").collect()) == ["1", "1", "5"]
