import unicodedata

import pytest

from stewardry.llm import looks

SCHEMA = "id bigint, text string, k string, parts string, look string"


def direct(text):
    """The form computed character by character, without tables, joins or stretches."""
    text = text.replace("\r\n", "\n")
    parts = "".join(looks._parts(c) if not c.isascii() or c in "\t\r" else c for c in text)
    return unicodedata.normalize("NFC", parts)


TEXTS = [
    "plain ASCII text.\nTwo lines", "", "\u200b", "caf\u00e9", "cafe\u0301", "ca\u200bfe\u0301\ufeff", "c\u0430f\u00e9", "\uff43\uff41\uff46\u00e9", "a\u00a0b", "a b", "a\u2009b", "a\tb", "a  b", "\ufb01n", "fin", "\u0422\u0438\u0445\u043e", "Ti\u0445o",
    "q\u0323\u0307", "q\u0307\u0323", "x\u00b2", "x2", "line\r\nend", "line\nend", "line\u2028end", "\ud55c\uae00", "\u1112\u1161\u11ab\u1100\u1173\u11af", "\u0451", "\u00eb", "e\u0308", "\u0439", "\u0438\u0306", "K\u212a\u00c5\u212b", "\u00df", "ss", "A", "a", "\U0001d400", "\u2026",
    "\u4e2d\u6587" * 500, "\u0301lead", "\u0416\u0301" * 200, "a" * 100_000 + "\u00a0",
    "a\u0323\u0302\u0308", "e\u0301\u0327\u0302", "o\u0315\u0301", "u\u031b\u0323\u0301x\u0301\u0301", "\u1f00\u0345\u0301", "\u0578\ua4ee\u13ba\u2c9f", "nAAo",
]


def test_same_form_as_direct_normalisation(spark):
    rows = [(i, t, "k", None, "x") for i, t in enumerate([*TEXTS, *TEXTS[:6]])] + [(900, None, "k", "p", "l")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = looks.normalise(df)
    assert got.columns == [*df.columns, "look_"]
    by = {r.id: r for r in got.collect()}
    assert len(by) == len(rows) and by[900].look_ is None
    for i, t, *_ in rows[:-1]:
        assert by[i].look_ == direct(t), ascii(t[:40])
        assert (by[i].text, by[i].k) == (t, "k")


def test_forms_are_stable(spark):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], SCHEMA).select("id", "text")
    once = looks.normalise(df).select("id", looks.F.col("look").alias("text"))
    assert once.exceptAll(looks.normalise(once).select("id", looks.F.col("look").alias("text"))).count() == 0


def test_pairs(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(100 + i, "", None, None, None) for i in range(5)] + [(200, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in looks.same_look_pairs(df, "id").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and direct(a[1]) == direct(b[1])}
    assert got == want and (1, 2) in want and (3, 4) in want
    assert looks.same_look_pairs(df.limit(0), "id").count() == 0


def test_a_third_of_all_rows_being_blank(spark):
    rows = [(i, "", None, None, None) for i in range(3000)] + [(5000, "\u200b", None, None, None), (5001, "x", None, None, None), (5002, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert looks.same_look_pairs(df, "id").count() == 3000
    classes = {r.id: (r.representative, r.n_rows, r.n_strings) for r in looks.look_classes(df, "id").collect()}
    assert len(classes) == 3002 and classes[5000] == classes[17] == (0, 3001, 2) and classes[5001] == (5001, 1, 1)


@pytest.mark.parametrize("a,b", [("x\u00b2", "x2"), ("\u00df", "ss"), ("A", "a"), ("caf\u00e9", "cafe"), ("a  b", "a b"), ("a\nb", "a b"), ("\u2019", "'"), ("0", "O"), ("1", "l")])
def test_different_looks_stay_different(a, b):
    assert direct(a) != direct(b)
