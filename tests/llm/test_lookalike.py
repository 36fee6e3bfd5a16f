from codelode.llm.lookalike import consistent, same_looking, spelt

CYR_A, CYR_E, CYR_O, GREEK_O = chr(0x430), chr(0x435), chr(0x43E), chr(0x3BF)


def test_same_to_a_reader():
    for a, b in [
        ("order", "ord" + CYR_E + "r"), ("zone", "z" + GREEK_O + "ne"), ("a b", "a" + chr(0xA0) + "b"), ("first", chr(0xFB01) + "rst"),
        ("abc", "".join(chr(ord(c) + 0xFEE0) for c in "abc")), ("zero", "ze" + chr(0x200B) + "ro"), ("caf" + chr(0xE9), "cafe" + chr(0x301)),
        ("a-b", "a" + chr(0x2011) + "b"), ("x\r\ny", "x\ny"), ("soft", "so" + chr(0xAD) + "ft"), ("end", "end  \n"), ("a\tb", "a b"),
        ("COP", chr(0x421) + chr(0x41E) + chr(0x420)), ("...", chr(0x2026)),
    ]:
        assert consistent(a) == consistent(b), (a, b)


def test_different_to_a_reader():
    for a, b in [("x2", "x" + chr(0xB2)), ("1", chr(0x2460)), ("TM", chr(0x2122)), ("Order", "order"), ("o", chr(0xF6)), ("a b", "a  b"), ("ab", "ba"), ("A", chr(0x1D4D0)), ("H2O", "H" + chr(0x2082) + "O")]:
        assert consistent(a) != consistent(b), (a, b)


def test_more_shapes_and_tags():
    lisu = "".join(map(chr, (0xA4D1, 0xA4EE, 0xA4E2)))  # reads PAS
    for a, b in [
        ("gas", chr(0x261) + chr(0x251) + "s"), ("COP", chr(0x2CA4) + chr(0x2C9E) + chr(0x2CA2)), ("PAS", lisu), ("a/b", "a" + chr(0x2215) + "b"), ("a-b", "a" + chr(0x2212) + "b"), ("real", "rea" + chr(0x4CF)),
        ("unit", chr(0x3C5) + "n" + chr(0x3B9) + "t"), ("tag", "t" + chr(0xE0061) + "ag" + chr(0xE007F)), ("all", "a" + chr(0x1C0) + "l"),
    ]:
        assert consistent(a) == consistent(b), (a, b)
    flag = lambda land: chr(0x1F3F4) + "".join(chr(0xE0000 + ord(c)) for c in land) + chr(0xE007F)
    assert consistent(flag("gbeng")) != consistent(flag("gbsct")) and consistent(flag("gbeng")) != chr(0x1F3F4)


def test_a_token_keeps_the_script_that_only_it_can_have():
    word = "п" + CYR_O + "иск"
    assert spelt("п" + "o" + "иск") == word == spelt(word)
    assert spelt(CYR_A + CYR_O) == "ao"


def test_null_blank_and_idempotence():
    assert consistent(None) is None and consistent("") == "" and consistent(" \n\t ") == ""
    for t in ["a" * 50_000, "ﬃ…Ⅳ", "한국어 שלום", chr(0x1F469) + chr(0x200D) + chr(0x1F4BB)]:
        assert consistent(consistent(t)) == consistent(t)
    assert chr(0x200D) in consistent(chr(0x1F469) + chr(0x200D) + chr(0x1F4BB))


def test_pairs_of_classes(spark):
    v = "ord" + CYR_E + "r"
    rows = [(1, "order"), (2, "order"), (3, v), (3, v), (4, None), (5, ""), (6, "  "), (7, "other"), (None, "order"), (8, " "), (9, chr(0x200B))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'f' as form", "'s' as same", "1 as first")
    assert {tuple(r) for r in same_looking(docs).collect()} == {(1, 3), (2, 3)}
    assert same_looking(docs.limit(0)).count() == 0


def test_many_rows_of_a_form_give_all_pairs(spark, monkeypatch):
    from codelode.llm import common
    from codelode.llm.lookalike import form_classes

    monkeypatch.setattr(common, "BLOCK", 8)
    rows = [(k, "order") for k in range(30)] + [(100 + k, "ord" + CYR_E + "r") for k in range(30)] + [(200, CYR_O + "rder"), (300, "other"), (301, None), (302, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [tuple(r) for r in same_looking(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, x in rows[:61] for b, y in rows[:61] if a < b and x != y}
    got = {tuple(r) for r in form_classes(docs).collect()}
    assert got == {(k, 0, 0, 3) for k in range(30)} | {(100 + k, 0, 100, 3) for k in range(30)} | {(200, 0, 200, 3), (300, 300, 300, 1)}
