from pyspark.sql import functions as F

from vellum.functions import keys, labels, lexemes


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_canonical_key_folds_compatibility_forms_and_blanks(spark):
    texts = ["  Red\tWidget ", "ＡＢＣ", "ﬁne Ⅳ", "a  b", "İx", "\ufeffq\u2028r", None]
    assert values(spark, texts, keys.canonical_key) == ["red widget", "abc", "fine iv", "a b", "i̇x", "q r", None]
    assert [keys.fold_text(t) for t in texts if t] == ["red widget", "abc", "fine iv", "a b", "i̇x", "q r"]


def test_slug_drops_marks_and_falls_back_to_code_points(spark):
    assert values(spark, ["Crème Brûlée!", "剣", "+1", "--A--"], keys.slugify) == ["creme-brulee", "5263", "1", "a"]
    assert values(spark, ["+*", "😀é"], keys.slugify) == ["2b-2a", "e"]
    assert values(spark, ["😀剣"], keys.slugify) == ["1f600-5263"]


def fnv(text):
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits.rjust(7, "0")


def test_suffix_hashes_code_points(spark):
    texts = ["item:red widget", "item:剣😀", "a", ""]
    assert values(spark, texts, keys.stable_suffix) == [fnv(t) for t in texts]


def test_order_is_by_utf16_code_units(spark):
    texts = ["\U0001f600", "\uffee", "z", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in df.orderBy(keys.code_unit_order(F.col("t"))).collect()]
    assert got == sorted(texts, key=lambda t: t.encode("utf-16-be"))


def test_number_grammars_reject_what_a_cast_would_take(spark):
    texts = ["5", "-7", "+5", " 5", "5.0", "1e3", "9007199254740991", "9007199254740992", "", None]
    assert values(spark, texts, lexemes.source_integer) == [5, -7, None, None, None, None, 9007199254740991, None, None, None]
    texts = ["5", "-.5", ".5", "5.", "1e3", "NaN", "0x1"]
    assert values(spark, texts, lexemes.source_number) == [5.0, -0.5, 0.5, None, None, None, None]
    assert values(spark, ["1", "true", "True", "0", "", None], lexemes.flag) == [True, True, False, False, False, False]
    assert values(spark, ["1", "true", "0", None], lexemes.optional_bit) == [True, None, False, None]


def test_titles_keep_the_rest_of_a_word(spark):
    assert values(spark, ["mcDuff-the_big:one"], labels.category_title) == ["McDuff The Big One"]
    assert values(spark, ["invalid_xml_root"], labels.diagnostic_label) == ["Invalid XML Root"]
    assert values(spark, ["NoFood", "opensBigDoors"], labels.flag_label) == ["No food", "Opens Big Doors"]


def test_paths_that_leave_their_root_are_refused(spark):
    texts = [".\\art\\a.png", "/etc/x", "C:\\x", "a/../b", "a..b/c", ""]
    assert values(spark, texts, labels.asset_path) == ["art/a.png", None, None, None, "a..b/c", None]
