import pytest
from pyspark.sql import functions as F

from kinloom.functions import names, text


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    out = df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]
    return out


@pytest.mark.parametrize(("f", "value", "expect"), [
    (text.normalize_quotes, "רש״י ג׳", "רש\"י ג'"),
    (text.strip_comments, "a<!-- x\ny -->b", "ab"),
    (text.normalize_title, "  a_b   c ", "a b c"),
    (text.display_name, "Name (place)", "Name"),
    (text.disambiguator, "Name (place)", "place"),
    (text.slug, 'a/b:"c"', "a_b_c_"),
    (text.escape_html, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
    (text.year_in, "נולד בשנת תרכ\"א בעיר", "תרכ\"א"),
    (text.year_in, "born 1861 there", "1861"),
    (text.year_in, "none", None),
    (text.plain, "'''A''' {{t|x={{y}}}}[[B|see b]] and [[C]]<ref>n</ref> <b>d</b>", "A see b and C d"),
    (text.strip_templates, "a{{b|{{c}}}}d", "ad"),
    (text.strip_templates, "a{{b", "a{{b"),
    (names.surname_of, "הרב משה כהן", "כהן"),
    (names.surname_of, "משה", ""),
    (names.surname_of, "שניאור זלמן מלאדי", ""),
    (names.year, "1861", 1861),
    (names.year, "ה'תרכ\"א", 1861),
    (names.year, "abc", None),
    (names.year, None, None),
])
def test_scalars(spark, f, value, expect):
    assert one(spark, f, value) == expect


def test_links_templates_sections_sentences(spark):
    links = one(spark, text.wikilinks, "[[A b|x]] [[קטגוריה:ג]] [[File:z]] [[C#d]] [[_E_]]")
    assert [(x["target"], x["display"]) for x in links] == [("A b", "x"), ("C", "C"), ("E", "E")]
    assert one(spark, text.categories, "[[קטגוריה: א ב |k]] [[category:C]]") == ["א ב", "C"]
    (t,) = one(spark, text.templates, "x {{Box|a = 1|[[p|q]]|2=z|b={{n|m=3}}}} y")
    assert (t["name"], t["params"], t["positional"], t["start"]) == ("Box", {"a": "1", "b": "{{n|m=3}}"}, ["[[p|q]]", "2=z"], 2)
    s = one(spark, text.sections, "lead\n== One ==\nbody\n=== Two ===\nmore")
    assert [(x["title"], x["level"]) for x in s] == [("", 0), ("One", 2), ("Two", 3)]
    assert one(spark, text.split_sentences, "A b. C [[d. e]] f! g\nh") == ["A b.", "C [[d. e]] f!", "g", "h"]
    assert one(spark, text.sentences_plain, "A b. C d! e\n\nf") == ["A b.", "C d!", "e", "f"]


def test_sentences_keep_digits_at_their_ends(spark):
    assert one(spark, text.sentences_plain, "0 a 0. 12.1.1.1 b\n2 c 2! 33") == ["0 a 0.", "12.1.1.1 b", "2 c 2!", "33"]
    assert one(spark, text.sentences_plain, "  a \n\u00a0b 1\u3000\n \u2003 \n\tc\t") == ["a", "b 1", "\tc\t"]


def test_nested_templates_and_own_namespaces(spark):
    found = one(spark, text.nested_templates, "a {{A|x={{B|[[p|q]]}}|{{C}}}} {{D_d|1=z}} {{open")
    assert [(t["name"], t["params"], t["positional"]) for t in found] == [("A", {"x": "{{B|[[p|q]]}}"}, ["{{C}}"]), ("B", {}, ["[[p|q]]"]), ("C", {}, []), ("D d", {}, ["1=z"])]
    assert all("a {{A|x={{B|[[p|q]]}}|{{C}}}} {{D_d|1=z}} {{open"[t["start"] : t["end"]].startswith("{{" + t["name"][0]) for t in found)
    links = one(spark, lambda c: text.wikilinks(c, ("portal:",)), "[[Portal:x]] [[y]]")
    assert [x["target"] for x in links] == ["y"]


def test_footnote_tokens(spark):
    t = "a<ref name=x/>b<ref>n. 2</ref>c"
    assert one(spark, text.tokenize_refs, t) == "a\0R0\0b\0R1\0c"
    assert one(spark, text.refs, t) == ["<ref name=x/>", "<ref>n. 2</ref>"]
    assert one(spark, lambda c: text.refs_in(text.tokenize_refs(c), text.refs(c)), t) == ["<ref name=x/>", "<ref>n. 2</ref>"]
    assert one(spark, lambda c: text.remove_ref_tokens(text.tokenize_refs(c)), t) == "abc"
    assert one(spark, lambda c: text.restore_refs(text.tokenize_refs(c), text.refs(c)), t) == t


@pytest.mark.parametrize(("a", "b", "expect"), [
    ("משה כהן", "הרב משה כהן", True), ("משה", "משה כהן", True), ("משה יצחק כהן", "משה כהן", True),
    ("משה-אורי בלוי", "משה אורי בלויא", True), ("משה (כהן)", "משה כהן", True), ("אסתר לבית וולף", "אסתר", True),
    ("חי שרה", "חיה שרה", True), ("משה כהן", "דוד כהן", False), ("משה כהן", "משה לוי", False),
])
def test_names_match(spark, a, b, expect):
    assert one(spark, names.names_match, a, b) is expect


@pytest.mark.parametrize(("f", "value", "expect"), [
    (names.name_key, "משה בלויא", "משה בלוי"), (names.name_key, "לנדא", "לנדא"), (names.name_key, "הרב משה, לאנדא", "משה לאנד"), (names.name_key, None, ""),
    (names.name_key, "שפירא", "שפירא"), (names.mention_surname, "הרב משה כהן", "כהן"), (names.mention_surname, "הרב משה", ""), (names.plain_surname, "בלויא", "בלוי"),
])
def test_name_keys(spark, f, value, expect):
    assert one(spark, f, value) == expect


@pytest.mark.parametrize(("a", "b", "expect"), [("בלוי", "בלויא", True), ("כהן", "לוין", False), ("גורארי", "גוראריה", True), ("שניאורסון", "שניאורסאן", True), ("", "כהן", False), ("לוי", "כהן", False)])
def test_similar_surnames(spark, a, b, expect):
    assert one(spark, names.similar_surname, a, b) is expect
