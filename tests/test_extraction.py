from pyspark.sql import functions as F

from kinloom.operators import extraction, model_extraction
from kinloom.plans import storage

def test_lists_below_their_lead_in(spark):
    text = "פלוני נולד בעיר.\n== משפחתו ==\nילדיו:\n* [[רבקה]] – נישאה ל[[דוד]].\n* [[יהודה]]<ref>ש</ref>\n== ספריו ==\n* [[ספר]]"
    rows = extraction.from_text(spark.createDataFrame([("פלוני", text)], "title string, wikitext string")).collect()
    assert {(r["relation"], r["person"], r["relative"]) for r in rows} == {("parent", "רבקה", "פלוני"), ("spouse", "רבקה", "דוד"), ("parent", "יהודה", "פלוני")}
    assert next(r["refs"] for r in rows if r["person"] == "יהודה") == ["<ref>ש</ref>"]


def test_lexicon_and_genders(spark):
    titles = spark.createDataFrame([("משה כהן",), ("רבקה לוי (אשת דוד)",), ("כהן משה",)], "title string")
    rows = extraction.lexicon_of(titles, None, 3).collect()
    assert {r["word"] for r in rows if r["given"]} == {"משה", "רבקה", "כהן"} and {r["word"] for r in rows if r["last"]} == {"לוי"}
    assert extraction.lexicon_of(titles, None, 4) is None
    rows = [("הרבנית רבקה", "", "f"), ("הרב דוד", "", "m"), ("חנה (אשת דוד)", "", "f"), ("דוד (בן חנה)", "", "m"), ("פלוני", "נולדה בעיר", "f"), ("פלוני", "הוא נולד", "m"), ("פלוני", "", None)]
    df = spark.createDataFrame(rows, "t string, lead string, g string")
    got = df.select(
        extraction.gender_of_title(F.col("t"), F.col("lead")), "g", extraction.gender_votes(F.lit("נולד, ואז נולד, נולדה"))["m"], extraction.honorific_gender(F.lit("אצל הרבנית ")),
        extraction.honorific_gender(F.lit("הרב בעיר ")), extraction.looks_like_year(F.lit('תרפ"ט')), extraction.looks_like_year(F.lit("דוד")),
        extraction.gender_conflict(F.lit(None).cast("string"), F.struct(F.lit(3).alias("m"), F.lit(1).alias("f")), F.lit("f")),
    ).collect()
    assert all(r[0] == r[1] and tuple(r[2:]) == (2, "f", None, True, False, True) for r in got)


def test_years_of_pages(spark):
    rows = [("A", "{{אישיות|תאריך לידה=ה'תר\"מ}}\nנפטר בשנת 1950."), ("B", "נולד ב-1900 בעיר")]
    df = spark.createDataFrame(rows, "title string, wikitext string")
    got = {r["title"]: (r["born"], r["died"]) for r in extraction.page_years(df, ("תאריך לידה",), ("תאריך פטירה",)).collect()}
    assert got["A"][0].endswith('תר"מ') and got["A"][1] == "1950" and got["B"] == ("1900", None)


class Stub:
    def __call__(self, title, text):
        if title == "bad":
            raise RuntimeError("no")
        return [{"person": title, "relative": "B", "relation": "parent", "confidence": 3, "evidence": text}, {"person": title, "relative": title, "relation": "parent"},
                {"person": "x", "relative": "y", "relation": "friend"}]


def test_model_answers_are_cached(spark):
    pages = spark.createDataFrame([("A", 1, "text"), ("A", 1, "text"), ("bad", 2, "t")], "title string, revid long, wikitext string")
    answers = storage.written(model_extraction.ask(model_extraction.asked(pages, None), Stub, attempts=2, wait=0.0))
    cache = model_extraction.updated_cache(None, answers)
    assert {r["title"]: (len(r["relations"]), r["error"]) for r in cache.collect()} == {"A": (1, None), "bad": (0, "RuntimeError: no")}
    assert [r["title"] for r in model_extraction.asked(pages, cache).collect()] == ["bad"]
    (r,) = model_extraction.relations(cache, pages.select("title").distinct()).collect()
    assert (r["person"], r["relative"], r["confidence"], r["method"]) == ("A", "~B", 0.85, "model")


def strict_world(spark, text):
    titles = ["אשר וילהלם", "חנה וילהלם", "שאול וילהלם", "שלמה זלמן לנדא", "שמואל גליצנשטיין", "פלוני כהן"]
    pages = spark.createDataFrame([(t, text if t == "פלוני כהן" else "הוא נסע לעיר.") for t in titles] + [("עיר", "נסע נסע")] , "title string, wikitext string")
    known = spark.createDataFrame([(t,) for t in titles], "title string")
    lexicon = extraction.lexicon_of(known, pages.select(F.col("wikitext").alias("text")), 3, 2)
    return pages, lexicon, known


def test_lexicon_and_known_people_come_by_joins(spark):
    text = "אחיו ר' [[שאול וילהלם]] היה נשוי למרת חנה, בת הרב [[שמואל גליצנשטיין]].<ref>מקור</ref> אביו [[עיר]].\nילדיו: [[1950]], [[אשר_וילהלם]]"
    pages, lexicon, known = strict_world(spark, text)
    assert {(r["word"], r["common"]) for r in lexicon.collect() if r["word"] in ("נסע", "חנה", "לנדא")} == {("נסע", True), ("חנה", False), ("לנדא", False)}
    rows = extraction.extract(pages, {}, lexicon, known).collect()
    got = {(r["relation"], r["person"], r["relative"]): r for r in rows}
    assert set(got) == {("sibling", "פלוני כהן", "שאול וילהלם"), ("spouse", "שאול וילהלם", "~חנה"), ("parent", "~חנה", "שמואל גליצנשטיין"),
                        ("parent", "פלוני כהן", "עיר"), ("parent", "אשר וילהלם", "פלוני כהן")}
    doubt = got["parent", "פלוני כהן", "עיר"]
    assert doubt["doubtful"] and doubt["confidence"] == 0.35 and got["sibling", "פלוני כהן", "שאול וילהלם"]["refs"] == ["<ref>מקור</ref>"] and doubt["refs"] == []
    assert all(r["start"] < r["end"] for r in rows)


def test_aliases_stand_for_pages(spark):
    from kinloom.operators import identity

    text = "אביו הרב שאול וילהלם. אמו מרת חנה לנדא.\n== משפחתו ==\n* בנו, ר' שאול וילהלם"
    pages, lexicon, known = strict_world(spark, text)
    index = identity.unique_alias_index(spark.createDataFrame([("שאול וילהלם", "שאול וילהלם (הרב)", "name"), ("חנה לנדא", "חנה (אם)", "nick")], "alias string, title string, kind string"))
    got = {(r["relation"], r["person"], r["relative"]): (r["confidence"], r["alias"]) for r in extraction.extract(pages, {}, lexicon, known, index).collect()}
    assert got[("parent", "פלוני כהן", "שאול וילהלם (הרב)")] == (0.7, True) and got[("parent", "פלוני כהן", "חנה (אם)")] == (0.7, True)
    assert ("parent", "~שאול וילהלם", "פלוני כהן") in got  # a name in a list is not resolved


def test_years_from_categories(spark):
    text = "P היה חסיד.\n[[קטגוריה:אישים שנולדו בשנת תרצ\"ז]]\n[[קטגוריה:אישים שנפטרו בשנת תשע\"ט]]"
    (r,) = extraction.page_years(spark.createDataFrame([("P", text)], "title string, wikitext string"), (), ()).collect()
    assert (r["born"], r["died"]) == ('תרצ"ז', 'תשע"ט')


def test_table_function_gives_what_the_frame_gives(spark):
    text = "<!-- x<ref>no</ref> -->{{אישיות|אב=ב<ref>box</ref>}}פלוני בנו של [[דוב]].<ref>one</ref> נשוי ל[[אשה]].\n== משפחתו ==\nילדיו:\n* [[בת]]<ref name=\"t\">two</ref> – נישאה ל[[חתן]].\n* [[1950]]\n== ספריו ==\n* [[ספר]]"
    pages = spark.createDataFrame([("פלוני", text), ("ריק", ""), ("אין", None)], "title string, wikitext string")
    extraction.register_page_reader(spark)
    pages.createOrReplaceTempView("some_pages")
    columns = [c.split()[0] for c in extraction.SCHEMA.split(", ")]
    told = {tuple(map(str, r)) for r in spark.sql("SELECT * FROM relations_of(TABLE(some_pages))").select(columns).collect()}
    assert told == {tuple(map(str, r)) for r in extraction.from_text(pages).select(columns).collect()} and len(told) == 4
    notes = {r["relative"]: r["refs"] for r in spark.sql("SELECT * FROM relations_of(TABLE(some_pages))").collect()}
    assert notes["דוב"] == ["<ref>one</ref>"] and notes["פלוני"] == ['<ref name="t">two</ref>'] and notes["אשה"] == []
