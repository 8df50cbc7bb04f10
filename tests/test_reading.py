"""What sentences and lines of lists say, and what they don't: no Spark needed."""

import pytest

from kinloom.operators import reading
from kinloom.operators.reading import Lexicon

GIVEN = "משה רבקה ברוך חנה שלום אברהם אשר שאול שלמה שמואל יהודה אריה רחל יוסף יצחק שניאור צבי דוד".split()
LAST = "כהן לוי וילהלם לנדא גליצנשטיין הרטמן".split()
COMMON = "מפעילה פעילות רחבה שימשה כמחנכת ביתו שליח בארץ תנועת מראשי מנהיג בירושלים חסיד רב בעיר נסע".split()
NAMES = Lexicon(frozenset(GIVEN), frozenset(LAST), frozenset([*GIVEN, *LAST, "זלמן"]), frozenset(COMMON))
KNOWN = frozenset({"S", "G", "L", "Y", "X", "Z", "A", "B", "T", "D"})
TABLE = reading.phrases()


def said(text, context="", known=None, names=NAMES):
    return {(f.relation, f.person, f.relative) for _, f in reading.read_line("P", text, context, TABLE, names, known)}


@pytest.mark.parametrize(("text", "expect"), [
    # clauses and subjects
    ("בנו של [[A]], בנו הבכור של [[B]].", {("parent", "P", "A"), ("parent", "A", "B")}),
    ("היה חתנו של [[T]], בעלה של [[D]].", {("parent_in_law", "P", "T"), ("spouse", "P", "D")}),
    ("בתו חנה נישאה ל[[L]]. בנו, ר' שאול אמסעל - שליח.", {("parent", "~חנה", "P"), ("spouse", "~חנה", "L"), ("parent", "~שאול אמסעל", "P")}),
    ("אחיו ר' [[S]] היה נשוי למרת חנה, בת הרב [[G]], שד\"ר כולל.", {("sibling", "P", "S"), ("spouse", "S", "~חנה"), ("parent", "~חנה", "G")}),
    ("נולד בה' אייר תש\"ב להוריו ר' ברוך יהודה (בנו של משה וילהלם בנו של [[S]]) וזוגתו מרת חנה.",
     {("parent", "P", "~ברוך יהודה"), ("parent", "~ברוך יהודה", "~משה וילהלם"), ("parent", "~משה וילהלם", "S"), ("spouse", "~ברוך יהודה", "~חנה")}),
    ("נולד בירושלים לר' ברוך יהודה וילהלם, שהיה מראשי התנועה, בנו של ר' משה וילהלם, מנהיג תנועת אגודה בארץ (בנו של [[S]]).",
     {("parent", "P", "~ברוך יהודה וילהלם"), ("parent", "~ברוך יהודה וילהלם", "~משה וילהלם"), ("parent", "~משה וילהלם", "S")}),
    ("נולד בירושלים לר' ברוך יהודה וילהלם, שהיה מראשי התנועה, בנו של ר' משה וילהלם, מנהיג תנועת [[אגודה]] בארץ (בנו של [[S]]).",
     {("parent", "P", "~ברוך יהודה וילהלם"), ("parent", "~ברוך יהודה וילהלם", "~משה וילהלם"), ("parent", "~משה וילהלם", "S")}),
    ("P הייתה בתם של אביה הרב שאול וילהלם ושל אימה חנה אמסעל בתו של הרב [[G]].",
     {("parent", "P", "~שאול וילהלם"), ("parent", "P", "~חנה אמסעל"), ("parent", "~חנה אמסעל", "G")}),
    ("P נולדה בשנת תרע\"ד לאביה הרב שאול וילהלם, ולאימה חנה אמסעל, בתו של הרב [[G]], ונקראה על שם סבתה.",
     {("parent", "P", "~שאול וילהלם"), ("parent", "P", "~חנה אמסעל"), ("parent", "~חנה אמסעל", "G")}),
    ("בשנת תשכ\"ד (1964) התחתן עם מתיה וילהלם, בתו של הרב שאול צבי וילהלם, מחסידי העיר.",
     {("spouse", "P", "~מתיה וילהלם"), ("parent", "~מתיה וילהלם", "~שאול צבי וילהלם")}),
    ("ר' משה כהן (אביו של [[X]]) נסע.", {("parent", "X", "~משה כהן")}),
    ("ילדיו: [[X]], [[Y]] ו[[Z]].", {("parent", "X", "P"), ("parent", "Y", "P"), ("parent", "Z", "P")}),
    ("נשא את בתו של [[X]].", {("parent_in_law", "P", "X")}),
    ("[[X]], אשת [[Y]].", {("spouse", "X", "Y")}),
    ("[[X]] בת [[Y]].", {("parent", "X", "Y")}),
    ("בת [[Y]].", set()),
    ("חתן [[Y]].", {("parent_in_law", "P", "Y")}),
    ("נולד ב[[ליאזנא]] לאביו ר' ברוך ולאמו מרת רבקה.", {("parent", "P", "~ברוך"), ("parent", "P", "~רבקה")}),
    ("נישאה לר' משה כהן.", {("spouse", "P", "~משה כהן")}),
    ("נישאה לעולם.", set()),
    # years, composite kin and order of birth are no parents, spouses or children
    ("ילדיו: [[1950]], [[דוד כהן]]", {("parent", "דוד כהן", "P")}),
    ("אשתו [[ה'תרכ\"א]]", set()),
    ("אביו [[כ' במנחם אב]]", set()),
    ("אחי אביו, [[X]]", {("uncle", "P", "X")}),
    ("אם אמו, [[X]]", {("grandparent", "P", "X")}),
    ("את ההתקשרות קיבל מדודו, אחי אביו, הרב [[S]]. נולד בין [[A]] ל[[B]].", {("uncle", "P", "S")}),
    ("נולד בירושלים (אם אמו הרבנית מרת חנה אמסעל היא נכדת הרבנית רחל).", {("grandparent", "P", "~חנה אמסעל")}),
    ("סבו מצד אביו, [[Y]], היה רב.", {("grandparent", "P", "Y")}),
    ("חותן אביו, [[X]]", set()),
    ("נקרא על שם סבו [[X]], ואביו [[Y]]", {("parent", "P", "Y")}),
])
def test_sentences(text, expect):
    assert said(text, known=KNOWN | {"דוד כהן"}) == expect


@pytest.mark.parametrize(("line", "context", "expect"), [
    ("* [[X]] – נישאה לר' משה כהן.", "ילדיו:", {("parent", "X", "P"), ("spouse", "X", "~משה כהן")}),
    ("* [[X]] – בנו הבכור", "", {("parent", "X", "P")}),
    ("* אחיו: [[X]], [[Y]] ו[[Z]]", "", {("sibling", "P", "X"), ("sibling", "P", "Y"), ("sibling", "P", "Z")}),
    ("* [[X]] – בנו של [[Y]]", "", {("parent", "X", "Y")}),
    ("* [[X]], רב ב[[עיר]]", "חתניו", {("parent_in_law", "X", "P")}),
    ("* ר' שלום לוי – רב", "צאצאיו", {("parent", "~שלום לוי", "P")}),
    ("* [[X]]", "ספריו", set()),
    ("*חתנו, ר' אריה הרטמן - בעיר, בנו של [[Y]].", "", {("parent_in_law", "~אריה הרטמן", "P"), ("parent", "~אריה הרטמן", "Y")}),
    ("*בתו, רחל הרטמן - בעיר, חמיה הרב [[Y]].", "", {("parent", "~רחל הרטמן", "P"), ("parent_in_law", "~רחל הרטמן", "Y")}),
    ("*הרב שניאור זלמן הרטמן - בעיר. חתן ר' [[Y]].", "ילדיו:", {("parent", "~שניאור זלמן הרטמן", "P"), ("parent_in_law", "~שניאור זלמן הרטמן", "Y")}),
    ("* חנה ליבא, אשת [[G]]", "", {("spouse", "~חנה ליבא", "G")}),
    ("* בתו [[D]] נישאה לר' שלום כהן.", "", {("parent", "D", "P"), ("spouse", "D", "~שלום כהן")}),
    ("* [[1950]]", "ילדיו:", set()),
])
def test_list_lines(line, context, expect):
    assert said(line, context, KNOWN) == expect


def test_sides_spans_and_doubt():
    rows = [f for _, f in reading.read_line("P", "סבו מצד אביו, [[Y]], ואם אמו [[Q]].", "", TABLE, NAMES, KNOWN)]
    assert [(f.relative, f.side, f.doubtful) for f in rows] == [("Y", "father", False), ("Q", "mother", True)]
    text = "הוא נסע. אביו [[X]] נסע."
    (f,) = [f for _, f in reading.read_line("P", text, "", TABLE, NAMES, KNOWN)]
    assert text[f.start : f.end] == "אביו [[X]]"


@pytest.mark.parametrize(("text", "titled", "name"), [
    ("שימשה כמחנכת", False, ""), ("חנה מפעילה פעילות רחבה", False, "חנה"), ("חנה למשפחת וולף", False, "חנה לבית וולף"), ("חנה בלה ביתו", False, "חנה בלה"),
    ("שאול אמסעל", False, "שאול אמסעל"), ("מנדבורנא", True, ""), ("אשר", False, "אשר"), ("וילהלם", False, ""), ("מתיה וילהלם", False, "מתיה וילהלם"),
    ("שימשה וילהלם", False, ""), ("שאול סג\"ל וילהלם", False, "שאול סג\"ל וילהלם"), ("ברוך ולאמו מרת רבקה", True, "ברוך"), ("אברהם כהן מקישינוב", False, "אברהם כהן"),
    ("אברהם אלכסנדרוב ונכדתו", False, "אברהם אלכסנדרוב"), ("משה כהן, רב", False, "משה כהן"), ("תרפ\"ט", True, ""), ("", True, ""),
])
def test_names(text, titled, name):
    assert NAMES.name(text, titled) == name


def test_names_without_common_words_stop_at_words_that_nobody_knows():
    plain = Lexicon(NAMES.given, NAMES.last, NAMES.every)
    assert plain.name("משה נכנס", False) == "משה" and plain.name("זלמנון בא", True) == "זלמנון"


@pytest.mark.parametrize("text", ["כ' במנחם אב", "ל' בסיוון", 'י"א ניסן', 'תרפ"ט', 'ה\'תשמ"ב', "ג' תמוז", "1950", "שנת השמיטה", "פורים"])
def test_dates_are_not_people(text):
    assert reading.looks_like_year(text)


@pytest.mark.parametrize("text", ["חנה", "מנחם מענדל", "אב הרבי", "דוד כהן"])
def test_people_are_not_dates(text):
    assert not reading.looks_like_year(text)


def test_titles_must_touch():
    assert reading.title_gender("* הרב שלום הלפרין, רב ב") == (False, None)
    assert reading.title_gender("אחיו הרב ") == (True, "m") and reading.title_gender("בתו מרת ") == (True, "f")
