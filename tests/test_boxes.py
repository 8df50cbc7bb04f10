from pyspark.sql import functions as F

from kinloom import cli
from kinloom.operators import boxes, layout
from kinloom.sinks import outputs
from tests.test_merging import edges, people


def told(p):
    return p.drop("born", "died").withColumns({"born": F.when(F.col("id") == "A (x)", "1900"), "died": F.lit(None).cast("string")})


def test_labels_and_refs(spark):
    rows = [("A (x)", "A", "1900", "1950"), ("B", "B", None, None), ("~C@z", "C", None, "1800"), ("D", "D", "1700", None)]
    df = spark.createDataFrame(rows, "id string, name string, born string, died string")
    got = [r[0] for r in df.select(boxes.person_label(F.col("id"), F.col("name"), F.col("born"), F.col("died"))).collect()]
    assert got == ["[[A (x)|A]]<br /><small>x · 1900–1950</small>", "[[B]]", "C<br /><small>?–1800</small>", "[[D]]<br /><small>1700</small>"]
    ref = spark.createDataFrame([("<ref>a|b [[c|d]] {{e|f}}</ref>",)], "r string").select(boxes.sanitize_ref(F.col("r"))).first()[0]
    assert ref == "<ref>a{{!}}b [[c|d]] {{e|f}}</ref>"


def test_contents(spark):
    p = told(people(spark, ("A (x)", "m", None), ("B", "f", None), ("~w", "f", None), ("F", "m", None), ("L", "m", None), ("~n", "m", None)))
    e = edges(spark, ("B", "A (x)", "parent"), ("A (x)", "~w", "spouse"), ("~w", "F", "parent"), ("A (x)", "L", "sibling_in_law"), ("~n", "A (x)", "parent"))
    shown = spark.createDataFrame([("t", "A (x)", "member", 0, None, ["k"], True, None, True), ("t", "B", "member", 1, None, [], False, "note", False), ("t", "~n", "member", 1, None, [], False, None, False)],
                                  "tree_id string, person string, role string, depth int, partner string, extra array<string>, truncated boolean, note string, has_children boolean")
    inline = spark.createDataFrame([("t", "A (x)", "~w", 0)], "tree_id string, person string, spouse string, place int")
    trees = spark.createDataFrame([("F", "תבנית:עץ F"), ("A (x)", "t")], "person string, title string")
    secret = spark.createDataFrame([("t", "~n")], "tree_id string, person string")
    got = {r["person"]: r["content"] for r in boxes.box_contents(shown, inline, p, e, trees, secret).collect()}
    assert got["A (x)"] == ("[[A (x)|A]]<br /><small>x · 1900</small><br /><small>אשתו: בת [[F]] ([[תבנית:עץ F|עץ F]])</small><br /><small>גיסו: [[L]]</small>"
                            "<br /><small>ילדים נוספים: k</small><br /><small>(יש צאצאים נוספים)</small>")
    assert got["B"] == "[[B]]<ref>r</ref><br /><small>note</small>" and got["~n"] == "בן (ללא ערך)<ref>r</ref>"


def test_pages_and_templates(spark):
    df = spark.createDataFrame([("עץ משפחת כהן", "BODY", ["n"], ["משפחת כהן"])], "t string, b string, n array<string>, c array<string>")
    page = df.select(outputs.tree_page(F.col("t"), F.col("b"), F.col("n"), F.col("c"))).first()[0]
    assert page.startswith("<!--") and "\n     n\n-->\nBODY\n<noinclude>\n[[קטגוריה:עצי משפחה|כהן]]\n[[קטגוריה:משפחת כהן|*]]\n</noinclude>\n" in page
    slots = spark.createDataFrame([("A", "f", "B"), ("A", "m", "~C"), ("A", "zz", "B")], "person string, slot string, ancestor string")
    text = outputs.ahnentafel(slots, told(people(spark, ("B", "m", None), ("~C", "f", None))), "T", {"m": "mother", "f": "father"}).first()["text"]
    assert text == "{{T\n| mother = C\n| father = [[B]]\n}}"


def test_preview_and_report(spark):
    nodes = spark.createDataFrame([("t", 0, None, None, None, "P", 0), ("t", 1, 0, 0, 0, "a", 1)], "tree_id string, node_id int, parent_node int, marriage int, child int, person string, depth int")
    wed = spark.createDataFrame([("t", 0, 0, "S")], "tree_id string, node_id int, marriage int, spouse string")
    contents = spark.createDataFrame([("t", "P", 0, "[[P q|p]]<ref>one</ref><br /><b>"), ("t", "S", 1, "S<ref>two</ref>"), ("t", "a", 2, "a<ref>one</ref>")], "tree_id string, person string, place int, content string")
    titles = spark.createDataFrame([("t", "T <1>", None)], "tree_id string, title string, subtitle string")
    (r,) = outputs.previews(layout.chart_cells(nodes, wed), contents, titles, "https://site/").collect()
    assert r["name"] == "T _1_.html" and '<a href="https://site/P_q">p</a><sup>[1]</sup><br />&lt;b&gt;' in r["text"] and "a<sup>[1]</sup>" in r["text"] and "<li>one</li><li>two</li>" in r["text"]
    assert r["text"].count('class="box"') == 3
    e = edges(spark, ("a", "P", "parent"), ("x", "y", "spouse"), ("a", "z", "uncle")).withColumn("flags", F.array(F.lit("no_ref"), F.lit("cycle")))
    listed = outputs.review_edges(contents.select("tree_id", "person"), e)
    (row,) = listed.collect()
    assert (row["a"], row["classes"], row["refs"]) == ("a", ["noref", "conflict"], ["<ref>r</ref>"])
    cover = spark.createDataFrame([("F", "partial", "old", 0.4)], "family string, status string, tree string, score double")
    (t,) = outputs.review_report(spark.createDataFrame([("t", "T", "F")], "tree_id string, title string, label string"), listed, cover).collect()
    assert "חלקי old (0.4)" in t["text"] and "<td>P</td><td>הורה של</td><td>a</td>" in t["text"]


PAGES = "title string, pageid bigint, wikitext string, categories array<string>, revid bigint, fetched_at timestamp, requested_title string, redirect_to string"


def written_texts(spark, work):
    out = []
    for name in ("out_trees", "out_previews", "out_review"):
        out += [(r["name"], r["text"]) for r in spark.read.json(f"{work}/{name}").collect()]
    return out


def test_commands_from_pages_to_trees(spark, tmp_path):
    texts = {
        "אברהם כהן": "'''אברהם כהן''' נולד בשנת 1850. ילדיו: [[יצחק כהן]], [[דוד כהן]]. נישא ל[[שרה כהן]]. [[קטגוריה:משפחת כהן]]",
        "שרה כהן": "'''הרבנית שרה''' נולדה בשנת 1855.",
        "יצחק כהן": "{{אישיות|ילדים=[[יעקב כהן]]<br>נחום לוי|בן זוג=מינדל רוזן}}'''יצחק''' נולד בשנת 1880, בנו של [[אברהם כהן]].<ref>מקור</ref> ילדיו: [[יעקב כהן]].",
        "דוד כהן": "'''דוד''' נולד בשנת 1885. אביו [[אבי כהן]]. אחי אביו, [[משה כהן]].",
        "יעקב כהן": "'''יעקב''' נולד בשנת 1910, בנו של [[יצחק כהן]]. ילדיו: [[1950]].",
        "משה כהן": "'''משה''' נולד בשנת 1852.", "ספר הזכרונות": "ספר של [[אברהם כהן]], בנו של [[דוד כהן]].",
    }
    rows = [(t, n, x, ["ספרים" if t.startswith("ספר") else "משפחת כהן"], n, None, t, None) for n, (t, x) in enumerate(texts.items())]
    rows.append(("אברהם כהן", 0, texts["אברהם כהן"], ["משפחת כהן"], 0, None, "אבי כהן", "אברהם כהן"))
    work = f"{tmp_path}/work"
    spark.createDataFrame(rows, PAGES).write.parquet(f"{work}/pages")
    assert cli.main(["--work", work, "all"], spark) == 0
    edge = {(r["a"], r["b"]) for r in spark.read.parquet(f"{work}/edges").collect() if r["relation"] == "parent"}
    assert {("יצחק כהן", "אברהם כהן"), ("יעקב כהן", "יצחק כהן"), ("דוד כהן", "אברהם כהן")} <= edge
    assert not any("אבי כהן" in e or "1950" in e or "משה כהן" in e for e in edge)  # a redirect, a year, and an uncle
    assert {r["title"] for r in spark.read.parquet(f"{work}/persons").collect()} == set(texts) - {"ספר הזכרונות"}
    found = written_texts(spark, work)
    tree = next(t for n, t in found if n.endswith(".wiki"))
    assert all(f"[[{t}]]" in tree for t in ("אברהם כהן", "שרה כהן", "יצחק כהן", "דוד כהן", "יעקב כהן")) and "עצי משפחה" in tree
    bare = [r["name"] for r in spark.read.parquet(f"{work}/people").filter("NOT coalesce(fetched, false)").collect()]
    assert {"נחום לוי", "מינדל רוזן"} <= set(bare)
    assert not [(b, n) for b in bare for n, t in found if b in t or b in n]  # nobody without a page is named anywhere
    assert cli.main(["--work", work, "render", "--include-unlinked", "--files", f"{tmp_path}/files"], spark) == 0
    assert {p.name for p in (tmp_path / "files").iterdir() if p.suffix == ".wiki"} == {n for n, _ in written_texts(spark, work) if n.endswith(".wiki")}
    assert any("נחום לוי" in t for _, t in written_texts(spark, work))
    assert cli.main(["--work", work, "render", "--ancestors-for", "יעקב כהן"], spark) == 0
    drawn = {r["name"]: r["text"] for r in spark.read.json(f"{work}/out_ancestors").collect()}
    assert "[[אברהם כהן]]" in drawn["יעקב כהן"] and "[[אברהם כהן]]" in drawn["יעקב כהן (chart)"] and drawn["יעקב כהן (chart)"].count("|!") == 2
    assert cli.main(["--work", work, "render", "--ancestors", "--generations", "3"], spark) == 0
    assert cli.main(["--work", work, "calibrate"], spark) == 0 and cli.main(["--work", work, "upload", "--yes"], spark) == 3


def test_tables_survive_a_crash_between_renames(spark, tmp_path):
    w = cli.Work(spark, f"{tmp_path}/w")
    w.save(spark.range(3), "t")
    at, fs = w._fs("t")
    fs.rename(at, w._fs("t.old")[0])  # as a run leaves it that ends after the first rename
    assert w.has("t") and w.load("t").count() == 3
    assert w.save(spark.range(5), "t").count() == 5 and not fs.exists(w._fs("t.old")[0])
