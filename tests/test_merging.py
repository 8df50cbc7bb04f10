from pyspark.sql import functions as F

from kinloom.operators import existing, forest, merging, selection
from kinloom.operators.layout import Node
from kinloom.plans.storage import written

PEOPLE = "id string, name string, fetched boolean, gender string, born int, died int, surname string, separated boolean"
EDGE = "a string, b string, relation string, confidence double, inferred boolean, flags array<string>, side string, alias_only boolean, evidence array<struct<source_page:string,refs:array<string>,confidence:double,alias:boolean>>"


def people(spark, *rows):
    full = []
    for ident, gender, born, *more in rows:
        name = more[0] if more else ident.lstrip("~").split("@")[0]
        full.append((ident, name, not ident.startswith(("~", "red")), gender, born, None, name.split()[-1] if " " in name else "", False))
    return spark.createDataFrame(full, PEOPLE)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, rel, 0.9, False, [], None, False, [(f"page {a}", ["<ref>r</ref>"], 0.9, False)]) for a, b, rel in rows], EDGE)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_upsert_takes_pages_first(spark):
    pages = spark.createDataFrame([("A (x)", "A", "m")], "id string, name string, gender string")
    rel = spark.createDataFrame([("A (x)", "~B@A:parent", "other", "", None, "f", 1), ("C d", "~B@A:parent", "", "B two", "m", "m", 2), (None, "E", None, None, None, None, 3)],
                                "person string, relative string, person_name string, relative_name string, person_gender string, relative_gender string, order int")
    got = {r["id"]: (r["name"], r["fetched"], r["gender"]) for r in merging.upsert_people(pages, rel).collect()}
    assert got == {"A (x)": ("A", True, "m"), "~B@A:parent": ("B", False, "f"), "C d": ("C d", False, "m"), "E": ("E", False, None)}


def test_estimated_births(spark):
    p = people(spark, ("a", "m", 1900), ("b", "f", None), ("c", "m", None), ("d", "m", None), ("e", "m", None), ("z", "m", None))
    e = edges(spark, ("a", "b", "spouse"), ("c", "a", "parent"), ("d", "c", "parent"), ("a", "e", "parent"))
    assert pairs(merging.estimated_births(p, e)) == {("a", 1900), ("b", 1900), ("c", 1925), ("d", 1950), ("e", 1875), ("z", None)}


def test_middle_names_merge_into_the_one_article(spark):
    p = people(spark, ("efraim lerer", "m", 1900), ("~efraim zvi lerer@x:child", "m", None), ("~efraim zvi lerer@y:child", "m", 2000), ("x", "m", 1930), ("y", "m", 1950), ("moshe cohen", "m", None),
               ("moshe cohen (b)", "m", None), ("~moshe dov cohen@x:spouse", "m", None), ("~efraim dov lerer@w:child", "f", None))
    e = edges(spark, ("x", "~efraim zvi lerer@x:child", "parent"), ("~efraim zvi lerer@y:child", "y", "parent"))
    got = pairs(merging.merge_middle_names(p, e))
    assert got == {("~efraim zvi lerer@x:child", "efraim lerer")}  # the other is a century later; two articles fit the last name
    father = edges(spark, ("efraim lerer", "~efraim zvi lerer@x:child", "parent"))
    assert pairs(merging.merge_middle_names(p, father)) == set()


def test_full_names_of_exactly_two_merge(spark):
    p = people(spark, ("moshe blau", "m", 1900), ("~moshe uri blau@a:child", "m", None), ("~moshe uri blau@b:spouse", None, None), ("~arie hartman@c:child", "m", None),
               ("~arie avraham hartman@d:parent", "m", None), ("dov hartman", "m", None), ("~dov ber hartman@a:x", "m", 1800), ("~dov ber hartman@b:x", "m", 1900), ("k", "m", None))
    none = edges(spark, ("~arie avraham hartman@d:parent", "k", "parent"))
    got = pairs(merging.merge_full_names(p, none))
    assert got == {("~moshe uri blau@b:spouse", "~moshe uri blau@a:child"), ("~arie hartman@c:child", "~arie avraham hartman@d:parent")}
    people2, fused = merging.apply_mapping(p, none.unionByName(edges(spark, ("~arie hartman@c:child", "k", "parent"))), merging.merge_full_names(p, none))
    (r,) = fused.collect()
    assert (r["a"], r["b"]) == ("~arie avraham hartman@d:parent", "k") and len(r["evidence"]) == 2 and r["confidence"] > 0.9
    assert people2.count() == p.count() - 2


def test_merge_schedule_runs_and_keeps_articles(spark):
    p = people(spark, ("efraim lerer", "m", 1900), ("~efraim zvi lerer@x:parent", "m", None), ("x", "m", 1930), ("~efraim@x:parent", "m", None))
    e = edges(spark, ("x", "~efraim zvi lerer@x:parent", "parent"), ("x", "~efraim@x:parent", "parent"))
    people2, out = merging.merge_all(p, e)
    assert pairs(out.select("a", "b", "relation")) == {("x", "efraim lerer", "parent")}
    assert {r["id"] for r in people2.collect()} == {"efraim lerer", "x"}


def members(spark, *ids):
    return spark.createDataFrame([("s", i) for i in ids], "spec string, id string")


def test_surnames_label_person_and_married_in(spark):
    p = people(spark, ("a", "m", None, "a blau"), ("b", "m", None, "b blaua"), ("c", "f", None, "c cohen"), ("d", "m", None, "d cohen"), ("e", "f", None, "e levi"), ("the maggid", "m", None, "the maggid"))
    p = p.withColumn("surname", F.when(F.col("id") == "the maggid", "").otherwise(F.col("surname")))
    m = members(spark, "a", "b", "c", "d")
    label = lambda text: spark.createDataFrame([("s", text)], "spec string, label string")
    assert pairs(selection.family_surnames(p, m, label("משפחת blau"))) == {("s", "blau"), ("s", "blaua")}
    assert pairs(selection.family_surnames(p, m, label("משפחת else"))) == {("s", "cohen")}
    assert pairs(selection.label_person(p, m, label("משפחת the maggid"))) == {("s", "the maggid")} and not pairs(selection.label_person(p, m, label("משפחת cohen")))
    e = edges(spark, ("b", "a", "parent"), ("b", "c", "spouse"), ("a", "e", "spouse"))
    names = spark.createDataFrame([("s", "blau"), ("s", "blaua")], "spec string, surname string")
    assert pairs(selection.married_in(p, e, members(spark, "a", "b", "c", "e"), names)) == {("s", "c"), ("s", "e")}


def test_relatives_without_article_and_records(spark):
    p = people(spark, ("a", "m", None), ("~b", "f", None), ("~c", "m", None), ("red", "m", None), ("d", "m", None))
    e = edges(spark, ("a", "~b", "spouse"), ("a", "~c", "parent"), ("red", "a", "parent"), ("d", "a", "parent"))
    m = members(spark, "a")
    assert pairs(selection.with_unlinked_relatives(p, e, m)) == {("s", "a"), ("s", "~b"), ("s", "~c"), ("s", "red")}
    assert pairs(selection.with_unlinked_relatives(p, e, m, m)) == {("s", "a"), ("s", "~b"), ("s", "red")}
    nodes = spark.createDataFrame([("s", "r", "r", True, True), ("s", "r", "w", False, False), ("s", "q", "q", True, True), ("s", "q", "k", True, False)], "spec string, root string, person string, has_children boolean, is_root boolean")
    wed = spark.createDataFrame([("s", "q", "w"), ("s", "r", None)], "spec string, root string, spouse string")
    assert {r["root"] for r in selection.drop_redundant_roots(nodes, wed, p).collect()} == {"q"}
    links = selection.cross_links(spark.createDataFrame([("a", "T2"), ("a", "T2")], "person string, title string"), spark.createDataFrame([("a", "T1")], "person string, title string"))
    assert [tuple(r) for r in links.collect()] == [("a", ["T1", "T2"])]


def test_existing_trees(spark):
    rows = [("תבנית:עץ משפחת כהן/א", 10, [], ["Tree"], "{{row|a|[[דוד|x|y]]|B1|B1=z}}\n{{row| |-}}"), ("Page", 0, [], ["Tree"], ""), ("In", 2, ["Trees"], [], "[[חנה]]"), ("עץ משפחת לוי", 0, [], [], "עץ משפחת"), ("No", 0, [], [], "עץ משפחת")]
    pages = spark.createDataFrame(rows, "title string, ns int, categories array<string>, uses array<string>, wikitext string")
    trees = existing.find_trees(pages, "Trees", ("Tree",))
    got = {r["title"]: (r["sources"], r["draft"]) for r in trees.collect()}
    assert got == {"תבנית:עץ משפחת כהן/א": (["embeds:Tree", "prefix"], False), "In": (["category"], True), "עץ משפחת לוי": (["prefix", "search"], False)}
    inside = existing.tree_contents(trees, pages, "row")
    by = {r["title"]: (r["persons"], r["rows"], r["width"]) for r in inside.collect()}
    assert by["תבנית:עץ משפחת כהן/א"] == (["דוד"], 2, 3) and by["In"] == (["חנה"], 0, 0)
    assert pairs(existing.person_trees(trees, inside)) == {("דוד", "תבנית:עץ משפחת כהן/א")}
    hint = trees.select(existing.family_hint(F.col("title"))).collect()
    assert {r[0] for r in hint} == {"כהן", "In", "לוי"}


def grown(spark, budget=400, depth=None):
    p = people(spark, ("r", "m", 1900), ("w", "f", None), ("a", "m", 1930), ("b", "m", 1925), ("~c levi@r:child", "m", None), ("~dov@r:child", "m", None), ("x", "m", 1960), ("y", "m", None), ("w2", "f", None))
    p = p.withColumn("year", F.col("born"))
    e = edges(spark, ("r", "w", "spouse"), ("r", "w2", "spouse"), ("a", "r", "parent"), ("a", "w", "parent"), ("b", "r", "parent"), ("b", "w2", "parent"), ("~c levi@r:child", "r", "parent"),
              ("~dov@r:child", "r", "parent"), ("x", "a", "parent"), ("y", "~c levi@r:child", "parent"))
    owner = [("a", "r"), ("b", "r"), ("~c levi@r:child", "r"), ("~dov@r:child", "r"), ("x", "a"), ("y", "~c levi@r:child")]
    below = forest.families_below(p, e, spark.createDataFrame([("s", c, o) for c, o in owner], "spec string, child string, owner string"))
    roots = spark.createDataFrame([("t", "s", "r")], "tree_id string, spec string, person string")
    return p, *forest.grow_trees(roots, below, p, forest.bare_children(p, e), budget, depth)


def test_trees_grow_by_marriage_and_year(spark):
    _, nodes, wed = grown(spark)
    rows = {r["person"]: r for r in nodes.collect()}
    assert set(rows) == {"r", "a", "b", "~c levi@r:child", "x", "y"} and rows["r"]["extra"] == ["dov"]
    assert (rows["b"]["marriage"], rows["a"]["marriage"], rows["~c levi@r:child"]["marriage"]) == (0, 1, 2) and rows["x"]["parent_node"] == rows["a"]["node_id"]
    assert {(r["marriage"], r["spouse"]) for r in wed.collect() if r["node_id"] == rows["r"]["node_id"]} == {(0, "w2"), (1, "w")}


def test_budget_prefers_linked_people_and_depth_cuts(spark):
    _, nodes, _ = grown(spark, budget=4)
    rows = {r["person"]: r["truncated"] for r in nodes.collect()}
    assert rows == {"r": True, "a": False, "b": False, "x": False}
    _, nodes, _ = grown(spark, depth=1)
    rows = {r["person"]: r["truncated"] for r in nodes.collect()}
    assert rows == {"r": False, "a": True, "b": False, "~c levi@r:child": True}


def chain(n, prefix, depth=1):
    return [Node(f"{prefix}{i}", depth) for i in range(n)]


def test_large_trees_are_split():
    head = Node("head", 1, [("w", chain(12, "g", 2))])
    root = Node("top", 0, [(None, [head, *chain(9, "k")])])
    out = forest.split_tree("T", [root], lambda p: p, lambda p: True, most=15, widest=200, least=6)
    assert [(x.title, len(forest._spots(x.roots)), x.origin) for x in out] == [("T", 11, None), ("T – צאצאי head", 13, "T")]
    assert "T – צאצאי head" in out[0].notes["head"] and out[1].roots[0].depth == 0 and out[1].roots[0].marriages[0][0] == "w"
    other = forest.split_tree("T", [Node("p", 0, [(None, chain(9, "a"))]), Node("q", 0, [(None, chain(8, "b"))])], lambda p: p, lambda p: True, most=12, widest=200, least=6)
    assert [(x.title, x.roots[0].person) for x in other] == [("T", "p"), ("T – צאצאי q", "q")]
    folded = forest.split_tree("T", [Node("p", 0, [(None, [*chain(3, "a"), *chain(9, "~u")])])], lambda p: p, lambda p: True, most=6, widest=200, least=20)
    assert folded[0].folded["p"] == [f"~u{i}" for i in range(9)] and len(forest._spots(folded[0].roots)) == 4


def test_split_as_rows(spark):
    p, nodes, wed = grown(spark)
    rows = forest.split_trees(written(nodes), written(wed), p, most=4, least=1).collect()
    assert {r["person"] for r in rows} <= {"r", "a", "b", "~c levi@r:child", "x", "y"} and all(r["depth"] == 0 for r in rows if r["parent_node"] is None)


def test_no_name_that_matches_is_filtered_before_the_comparison(spark):
    import random

    from kinloom.functions import names

    rng = random.Random(4)
    base = ["Moshe Cohen", "Moishe Cohn", "Rivka Levi", "Baruch Shalom Kahn", "Barukh Kahn", "a", "", "Levi"]
    words = [b[:rng.randint(0, len(b))] + rng.choice(["", "x", " Q", "e"]) + b[rng.randint(0, len(b)):] for b in base for _ in range(8)] + base
    df = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    got = df.select(names.names_match(F.col("x"), F.col("y")).alias("m"), names.names_may_match(F.col("x"), F.col("y")).alias("may")).groupBy("m", "may").count().collect()
    n = {(r["m"], r["may"]): r["count"] for r in got}
    assert (True, False) not in n and n[True, True] > 0 and n[False, False] > n.get((False, True), 0)


def test_names_of_a_slot_are_compared_once_not_rows(spark):
    from kinloom.operators import identity

    rows = [(f"~{n}@{i:02}", n, 1800 + i, s, True) for s in ("s", "t") for n in ("A B", "A C", "A x B") for i in range(20)] + [("A B", "A B", None, "s", False)]
    placed = spark.createDataFrame(rows, "id string, name string, born int, slot string, bare boolean")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(x, y):
        asked.add(1)
        return x == y or {x, y} == {"A B", "A x B"}

    got = {tuple(r) for r in identity.matching_in_slots(placed, 5, same).collect()}
    fits = lambda x, y: x == y or {x, y} == {"A B", "A x B"}
    assert got == {(i, j, bare) for i, n, b, s, _ in rows if i[0] == "~" for j, m, c, t, bare in rows if s == t and i != j and (not bare or i < j) and fits(n, m) and (c is None or abs(b - c) <= 5)}
    assert 0 < asked.value <= 18


def test_estimated_births_keep_mentions_of_a_slot_apart(spark):
    from kinloom.operators import identity

    p = spark.createDataFrame([("A", "A", None), ("~Dov@x", "Dov", 1700), ("~Dov@y", "Dov", None)], "id string, name string, born int")
    e = spark.createDataFrame([("~Dov@x", "A", "parent"), ("~Dov@y", "A", "parent")], "a string, b string, relation string")
    assert identity.merge_in_slots(p, e).count() == 1
    births = spark.createDataFrame([("~Dov@y", 1900)], "id string, estimate int")
    assert identity.merge_in_slots(p, e, births=births).count() == 0
