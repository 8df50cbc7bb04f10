import pytest

from kinloom.operators import ancestors, layout

SLOTS = "person string, slot string, ancestor string"


def grid(cells):
    """Rows of tiles as text: B for the three tiles of a box."""
    at = {}
    for r in cells:
        sign = {"box": "B", "marriage": layout.MARRIAGE, "wed": layout.BETWEEN}.get(r["kind"]) or layout.SIGNS["".join(r["dirs"])]
        for c in range(r["col"] - 1, r["col"] + 2) if r["kind"] == "box" else [r["col"]]:
            assert (r["row"], c) not in at
            at[r["row"], c] = sign
    wide = max(c for _, c in at) + 1
    return ["".join(at.get((row, c), "·") for c in range(wide)).rstrip("·") for row in range(max(r for r, _ in at) + 1)]


def drawn(spark, slots, generations=3):
    rows = spark.createDataFrame([("P", s, f"<{s}>") for s in slots], SLOTS)
    return ancestors.chart_cells(rows, generations).collect()


@pytest.mark.parametrize(("slots", "expect"), [
    ((["f"]), ["BBB", "·!", "BBB"]),
    ((["m"]), ["····BBB", "·····!", "····BBB"]),
    ((["f", "m"]), ["BBBדBBB", "···!", "··BBB"]),
    ((["f", "m", "ff", "fm"]), ["BBBדBBB", "···!", "··BBB~~~דדד~BBB"]),
])
def test_grids(spark, slots, expect):
    got = grid(drawn(spark, slots))
    if len(slots) < 4:
        assert got == expect
        return
    assert got[:2] == expect[:2] and got[2].count("B") == 6 and got[2].count(layout.MARRIAGE) == 1 and got[2].count(layout.BETWEEN) > 2 and len(got) == 5
    middle = got[2].index(layout.MARRIAGE)
    assert got[3] == "·" * middle + "!" and got[4] == "·" * (middle - 1) + "BBB"


def test_gaps_and_empty_generations(spark):
    got = grid(drawn(spark, ["f", "ff", "mm"], 4))  # the mother is not known, her mother is: drawn, but led to by no line
    assert len(got) == 5 and sum(row.count("B") for row in got) == 12 and sum(row.count("!") for row in got) == 2
    rows = spark.createDataFrame([("P", "f", "a"), ("Q", "f", "b"), ("Q", "m", "c"), ("Q", "fm", "d")], SLOTS)
    cells = ancestors.chart_cells(rows, 4).collect()
    assert {(r["tree_id"], r["row"]) for r in cells if r["ref"] in ("P", "Q")} == {("P", 2), ("Q", 4)}
    assert ancestors.chart_cells(rows.limit(0), 4).count() == 0


def test_grandparents_of_a_known_side_fill_places(spark):
    slots = spark.createDataFrame([("P", "f", "dad"), ("P", "ff", "grandpa"), ("Q", "f", "x")], SLOTS)
    edges = spark.createDataFrame([("P", "other", "grandparent", 0.8, "father"), ("P", "nan", "grandparent", 0.8, "mother"), ("P", "old", "grandparent", 0.8, None), ("P", "weak", "grandparent", 0.1, "mother"),
                                   ("Z", "nan", "grandparent", 0.8, "mother")], "a string, b string, relation string, confidence double, side string")
    people = spark.createDataFrame([("other", "m"), ("nan", "f")], "id string, gender string")
    got = {(r["person"], r["slot"], r["ancestor"]) for r in ancestors.with_grandparents(slots, edges, people).collect()}
    assert got == {("P", "f", "dad"), ("P", "ff", "grandpa"), ("Q", "f", "x"), ("P", "mm", "nan")}


def test_template_rows_of_a_chart(spark):
    rows = spark.createDataFrame([("P", "f", "a"), ("P", "m", "b")], SLOTS)
    contents = spark.createDataFrame([("P", p, f"<{p}>") for p in "Pab"], "tree_id string, person string, content string")
    (r,) = layout.chart_wikitext(ancestors.chart_cells(rows, 2), contents, "start", "row", "end").collect()
    assert r["text"].split("\n") == ["{{start}}", "{{row|B1|ד|B2|B1=<a>|B2=<b>}}", "{{row| | | |!}}", "{{row| | |B3|B3=<P>}}", "{{end}}"]
