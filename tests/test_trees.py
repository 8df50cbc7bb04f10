from pyspark.sql import functions as F

from kinloom.operators import trees

PEOPLE = "id string, fetched boolean, gender string, year int, family_categories array<string>"


def world(spark):
    people = spark.createDataFrame([
        ("grandpa", True, "m", 1850, ["Family K"]), ("dad", True, "m", 1880, ["Family K"]), ("mum", True, "f", 1885, []), ("kid", True, "m", 1910, ["Family K"]),
        ("kid2", False, None, None, ["Family K"]), ("mums_dad", False, "m", 1855, []), ("x1", True, "m", 1, []), ("x2", True, "f", 2, []), ("x3", True, "m", 3, []), ("x4", True, "m", 4, []),
    ], PEOPLE)
    rows = [("dad", "grandpa", "parent"), ("kid", "dad", "parent"), ("kid", "mum", "parent"), ("kid2", "mum", "parent"), ("mum", "mums_dad", "parent"), ("dad", "mum", "spouse"),
            ("kid", "grandpa", "parent"), ("x3", "x1", "parent"), ("x3", "x2", "parent"), ("x4", "x2", "parent"), ("x1", "x2", "spouse")]
    return people, spark.createDataFrame([(*r, 0.9) for r in rows] + [("kid", "x1", "parent", 0.3)], "a string, b string, relation string, confidence double")


def test_specs(spark):
    people, _ = world(spark)
    families = spark.createDataFrame([("F1", i) for i in ("grandpa", "dad", "mum", "kid", "kid2")] + [("F2", f"x{k}") for k in (1, 2, 3, 4)], "family string, id string")
    got = {(r["spec"], r["kind"], r["id"]) for r in trees.family_specs(people, families).collect()}
    assert {g[0] for g in got} == {"Family K", "F2"} and len(got) == 8


def test_owner_and_roots(spark):
    people, edges = world(spark)
    members = people.select(F.when(F.col("id").startswith("x"), "X").otherwise("K").alias("spec"), "id")
    got = {(r["child"], r["owner"]) for r in trees.owners(people, edges, members).collect()}
    assert got == {("dad", "grandpa"), ("kid", "dad"), ("kid2", "mum"), ("mum", "mums_dad"), ("x3", "x1"), ("x4", "x2")}
    roots = sorted((r["spec"], r["place"], r["id"]) for r in trees.choose_roots(people, edges, members).collect())
    assert roots == [("K", 1, "grandpa"), ("K", 2, "mums_dad"), ("X", 1, "x1")]


def test_bloodline(spark):
    people, edges = world(spark)
    got = {r["node"] for r in trees.bloodline(people, edges, spark.createDataFrame([("dad",)], "node string")).collect()}
    assert got == {"grandpa", "dad", "kid", "mum"}


def test_bloodlines_of_several_groups_keep_apart(spark):
    people, edges = world(spark)
    seeds = spark.createDataFrame([("K", "dad"), ("X", "x1"), ("Y", "kid")], "spec string, id string")
    got = {(r["spec"], r["id"]) for r in trees.bloodlines(people, edges, seeds).collect()}
    own = {s: {r["node"] for r in trees.bloodline(people, edges, seeds.filter(F.col("spec") == s).select(F.col("id").alias("node"))).collect()} for s in "KXY"}
    assert got == {(s, i) for s, ids in own.items() for i in ids} and {s for s, _ in got} == {"K", "X", "Y"}


def test_labels_of_families(spark):
    people = spark.createDataFrame([("a", "Levi"), ("b", "Levi"), ("c", "Katz"), ("d", "Katz"), ("e", "Levi"), ("f", "")], "id string, surname string")
    specs = spark.createDataFrame([("Family K", "category", "a"), ("F1", "component", "a"), ("F1", "component", "b"), ("F1", "component", "c"), ("F2", "component", "c"),
                                   ("F2", "component", "d"), ("F3", "component", "e"), ("F4", "component", "f")], "spec string, kind string, id string")
    got = {r["spec"]: r["label"] for r in trees.family_labels(people, specs).collect()}
    assert got == {"Family K": "Family K", "F1": "משפחת Levi (F1)", "F2": "משפחת Katz", "F3": "משפחת Levi (F3)", "F4": "F4"}
