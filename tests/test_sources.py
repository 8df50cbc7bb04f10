import pytest
from pyspark.sql import functions as F

from kinloom.operators import canonical, extraction, incremental
from kinloom.sources import wiki
from kinloom.streaming import changes

ROLES = {"father": ("אב",), "mother": ("אם",), "spouse": ("בן זוג",), "children": ("ילדים",)}


def fake_site(params):
    """A site of two pages and a redirect, that gives texts only to those who ask for them as the real one wants."""
    assert params["maxlag"] == 5 and params["formatversion"] == 2
    if "list" in params:
        kind = {"categorymembers": "cm", "recentchanges": "rc", "embeddedin": "ei", "prefixsearch": "ps", "search": "sr"}[params["list"]]
        assert params[f"{kind}limit"] == "max"
        first = not params.get(f"{kind}continue")
        items = [{"title": "A", "ns": 0, "pageid": 1}] if first else [{"title": "B", "ns": 0, "pageid": 2}, {"title": "A", "ns": 0, "pageid": 1}]
        return 200, {}, {"query": {params["list"]: items}} | ({"continue": {f"{kind}continue": "x"}} if first else {})
    texts = {"A": "[[B]] {{Box|a={{Inner}}}}", "B": "text"}
    asked = params["titles"].split("|")
    moved = [{"from": t, "to": "B"} for t in asked if t == "Old B"]
    final = {"B" if t == "Old B" else t for t in asked}
    assert params["rvprop"].startswith("content") and params["rvslots"] == "main" and params["cllimit"] == "max"
    revisions = lambda t: [{"slots": {"main": {"content": texts[t]}}, "revid": 7}]
    pages = [{"title": t, "pageid": 1, "revisions": revisions(t), "categories": [{"title": "Category:People"}]} if t in texts else {"title": t, "missing": True} for t in sorted(final)]
    return 200, {}, {"query": {"pages": pages, "redirects": moved}}


def test_client_slows_down_and_loses_nothing():
    answers = iter([(429, {"Retry-After": "3"}, {}), (500, {}, {}), (200, {}, {"error": {"code": "maxlag"}}), (200, {}, {"query": {"x": 1}})])
    slept = []
    c = wiki.Client(lambda p: next(answers), sleep=slept.append, clock=lambda: 0.0)
    assert list(c.pages({})) == [{"x": 1}] and c.spacing == 2.0 and 3.0 in slept and 10.0 in slept
    with pytest.raises(wiki.ApiError):
        wiki.Client(lambda p: (200, {}, {"error": {"code": "bad"}}), sleep=slept.append).request({})
    with pytest.raises(wiki.ApiError):
        wiki.Client(lambda p: (404, {}, {}), sleep=slept.append).request({})

    def unreadable(p):
        raise ValueError("no JSON")

    with pytest.raises(wiki.ApiError):
        wiki.Client(unreadable, sleep=slept.append, retries=2).request({})
    assert wiki.retry_after("9999", 1) == 600 and wiki.retry_after("nonsense", 4) == 4 and wiki.retry_after(None, 4) == 4


def test_page_source(spark):
    spark.dataSource.register(wiki.WikiPages)
    df = spark.read.format("wiki_pages").option("client", "tests.test_sources:fake_site").option("titles", "A|Old B|Gone").option("spacing", "0").load()
    got = {r["requested_title"]: (r["title"], r["redirect_to"], r["wikitext"], r["categories"]) for r in df.collect()}
    assert got == {"A": ("A", None, "[[B]] {{Box|a={{Inner}}}}", ["People"]), "Old B": ("B", "B", "text", ["People"])}
    assert [r["title"] for r in wiki.pages_with_template(df, "Inner").collect()] == ["A"]


@pytest.mark.parametrize(("kind", "expect"), [("category", ["A", "B", "A"]), ("changes", ["A", "B"]), ("embedded", ["A", "B", "A"]), ("prefix", ["A", "B", "A"]), ("search", ["A", "B", "A"])])
def test_listings_go_on_to_the_end(spark, kind, expect):
    spark.dataSource.register(wiki.WikiList)
    df = spark.read.format("wiki_list").options(client="tests.test_sources:fake_site", list=kind, of="X", spacing="0").load()
    assert [r["title"] for r in df.collect()] == expect


def test_site_info():
    body = {"general": {"sitename": "x"}, "statistics": {"pages": 2}, "namespaces": {}}
    assert wiki.site_info(wiki.Client(lambda p: (200, {}, {"query": body}), spacing=0)) == body


def test_relations_of_a_page(spark):
    text = "{{אישיות|אב=[[יוסף]]|ילדים=[[דן]]<br>רחל}}\nמשה, בנו של [[יוסף]]<ref>מקור</ref>. אחיו, [[אהרן]]. נישא ל[[צפורה]]. [[גרשום]], בנו של [[משה]]. נולד בעיר לאביו [[יוסף]] ולאמו [[לאה]]. על שם חותנו [[יתרו]]."
    rows = extraction.extract(spark.createDataFrame([("משה", text), ("משה", text)], "title string, wikitext string"), ROLES).collect()
    got = {(r["relation"], r["person"], r["relative"]) for r in rows}
    assert {("parent", "משה", "יוסף"), ("parent", "דן", "משה"), ("parent", "~רחל", "משה"), ("sibling", "משה", "אהרן"), ("spouse", "משה", "צפורה"),
            ("parent", "גרשום", "משה"), ("parent", "משה", "לאה")} <= got
    assert not any("יתרו" in r["relative"] + r["person"] for r in rows)
    (ref,) = {tuple(r["refs"]) for r in rows if r["pattern"] == "child_of" and r["person"] == "משה"}
    assert ref == ("<ref>מקור</ref>",)


def test_person_pages(spark):
    rules = canonical.PersonRules("^List", "People|Rabbis", "^Books", "^Day", "was born")
    rows = [("List of x", ["People"], ""), ("A", ["People"], ""), ("B", ["Books of People"], ""), ("Day 1", [], "was born"), ("C", [], "was born"), ("D", [], ""), ("E", None, "was born")]
    df = spark.createDataFrame(rows, "t string, c array<string>, x string")
    got = [r[0] for r in df.select(canonical.is_person_page(F.col("t"), F.col("c"), F.col("x"), rules)).collect()]
    assert got == [False, True, False, False, True, False, True]


def test_canonicalise(spark):
    rel = spark.createDataFrame([("A", "Old", "parent"), ("A", "Place", "spouse"), ("A", "~x", "parent"), ("Old2", "New", "sibling")], "person string, relative string, relation string")
    res = spark.createDataFrame([("Old", "Old2", True), ("Old2", "New", True), ("Place", None, True)], "target string, to string, exists boolean")
    folk = spark.createDataFrame([("A",), ("New",)], "title string")
    got = {(r["person"], r["relative"], r["relative_has_article"]) for r in canonical.canonicalise(rel, res, folk, spark.createDataFrame([], "id string")).collect()}
    assert got == {("A", "New", True), ("A", "~x", False)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes.keep_current(stream, f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp").awaitTermination()
    got = changes.current(spark, f"{tmp_path}/out").select("user_id", "event_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.upsert(events.limit(0), events, ["user_id"], "event_id").collect()))


def flaky_site(params):
    """``fake_site``, but it refuses every call that asks for "Bad"."""
    if "Bad" in params.get("titles", "").split("|"):
        return 404, {}, {}
    return fake_site(params)


def test_lookups_stay_in_their_tasks(spark):
    titles = spark.createDataFrame([(t,) for t in ("A", "Old B", "Gone", "Bad")], "title string")
    rows = wiki.lookup(titles, "tests.test_sources:flaky_site", 0.0, parallel=2, batch=1).collect()
    got = {r["requested_title"]: (r["status"], r["title"], r["redirect_to"], r["error"] is not None) for r in rows}
    assert got == {"A": ("ok", "A", None, False), "Old B": ("ok", "B", "B", False), "Gone": ("missing", None, None, False), "Bad": ("failed", None, None, True)}


def test_fetch_remembers_what_failed(spark, tmp_path):
    from kinloom import cli

    work, names = f"{tmp_path}/w", f"{tmp_path}/titles.txt"
    with open(names, "w") as f:
        f.write("A\nGone\n\nBad\n")
    run = lambda site, *more: cli.main(["--work", work, "fetch", "--client", f"tests.test_sources:{site}", "--spacing", "0", "--wait", "0", *more], spark)
    table = lambda name: {r["title"] for r in spark.read.parquet(f"{work}/{name}").collect()}
    with open(names, "w") as f:
        f.write("Bad\n")
    assert run("flaky_site", "--titles", names) == 2 and table("failures") == {"Bad"} and table("pages") == set()
    with open(names, "w") as f:
        f.write("A\nGone\n")
    assert run("fake_site", "--titles", names) == 0  # the failure is asked for again although nobody wants it any more
    assert (table("pages"), table("missing"), table("failures")) == ({"A"}, {"Bad", "Gone"}, set())
    assert run("fake_site", "--titles", names) == 0 and table("todo") == set()
    assert run("fake_site") == 0 and table("todo") == {"A", "B"} and table("pages") == {"A", "B"}  # what changed since the oldest page
    assert spark.read.parquet(f"{work}/checked").count() == 1


CHANGES = "/tmp/kinloom-test-changes.json"  # what ``changing_site`` lists: its process is not the test's


def changing_site(params):
    import json

    with open(CHANGES) as f:
        rows = [r for r in json.load(f) if r["timestamp"] >= params["rcstart"]]
    assert params["rcdir"] == "newer" and "timestamp" in params["rcprop"]
    return 200, {}, {"query": {"recentchanges": sorted(rows, key=lambda r: r["timestamp"])}}


def test_stream_of_changes_loses_and_repeats_nothing(spark, tmp_path):
    import json

    spark.dataSource.register(wiki.WikiChanges)
    listed = []

    def turn_up(*new):
        listed.extend({"rcid": n, "timestamp": f"2024-01-01T{t}:00Z", "title": f"T{n}", "ns": 0, "pageid": n} for n, t in new)
        with open(CHANGES, "w") as f:
            json.dump(listed, f)

    def run():
        source = spark.readStream.format("wiki_changes").options(client="tests.test_sources:changing_site", since="2024-01-01T10:00:00Z", spacing="0").load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["change"] for r in spark.read.schema(wiki.CHANGED).parquet(f"{tmp_path}/out").collect())

    turn_up((1, "10:00"), (2, "10:30"), (3, "09:00"))  # the third is from before the stream
    assert run() == [1, 2]
    assert run() == [1, 2]
    turn_up((4, "10:10"), (5, "13:00"), (6, "10:30"))  # 4 and 6 turn up late
    assert run() == [1, 2, 4, 5, 6]
    turn_up((7, "11:30"), (8, "13:00"), (9, "16:00"))
    assert run() == [1, 2, 4, 5, 6, 7, 8, 9]


def test_a_batch_of_changes_is_the_same_when_it_is_read_again():
    import json

    rows = [{"rcid": n, "timestamp": f"2024-01-01T{t}:00Z", "title": "T", "ns": 0, "pageid": n} for n, t in ((1, "10:00"), (2, "13:00"))]
    reader = wiki._ChangeReader({"client": "tests.test_sources:changing_site", "since": "2024-01-01T09:00:00Z", "spacing": "0"})
    with open(CHANGES, "w") as f:
        json.dump(rows, f)
    got, end = reader.read(reader.initialOffset())
    assert [r[0] for r in got] == [1, 2] and end == {"at": "2024-01-01T13:00:00Z", "seen": [[2, "2024-01-01T13:00:00Z"]]}
    with open(CHANGES, "w") as f:
        json.dump([*rows, {"rcid": 3, "timestamp": "2024-01-01T12:00:00Z", "title": "T", "ns": 0, "pageid": 3}], f)
    assert [r[0] for r in reader.readBetweenOffsets(reader.initialOffset(), end)] == [1, 2]
    assert [r[0] for r in reader.read(end)[0]] == [3]
