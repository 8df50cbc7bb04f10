"""Registered queries of the operators on wikitext and names.

The tables hold no wikitext, so pages are written from their rows, in the forms that the operators read; the SQL says what
each row's page tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import names
from kinloom.functions import text as tx
from kinloom.operators import ancestors, extraction, identity, incremental, traverse, trees
from kinloom.plans.registry import load, registered
from kinloom.plans.storage import written


def _customer(key: Column) -> Column:
    return F.concat(F.lit("Customer "), F.lpad(key.cast("bigint").cast("string"), 9, "0"))


_NAME = "'Customer ' || lpad(CAST({} AS VARCHAR), 9, '0')"
_KIN = " UNION ALL ".join(
    f"SELECT {_NAME.format('k')} AS page, '{relation}' AS relation, {_NAME.format(a)} AS person, {_NAME.format(b)} AS relative, '{pattern}' AS pattern, CAST({sure} AS DOUBLE) AS confidence FROM c WHERE {a} <> {b}"
    for relation, a, b, pattern, sure in (
        ("parent", "k", "k // 2", "child_of", 0.7), ("parent", "k // 2", "k // 4", "child_of", 0.7), ("spouse", "k", "(k + 1)", "spouse_verb", 0.85),
        ("uncle", "k", "(k + 7)", "uncle_is", 0.7), ("parent", "(2 * k)", "k", "list:child", 0.8), ("spouse", "(2 * k)", "(2 * k + 5)", "spouse_verb", 0.85),
    )
)


def kin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, wikitext): a page of each customer, with a chain of fathers, a marriage, an uncle, and a list of children."""
    k = F.col("c_custkey")
    link = lambda key: F.concat(F.lit("[["), _customer(key), F.lit("]]"))
    body = F.concat(
        F.lit("{{תבנית|x=1}}'''"), _customer(k), F.lit("''' בנו של "), link(F.floor(k / 2)), F.lit(", בנו של "), link(F.floor(k / 4)), F.lit(".<ref>מקור "), k.cast("string"),
        F.lit("</ref> נשוי ל"), link(k + 1), F.lit(". אחי אביו, "), link(k + 7), F.lit(".\n== משפחתו ==\nילדיו:\n* "), link(2 * k), F.lit(" – נישאה ל"), link(2 * k + 5), F.lit(".\n* [[1950]]\n== ספריו ==\n* "),
        link(k + 3), F.lit("\n"),
    )
    return load(spark, sf_dir, "customer").select(_customer(k).alias("title"), body.alias("wikitext"))


@registered(f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) {_KIN}")
def page_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of pages in running text and lists, by the table function in SQL."""
    extraction.register_page_reader(spark)
    # pages are written from a few bytes of a row each, so a file of many comes as one partition, and a page takes a millisecond
    pages = kin_pages(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages.createOrReplaceTempView("kinloom_kin_pages")
    return spark.sql("SELECT source_page AS page, relation, person, relative, pattern, confidence FROM relations_of(TABLE(kinloom_kin_pages))")


@registered(f"WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) SELECT *, pattern = 'child_of' AS noted FROM ({_KIN})")
def sentence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the DataFrame form, and which relations have a footnote: those of the first sentence."""
    found = extraction.from_text(kin_pages(spark, sf_dir))
    return found.select(F.col("source_page").alias("page"), "relation", "person", "relative", "pattern", "confidence", (F.size("refs") > 0).alias("noted"))


_ROLES = {"father": ("אב",), "mother": ("אם",), "children": ("ילדים",), "spouse": ("בן זוג",)}


@registered(f"""
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer), r AS (
  SELECT k, 'parent' AS relation, {_NAME.format('k')} AS person, {_NAME.format('k // 2')} AS relative, 'אב' AS field, 0 AS place, 0.9 AS confidence FROM c UNION ALL
  SELECT k, 'parent', {_NAME.format('k')}, {_NAME.format('k // 3')}, 'אם', 0, 0.9 FROM c UNION ALL
  SELECT k, 'parent', {_NAME.format('2 * k + 1')}, {_NAME.format('k')}, 'ילדים', 0, 0.9 FROM c UNION ALL
  SELECT k, 'parent', '~Kid ' || k || 'x', {_NAME.format('k')}, 'ילדים', 1, 0.7 FROM c UNION ALL
  SELECT k, 'parent', {_NAME.format('2 * k + 2')}, {_NAME.format('k')}, 'ילדים', 2, 0.9 FROM c)
SELECT relation, person, relative, field, CAST(place AS INT) AS place, CAST(confidence AS DOUBLE) AS confidence, field = 'אם' AS noted FROM r WHERE person <> relative""")
def infobox_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations from template fields: links, shown names, footnotes, lists, names without a link; a year is nobody."""
    k = F.col("c_custkey")
    n = _customer
    box = F.concat(F.lit("{{אישיות|אב=[["), n(F.floor(k / 2)), F.lit("]]|אם=[["), n(F.floor(k / 3)), F.lit("|כינוי]]<ref>מקור</ref>|ילדים=[["), n(2 * k + 1), F.lit("]]<br>Kid "), k.cast("string"),
                   F.lit("x, [["), n(2 * k + 2), F.lit("]]|בן זוג=1950|מקצוע=[["), n(k + 9), F.lit("]]}} טקסט"))
    pages = load(spark, sf_dir, "customer").select(n(k).alias("title"), box.alias("wikitext"))
    return extraction.from_infobox(pages, _ROLES).select(
        "relation", "person", "relative", F.col("pattern").alias("field"), F.col("order").alias("place"), "confidence", (F.size("refs") > 0).alias("noted")
    )


@registered("""
SELECT c_custkey AS k, 'Box,In' AS names, c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS inner_value, '|Head ' || c_custkey || '|Sub' AS heads, 5 AS levels,
       '<ref>note ' || c_custkey || '</ref>' AS note, 'Cat ' || c_mktsegment AS category, replace(c_name, '#', ' ') || '>' || c_mktsegment AS links, true AS restored, 5 AS sentences,
       'Lead of ' || c_mktsegment || '.' || chr(10) || '== Head ' || c_custkey || ' ==' || chr(10) || 'Body ' || c_custkey || ' קטגוריה:Cat ' || c_mktsegment || chr(10) || '=== Sub ===' || chr(10) || 'End' AS plain
FROM customer""")
def wikitext_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the functions on markup find in a page of each customer."""
    k, s = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    text = F.concat(F.lit("<!-- c "), k, F.lit(" -->{{Box|a="), s, F.lit("|{{In|"), k, F.lit("}}}}Lead of [["), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("|"), s, F.lit("]].<ref>note "), k, F.lit("</ref>\n== Head "), k,
                    F.lit(" ==\nBody ''"), k, F.lit("'' [[קטגוריה:Cat "), s, F.lit("]]\n=== Sub ===\nEnd"))
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), tx.strip_comments(text).alias("t"))
    t = F.col("t")
    rows = rows.withColumns({"nested": tx.nested_templates(t), "outer": tx.templates(t), "cut": tx.sections(t), "bare": tx.strip_templates(t)})
    links = F.transform(tx.wikilinks(t), lambda x: F.concat_ws(">", x["target"], x["display"]))
    return rows.select(
        "k", F.array_join(F.transform("nested", lambda x: x["name"]), ",").alias("names"), F.col("outer")[0]["params"]["a"].alias("a"), F.col("nested")[1]["positional"][0].alias("inner_value"),
        F.array_join(F.transform("cut", lambda x: x["title"]), "|").alias("heads"), F.aggregate(F.transform("cut", lambda x: x["level"]), F.lit(0), lambda a, v: a + v).alias("levels"),
        tx.refs(t)[0].alias("note"), tx.categories(t)[0].alias("category"), F.array_join(links, ",").alias("links"), (tx.restore_refs(tx.tokenize_refs(t), tx.refs(t)) == t).alias("restored"),
        F.size(tx.split_sentences(tx.plain(t))).alias("sentences"), tx.plain(t).alias("plain"),
    )


@registered("""
WITH t AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, string_split(p_name, ' ') AS w FROM part)
SELECT k, 'הרב ' || n AS shown, b AS addition, CASE WHEN len(w) < 2 THEN '' ELSE w[-1] END AS surname, n AS alias, CASE WHEN len(w) >= 2 AND length(w[-1]) >= 5 AND w[-1] LIKE '%א' THEN NULL ELSE n END AS name_key,
       n AS given, 'הרב ' || n || ' (' || b || ')_' AS slug, '&lt;' || n || '&gt;' AS html, starts_with(w[-1], w[1]) OR starts_with(w[1], w[-1]) AND least(length(w[1]), length(w[-1])) >= 4 OR w[1] = w[-1] AS alike,
       true AS found FROM t""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of titles and names, on the names of parts."""
    title = F.concat(F.lit("הרב "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    w = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), tx.display_name(title).alias("shown"), tx.disambiguator(title).alias("addition"), names.surname_of(title).alias("surname"), names.alias_key(title).alias("alias"),
        names.name_key(F.concat(F.lit("הרב "), F.col("p_name"), F.lit(" ז\"ל"))).alias("name_key"), names.given_part(F.concat(F.col("p_name"), F.lit(" לבית כהן"))).alias("given"),
        tx.slug(F.concat(title, F.lit("?"))).alias("slug"), tx.escape_html(F.concat(F.lit("<"), F.col("p_name"), F.lit(">"))).alias("html"),
        names.similar_surname_plain(F.element_at(w, 1), F.element_at(w, -1)).alias("alike"), names.names_match_plain(title, F.concat(F.lit("הרבנית "), F.col("p_name"))).alias("found"),
    )


@registered("""
WITH t AS (SELECT o_orderkey AS k, translate(CAST(o_orderkey % 1000 AS VARCHAR), '0123456789', 'תאבגדהוזחט') AS s, 1500 + o_orderkey % 500 AS civil FROM orders),
n AS (SELECT *, list_sum(list_transform(string_split(s, ''), lambda x: CASE WHEN x = 'ת' THEN 400 ELSE strpos('אבגדהוזחט', x) END)) AS v FROM t)
SELECT k, s AS letters, CAST(v AS INT) AS number, CAST(CASE WHEN v < 1000 THEN v + 5000 ELSE v END - 3760 AS INT) AS hebrew_year, CAST(civil AS INT) AS civil_year, CAST(civil AS VARCHAR) AS found FROM n""")
def years_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in letters and digits, on the keys of orders."""
    k = F.col("o_orderkey")
    letters = F.translate((k % 1000).cast("string"), "0123456789", "תאבגדהוזחט")
    civil = (F.lit(1500) + k % 500).cast("string")
    return load(spark, sf_dir, "orders").select(
        k.alias("k"), letters.alias("letters"), names.hebrew_number(letters).alias("number"), names.year(F.concat(F.lit("ה'"), letters)).alias("hebrew_year"), names.year(civil).alias("civil_year"),
        tx.year_in(F.concat(F.lit("נולד בשנת "), civil, F.lit(" בעיר"))).alias("found"),
    )


@registered("""
WITH c AS (SELECT c_custkey AS k, 'G' || c_custkey % 7 || CASE WHEN c_custkey % 5 = 0 THEN ' M' ELSE '' END || ' ' || c_mktsegment AS name, 1700 + c_custkey % 120 AS born, c_nationkey AS slot, c_custkey % 25 = 0 AS art FROM customer),
p AS (SELECT k, CASE WHEN art THEN '' ELSE '~' END || name || '@' || k AS id, name, born, slot, art FROM c),
w AS (SELECT *, string_split(name, ' ') AS w FROM p),
m AS (SELECT x.id AS u, y.id AS v, y.art FROM w x JOIN w y ON x.slot = y.slot AND x.id <> y.id AND NOT x.art AND abs(x.born - y.born) <= 40
      AND (x.name = y.name OR x.w[1] = y.w[1] AND x.w[-1] = y.w[-1]))
SELECT u, v, art FROM m WHERE art OR u < v""")
def slot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one slot (children of a nation) whose names match, and births are near: the plain form of the match."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("G"), (k % 7).cast("string"), F.when(k % 5 == 0, " M").otherwise(""), F.lit(" "), F.col("c_mktsegment"))
    art = k % 25 == 0
    ident = F.concat(F.when(art, "").otherwise("~"), name, F.lit("@"), k.cast("string"))
    rows = load(spark, sf_dir, "customer").select(ident.alias("id"), name.alias("name"), (F.lit(1700) + k % 120).alias("born"), F.col("c_nationkey").cast("string").alias("slot"), (~art).alias("bare"))
    return identity.matching_in_slots(rows, 40, names.names_match_plain).select("u", "v", (~F.col("bare")).alias("art"))


@registered("""
WITH a AS (SELECT p_name AS alias, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_partkey % 10 = 0 GROUP BY p_name),
one AS (SELECT alias, 'P' || lo AS title, CASE WHEN length(alias) % 2 = 0 THEN 'nick' ELSE 'name' END AS kind FROM a WHERE lo = hi AND length(alias) >= 3)
SELECT p_partkey AS k, p_partkey % 3 = 0 AS in_prose, CASE WHEN kind = 'nick' OR p_partkey % 3 = 0 THEN title END AS title, coalesce(title IS NOT NULL AND (kind = 'nick' OR p_partkey % 3 = 0), false) AS alias
FROM part LEFT JOIN one ON one.alias = p_name""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions (names of parts, with a title before them) that stand for the one tenth part of that name."""
    p = load(spark, sf_dir, "part")
    kind = F.when(F.length("p_name") % 2 == 0, "nick").otherwise("name")
    titles = p.filter("p_partkey % 10 = 0").select(F.col("p_name").alias("alias"), F.concat(F.lit("P"), "p_partkey").alias("title"), kind.alias("kind"))
    mentions = p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("הרב "), "p_name").alias("name"), (F.col("p_partkey") % 3 == 0).alias("in_prose"))
    return identity.resolve_aliases(mentions, identity.unique_alias_index(titles)).select("k", "in_prose", "title", "alias")


@registered("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'f' WHEN 1 THEN 'm' WHEN 2 THEN 'f' WHEN 3 THEN 'm' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'f' END END AS of_title,
       CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS of_honorific, CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE 2 END AS men, CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1 END AS women, c_custkey % 2 = 1 AS conflict, c_custkey % 4 < 2 AS dated
FROM customer""")
def gender_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genders by titles, kin words in parentheses, first verbs, and words before a name; and names that are days or years."""
    k, n = F.col("c_custkey"), F.concat(F.lit("X"), F.col("c_custkey").cast("string"))
    title = F.when(k % 5 == 0, F.concat(F.lit("הרבנית "), n)).when(k % 5 == 1, F.concat(F.lit("הרב "), n)).when(k % 5 == 2, F.concat(n, F.lit(" (אשת Y)"))).when(k % 5 == 3, F.concat(n, F.lit(" (בן Y)"))).otherwise(n)
    lead = F.when(F.col("c_nationkey") % 2 == 0, "נולד בעיר").otherwise("נולדה בעיר")
    before = F.when(k % 3 == 0, "אצל מרת ").when(k % 3 == 1, "אצל הרב ").otherwise("הרב בעיר ")
    votes = extraction.gender_votes(F.when(F.col("c_nationkey") % 2 == 0, "נולד ונפטר, כיהן, שימש").otherwise("למד, נפטר, נולדה"))
    own = F.when(k % 2 == 0, "m").otherwise("f")
    name = F.when(k % 4 == 0, 'תרפ"ט').when(k % 4 == 1, F.lit("1950")).when(k % 4 == 2, "דוד").otherwise(n)
    return load(spark, sf_dir, "customer").select(
        k.alias("k"), extraction.gender_of_title(title, lead).alias("of_title"), extraction.honorific_gender(before).alias("of_honorific"), votes["m"].cast("int").alias("men"), votes["f"].cast("int").alias("women"),
        extraction.gender_conflict(own, votes, F.lit("m")).alias("conflict"), extraction.looks_like_year(name).alias("dated"),
    )


@registered("""
SELECT 'T' || o_orderkey AS title, CASE o_orderkey % 3 WHEN 0 THEN CAST(1600 + o_orderkey % 300 AS VARCHAR) WHEN 1 THEN 'תר"ן' ELSE CAST(1700 + o_orderkey % 200 AS VARCHAR) END AS born,
       CASE WHEN o_orderkey % 3 = 1 THEN 'תש"ח' WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(1900 + o_orderkey % 99 AS VARCHAR) END AS died FROM orders""")
def page_year_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of pages: of a template field before those of a category, before those of a sentence."""
    k = F.col("o_orderkey")
    year = lambda base, of: (F.lit(base) + k % of).cast("string")
    filed = '[[קטגוריה:אישים שנולדו בשנת תר"ן]]\n[[קטגוריה:אישים שנפטרו בשנת תש"ח]]'
    text = F.when(k % 3 == 0, F.concat(F.lit("{{אישיות|לידה="), year(1600, 300), F.lit("}} נולד בשנת 1555, נפטר בשנת "), year(1900, 99), F.lit(".")))
    text = text.when(k % 3 == 1, F.concat(F.lit("נולד בשנת "), year(1700, 200), F.lit(".\n" + filed))).otherwise(F.concat(F.lit("היא נולדה בשנת "), year(1700, 200), F.lit(" בעיר.")))
    pages = load(spark, sf_dir, "orders").select(F.concat(F.lit("T"), k.cast("string")).alias("title"), text.alias("wikitext"))
    return extraction.page_years(pages, ("לידה",), ("פטירה",))


@registered("""
WITH c AS (SELECT DISTINCT CASE WHEN l_orderkey % 7 = 0 THEN 'Talk:' ELSE '' END || l_partkey AS title FROM lineitem), k AS (SELECT CAST(p_partkey AS VARCHAR) AS title FROM part WHERE p_partkey % 2 = 0)
SELECT title FROM c WHERE title IN (SELECT title FROM k) OR title NOT LIKE '%:%'""")
def changed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which titles of a listing of changes are to be fetched: known ones, and new ones of the main space."""
    title = F.concat(F.when(F.col("l_orderkey") % 7 == 0, "Talk:").otherwise(""), F.col("l_partkey").cast("string"))
    known = load(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("title"))
    return incremental.changed(load(spark, sf_dir, "lineitem").select(title.alias("title")), known, "title")


@registered("""
WITH m AS (SELECT s_nationkey AS n, s_suppkey AS k, s_suppkey % 4 AS surname FROM supplier), c AS (SELECT n, surname, count(*) AS t FROM m WHERE n % 3 <> 0 GROUP BY ALL),
best AS (SELECT n, 'משפחת S' || surname AS modal, row_number() OVER (PARTITION BY n ORDER BY t DESC, surname) AS r FROM c),
e AS (SELECT DISTINCT m.n, CASE WHEN m.n % 3 = 0 THEN 'N' || m.n ELSE modal END AS label FROM m LEFT JOIN best ON best.n = m.n AND r = 1)
SELECT 'N' || n AS spec, CASE WHEN n % 3 <> 0 AND count(*) OVER (PARTITION BY label) > 1 THEN label || ' (N' || n || ')' ELSE label END AS label FROM e""")
def family_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation are a group; every third nation is a category, the others are called by their commonest surname."""
    s = load(spark, sf_dir, "supplier")
    people = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey") % 4).alias("surname"))
    kind = F.when(F.col("s_nationkey") % 3 == 0, "category").otherwise("component")
    return trees.family_labels(people, s.select(F.concat(F.lit("N"), "s_nationkey").alias("spec"), kind.alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("id")))


_SLOTS = """
WITH p AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER w AS f, lag(o_orderkey, 2) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
one AS (SELECT child AS person, 'f' AS slot, f AS ancestor FROM p WHERE f IS NOT NULL UNION ALL SELECT child, 'm', m FROM p WHERE m IS NOT NULL),
s AS (SELECT * FROM one UNION ALL SELECT a.person, a.slot || b.slot, b.ancestor FROM one a JOIN one b ON a.ancestor = b.person),
top AS (SELECT person, max(length(slot)) AS top FROM s GROUP BY person)"""


@registered(f"""{_SLOTS},
t AS (SELECT person, top, max(CASE WHEN slot = 'f' THEN 1 END) AS f, max(CASE WHEN slot = 'm' THEN 1 END) AS m FROM s JOIN top USING (person) GROUP BY ALL)
SELECT CAST(person AS VARCHAR) AS tree_id, 'box' AS kind, CAST(2 * (top - length(slot)) AS INT) AS "row", CAST(ancestor AS VARCHAR) AS ref, count(*) AS n FROM s JOIN top USING (person) GROUP BY ALL
UNION ALL SELECT CAST(person AS VARCHAR), 'box', CAST(2 * top AS INT), CAST(person AS VARCHAR), 1 FROM top
UNION ALL SELECT CAST(person AS VARCHAR), 'marriage', CAST(2 * (top - 1) AS INT), NULL, 1 FROM t WHERE f = 1 AND m = 1
UNION ALL SELECT CAST(x.person AS VARCHAR), 'marriage', 0, NULL, count(*) FROM s x JOIN s y ON x.person = y.person AND x.slot || 'f' = y.slot JOIN s z ON x.person = z.person AND x.slot || 'm' = z.slot GROUP BY x.person""")
def ancestor_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of two generations of all orders (an order's father is the one before it of its customer, its mother the one
    before that): how many boxes of whom, and signs of couples, stand in each row."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("child"), F.lag("o_orderkey").over(w).cast("string").alias("f"), F.lag("o_orderkey", 2).over(w).cast("string").alias("m"))
    both = F.inline(F.array(F.struct(F.col("f").alias("parent"), F.lit("m").alias("gender")), F.struct(F.col("m").alias("parent"), F.lit("f").alias("gender"))))
    parents = p.select("child", both).filter("parent IS NOT NULL")
    slots = written(traverse.ancestor_slots(parents, p.select(F.col("child").alias("node")), 2), "slots")
    cells = ancestors.chart_cells(slots, 2).filter("kind IN ('box', 'marriage')")
    return cells.groupBy("tree_id", "kind", "row", "ref").agg(F.count(F.lit(1)).alias("n"))
