"""Registered queries: each operator on the relational and text tables, with its SQL equivalent.

The tables hold no wikitext and no families, so each query says what stands for people, edges, pages and evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import names, text
from kinloom.operators import boxes, canonical, consistency, coverage, existing, forest, fusion, identity, incremental, inference, merging, selection, traverse, trees
from kinloom.operators.graph import connected_components
from kinloom.plans.storage import written
from kinloom.sinks import outputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@registered("""
SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n_evidence, count(DISTINCT l_orderkey) AS n_pages,
       round(least(1 - product(1 - greatest(least(0.4 + l_discount * 5, 0.95), 0.05)), 0.98), 6) AS confidence,
       count(DISTINCT l_orderkey) >= 2 AS corroborated
FROM lineitem GROUP BY l_suppkey, l_partkey""")
def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part are the ends of an edge, the order is the page that gives evidence for it."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("page"),
        (F.lit(0.4) + F.col("l_discount") * 5).alias("confidence"),
    )
    return fusion.fuse_evidence(rows, ["a", "b"], page="page", confidence="confidence")


@registered("""
SELECT l_suppkey AS a, l_partkey AS b, l_returnflag AS page, max(l_discount) AS confidence,
       arg_min(l_linenumber, l_orderkey * 16 + l_linenumber) AS line, min(l_orderkey) AS ord
FROM lineitem GROUP BY ALL""")
def evidence_dedupe_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one return flag are one piece of evidence of an edge."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("page"),
        F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
    )
    return fusion.dedupe_evidence(rows, ["a", "b", "page"], "confidence", ["ord", "line"], ["line", "ord"])


@registered("""
SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS votes_m, count(*) FILTER (event_type = 'error') AS votes_f,
       CASE WHEN count(*) FILTER (event_type IN ('view', 'click', 'error')) > 0 THEN
            CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) >= count(*) FILTER (event_type = 'error') THEN 'm' ELSE 'f' END END AS winner
FROM events GROUP BY user_id""")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events vote on their user."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type")
    return fusion.majority_vote(e, "user_id", F.col("event_type").isin("view", "click"), F.col("event_type") == "error")


@registered("""
SELECT word, count(*) AS documents FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents)
GROUP BY word HAVING count(*) >= 8""")
def doc_frequency_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that eight documents have at least."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    words = d.select(F.explode(F.array_distinct(found)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).filter("documents >= 8")


@registered("""
SELECT alias, min(title) AS title, max(kind) AS kind FROM (
  SELECT p_name || ' ' || p_size AS alias, p_partkey AS title, 'name' AS kind FROM part
  UNION ALL SELECT p_brand || ' ' || p_type || ' ' || p_size, p_partkey, 'nick' FROM part)
WHERE length(alias) >= 3 GROUP BY alias HAVING count(DISTINCT title) = 1""")
def unique_alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are titles; name and size, and brand, type and size, are aliases for them."""
    p = load(spark, sf_dir, "part")
    one = p.select(F.concat_ws(" ", "p_name", "p_size").alias("alias"), F.col("p_partkey").alias("title"), F.lit("name").alias("kind"))
    two = p.select(F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("alias"), F.col("p_partkey").alias("title"), F.lit("nick").alias("kind"))
    return identity.unique_alias_index(one.unionByName(two))


@registered("""SELECT page_id, target, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page with their number."""
    p = load(spark, sf_dir, "pages").select("page_id", F.explode(text.hrefs(F.col("html"))).alias("target"))
    return p.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@registered(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages""")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of each page."""
    return load(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


@registered(r"""
SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM documents)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document with their position."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences_plain(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", "sentence", F.col("pos").cast("long").alias("pos"))


@registered(r"""
SELECT doc_id, CASE WHEN regexp_matches(source || '/' || doc_id, '7$') THEN false
  WHEN doc_id % 3 <> 0 AND regexp_matches(lang, '^(en|fr)$') AND NOT regexp_matches(lang, '^fr$') THEN true WHEN doc_id % 3 <> 0 THEN false
  WHEN regexp_matches(source || '/' || doc_id, '5$') THEN false ELSE regexp_matches(left(coalesce(text, ''), 1500), '[0-9]{16}|@') END AS person
FROM documents""")
def page_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: titles that end in 7 are nobody's, English ones without a digit of three are people's."""
    d = load(spark, sf_dir, "documents")
    title = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    rules = canonical.PersonRules("7$", "^(en|fr)$", "^fr$", "5$", "[0-9]{16}|@")
    categories = F.when(F.col("doc_id") % 3 != 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", canonical.is_person_page(title, categories, F.col("text"), rules).alias("person"))


@registered("""
WITH RECURSIVE r AS (SELECT page_id AS source, (page_id // 3) * 2 AS target FROM pages WHERE page_id % 3 <> 0),
walk AS (SELECT source, target FROM r UNION SELECT w.source, r.target FROM walk w JOIN r ON w.target = r.source)
SELECT source, target FROM walk WHERE target NOT IN (SELECT source FROM r)""")
def redirect_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose number is no multiple of three redirect to an earlier one; where do they end?"""
    p = load(spark, sf_dir, "pages").filter("page_id % 3 <> 0")
    return traverse.follow_redirects(p.select(F.col("page_id").alias("source"), (F.floor(F.col("page_id") / 3) * 2).alias("target")))


@registered("""
WITH new AS (SELECT o_orderkey, max(o_totalprice) AS o_totalprice, 'new' AS origin FROM orders
             WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 2 HOUR GROUP BY o_orderkey),
     old AS (SELECT o_orderkey, o_totalprice - 1 AS o_totalprice, 'old' AS origin FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since a watermark less its overlap replace earlier versions of themselves."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = o.filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp") - F.expr("INTERVAL 2 HOURS"))
    new = new.select("o_orderkey", "o_totalprice", F.lit("new").alias("origin"))
    old = o.filter("o_orderdate < timestamp '2001-01-01'")
    old = old.select("o_orderkey", (F.col("o_totalprice") - 1).alias("o_totalprice"), F.lit("old").alias("origin"))
    return incremental.upsert(old, new, ["o_orderkey"], version="o_totalprice")


@registered("""
WITH wanted AS (SELECT DISTINCT o_custkey AS title FROM orders), done AS (SELECT c_custkey AS title FROM customer WHERE c_acctbal > 0),
     failed AS (SELECT c_custkey AS title FROM customer WHERE c_acctbal < -500), missing AS (SELECT c_custkey AS title FROM customer WHERE c_nationkey = 3)
SELECT title, true AS retry FROM failed UNION ALL
SELECT title, false FROM wanted WHERE title NOT IN (FROM failed) AND title NOT IN (FROM done) AND title NOT IN (FROM missing)""")
def retry_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers are to be fetched: failures again, others unless they are there or known to be missing."""
    c = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "title")
    wanted = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("title"))
    return incremental.pending(wanted, c.filter("c_acctbal > 0"), c.filter("c_acctbal < -500"), c.filter("c_nationkey = 3"), "title")


@registered("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL
                     SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
walk AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION
         SELECT e.child, depth + 1 FROM walk JOIN e ON e.parent = node WHERE depth < 8 AND e.child NOT IN ('n3', 'n7'))
SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def category_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a category tree with two excluded categories."""
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    out = spark.createDataFrame([("n3",), ("n7",)], "node string")
    return traverse.descendants(n.unionByName(c), roots, 8, out)


@registered("""
SELECT DISTINCT a, b FROM (
  SELECT l_partkey, min(l_suppkey) FILTER (l_suppkey % 2 = 0) AS a, min(l_suppkey) FILTER (l_suppkey % 2 = 1) AS b,
         count(DISTINCT l_suppkey) FILTER (l_suppkey % 2 = 0) AS m, count(DISTINCT l_suppkey) FILTER (l_suppkey % 2 = 1) AS f
  FROM lineitem GROUP BY l_partkey, l_orderkey) WHERE m = 1 AND f = 1""")
def coparent_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part in an order is a child of its suppliers there; even suppliers are fathers."""
    p = load(spark, sf_dir, "lineitem").select(F.struct("l_partkey", "l_orderkey").alias("child"), F.col("l_suppkey").alias("parent"))
    return inference.coparents(p.withColumn("gender", F.when(F.col("parent") % 2 == 0, "m").otherwise("f")))


@registered("""
SELECT o_custkey AS x, l_suppkey AS b, min(l_partkey) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY ALL HAVING count(DISTINCT l_partkey) = 1""")
def inlaw_inference_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier are linked through a part if only one fits."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    pairs = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("x"), F.col("l_suppkey").alias("b"), F.col("l_partkey").alias("y"))
    return inference.unique_candidates(pairs, ["x", "b"], "y")


@registered("""
SELECT l_orderkey AS a, l_linenumber AS line, CASE WHEN cb < pb + 12 OR cd < pb THEN 'too_late' WHEN cb > pd + 1 THEN 'posthumous' END AS why,
       CASE WHEN cb < pb + 12 OR cd < pb OR cb > pd + 1 THEN least(0.5 + l_discount, 0.3) ELSE 0.5 + l_discount END AS confidence
FROM (SELECT *, 1900 + l_quantity AS cb, 1960 + l_quantity AS cd, 1870 + l_partkey % 50 AS pb, 1900 + l_suppkey % 60 AS pd FROM lineitem)""")
def consistency_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items carry the years of a child and a parent."""
    l = load(spark, sf_dir, "lineitem")
    why = consistency.parent_years(1900 + F.col("l_quantity"), 1960 + F.col("l_quantity"), 1870 + F.col("l_partkey") % 50, 1900 + F.col("l_suppkey") % 60)
    conf = F.lit(0.5) + F.col("l_discount")
    out = l.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("line"), why.alias("why"), conf.alias("confidence"))
    return out.withColumn("confidence", F.when(F.col("why").isNotNull(), F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")))


_SAME = """
keys AS (SELECT doc_id, 'a' || md5(lower(text)) AS k FROM documents UNION ALL SELECT doc_id, 'z' || md5(regexp_replace(lower(text), '[^a-z]+', '', 'g')) FROM documents),
e AS (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM keys x JOIN keys y USING (k) WHERE x.doc_id <> y.doc_id),
walk AS (SELECT u AS node, u AS reach FROM e UNION SELECT node, v FROM walk JOIN e ON reach = u),
comp AS (SELECT node, min(reach) AS component FROM walk GROUP BY node)"""


def _same_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole texts are equal but for case, or have the same letters, each linked to the first of them."""
    low = F.lower("text")
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(
        F.concat(F.lit("a"), F.md5(low)), F.concat(F.lit("z"), F.md5(F.regexp_replace(low, "[^a-z]+", ""))))).alias("k"))
    d = written(d, "texts")
    first = d.groupBy("k").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.join(first, "k").select(F.col("doc_id").alias("u"), "v")


@registered(f"WITH RECURSIVE {_SAME} SELECT node, component FROM comp")
def connected_components_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that have the same text, but for case or signs."""
    return connected_components(_same_texts(spark, sf_dir), written)


@registered(f"""WITH RECURSIVE {_SAME}, n AS (SELECT component, source, count(*) AS n FROM comp JOIN documents ON doc_id = node GROUP BY ALL)
SELECT component, min(source) AS source, n FROM n WHERE n = (SELECT max(n) FROM n AS m WHERE m.component = n.component) GROUP BY component, n""")
def component_label_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent source of each component, the smallest on a tie."""
    parts = connected_components(_same_texts(spark, sf_dir), written)
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "source")
    return identity.top_value(parts.join(d, "node"), "component", "source")


@registered("""
SELECT x.c_custkey AS u, y.c_custkey AS v FROM customer x JOIN customer y
ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey < y.c_custkey AND levenshtein(x.c_name, y.c_name) <= 1""")
def slot_blocking_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment whose names differ in one character."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return identity.near_pairs(c, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_name")


@registered("""
WITH m AS (SELECT DISTINCT s_nationkey AS family, s_suppkey AS person FROM supplier), size AS (SELECT family, count(*) AS members FROM m GROUP BY family),
t AS (SELECT DISTINCT l_partkey AS tree, l_suppkey AS person, l_partkey % 5 = 0 AS draft FROM lineitem),
hit AS (SELECT family, tree, draft, count(*) AS covered FROM m JOIN t USING (person) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY covered / members DESC, draft, tree) AS r FROM hit JOIN size USING (family))
SELECT size.family, size.members, tree, coalesce(covered, 0) AS covered, round(coalesce(covered / size.members, 0), 6) AS score,
  CASE WHEN tree IS NULL THEN 'none' WHEN covered / size.members >= 0.5 AND covered >= 3 THEN CASE WHEN draft THEN 'draft' ELSE 'exists' END ELSE 'partial' END AS status
FROM size LEFT JOIN (FROM best WHERE r = 1) b USING (family)""")
def coverage_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation are a family, suppliers of a part a tree."""
    m = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("person"))
    t = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tree"), F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 5 == 0).alias("draft"))
    return coverage.best_coverage(m, t)


@registered("""
SELECT child, owner FROM (SELECT child, owner, row_number() OVER (PARTITION BY child ORDER BY NOT fetched, gender <> 'm', year, owner) AS r FROM (
  SELECT DISTINCT 'p' || l_partkey AS child, 's' || l_suppkey AS owner, s_acctbal > 0 AS fetched, CASE WHEN s_nationkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender, s_suppkey % 13 AS year
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)) WHERE r = 1""")
def owner_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are parents of their parts: which of them is a part drawn under?"""
    people = _supplier_people(spark, sf_dir)
    e = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    e = e.select("a", "b", F.lit("parent").alias("relation"), F.lit(0.9).alias("confidence"))
    everybody = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct().select(F.lit("all").alias("spec"), "id")
    return trees.owners(people, e, everybody).select("child", "owner")


def _supplier_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("fetched"),
        F.when(F.col("s_nationkey") % 2 == 0, "m").otherwise("f").alias("gender"), (F.col("s_suppkey") % 13).cast("int").alias("year"),
    )


@registered("""
WITH RECURSIVE p AS (SELECT * FROM (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL),
up AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT parent FROM up JOIN p ON child = node WHERE parent % 5 <> 0),
down AS (SELECT node FROM up UNION SELECT child FROM down JOIN p ON parent = node)
SELECT node FROM down UNION SELECT o_orderkey + 1 FROM orders JOIN down ON node = o_orderkey WHERE o_orderkey % 7 = 0
UNION SELECT o_orderkey FROM orders JOIN down ON node = o_orderkey + 1 WHERE o_orderkey % 7 = 0""")
def bloodline_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order descends from the one before it of its customer, a father unless a multiple of five; who is of one blood
    with every 97th?"""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    p = _order_chain(spark, sf_dir).filter("parent IS NOT NULL").select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit("parent").alias("relation"))
    wed = o.filter("id % 7 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("spouse").alias("relation"))
    people = o.withColumn("gender", F.when(F.col("id") % 5 != 0, "m").otherwise("f"))
    return trees.bloodline(people, p.unionByName(wed).withColumn("confidence", F.lit(0.9)), o.filter("id % 97 = 0").select(F.col("id").alias("node")))


def _order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), before.alias("parent"))


@registered("""
WITH p AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f,
                  lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS m FROM orders),
one AS (SELECT child, 'f' AS letter, f AS parent FROM p WHERE f IS NOT NULL UNION ALL SELECT child, 'm', m FROM p WHERE m IS NOT NULL),
two AS (SELECT a.child, a.letter || b.letter AS slot, b.parent FROM one a JOIN one b ON a.parent = b.child),
three AS (SELECT a.child, a.slot || b.letter AS slot, b.parent FROM two a JOIN one b ON a.parent = b.child)
SELECT child AS person, letter AS slot, parent AS ancestor FROM one UNION ALL FROM two UNION ALL FROM three""")
def ancestor_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's father is the order before it of its customer, its mother the one before that."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(w).alias("f"), F.lag("o_orderkey", 2).over(w).alias("m"))
    p = o.select("child", F.col("f").alias("parent"), F.lit("m").alias("gender")).unionByName(o.select("child", F.col("m").alias("parent"), F.lit("f").alias("gender")))
    return traverse.ancestor_slots(p.filter("parent IS NOT NULL"), o.select(F.col("child").alias("node")), 3)


@registered("""
WITH RECURSIVE p AS (SELECT * FROM (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL),
art AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'F'),
reach AS (SELECT node FROM art UNION SELECT parent FROM reach JOIN p ON child = node),
br AS (SELECT parent AS node, count(DISTINCT child) AS n FROM p JOIN reach ON child = node GROUP BY parent),
bare AS (SELECT node, coalesce(n, 0) AS n FROM (SELECT child AS node FROM p UNION SELECT parent FROM p) LEFT JOIN br USING (node) WHERE node NOT IN (SELECT node FROM art)),
wed AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey + 1 IN (SELECT node FROM art)
        UNION SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey IN (SELECT node FROM art)),
seed AS (SELECT node FROM bare WHERE n >= 2 UNION SELECT node FROM bare JOIN p ON child = node WHERE n >= 1 AND parent IN (SELECT node FROM art)),
kept AS (SELECT node FROM seed UNION SELECT b.node FROM kept JOIN p ON p.parent = kept.node JOIN bare b ON b.node = p.child WHERE b.n >= 1 OR b.node IN (SELECT node FROM wed))
SELECT node FROM kept""")
def privacy_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders descend from the one before; those of status F have no article. Which of them keep the chain together?"""
    p = written(_order_chain(spark, sf_dir).filter("parent IS NOT NULL"), "chain")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderstatus", "o_custkey")
    wed = o.filter("node % 7 = 0").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return traverse.kept_without_article(p, wed, o.filter("o_orderstatus <> 'F'").select("node"))


_WAYS = ",\n".join(  # the strongest way of up to 2 ** k edges between two ends: its weakest edge's rank
    f"p{k + 1} AS (SELECT i, j, min(r) AS r FROM (FROM p{k} UNION ALL SELECT x.i, y.j, greatest(x.r, y.r) FROM p{k} x JOIN p{k} y ON x.j = y.i) GROUP BY i, j)" for k in range(10)
)


@registered(f"""
WITH e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, 0.5 + max(x.l_discount) AS c, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY a % 5 <> 0 DESC, c DESC, n DESC, a DESC, b DESC) AS r FROM e), p0 AS (SELECT a AS i, b AS j, r FROM r),
{_WAYS}
SELECT a, b, CASE WHEN p10.r < r.r THEN least(c, 0.2) ELSE c END AS confidence, a % 5 = 0 AS alias_any, n AS n_evidence, coalesce(p10.r < r.r, false) AS in_cycle FROM r LEFT JOIN p10 ON i = b AND j = a""")
def cycle_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers of lines of an order, their cycles broken."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    e = l.alias("x").join(l.alias("y"), "l_orderkey").filter("x.l_suppkey <> y.l_suppkey")
    e = e.groupBy(F.col("x.l_suppkey").alias("a"), F.col("y.l_suppkey").alias("b")).agg(F.max("x.l_discount").alias("d"), F.count(F.lit(1)).alias("n_evidence"))
    e = e.select("a", "b", (F.lit(0.5) + F.col("d")).alias("confidence"), (F.col("a") % 5 == 0).alias("alias_any"), "n_evidence")
    return traverse.break_cycles(e, 0.2)


@registered("""
WITH r AS (SELECT c_name AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender, true AS fetched, -1 AS ord, 0 AS side FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), NULL, false, o_orderkey, 0 FROM orders
  UNION ALL SELECT '~' || o_orderpriority || '@' || o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'f' END, false, o_orderkey, 1 FROM orders)
SELECT id, CASE WHEN id LIKE '~%' THEN split_part(substr(id, 2), '@', 1) ELSE id END AS name, bool_or(fetched) OVER (PARTITION BY id) AS fetched, gender
FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord, side) = 1""")
def person_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers have pages; orders mention customers and unlinked priorities."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    pages = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "m").otherwise("f").alias("gender"))
    none = F.lit(None).cast("string")
    rel = o.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("person"), F.concat(F.lit("~"), "o_orderpriority", F.lit("@"), "o_orderstatus").alias("relative"),
        F.lit("").alias("person_name"), none.alias("relative_name"), none.alias("person_gender"), F.when(F.col("o_orderkey") % 2 == 0, "f").alias("relative_gender"), F.col("o_orderkey").alias("order"),
    )
    return merging.upsert_people(pages, rel)


@registered("""
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END AS born FROM orders),
p AS (SELECT * FROM (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL),
w AS (SELECT id AS a, id + 1 AS b FROM o WHERE id % 7 = 0 UNION SELECT id + 1, id FROM o WHERE id % 7 = 0),
sure AS (SELECT o.id, coalesce(any_value(o.born), min(s.born)) AS born FROM o LEFT JOIN w ON w.a = o.id LEFT JOIN o s ON s.id = w.b GROUP BY o.id),
one AS (SELECT id, coalesce(born, (SELECT min(k.born) - 25 FROM p JOIN o k ON k.id = p.child WHERE p.parent = sure.id), (SELECT max(k.born) + 25 FROM p JOIN o k ON k.id = p.parent WHERE p.child = sure.id)) AS born FROM sure),
two AS (SELECT id, coalesce(born, (SELECT min(k.born) - 25 FROM p JOIN one k ON k.id = p.child WHERE p.parent = sure.id), (SELECT max(k.born) + 25 FROM p JOIN one k ON k.id = p.parent WHERE p.child = sure.id)) AS born FROM sure)
SELECT id, CAST(born AS INT) AS estimate FROM two""")
def birth_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders descend from the one before of their customer; those of status F are born in their year."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).alias("born"))
    p = _order_chain(spark, sf_dir).filter("parent IS NOT NULL").select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit("parent").alias("relation"))
    wed = o.filter("id % 7 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("spouse").alias("relation"))
    return merging.estimated_births(o, p.unionByName(wed))


_CUSTOMERS = "c AS (SELECT 'c' || c_custkey AS id, c_custkey AS k, c_mktsegment AS surname, c_custkey % 10 AS spec, c_acctbal > 0 AS fetched FROM customer)"
_KIN = """e AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey - 10) AS b, 'parent' AS relation FROM customer WHERE c_custkey % 3 = 0 AND c_custkey >= 10
  UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey + 10), 'spouse' FROM customer WHERE c_custkey % 4 = 0)"""


def _kin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as people (surname: segment), relations between every tenth, groups by last digit."""
    c = load(spark, sf_dir, "customer")
    name = lambda shift: F.concat(F.lit("c"), (F.col("c_custkey") + shift).cast("string"))
    people = c.select(name(0).alias("id"), F.col("c_mktsegment").alias("surname"), (F.col("c_acctbal") > 0).alias("fetched"))
    up = c.filter("c_custkey % 3 = 0 AND c_custkey >= 10").select(name(0).alias("a"), name(-10).alias("b"), F.lit("parent").alias("relation"))
    wed = c.filter("c_custkey % 4 = 0").select(name(0).alias("a"), name(10).alias("b"), F.lit("spouse").alias("relation"))
    members = c.select((F.col("c_custkey") % 10).alias("spec"), name(0).alias("id"))
    return people, up.unionByName(wed).withColumn("confidence", F.lit(0.9)), members


@registered(f"""
WITH {_CUSTOMERS}, n AS (SELECT spec, surname, count(*) AS n FROM c GROUP BY ALL),
base AS (SELECT DISTINCT spec, CASE spec % 3 WHEN 0 THEN 'HOUS' WHEN 1 THEN 'ELSE' END AS base FROM c WHERE spec % 3 < 2),
fit AS (SELECT DISTINCT n.spec, base FROM n JOIN base USING (spec) WHERE surname = base OR surname LIKE base || '%'),
modal AS (SELECT spec, surname FROM n QUALIFY row_number() OVER (PARTITION BY spec ORDER BY n DESC, surname) = 1),
main AS (SELECT modal.spec, coalesce(fit.base, modal.surname) AS main FROM modal LEFT JOIN fit USING (spec))
SELECT spec, main AS surname FROM main UNION SELECT n.spec, surname FROM n JOIN main USING (spec) WHERE surname = main OR surname LIKE main || '%'""")
def family_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are surnames; some groups are labelled with the beginning of one, some with none of theirs, some not."""
    people, _, members = _kin(spark, sf_dir)
    label = F.when(F.col("spec") % 3 == 0, selection.FAMILY_PREFIXES[0] + "HOUS").when(F.col("spec") % 3 == 1, selection.FAMILY_PREFIXES[0] + "ELSE").otherwise("x")
    return selection.family_surnames(people, members, members.select("spec").distinct().withColumn("label", label), names.similar_surname_plain)


@registered(f"""
WITH {_CUSTOMERS}, {_KIN}, up AS (SELECT DISTINCT a AS id FROM e WHERE relation = 'parent'),
w AS (SELECT a, b FROM e WHERE relation = 'spouse' UNION SELECT b, a FROM e WHERE relation = 'spouse'),
f AS (SELECT w.a AS id, any_value(x.spec) AS spec, bool_or(w.b IN (SELECT id FROM up)) AS sup, bool_or(y.surname = 'BUILDING') AS snamed, bool_or(w.a IN (SELECT id FROM up)) AS own, bool_or(x.surname = 'BUILDING') AS named
      FROM w JOIN c x ON x.id = w.a JOIN c y ON y.id = w.b GROUP BY w.a)
SELECT spec, id FROM f WHERE (NOT named AND CASE WHEN own THEN sup ELSE sup OR snamed END) OR (named AND NOT own AND sup)""")
def married_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who came into the groups, all of the name BUILDING, by marriage."""
    people, e, members = _kin(spark, sf_dir)
    surname = members.select("spec").distinct().withColumn("surname", F.lit("BUILDING"))
    return selection.married_in(people, e, members, surname, names.similar_surname_plain)


@registered(f"""
WITH {_CUSTOMERS}, {_KIN}, m AS (SELECT spec, id FROM c WHERE fetched), bare AS (SELECT id FROM c WHERE NOT fetched)
SELECT spec, id FROM m UNION SELECT spec, b FROM e JOIN m ON m.id = a WHERE b IN (SELECT id FROM bare) UNION SELECT spec, a FROM e JOIN m ON m.id = b WHERE a IN (SELECT id FROM bare)""")
def unlinked_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of customers in credit, and their relatives who are not."""
    people, e, members = _kin(spark, sf_dir)
    own = members.join(people.filter("fetched").select("id"), "id", "left_semi").select("spec", "id")
    return selection.with_unlinked_relatives(people, e, own)


@registered("""
WITH o AS (SELECT o_custkey AS tree, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT 't' || tree AS tree_id, CAST(depth AS INT) AS node_id, CASE WHEN depth > 0 THEN CAST(depth - 1 AS INT) END AS parent_node, 'o' || k AS person, CAST(depth AS INT) AS depth, depth = 3 AND n > 4 AS truncated
FROM o WHERE depth < 4""")
def tree_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each customer: every order stands below the one before it; four people fit."""
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("t"), "o_custkey").alias("spec"), F.year("o_orderdate").alias("year"), F.lit("m").alias("gender"), F.lit("one two").alias("name"))
    chain = _order_chain(spark, sf_dir).select(F.concat(F.lit("o"), "child").alias("child"), F.when(F.col("parent").isNotNull(), F.concat(F.lit("o"), "parent")).alias("owner"))
    chain = written(chain.join(o.select(F.col("id").alias("child"), "spec"), "child"), "chain")
    e = chain.filter("owner IS NOT NULL").select(F.col("child").alias("a"), F.col("owner").alias("b"), F.lit("parent").alias("relation"), F.lit(0.9).alias("confidence"))
    below = forest.families_below(o, e, chain.filter("owner IS NOT NULL").select("spec", "child", "owner"))
    roots = chain.filter("owner IS NULL").select(F.col("spec").alias("tree_id"), "spec", F.col("child").alias("person"))
    nodes, _ = forest.grow_trees(roots, below, o, forest.bare_children(o, e), 4, max_depth=5)
    return nodes.select("tree_id", "node_id", "parent_node", "person", "depth", "truncated")


@registered("""
WITH p AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'עץ משפחת ' ELSE '' END || 'p' || page_id // 2 AS title, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 10 END AS ns,
  page_id % 4 = 0 AS cat, CASE WHEN page_id % 7 IN (1, 2) THEN 'T' || page_id % 7 END AS uses, page_id % 5 = 0 AS titled, contains(html, 'the ') AS said FROM pages),
s AS (SELECT title, 'category' AS source FROM p WHERE cat UNION SELECT title, 'embeds:' || uses FROM p WHERE uses IS NOT NULL AND (ns = 10 OR titled)
      UNION SELECT title, 'prefix' FROM p WHERE titled UNION SELECT title, 'search' FROM p WHERE titled AND said),
q AS (SELECT DISTINCT title FROM s)
SELECT title, CAST(max(ns) AS INT) AS ns, (SELECT string_agg(source, ',' ORDER BY source) FROM s WHERE s.title = p.title) AS sources, max(ns) = 2 AS draft
FROM p WHERE cat OR titled OR (uses IS NOT NULL AND ns = 10) GROUP BY title""")
def existing_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a site's: category, templates, namespaces and titles by number; two pages each share a name."""
    n = F.col("page_id")
    pages = load(spark, sf_dir, "pages").select(
        F.concat(F.when(n % 5 == 0, "עץ משפחת ").otherwise(""), F.lit("p"), F.floor(n / 2).cast("string")).alias("title"), F.when(n % 3 == 0, 0).when(n % 3 == 1, 2).otherwise(10).alias("ns"),
        F.when(n % 4 == 0, F.array(F.lit("Trees"))).otherwise(F.array().cast("array<string>")).alias("categories"), F.array(F.concat(F.lit("T"), (n % 7).cast("string"))).alias("uses"), F.col("html").alias("wikitext"),
    )
    found = existing.find_trees(pages, "Trees", ("T1", "T2"), "the ")
    return found.select("title", "ns", F.array_join("sources", ",").alias("sources"), "draft")


@registered("""
WITH e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, CASE l_linenumber % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'spouse' ELSE 'uncle' END AS relation, max(l_discount) AS confidence,
  bool_or(l_returnflag = 'A') AS noref, bool_or(l_returnflag = 'N') AS inferred, bool_or(l_linestatus = 'F') AS conflict FROM lineitem GROUP BY 1, 2, 3)
SELECT DISTINCT 't' || s_nationkey AS tree_id, a, b, relation, confidence,
  concat_ws(',', CASE WHEN noref THEN 'noref' END, CASE WHEN inferred THEN 'inferred' END, CASE WHEN conflict THEN 'conflict' END) AS classes
FROM e JOIN supplier ON a = 's' || s_suppkey WHERE relation <> 'uncle'""")
def review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation are a tree; which of their edges does the report list, and how?"""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "parent").when(F.col("l_linenumber") % 3 == 1, "spouse").otherwise("uncle")
    e = load(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), kind.alias("relation")).agg(
        F.max("l_discount").alias("confidence"), F.bool_or(F.col("l_returnflag") == "A").alias("noref"), F.bool_or(F.col("l_returnflag") == "N").alias("inferred"), F.bool_or(F.col("l_linestatus") == "F").alias("conflict"))
    flags = F.array_compact(F.array(F.when(F.col("noref"), F.lit("no_ref")), F.when(F.col("inferred"), F.lit("inferred")), F.when(F.col("conflict"), F.lit("cycle"))))
    e = e.select("a", "b", "relation", "confidence", "inferred", flags.alias("flags"), F.array().cast("array<struct<refs:array<string>>>").alias("evidence"))
    shown = load(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), "s_nationkey").alias("tree_id"), F.concat(F.lit("s"), "s_suppkey").alias("person"))
    return outputs.review_edges(shown, e).select("tree_id", "a", "b", "relation", "confidence", F.array_join("classes", ",").alias("classes"))


@registered("""
SELECT c_custkey, '[[' || c_name || ' (' || c_mktsegment || ')|' || c_name || ']]<br /><small>' || c_mktsegment ||
  CASE WHEN c_nationkey % 3 < 2 THEN ' · ' || CASE WHEN c_nationkey % 3 = 0 THEN CAST(c_nationkey + 1900 AS VARCHAR) ELSE '?–' || (c_nationkey + 1950) END ELSE '' END || '</small>' AS label
FROM customer""")
def person_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles named by customer and segment; some have a year of birth, some of death."""
    k = F.col("c_nationkey")
    born, died = F.when(k % 3 == 0, (k + 1900).cast("string")), F.when(k % 3 == 1, (k + 1950).cast("string"))
    title = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return load(spark, sf_dir, "customer").select("c_custkey", boxes.person_label(title, F.col("c_name"), born, died).alias("label"))


@registered("""
SELECT c_nationkey AS tree_id, count(DISTINCT c_custkey) AS people, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS articles, max(c_custkey % 4) + 1 AS generations, 700 AS width, 500 AS height
FROM customer GROUP BY c_nationkey""")
def tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation are a tree of four generations."""
    c = load(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_nationkey").alias("tree_id"), F.col("c_custkey").alias("person"), (F.col("c_custkey") % 4).alias("depth"))
    size = c.select(F.col("c_nationkey").alias("tree_id")).distinct().withColumns({"width": F.lit(700), "height": F.lit(500)})
    return selection.tree_records(nodes, c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("fetched")), size)


@registered("""
SELECT person, string_agg(title, ',' ORDER BY title) AS trees FROM (
  SELECT l_suppkey AS person, 'B' || l_partkey % 50 AS title FROM lineitem UNION SELECT l_suppkey, 'A' || l_orderkey % 50 FROM lineitem) GROUP BY person""")
def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are in built trees by part and in existing ones by order."""
    l = load(spark, sf_dir, "lineitem")
    tree = lambda letter, key: l.select(F.col("l_suppkey").alias("person"), F.concat(F.lit(letter), (F.col(key) % 50).cast("string")).alias("title"))
    return selection.cross_links(tree("B", "l_partkey"), tree("A", "l_orderkey")).select("person", F.array_join("trees", ",").alias("trees"))


@registered("""
SELECT DISTINCT target FROM (SELECT 'c' || o_custkey AS target FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN '~' ELSE 'p' END || o_orderpriority FROM orders)
WHERE target NOT LIKE '~%' AND target NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0) AND target NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 3)""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ends of orders are neither pages (customers in credit) nor looked up before (those of one nation)?"""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").withColumn("t", F.concat(F.lit("c"), "c_custkey"))
    rel = o.select(F.concat(F.lit("c"), "o_custkey").alias("person"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "~").otherwise("p"), "o_orderpriority").alias("relative"))
    return canonical.unresolved_targets(rel, c.filter("c_acctbal > 0").select(F.col("t").alias("title")), c.filter("c_nationkey = 3").select(F.col("t").alias("target")))


@registered(f"""
WITH {_CUSTOMERS}, cat AS (SELECT spec AS g, id FROM c WHERE spec < 4), fam AS (SELECT 'F' || k % 9 AS family, id, fetched FROM c),
n AS (SELECT family, count(*) AS n, count(cat.id) AS covered FROM fam LEFT JOIN cat USING (id) WHERE fetched GROUP BY family)
SELECT 'N' || g AS spec, 'category' AS kind, id FROM cat UNION ALL
SELECT family, 'component', id FROM fam JOIN n USING (family) WHERE n >= 4 AND covered / n < 0.5""")
def family_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a category by last digit, and components by another number."""
    c = load(spark, sf_dir, "customer")
    ident = F.concat(F.lit("c"), "c_custkey").alias("id")
    category = F.when(F.col("c_custkey") % 10 < 4, F.array(F.concat(F.lit("N"), (F.col("c_custkey") % 10).cast("string")))).otherwise(F.array().cast("array<string>"))
    people = c.select(ident, (F.col("c_acctbal") > 0).alias("fetched"), category.alias("family_categories"))
    return trees.family_specs(people, c.select(F.concat(F.lit("F"), (F.col("c_custkey") % 9).cast("string")).alias("family"), ident))
