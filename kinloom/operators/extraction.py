"""Relations from wikitext: infobox fields, phrases and list lines, with their sentence and footnotes.

Sentences without any kin word are dropped by a native test before Python sees them; ``reading`` reads the others, a line
at a time. What a line needs of the whole corpus comes with it by joins: the words of its names from the lexicon, and which
of its links are pages of people. So no vocabulary and no list of titles passes through the driver, whatever their size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions import text as tx
from kinloom.functions.names import HONORIFICS, key_words
from kinloom.operators.identity import resolve_aliases
from kinloom.operators.reading import (
    FEMALE_KIN,
    FEMALE_TITLES,
    GENDERED,
    LINKED,
    MALE_KIN,
    NO_ARTICLE,
    TRIGGER,
    UNLINKED,
    YEAR,
    Found,
    Lexicon,
    any_of,
    notes_of,
    phrases,
    read_line,
    read_page,
    word,
)
from kinloom.plans.storage import written

T = Thresholds()

SCHEMA = (
    "person string, relative string, relation string, source_page string, evidence string, refs array<string>, method string, "
    "pattern string, confidence double, side string, alias boolean, order int, doubtful boolean, start int, end int"
)
ARROW = pa.schema([
    *((c, pa.string()) for c in ("person", "relative", "relation", "source_page", "evidence")), ("refs", pa.list_(pa.string())), ("method", pa.string()), ("pattern", pa.string()),
    ("confidence", pa.float64()), ("side", pa.string()), ("alias", pa.bool_()), ("order", pa.int32()), ("doubtful", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()),
])


def lexicon_of(titles: DataFrame, texts: DataFrame | None = None, least: int = T.strict_lexicon, frequent: int = T.document_frequency) -> DataFrame | None:
    """(word, given, last, every, common) of names in (title), and of words that ``frequent`` of ``texts`` (text) have;
    None below ``least`` titles: too few to know names by."""
    if titles.limit(least).count() < least:
        return None
    w = titles.select(key_words(tx.display_name(F.col("title"))).alias("w")).filter(F.size("w") > 0)
    ends = w.select(F.posexplode("w").alias("at", "word"), F.size("w").alias("n")).filter(F.length("word") > 1)
    each = ends.groupBy("word").agg(F.bool_or(F.col("at") == 0).alias("given"), F.bool_or((F.col("at") == F.col("n") - 1) & (F.col("n") > 1)).alias("l"))
    named = each.select("word", "given", (F.col("l") & ~F.col("given")).alias("last"), F.lit(True).alias("every"))
    if texts is None:
        return named.withColumn("common", F.lit(False))
    common = document_frequency(texts).filter(F.col("n") >= frequent).select("word", F.lit(True).alias("common"))
    no = F.lit(False)
    return named.join(common, "word", "full").select("word", *[F.coalesce(c, no).alias(c) for c in ("given", "last", "every", "common")])


def document_frequency(texts: DataFrame) -> DataFrame:
    """(word, n): how many of ``texts`` (text) have a word of two letters or more."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[א-ת][א-ת'\"-]+"), F.lit(0)))
    return texts.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def gender_of_title(title: Column, lead: Column) -> Column:
    """m, f or null of a page's person: by a title before the name, a kin word in parentheses, the first verb."""
    t = tx.normalize_quotes(title)
    first = F.split(t, r"\s+")[0]
    kin = F.split(tx.disambiguator(t), r"\s+")[0]
    verb = F.regexp_extract(lead, word([w for words in GENDERED.values() for w in words] + ["היה", "הייתה", "היתה", "הוא", "היא"]), 0)
    man = [*GENDERED["m"], "היה", "הוא"]
    return (
        F.when(first.isin(*FEMALE_TITLES), "f").when(first.isin(*HONORIFICS), "m").when(kin.isin(*FEMALE_KIN), "f").when(kin.isin(*MALE_KIN), "m")
        .when(verb.isin(*man), "m").when(verb != "", "f")
    )


def gender_votes(text: Column) -> Column:
    """struct(m, f): how many gendered verbs a text has."""
    n = lambda g: F.size(F.regexp_extract_all(text, F.lit(word(GENDERED[g])), F.lit(0)))
    return F.struct(n("m").alias("m"), n("f").alias("f"))


def honorific_gender(before: Column) -> Column:
    """Gender of a title that stands right before a name, at the end of ``before``; other titles say nothing."""
    last = F.regexp_extract(tx.normalize_quotes(before), rf"(?:^|[\s,;:(–-])((?:{any_of(HONORIFICS)}\s+)+)$", 1)
    words = F.split(F.trim(last), r"\s+")
    female = F.array(*[F.lit(t) for t in FEMALE_TITLES])
    return F.when(F.trim(last) == "", F.lit(None).cast("string")).when(F.arrays_overlap(words, female), "f").otherwise("m")


def gender_conflict(own: Column, votes: Column, word: Column) -> Column:
    """Whether a kin word's gender (of "his" or "her") contradicts the page's: its own, else two votes or more."""
    voted = F.when((votes["m"] >= 2) & (votes["m"] > votes["f"]), "m").when((votes["f"] >= 2) & (votes["f"] > votes["m"]), "f")
    return F.coalesce(F.coalesce(own, voted) != word, F.lit(False))


def looks_like_year(text: Column) -> Column:
    """Whether a name is in truth a year, a number, a day or a feast."""
    return F.trim(tx.normalize_quotes(text)).rlike(f"^(?:{YEAR.pattern})$")


def lines(pages: DataFrame, lexicon: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The lines of (title, wikitext) that may tell relations: title, notes, row, line, context; with ``lexicon`` also
    words (those of the line that it has), with ``known`` (title) also people (targets of the line's links in it)."""
    body = tx.strip_templates(tx.strip_comments(tx.normalize_quotes(F.col("wikitext"))))
    rows = pages.select("title", body.alias("body")).select("title", tx.refs(F.col("body")).alias("notes"), F.posexplode(F.split(tx.tokenize_refs(F.col("body")), "\n")).alias("row", "line"))
    # the heading, or a line before the list that ends in a colon, is what its lines are about
    lead = F.when(F.col("line").rlike(r"^==+.*==+\s*$"), F.trim(F.regexp_replace("line", "=", ""))).when(F.col("line").rlike(r"^[^*#].*:\s*$"), F.col("line"))
    rows = rows.withColumn("context", F.last(lead, ignorenulls=True).over(Window.partitionBy("title").orderBy("row")))  # lines of one page
    listed = F.col("line").rlike(r"^[*#]")
    rows = rows.filter(listed | F.col("line").rlike(TRIGGER)).select("title", "notes", "row", "line", F.coalesce("context", F.lit("")).alias("context"))
    if lexicon is None and known is None:
        return rows
    rows = written(rows, "lines")
    if lexicon is not None:
        bare = F.transform(F.split("line", r"\s+"), lambda w: F.regexp_replace(w, r"^[(),.;:'\[\]]+|[(),.;:'\[\]]+$", ""))
        each = rows.select("title", "row", F.explode(F.array_distinct(bare)).alias("word")).join(lexicon, "word")
        rows = rows.join(each.groupBy("title", "row").agg(F.collect_list(F.struct("word", "given", "last", "every", "common")).alias("words")), ["title", "row"], "left")
    if known is not None:
        target = F.transform(F.regexp_extract_all("line", F.lit(tx.LINK), F.lit(1)), lambda t: F.trim(F.regexp_replace(F.translate(t, "_", " "), r"\s+", " ")))
        each = rows.select("title", "row", F.explode(F.array_distinct(target)).alias("target")).join(known.select(F.col("title").alias("target")).distinct(), "target")
        rows = rows.join(each.groupBy("title", "row").agg(F.collect_set("target").alias("people")), ["title", "row"], "left")
    return rows


def from_text(pages: DataFrame, lexicon: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Relations from the sentences and list lines of (title, wikitext), titles distinct. With ``lexicon`` (``lexicon_of``)
    unlinked names are taken as well, as ``~name`` ends; with ``known`` (title), links to other pages without a title
    before them are doubtful: their relations are kept at ``doubtful_cap`` at most."""
    rows = lines(pages, lexicon, known)
    none = F.lit(None).cast("array<string>")
    named = rows.withColumn("words", F.lit(None).cast("array<struct<word:string,given:boolean,last:boolean,every:boolean,common:boolean>>")) if lexicon is None else rows
    part = lambda c: F.transform(F.filter("words", lambda w: w[c]), lambda w: w["word"]).alias(c)
    rows = named.select(
        "title", "notes", "row", "line", "context", part("given"), part("last"), part("every"), part("common"),
        (none if known is None else F.coalesce("people", F.array().cast("array<string>"))).alias("people"),
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = phrases()
        for batch in batches:
            out = []
            for title, notes, row, line, context, *names, people in batch.itertuples(index=False):
                words = Lexicon(*(frozenset(() if n is None else n) for n in names))
                for sentence, f in read_line(title, re.sub("\0R(\\d+)\0", "", line), context, table, words, None if people is None else frozenset(people)):
                    out.append(_row(title, int(row), sentence, [notes[i] for i in notes_of(line, sentence)], f))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInPandas(find, SCHEMA)


def register_page_reader(spark: SparkSession, name: str = "relations_of", lexicon: Lexicon = Lexicon()) -> None:
    """Make the SQL table function ``name(TABLE(...))`` of tables (title, wikitext): a row for each relation of a page. It
    gives what ``from_text`` gives, with a lexicon that is small enough to go to every task. Pages stay in their partitions."""

    @F.arrow_udtf(returnType=f"{SCHEMA}")
    class Reader:
        def __init__(self) -> None:
            self.table = phrases()

        def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
            rows = []
            for page, text in zip(pages.column("title").to_pylist(), pages.column("wikitext").to_pylist(), strict=True):
                if page is not None and text is not None:
                    rows += [_row(page, row, sentence, refs, f) for row, sentence, refs, f in read_page(page, text, self.table, lexicon)]
            yield pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW.types, strict=True)], schema=ARROW)

    spark.udtf.register(name, Reader)


def _row(page: str, row: int, sentence: str, refs: list[str], f: Found) -> tuple:
    """A row of SCHEMA, with the confidence within its bounds."""
    sure = round(max(T.relation_floor, min(f.confidence, T.doubtful_cap if f.doubtful else T.relation_cap)), 2)
    method = "list" if f.pattern.startswith("list:") else "pattern"
    return f.person, f.relative, f.relation, page, sentence, refs, method, f.pattern, sure, f.side, False, row, f.doubtful, f.start, f.end


def from_infobox(pages: DataFrame, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """Relations from template parameters of (title, wikitext); ``roles`` names the fields of father, mother, parents,
    spouse, children, siblings."""
    spark = pages.sparkSession
    kinds = {"father": ("parent", True), "mother": ("parent", True), "parents": ("parent", True), "spouse": ("spouse", True), "children": ("parent", False), "siblings": ("sibling", True)}
    table = [(name, *kinds[role]) for role, names in roles.items() if role in kinds for name in names]
    known = F.broadcast(spark.createDataFrame(table, "field string, relation string, forward boolean"))  # a dozen of fields
    t = pages.select("title", F.explode(tx.templates(tx.strip_comments(tx.normalize_quotes(F.col("wikitext"))))).alias("t"))
    fields = t.select("title", F.explode("t.params").alias("field", "value")).join(known, "field")
    items = fields.select("*", F.posexplode(F.split(tx.without_refs(F.col("value")), r"<br\s*/?>|\n\*|[;,](?![^\[]*\]\])")).alias("order", "item"))
    link = F.regexp_extract("item", tx.LINK, 1)
    bare = F.trim(F.regexp_replace("item", r"<[^>]+>|'{2,}", ""))
    who = F.when(link != "", tx.normalize_title(link)).when((bare != "") & (F.length(bare) <= 40), F.concat(F.lit("~"), bare))
    rows = items.withColumn("who", who).filter("who IS NOT NULL AND who <> title").filter(~looks_like_year(F.regexp_replace("who", "^~", "")))
    a, b = F.when(F.col("forward"), F.col("title")).otherwise(F.col("who")), F.when(F.col("forward"), F.col("who")).otherwise(F.col("title"))
    sure = F.when(F.col("who").startswith("~"), UNLINKED).otherwise(LINKED)
    return rows.select(
        a.alias("person"), b.alias("relative"), "relation", F.col("title").alias("source_page"),
        F.concat_ws(" = ", "field", F.trim("item")).alias("evidence"), tx.refs(F.col("value")).alias("refs"), F.lit("infobox").alias("method"),
        F.col("field").alias("pattern"), sure.alias("confidence"), F.lit(None).cast("string").alias("side"), F.lit(False).alias("alias"), "order",
        F.lit(False).alias("doubtful"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )


BORN_IN, DIED_IN = "אישים שנולדו בשנת", "אישים שנפטרו בשנת"  # fixed values: categories of years


def page_years(pages: DataFrame, born: tuple[str, ...], died: tuple[str, ...]) -> DataFrame:
    """(title, born, died): years as written, from the first of the named template fields, else from the page's
    categories, else from the first sentence that has the verb."""
    t = pages.select("title", F.explode(tx.templates(tx.strip_comments(tx.normalize_quotes(F.col("wikitext"))))).alias("t"))
    fields = t.select("title", F.explode("t.params").alias("field", "value")).filter(F.col("field").isin(*born, *died)).withColumn("year", tx.year_in(F.col("value"))).filter("year IS NOT NULL")
    boxed = fields.groupBy("title").agg(
        F.min(F.when(F.col("field").isin(*born), F.col("year"))).alias("b"), F.min(F.when(F.col("field").isin(*died), F.col("year"))).alias("d"))
    text = tx.normalize_quotes(F.col("wikitext"))
    said = lambda words: tx.year_in(F.regexp_extract(text, rf"{word(words)}[^.\n]*", 0))
    filed = lambda lead: F.nullif(F.trim(F.regexp_extract(text, rf"\[\[[^\]|]*:\s*{lead}\s+([^\]|]+)", 1)), F.lit(""))
    spoken = pages.select("title", filed(BORN_IN).alias("cb"), filed(DIED_IN).alias("cd"), said(("נולד", "נולדה")).alias("sb"), said(("נפטר", "נפטרה")).alias("sd"))
    return spoken.join(boxed, "title", "left").select("title", F.coalesce("b", "cb", "sb").alias("born"), F.coalesce("d", "cd", "sd").alias("died"))


def with_aliases(relations: DataFrame, index: DataFrame) -> DataFrame:
    """Relations whose unlinked ends are the pages they stand for (``identity.unique_alias_index``), where there is one:
    names count in running text alone, nicks everywhere. They are no surer than ``alias_cap``."""
    out = relations.withColumn("in_prose", (F.col("method") == "pattern") & ~F.col("evidence").rlike(r"^[*#]"))
    for end in ("person", "relative"):
        bare = F.col(end).startswith("~")
        named = out.withColumn("name", F.when(bare, F.substring(end, F.lit(2), F.length(end)))).withColumnRenamed("alias", "__alias")
        hit = resolve_aliases(named, index)
        sure = F.when(F.col("alias"), F.least(F.col("confidence") + NO_ARTICLE, F.lit(T.alias_cap))).otherwise(F.col("confidence"))
        out = hit.withColumns({end: F.coalesce("title", end), "confidence": F.round(sure, 2), "__alias": F.col("__alias") | F.col("alias")})
        out = out.drop("alias", "title", "name").withColumnRenamed("__alias", "alias")
    return out.filter("person <> relative").select(*relations.columns)


def extract(pages: DataFrame, roles: dict[str, tuple[str, ...]], lexicon: DataFrame | None = None, known: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """All relations of (title, wikitext); a page that is there twice counts once."""
    once = pages.select("title", "wikitext").dropDuplicates(["title"])
    found = from_infobox(once, roles).unionByName(from_text(once, lexicon, known))
    return found if index is None else with_aliases(found, index)
