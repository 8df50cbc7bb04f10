"""Wiki pages as a Spark data source, with the retry rules of a polite client.

The client is any callable (params) -> (status, headers, body), so that tests and mirrors need no network. One partition
reads one listing, because the rate limit is for the whole site.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from kinloom.functions.text import nested_templates

Call = Callable[[dict], tuple[int, dict, dict]]
PAGE_SCHEMA = (
    "title string, pageid bigint, wikitext string, categories array<string>, revid bigint, fetched_at timestamp, "
    "requested_title string, redirect_to string"
)


class ApiError(RuntimeError):
    """The site refused, or kept failing."""


def retry_after(header: str | None, fallback: float, now: datetime | None = None) -> float:
    """Seconds to wait, from a number or a date, at most 600; a date gives one second at least."""
    if not header:
        return fallback
    if header.strip().isdigit():
        return min(600.0, float(header))
    try:
        at = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return fallback
    return min(600.0, max(1.0, (at - (now or datetime.now(timezone.utc))).total_seconds()))


@dataclass
class Client:
    """Spaced calls with retries. After a 429 or 503 the spacing grows for the rest of the run, to 30 s at most. With
    ``maxlag`` the site may put a call off while its copies lag behind by more seconds."""

    call: Call
    spacing: float = 1.0
    retries: int = 6
    maxlag: int = 5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: float = field(default=float("-inf"))

    def request(self, params: dict) -> dict:
        wait = 5.0
        for _ in range(self.retries + 1):
            pause = self._last + self.spacing - self.clock()
            if pause > 0:
                self.sleep(pause)
            self._last = self.clock()
            try:
                status, headers, body = self.call({**params, "format": "json", "formatversion": 2, "maxlag": self.maxlag})
            except (OSError, ValueError):  # no answer, or one that cannot be read
                status, headers, body = 599, {}, {}
            body = body if isinstance(body, dict) else {}
            code = (body.get("error") or {}).get("code")
            if status in (429, 503):
                self.spacing = min(30.0, self.spacing * 1.5 + 0.5)
            if status in (429, 503) or status >= 500 or code in ("maxlag", "ratelimited"):
                self.sleep(retry_after(headers.get("Retry-After"), wait))
                wait = min(300.0, wait * 2)
            elif code or status >= 400:
                raise ApiError(code or f"status {status}")
            else:
                return body
        raise ApiError("no answer after all retries")

    def pages(self, params: dict) -> Iterator[dict]:
        """Answers until there is no continuation."""
        more: dict = {}
        while True:
            body = self.request({**params, **more})
            yield body.get("query", {})
            more = body.get("continue") or {}
            if not more:
                return


# Names of the site's pages that hold categories and templates.
CATEGORY_SPACE, TEMPLATE_SPACE = "קטגוריה:", "תבנית:"
LISTED = "title string, ns int, pageid bigint"


def category_members(client: Client, category: str, kinds: str = "page|subcat", ns: str | None = None) -> Iterator[tuple]:
    """Rows of LISTED: pages and categories in a category."""
    title = category if category.startswith(CATEGORY_SPACE) else CATEGORY_SPACE + category
    params = {"action": "query", "list": "categorymembers", "cmtitle": title, "cmtype": kinds, "cmlimit": "max"}
    return _listing(client, params | ({"cmnamespace": ns} if ns is not None else {}), "categorymembers")


def recent_changes(client: Client, since: str, ns: str = "0") -> Iterator[tuple]:
    """Rows of LISTED: pages edited or made since a time, oldest first, each once."""
    params = {"action": "query", "list": "recentchanges", "rcstart": since, "rcdir": "newer", "rcnamespace": ns, "rctype": "edit|new", "rcprop": "title|ids", "rclimit": "max"}
    seen: set[str] = set()
    for row in _listing(client, params, "recentchanges"):
        if row[0] and row[0] not in seen:
            seen.add(row[0])
            yield row


def embedded_in(client: Client, template: str, ns: str = "0|10|2") -> Iterator[tuple]:
    """Rows of LISTED: pages that use a template."""
    title = template if ":" in template else TEMPLATE_SPACE + template
    return _listing(client, {"action": "query", "list": "embeddedin", "eititle": title, "eilimit": "max", "einamespace": ns}, "embeddedin")


def prefix_search(client: Client, prefix: str, ns: str = "0") -> Iterator[tuple]:
    """Rows of LISTED: pages whose title begins with a text."""
    return _listing(client, {"action": "query", "list": "prefixsearch", "pssearch": prefix, "pslimit": "max", "psnamespace": ns}, "prefixsearch")


def search(client: Client, text: str, ns: str = "0|10|2") -> Iterator[tuple]:
    """Rows of LISTED: pages that have a text."""
    return _listing(client, {"action": "query", "list": "search", "srsearch": text, "srlimit": "max", "srnamespace": ns}, "search")


def _listing(client: Client, params: dict, key: str) -> Iterator[tuple]:
    for part in client.pages(params):
        for item in part.get(key) or []:
            yield item.get("title"), item.get("ns"), item.get("pageid")


def site_info(client: Client) -> dict:
    """general, statistics and namespaces of the site."""
    return client.request({"action": "query", "meta": "siteinfo", "siprop": "general|statistics|namespaces"}).get("query", {})


#: What ``spark.read.format("wiki_list")`` can list, by option ``list``; option ``of`` is its argument.
LISTINGS = {"category": category_members, "changes": recent_changes, "embedded": embedded_in, "prefix": prefix_search, "search": search}


class WikiPages(DataSource):
    """``spark.read.format("wiki_pages")`` with options ``client`` ("module:function") and ``titles`` (separated by |)."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class WikiList(DataSource):
    """``spark.read.format("wiki_list")`` with options ``client``, ``list`` (see LISTINGS), ``of`` and ``ns``."""

    @classmethod
    def name(cls) -> str:
        return "wiki_list"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema):
        return _ListReader(self.options)


CHANGED = "change bigint, at timestamp, title string, ns int, pageid bigint"
#: How long after its time a change may turn up in the site's listing.
OVERLAP = timedelta(hours=2)
_STAMP = "%Y-%m-%dT%H:%M:%SZ"


def changes_since(client: Client, since: str, ns: str = "0") -> Iterator[tuple]:
    """Rows of CHANGED with the time as written: edits and new pages since a time, oldest first."""
    params = {"action": "query", "list": "recentchanges", "rcstart": since, "rcdir": "newer", "rcnamespace": ns, "rctype": "edit|new", "rcprop": "title|ids|timestamp", "rclimit": "max"}
    for part in client.pages(params):
        for item in part.get("recentchanges") or []:
            if item.get("title"):
                yield item["rcid"], item["timestamp"], item["title"], item.get("ns"), item.get("pageid")


class WikiChanges(DataSource):
    """``spark.readStream.format("wiki_changes")`` with options ``client``, ``since`` (a time as the site writes it) and ``ns``.

    An offset is the time of the latest change and the numbers and times of those of the OVERLAP before it. A batch asks from that
    much before the last offset on and leaves those out: what turns up late is there once, and nothing twice.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki_changes"

    def schema(self) -> str:
        return CHANGED

    def simpleStreamReader(self, schema):
        return _ChangeReader(self.options)


class _ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"at": self.options["since"], "seen": []}

    def _since(self, start: dict) -> list[tuple]:
        begin = (datetime.strptime(start["at"], _STAMP) - OVERLAP).strftime(_STAMP)
        first = self.options["since"]  # what was before the stream began is no part of it
        seen, once = {n for n, _ in start["seen"]}, {}
        for row in changes_since(client_of(self.options["client"], float(self.options.get("spacing", 1.0))), max(begin, first), self.options.get("ns", "0")):
            if row[0] not in seen and row[1] >= first:
                once[row[0]] = row
        return list(once.values())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._since(start)
        at = max([start["at"], *(r[1] for r in rows)])
        border = (datetime.strptime(at, _STAMP) - OVERLAP).strftime(_STAMP)
        both = [*start["seen"], *([r[0], r[1]] for r in rows)]
        return iter(_typed(rows)), {"at": at, "seen": sorted(x for x in both if x[1] >= border)}  # as many as two hours have

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        border, held = (datetime.strptime(end["at"], _STAMP) - OVERLAP).strftime(_STAMP), {n for n, _ in end["seen"]}
        return iter(_typed([r for r in self._since(start) if r[0] in held or r[1] < border]))


def _typed(rows: list[tuple]) -> list[tuple]:
    return [(r[0], datetime.strptime(r[1], _STAMP), *r[2:]) for r in rows]


class _OneReader(DataSourceReader):
    """The rate limit is for the whole site, so one partition reads."""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]

    def client(self) -> Client:
        return client_of(self.options["client"], float(self.options.get("spacing", 1.0)))


class _ListReader(_OneReader):
    def read(self, partition):
        more = {"ns": self.options["ns"]} if "ns" in self.options else {}
        yield from LISTINGS[self.options["list"]](self.client(), self.options["of"], **more)


class _Reader(_OneReader):
    def read(self, partition):
        client = self.client()
        titles = [t for t in self.options.get("titles", "").split("|") if t]
        step = int(self.options.get("batch", 50))
        for k in range(0, len(titles), step):
            yield from fetch_batch(client, titles[k : k + step])


def fetch_batch(client: Client, titles: list[str]) -> Iterator[tuple]:
    """Rows of PAGE_SCHEMA for those of ``titles`` that exist, under the title that was asked for."""
    moved: dict[str, str] = {}
    found: dict[str, dict] = {}
    params = {"action": "query", "prop": "revisions|categories", "rvprop": "content|ids|timestamp", "rvslots": "main", "cllimit": "max"}
    for part in client.pages({**params, "titles": "|".join(titles), "redirects": 1}):
        moved |= {m["from"]: m["to"] for key in ("normalized", "redirects") for m in part.get(key) or []}
        for p in part.get("pages") or []:
            if p.get("missing") or p.get("invalid"):
                continue
            own = found.setdefault(p["title"], {"pageid": p.get("pageid"), "text": None, "categories": [], "revid": None})
            own["categories"] += [c["title"].split(":", 1)[-1] for c in p.get("categories") or []]
            if own["text"] is None and p.get("revisions"):
                last = p["revisions"][0]
                own["text"], own["revid"] = last.get("slots", {}).get("main", last).get("content"), last.get("revid")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    for asked in titles:
        final, seen = asked, set()
        while final in moved and final not in seen:
            seen.add(final)
            final = moved[final]
        if p := found.get(final):
            yield final, p["pageid"], p["text"], p["categories"], p["revid"], now, asked, final if final != asked else None


LOOKED_UP = f"{PAGE_SCHEMA}, status string, error string"


def client_of(name: str, spacing: float) -> Client:
    """The client that ``module:function`` calls the site with."""
    module, _, function = name.partition(":")
    return Client(getattr(importlib.import_module(module), function), spacing=spacing)


def lookup(titles: DataFrame, client: str, spacing: float = 1.0, parallel: int = 1, batch: int = 50) -> DataFrame:
    """LOOKED_UP for each of (title): status ok, missing or failed. Titles never leave the executors: ``parallel`` tasks ask
    for their share, each at so many times the spacing, so that the site sees one rate. A batch that the site keeps
    refusing fails alone."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site = client_of(client, spacing * parallel)
        names = [c.split()[0] for c in LOOKED_UP.split(", ")]
        for part in batches:
            rows = []
            for k in range(0, len(part), batch):
                asked = part["title"].iloc[k : k + batch].tolist()
                try:
                    found = {row[6]: (*row, "ok", None) for row in fetch_batch(site, asked)}
                    rows += [found.get(t, (None,) * 6 + (t, None, "missing", None)) for t in asked]
                except ApiError as e:
                    rows += [(None,) * 6 + (t, None, "failed", str(e)) for t in asked]
            yield pd.DataFrame(rows, columns=names).astype({"pageid": "Int64", "revid": "Int64", "fetched_at": "datetime64[us]"})

    return titles.select("title").repartition(parallel).mapInPandas(ask, LOOKED_UP)


def titles_file(spark: SparkSession, path: str) -> DataFrame:
    """(title): lines of a file, stripped; blank ones go."""
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> ''")


def pages_with_template(pages: DataFrame, template: str) -> DataFrame:
    """Pages of PAGE_SCHEMA that use a template, at any depth."""
    return pages.filter(F.array_contains(F.transform(nested_templates(F.col("wikitext")), lambda t: t["name"]), template))


def pages_with_prefix(pages: DataFrame, prefix: str) -> DataFrame:
    return pages.filter(F.col("title").startswith(prefix))


def pages_with_text(pages: DataFrame, text: str) -> DataFrame:
    return pages.filter(F.col("wikitext").contains(text))
