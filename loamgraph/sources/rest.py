"""REST sources as Python data sources, with an injected client, and their parsers as DataFrame expressions.

A client is any object with ``get(path, params) -> parsed JSON``: ``UrlClient`` asks a service, ``FolderClient`` answers from recorded files. A data source makes
its client on the executors from its options: ``recorded`` (a folder), ``base_url`` (and ``token``), or ``client`` (``module:function``, called with the options).
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loamgraph.functions.text import optional_number

PAGE = 100
#: Rows of one answer of the indicator service.
INDICATOR_PAGE = 20_000


class SourceError(RuntimeError):
    """The service answered with an error."""


class FolderClient:
    """Recorded answers: ``{root}/{path with slashes as __}[__page=n].json``."""

    def __init__(self, root: str):
        self.root = root

    def get(self, path: str, params: dict | None = None) -> object:
        name = path.strip("/").replace("/", "__")
        page = (params or {}).get("page", 1)
        file = f"{self.root}/{name}" + (f"__page={page}" if page != 1 else "") + ".json"
        if not os.path.exists(file):
            if page != 1:
                return []
            raise SourceError(f"no recorded answer: {file}")
        with open(file, encoding="utf-8") as f:
            return json.load(f)


class UrlClient:
    """JSON by HTTP. ``opener`` takes a request and a timeout, as ``urllib.request.urlopen`` does. Answers 429 and 5xx are asked for again after a pause that doubles
    or that the service names; others fail with what the service says."""

    def __init__(self, base_url: str, token: str | None = None, opener: Callable | None = None, tries: int = 5, pause: float = 1.0, timeout: float = 60.0):
        self.base, self.token, self.tries, self.pause, self.timeout = base_url.rstrip("/"), token, tries, pause, timeout
        self.opener = opener or urllib.request.urlopen

    def get(self, path: str, params: dict | None = None) -> object:
        url = f"{self.base}/{path.lstrip('/')}"
        if params:
            url += "?" + urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for k in range(self.tries):
            try:
                with self.opener(urllib.request.Request(url, headers=headers), timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or k + 1 == self.tries:
                    raise SourceError(f"{e.code}: {e.read().decode(errors='replace')[:500]}") from e
                named = (e.headers or {}).get("Retry-After", "")
                time.sleep(float(named) if named.isdigit() else self.pause * 2**k)
            except urllib.error.URLError as e:
                if k + 1 == self.tries:
                    raise SourceError(str(e.reason)) from e
                time.sleep(self.pause * 2**k)
        raise SourceError("no tries")


def client_of(options: dict) -> object:
    """The client that a source's options ask for."""
    if options.get("client"):
        module, _, name = options["client"].partition(":")
        return getattr(import_module(module), name)(dict(options))
    if options.get("recorded"):
        return FolderClient(options["recorded"])
    if options.get("base_url"):
        return UrlClient(options["base_url"], options.get("token"))
    raise SourceError("options name no client: recorded, base_url or client")


def pages(client, path: str, params: dict | None = None, most: int | None = None) -> Iterator[dict]:
    """All rows of a paged list, ``PAGE`` a page."""
    number, given = 1, 0
    while True:
        got = client.get(path, {**(params or {}), "per_page": PAGE, "page": number})
        for row in got:
            yield row
            given += 1
            if most is not None and given >= most:
                return
        if len(got) < PAGE:
            return
        number += 1


def resolve_revision(client, full_name: str, default_branch: str | None, wanted: str | None) -> dict:
    """Branch, then tag, then commit; nothing wanted: the default branch, else ``main``. sha, reference, is_head."""
    name = wanted or default_branch or "main"
    for kind in ("branches", "tags"):
        for row in pages(client, f"repos/{full_name}/{kind}"):
            if row["name"] == name:
                return {"sha": row["commit"]["sha"], "reference": name, "is_head": kind == "branches" and name == default_branch}
    return {"sha": client.get(f"repos/{full_name}/commits/{name}")["sha"], "reference": name, "is_head": False}


def issues_only(rows: Iterator[dict]) -> Iterator[dict]:
    """The list of issues has pull requests in it."""
    return (r for r in rows if "pull_request" not in r)


ENDPOINTS = {
    "issues": "repos/{repo}/issues", "pulls": "repos/{repo}/pulls", "comments": "repos/{repo}/issues/comments",
    "review_comments": "repos/{repo}/pulls/comments", "readme": "repos/{repo}/readme", "repository": "repos/{repo}",
}


class RepositorySource(DataSource):
    """``spark.read.format("repository").option("recorded", folder).option("repos", "a/b,c/d").option("endpoint", "issues")``: one partition per repository,
    rows (repo, payload as JSON text) for ``from_json``."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "repo string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RepositoryReader(self.options)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = [r.strip() for r in options["repos"].split(",") if r.strip()]
        self.endpoint, self.options = options.get("endpoint", "issues"), dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.repos]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        client, repo = client_of(self.options), partition.value
        path = ENDPOINTS[self.endpoint].format(repo=repo)
        if self.endpoint in ("repository", "readme"):
            yield repo, json.dumps(client.get(path))
            return
        rows = pages(client, path, {"state": "all", "sort": "updated", "direction": "desc"})
        for row in issues_only(rows) if self.endpoint == "issues" else rows:
            yield repo, json.dumps(row)


def search_query(text: str, language: str | None = None, min_stars: int | None = None, limit: int = 30) -> dict:
    """Parameters of a repository search: one page of 100 rows at most."""
    parts = [text, *([f"language:{language}"] if language else []), *([f"stars:>={min_stars}"] if min_stars is not None else [])]
    return {"q": " ".join(p for p in parts if p), "per_page": min(limit, PAGE)}


def search_repositories(spark: SparkSession, client, text: str, language: str | None = None, min_stars: int | None = None, limit: int = 30) -> DataFrame:
    """The panel of one search."""
    found = client.get("search/repositories", search_query(text, language, min_stars, limit)).get("items", [])
    return search_panel(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(found)], "place int, payload string").orderBy("place"), limit)


SEARCH_PANEL = "silver/panel/repository_search"


def search_panel(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The search panel's six columns, from JSON payloads."""
    r = F.from_json("payload", "full_name string, html_url string, description string, language string, stargazers_count bigint, updated_at timestamp")
    out = rows.select(r.alias("r")).select(
        "r.full_name", "r.html_url", "r.description", "r.language", F.coalesce("r.stargazers_count", F.lit(0)).alias("stargazers"), "r.updated_at",
    ).filter("full_name is not null and html_url is not null")
    return out if limit is None else out.limit(limit)


# -- indicators ----------------------------------------------------------------------------------------


def unwrap(answer: object) -> object:
    """[metadata, rows] -> rows; an error message in the metadata fails."""
    if isinstance(answer, list) and answer:
        first = answer[0]
        if isinstance(first, dict) and first.get("message"):
            messages = first["message"]
            value = messages[0].get("value") if isinstance(messages, list) and messages and isinstance(messages[0], dict) else None
            raise SourceError(value or "unknown error")
        return answer[1] if len(answer) >= 2 else first
    return answer


COUNTRY = "id string, iso2Code string, name string, region struct<id:string,iso2code:string,value:string>, incomeLevel struct<id:string,iso2code:string,value:string>, lendingType struct<id:string,iso2code:string,value:string>, capitalCity string, longitude string, latitude string"
INDICATOR = "id string, name string, source struct<id:string,value:string>, sourceNote string, sourceOrganization string, topics array<struct<id:string,value:string>>, unit string"
LISTS = {
    "country": COUNTRY, "indicator": INDICATOR, "topic": "id string, value string, sourceNote string", "source": "id string, name string, description string",
    "region": "id string, code string, iso2code string, name string",
}


def listed(spark: SparkSession, client, kind: str, one: str | None = None) -> DataFrame:
    """Countries, indicators, topics, sources, regions; ``one``: a single entry."""
    rows = unwrap(client.get(f"{kind}/{one}" if one else kind, {"format": "json", "per_page": INDICATOR_PAGE}))
    if one and not rows:
        raise SourceError("no data")
    out = spark.createDataFrame([(json.dumps(r),) for r in rows], "payload string").select(F.from_json("payload", LISTS[kind]).alias("r")).select("r.*")
    if kind == "country":
        from loamgraph.functions.text import optional_number

        out = out.withColumns({c: optional_number(F.col(c)) for c in ("longitude", "latitude")})
    return out


def contains_any(pattern: str, *columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(pattern.lower()), F.lit(False))
    return out


def search_countries(countries: DataFrame, pattern: str) -> DataFrame:
    return countries.filter(contains_any(pattern, F.col("name"), F.col("id"), F.col("iso2Code")))


def search_indicators(indicators: DataFrame, pattern: str) -> DataFrame:
    return indicators.filter(contains_any(pattern, F.col("name"), F.col("id"), F.col("sourceNote")))


def series_request(
    indicator: str, country: str = "all", date: str | None = None, mrv: int | None = None, gapfill: str | None = None, language: str = "en",
) -> tuple[str, dict]:
    """(path, parameters) of a data series."""
    path = f"country/{country}/indicator/{indicator}"
    params = {"format": "jsonstat", "date": date, "mrv": None if mrv is None else str(mrv), "gapfill": gapfill}
    return path if language == "en" else f"{language}/{path}", {k: v for k, v in params.items() if v is not None}


def series_cells(cubes: DataFrame) -> DataFrame:
    """A JSON-stat cube (value array, size array) as cells: position, coordinates (one index per dimension, first slowest), value."""
    sizes = F.col("size")
    stride = lambda i: F.aggregate(F.slice(sizes, i + 2, F.greatest(F.size(sizes) - i - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    cells = cubes.select("*", F.posexplode("value").alias("position", "cell"))
    at = F.transform(sizes, lambda n, i: F.pmod(F.floor(F.col("position") / stride(i)), n).cast("int"))
    return cells.withColumn("coordinates", at).drop("value").withColumnRenamed("cell", "value")


def dimension_codes(dimension: dict, ids: list[str]) -> list[list[str]]:
    """Codes of each dimension in order."""
    out = []
    for d in ids:
        index = dimension[d]["category"]["index"]
        out.append(list(index) if isinstance(index, list) else [k for k, _ in sorted(index.items(), key=lambda x: x[1])])
    return out


def series(spark: SparkSession, answer: dict) -> DataFrame:
    """One data series as a table: a column for each dimension with its codes, then value and status. ``answer`` is one JSON-stat cube; its cells are laid out by
    the executors."""
    dimension = answer["dimension"]
    ids, size = answer.get("id") or dimension["id"], answer.get("size") or dimension["size"]
    status = answer.get("status") or []
    cube = [(answer["value"], [int(n) for n in size], dimension_codes(dimension, ids), [str(s) for s in status])]
    cells = series_cells(spark.createDataFrame(cube, "value array<double>, size array<int>, codes array<array<string>>, status array<string>"))
    columns = [F.get(F.get("codes", F.lit(k)), F.get("coordinates", F.lit(k))).alias(d) for k, d in enumerate(ids)]
    return cells.select(*columns, "value", F.get("status", F.col("position")).alias("status"))


# -- recorded batches ----------------------------------------------------------------------------------


def read_capture(spark: SparkSession, folder: str, cast: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Datasets of a capture by name: ``metadata.json`` lists Arrow files, JSON ones stand in where an Arrow file is missing."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    with open(f"{folder}/metadata.json", encoding="utf-8") as f:
        meta = json.load(f)
    out = {}
    for d in meta["datasets"]:
        file = f"{folder}/{d['file']}"
        if os.path.exists(file):
            with pa.memory_map(file) as source:
                df = spark.createDataFrame(ipc.open_file(source).read_all())
        else:
            df = spark.read.json(re.sub(r"\.arrow$", ".json", file), multiLine=True)
        out[d["name"]] = cast(df, d["name"]) if cast else df
    return out


def write_capture(batches: list[tuple[str, str, DataFrame]], folder: str, also_json: bool = True) -> dict:
    """(category, name, rows) to Arrow files (and JSON) with ``metadata.json``; batches of one category and name must share a schema."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    os.makedirs(folder, exist_ok=True)
    groups: dict[tuple[str, str], list[pa.Table]] = {}
    for category, name, df in batches:
        groups.setdefault((category, name), []).append(df.toArrow())
    listed_files = []
    for (category, name), tables in groups.items():
        if any(not t.schema.equals(tables[0].schema) for t in tables):
            raise ValueError(f"batches of {name} differ in schema")
        whole = pa.concat_tables(tables)
        with pa.OSFile(f"{folder}/{name}.arrow", "wb") as sink, ipc.new_file(sink, whole.schema) as writer:
            writer.write_table(whole)
        if also_json:
            with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
                json.dump(whole.to_pylist(), f, default=str)
        listed_files.append({"name": name, "category": category, "file": f"{name}.arrow", "rows": whole.num_rows})
    meta = {"datasets": listed_files}
    with open(f"{folder}/metadata.json", "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=1)
    return meta
