"""REST sources: query builders, parsers of payloads, and a data source that fetches URLs in parallel.

Nothing here carries a key or contacts a server on import; addresses and keys are options.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Query:
    """Search terms and constraints; queries add up with ``+``."""

    terms: tuple[str, ...] = ()
    constraints: tuple[str, ...] = ()

    def __add__(self, other: Query) -> Query:
        return Query(self.terms + other.terms, self.constraints + other.constraints)

    def url(self, base: str) -> str:
        """``base/search/?searchTerm=...&...``; repeats count once, the default constraints come last."""
        words = [urllib.parse.quote_plus(t) for t in sorted(set(self.terms))]
        parts = ["searchTerm=" + "+".join(words)] if words else []
        return f"{base.rstrip('/')}/search/?" + "&".join([*parts, *sorted(set(self.constraints)), *DEFAULTS])


#: Constraints of every search.
DEFAULTS = ("frame=object", "limit=all")


def terms(*words: str) -> Query:
    """Free search terms."""
    return Query(terms=words)


# Names of the fields that the service searches.
CELL, ORGANISM, ASSAY, EXPERIMENTS = "biosample_term_name", "replicates.library.biosample.donor.organism.scientific_name", "assay_term_name", "type=experiment"


def _is(field_: str, *more: str):
    return lambda v: Query(constraints=(*more, f"{field_}={urllib.parse.quote_plus(v)}"))


cell_is, organism_is, assay_is = _is(CELL), _is(ORGANISM), _is(ASSAY, EXPERIMENTS)


def chunked(ids: list[str], size: int = 1000) -> list[list[str]]:
    """Id lists of at most ``size`` for services that take ids in a body."""
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def lookup_bodies(ids: list[str]) -> list[str]:
    """JSON bodies ``{"ids": [...]}`` of at most 1000 ids."""
    return [json.dumps({"ids": c}) for c in chunked(ids)]


def merge_lookups(payloads: list[dict]) -> dict:
    """Union of id-to-record objects; of ids given twice the first counts."""
    out: dict = {}
    for p in payloads:
        for k, v in p.items():
            out.setdefault(k, v)
    return out


def parse_id_table(text: str) -> dict[str, str]:
    """Two-column mapping with a header line."""
    rows = (line.split("\t") for line in text.splitlines()[1:] if "\t" in line)
    out: dict[str, str] = {}
    for a, b, *_ in rows:
        out.setdefault(a, b)
    return out


def aligned(ids: list[str], mapping: dict[str, str]) -> list[str | None]:
    """Mapped ids in the order of the input, None where unknown."""
    return [mapping.get(i) for i in ids]


def top_pathways(text: str) -> list[dict]:
    """Pathway objects with their six fields; missing ones are None."""
    keys = ("dbId", "stId", "displayName", "hasDiagram", "speciesName", "releaseDate")
    return [{k: x.get(k) for k in keys} for x in json.loads(text)]


class _Request(InputPartition):
    def __init__(self, url: str, body: str | None, headers: dict):
        super().__init__(url)
        self.url, self.body, self.headers = url, body, headers


class RestSource(DataSource):
    """``url, payload`` (text). Options: ``urls`` (JSON list), ``bodies`` (JSON list for POST, optional), ``headers`` (JSON object), ``timeout``."""

    @classmethod
    def name(cls):
        return "rest"

    def schema(self):
        return "url string, payload string"

    def reader(self, schema):
        return _RestReader(self.options)


class _RestReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])
        self.bodies = json.loads(options.get("bodies", "null")) or [None] * len(self.urls)
        self.headers = json.loads(options.get("headers", '{"Accept": "application/json"}'))
        self.timeout = float(options.get("timeout", "60"))

    def partitions(self):
        return [_Request(u, b, self.headers) for u, b in zip(self.urls, self.bodies, strict=True)]

    def read(self, partition):
        req = urllib.request.Request(partition.url, data=partition.body.encode() if partition.body else None, headers=partition.headers)
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            yield partition.url, r.read().decode("utf-8", "replace")


def fetch(spark: SparkSession, urls: list[str], bodies: list[str] | None = None, headers: dict | None = None) -> DataFrame:
    """``url, payload, value``: texts of URLs, one task each, and the payload as VARIANT (NULL if it is no JSON)."""
    spark.dataSource.register(RestSource)
    o = {"urls": json.dumps(urls)} | ({"bodies": json.dumps(bodies)} if bodies else {}) | ({"headers": json.dumps(headers)} if headers else {})
    return spark.read.format("rest").options(**o).load().withColumn("value", F.try_parse_json("payload"))


def download(url: str, path: str, *, timeout: float = 300) -> None:
    """Stream a URL to a file (a driver utility)."""
    with urllib.request.urlopen(url, timeout=timeout) as r, open(path, "wb") as f:
        while data := r.read(1 << 20):
            f.write(data)


def open_experiment_url(base: str, key: str, id_: str) -> str:
    """Address of one record."""
    return f"{base.rstrip('/')}/{urllib.parse.quote(id_.strip('/'))}/?{urllib.parse.urlencode({'format': 'json', **({'accesskey': key} if key else {})})}"
