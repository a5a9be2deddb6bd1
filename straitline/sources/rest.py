"""Paged REST sources as Python data sources: price series and map layers.

A reader takes its pages from ``fetch(url, params) -> dict``. In production that is an HTTP client; tests pass a local
one. The years of a price series are partitions; a map layer is paged in order, since it says only then whether more follow.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import logging
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from straitline.config import require_setting

log = logging.getLogger("straitline")

PRICE_PAGE, LAYER_PAGE, MAX_RECORDS = 5000, 1000, 500_000
ATTEMPTS, BASE_DELAY_S = 4, 3.0


class ServerError(RuntimeError):
    """A failure worth another try."""


def http_get(url: str, params: dict) -> dict:
    return json.loads(http_text(url, params))


def http_text(url: str, params: dict) -> str:
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params, doseq=True)}", timeout=120) as r:
            return r.read().decode()
    except urllib.error.HTTPError as e:
        if e.code >= 500:
            raise ServerError(str(e)) from e
        raise
    except urllib.error.URLError as e:
        raise ServerError(str(e)) from e


def with_retry(fetch: Callable[[str, dict], dict], url: str, params: dict, attempts: int = ATTEMPTS, delay: float = BASE_DELAY_S, sleep=time.sleep) -> dict:
    """Server and transport errors are tried again with doubled waits; anything else, and a payload's error, raises."""
    for k in range(attempts):
        try:
            page = fetch(url, params)
            break
        except ServerError:
            if k == attempts - 1:
                raise
            sleep(delay * 2**k)
    if "error" in page:
        raise RuntimeError(f"{url}: {page['error']}")
    return page


def layer_pages(fetch, url: str, where: str = "1=1", fields: str = "*", page_size: int = LAYER_PAGE, max_records: int | None = MAX_RECORDS, distinct: bool = False, sleep=time.sleep) -> Iterator[list[dict]]:
    """Attributes page by page, ordered by object id, until the layer says that no more follow."""
    seen = 0
    while True:
        params = {"where": where, "outFields": fields, "resultOffset": seen, "resultRecordCount": page_size, "f": "json"}
        params |= {"returnDistinctValues": "true", "returnGeometry": "false"} if distinct else {"orderByFields": "ObjectId ASC"}
        page = with_retry(fetch, url, params, sleep=sleep)
        rows = [f["attributes"] for f in page.get("features", [])]
        if not rows:
            return
        yield rows
        seen += len(rows)
        if max_records is not None and seen >= max_records:
            raise RuntimeError(f"{url}: more than {max_records} records; narrow the filter")
        if not page.get("exceededTransferLimit", len(rows) >= page_size):
            return


def price_pages(fetch, url: str, params: dict, page_size: int = PRICE_PAGE, sleep=time.sleep) -> Iterator[list[dict]]:
    offset = 0
    while True:
        rows = with_retry(fetch, url, params | {"offset": offset, "length": page_size}, sleep=sleep)["response"]["data"]
        yield rows
        if len(rows) < page_size:
            return
        offset += page_size


#: Column types of a layer's field types; dates come as epoch milliseconds.
FIELD_TYPES = {"esriFieldTypeOID": "long", "esriFieldTypeInteger": "long", "esriFieldTypeSmallInteger": "long", "esriFieldTypeDouble": "double", "esriFieldTypeSingle": "double", "esriFieldTypeDate": "timestamp"}


def layer_schema(metadata: dict) -> str:
    """DDL of a layer's fields; types that aren't known are strings."""
    return ", ".join(f"`{f['name']}` {FIELD_TYPES.get(f.get('type'), 'string')}" for f in metadata.get("fields", []))


def _typed(value, kind: str):
    if value is None:
        return None
    if kind == "timestamp":
        return dt.datetime.fromtimestamp(value / 1000, dt.timezone.utc) if isinstance(value, (int, float)) else dt.datetime.fromisoformat(value)
    return {"bigint": int, "int": int, "double": float}.get(kind, str)(value)


class _LayerReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.where = options, []
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership go to the service as a WHERE clause; Spark applies them again."""
        quote = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
        for f in filters:
            if isinstance(f, EqualTo):
                self.where.append(f"{f.attribute[0]} = {quote(f.value)}")
            elif isinstance(f, In):
                self.where.append(f"{f.attribute[0]} IN ({', '.join(map(quote, f.value))})")
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own = self.options.get("where")
        where = " AND ".join([*([f"({own})"] if own else []), *self.where]) or "1=1"
        top = int(self.options.get("maxrecords", MAX_RECORDS))
        distinct = self.options.get("distinct", "false") == "true"
        for page in layer_pages(http_get, f"{self.options['url']}/query", where, ",".join(n for n, _ in self.fields), int(self.options.get("pagesize", LAYER_PAGE)), top or None, distinct):
            for row in page:
                yield tuple(_typed(row.get(n), kind) for n, kind in self.fields)


class LayerSource(DataSource):
    """``spark.read.format("map_layer").option("url", layer).load()``: fields and types as the layer declares them.

    Options: ``where``, ``pagesize``, ``maxrecords`` (0 lifts the guard), ``distinct`` (the service removes repeated rows of
    the fields of a given schema, so a directory of names costs no pass over daily rows).
    """

    @classmethod
    def name(cls) -> str:
        return "map_layer"

    def schema(self) -> str:
        return layer_schema(with_retry(http_get, self.options["url"], {"f": "json"}))

    def reader(self, schema):
        return _LayerReader(self.options, schema)


class _Years(InputPartition):
    def __init__(self, start: str | None, end: str | None):
        self.start, self.end = start, end


class _PriceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """A partition a year between ``start`` and ``end``; one for all where either is open, or for a CSV."""
        start, end = self.options.get("start"), self.options.get("end")
        if not start or not end or self.options.get("form", "api") == "csv":
            return [_Years(start, end)]
        first, last = int(start[:4]), int(end[:4])
        return [_Years(start if y == first else f"{y}-01-01", end if y == last else f"{y}-12-31") for y in range(first, last + 1)]

    def read(self, part: _Years) -> Iterator[tuple]:
        series, url = self.options["series"], self.options["url"]
        if self.options.get("form", "api") == "csv":
            rows = list(csv.reader(io.StringIO(http_text(url, {"id": series}))))[1:]
            pairs: Iterator[tuple] = ((r[0], r[1]) for r in rows if len(r) > 1)
        else:
            params = {"api_key": self.options.get("token") or require_setting("EIA_API_KEY"), "frequency": "daily", "data[0]": "value", "facets[series][]": series, "sort[0][column]": "period", "sort[0][direction]": "asc"}
            params |= {k: v for k, v in (("start", part.start), ("end", part.end)) if v}
            pairs = ((r.get("period"), r.get("value")) for page in price_pages(http_get, url, params, int(self.options.get("pagesize", PRICE_PAGE))) for r in page)
        for day, value in pairs:
            try:
                number = float(value)
            except (TypeError, ValueError):
                continue
            if number == number:
                yield dt.date.fromisoformat(day[:10]), number, series


class PriceSource(DataSource):
    """``spark.read.format("price_series")``: (date, value, series_id); values that are no numbers are left out.

    Options: ``url``, ``series``, ``start``, ``end``, ``form`` (``api``: paged JSON; ``csv``: one file, first two columns),
    ``token`` (the API key; else the environment of the workers must have EIA_API_KEY), ``pagesize``.
    """

    @classmethod
    def name(cls) -> str:
        return "price_series"

    def schema(self) -> str:
        return "date date, value double, series_id string"

    def reader(self, schema):
        return _PriceReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LayerSource, PriceSource):
        spark.dataSource.register(source)
    return spark


def normalise_daily(rows: DataFrame, entity: str) -> DataFrame:
    """date, <entity>_id, <entity>_name first; epoch milliseconds or ISO text; dates that don't parse stay as nulls."""
    from straitline.operators.series import pick_column

    date = pick_column(rows.columns, ("date", "Date", "day"), "date")
    key = pick_column(rows.columns, (f"{entity}id", f"{entity}_id", "portid", "id"), f"{entity} id")
    name = pick_column(rows.columns, (f"{entity}name", f"{entity}_name", "portname", "name"), f"{entity} name")
    text = F.col(date).cast("string")
    millis = F.to_date(F.timestamp_millis(F.try_to_number(text, F.lit("9" * 15)).cast("long")))
    parsed = F.coalesce(F.to_date(F.try_to_timestamp(text)), millis)
    rest = [c for c in rows.columns if c not in (date, key, name)]
    return rows.select(parsed.alias("date"), F.col(key).cast("string").alias(f"{entity}_id"), F.col(name).alias(f"{entity}_name"), *rest)


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) of the first two columns; ``.`` is null, and null values are dropped."""
    raw = spark.read.option("header", "true").csv(path)
    d, v = raw.columns[:2]
    return raw.select(F.to_date(d).alias("date"), F.try_to_number(F.nullif(F.col(v), F.lit(".")), F.lit("S999999D999999")).cast("double").alias("value")).where("date is not null and value is not null")


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    df = df.where(F.col("date") >= F.lit(start).cast("date")) if start else df
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def spot(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """The primary source; on any error of it, a missing key too, the fallback, filtered to the dates here. The change of
    source is logged with its reason. An empty reply is no error."""
    try:
        return primary()
    except Exception as e:  # noqa: BLE001  any failure of a remote source
        log.warning("the primary source failed (%s: %s); using the fallback", type(e).__name__, str(e).splitlines()[0] if str(e) else "")
        return between(fallback(), start, end)
