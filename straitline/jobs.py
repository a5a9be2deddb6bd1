"""Command line: ``python -m straitline.jobs VERB``; tables are in the catalog below --root."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from straitline import __version__, report
from straitline.config import ZONES, load_ports, load_zones
from straitline.operators import series, zone_daily
from straitline.session import ensure_workers
from straitline.sources import ingest, rest
from straitline.sources.catalog import Catalog, children
from straitline.streaming import collector

#: The port layer's measures, in the order in which they are looked for.
PORT_MEASURES = ("n_tanker", "n_total", "portcalls_tanker")


def _day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="straitline")
    p.add_argument("--root", default="data")
    p.add_argument("--log-level", default="WARN")
    p.add_argument("--zones", help="YAML file of zones; the built-in ones without it")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("version", "validate-gates", "status"):
        sub.add_parser(verb)
    a = sub.add_parser("build-ais-metrics")
    a.add_argument("--start")
    a.add_argument("--end")
    a.add_argument("--laden-threshold", type=float, default=0.75)
    b = sub.add_parser("build-features")
    b.add_argument("--as-of")
    b.add_argument("--no-publication-lag", action="store_true")
    b.add_argument("--ports", help="YAML file of ports")
    b.add_argument("--events", help="CSV file of dated events")
    i = sub.add_parser("ingest-prices")
    i.add_argument("--start")
    i.add_argument("--end")
    i.add_argument("--prefer", choices=("eia", "fred"), default="eia")
    i.add_argument("--eia-url", default=ingest.EIA_URL)
    i.add_argument("--fred-url", default=ingest.FRED_URL)
    w = sub.add_parser("ingest-portwatch")
    w.add_argument("--chokepoints-url")
    w.add_argument("--ports-url")
    w.add_argument("--ports", help="YAML file of ports")
    w.add_argument("--id-map", help="saved directory of the ports")
    v = sub.add_parser("verify-endpoints")
    v.add_argument("urls", nargs="+")
    c = sub.add_parser("collect-ais")
    c.add_argument("--url", default=collector.FEED_URL)
    c.add_argument("--every", default="5 minutes")
    c.add_argument("--seconds", type=float, help="stop after so long; run on without it")
    c.add_argument("--key-env", default="AISSTREAM_API_KEY", help="the environment variable that holds the key")
    c.add_argument("--key-file", help="a file that holds the key")
    d = sub.add_parser("resolve-ids")
    d.add_argument("--url", required=True)
    d.add_argument("--entity", choices=("chokepoint", "port"), default="port")
    d.add_argument("--save")
    r = sub.add_parser("report")
    r.add_argument("--output", default="report.md")
    r.add_argument("--horizons", default="1,5,20")
    r.add_argument("--min-train", type=int, default=500)
    args = p.parse_args(argv)
    zones = load_zones(args.zones) if args.zones else ZONES
    if args.verb == "version":
        print(__version__)
        return 0
    if args.verb == "verify-endpoints":
        bad = 0
        for url in args.urls:
            try:
                print(f"{url}: {rest.layer_schema(rest.with_retry(rest.http_get, url, {'f': 'json'}))}")
            except Exception as e:  # noqa: BLE001  each address is reported on its own
                bad += 1
                print(f"{url}: {e}")
        return 1 if bad else 0
    if args.verb == "validate-gates":
        for z in zones.values():
            print(f"{z.key}: gate {z.gate}, box {z.bounds}, +{z.positive} / -{z.negative}")
        return 0
    spark = ensure_workers(SparkSession.builder.appName("straitline").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel(args.log_level)
    cat = Catalog(spark, args.root)
    if args.verb == "status":
        for name in children(spark, f"{args.root}/raw"):
            print(name, *cat.vintages(name)[-1:])
        print("processed:", *children(spark, f"{args.root}/processed"))
    elif args.verb == "ingest-prices":
        print("prices_daily", ingest.ingest_prices(cat, args.start, args.end, args.prefer, eia_url=args.eia_url, fred_url=args.fred_url))
    elif args.verb == "ingest-portwatch":
        if args.chokepoints_url:
            print("portwatch_chokepoints", ingest.ingest_chokepoints(cat, args.chokepoints_url))
        if args.ports_url:
            stamp, lost = ingest.ingest_ports(cat, args.ports_url, load_ports(args.ports), args.id_map)
            print("portwatch_ports", stamp, "without a match:", *lost)
    elif args.verb == "resolve-ids":
        directory = ingest.id_map(spark, args.url, args.entity)
        print(report.markdown(directory))
        if args.save:
            ingest.save_id_map(directory, args.save)
    elif args.verb == "collect-ais":
        where = f"{args.root}/feed"
        key = {"keyfile": args.key_file} if args.key_file else {"keyenv": args.key_env}
        query = collector.collect(cat, f"{where}/log", f"{where}/checkpoint", zones, args.every, url=args.url, **key)
        query.awaitTermination(args.seconds)
        query.stop()
        print(report.markdown(collector.collector_stats(spark, f"{where}/log").drop("last_error")))
    elif args.verb == "build-ais-metrics":
        pos = cat.read_partitions("ais_positions", _day(args.start), _day(args.end))
        has_static = bool(children(spark, f"{args.root}/raw/ais_static"))
        tables = zone_daily.ais_metrics(pos, cat.read_partitions("ais_static") if has_static else None, zones, threshold=args.laden_threshold)
        for name, df in tables.items():
            cat.write_processed(df, name)
    elif args.verb == "build-features":
        as_of = _day(args.as_of)
        flows = cat.read_vintage("portwatch_chokepoints", as_of)
        keys = spark.createDataFrame([(z.portwatch_id, z.key) for z in zones.values()], "chokepoint_id string, zone_key string")
        flows = flows.join(F.broadcast(keys), "chokepoint_id")
        value = series.pick_column(flows.columns, series.MEASURES, "traffic measure")
        own = cat.read_processed("ais_daily") if children(spark, f"{args.root}/processed/ais_daily") else None
        more: dict = {}
        if args.ports and cat.vintages("portwatch_ports"):
            ports = load_ports(args.ports).values()
            daily = cat.read_vintage("portwatch_ports", as_of)
            more |= {"port_daily": daily, "port_value": series.pick_column(daily.columns, PORT_MEASURES, "port measure"), "groups": sorted({p.group for p in ports})}
            more["ports"] = spark.createDataFrame([(p.key, p.match_name, p.group, p.portwatch_id) for p in ports], "port_key string, match_name string, port_group string, portwatch_id string")
        if args.events:
            events = ingest.load_events(spark, args.events)
            cat.write_processed(events, "events")
            more |= {"events": events, "categories": sorted(r[0] for r in events.select("category").distinct().collect())}
        if own is not None and children(spark, f"{args.root}/processed/waiting_daily"):
            seen = [c for c in own.columns if c == "n_waiting"]
            waiting = cat.read_processed("waiting_daily")
            more["waiting"] = waiting.select("date", "zone_key", *[c for c in series.numeric(waiting, ("date", "zone_key")) if c not in seen])
        table = series.feature_table(cat.read_vintage("prices_daily", as_of).drop("retrieved_at_ts"), flows.select("date", "zone_key", value), zones=list(zones), values=(value,), lag=not args.no_publication_lag, ais_daily=own, **more)
        cat.write_processed(table, "features_daily")
    elif args.verb == "report":
        events = cat.read_processed("events")
        text = report.generate(cat.read_processed("features_daily"), events, tuple(map(int, args.horizons.split(","))), args.min_train)
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
