"""Price and layer sources against a local service, the id directory, configuration files and the verbs."""

import csv
import datetime as dt
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from straitline import config, jobs
from straitline.operators import dynamics
from straitline.sources import ingest, rest
from straitline.sources.catalog import Catalog

DAYS = [dt.date(2023, 12, 1) + dt.timedelta(i) for i in range(70)]
FIELDS = [{"name": "ObjectId", "type": "esriFieldTypeOID"}, {"name": "date", "type": "esriFieldTypeDate"}, {"name": "portid", "type": "esriFieldTypeString"}, {"name": "portname", "type": "esriFieldTypeString"}, {"name": "n_tanker", "type": "esriFieldTypeInteger"}]
ROWS = [{"ObjectId": 3 * i + k, "date": int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp() * 1000), "portid": p, "portname": n, "n_tanker": 10 * k + i} for i, d in enumerate(DAYS) for k, (p, n) in enumerate((("chokepoint6", "Hormuz"), ("p2", "Ras Tanura"), ("p3", "Elsewhere")))]


@pytest.fixture
def service():
    """(root address, queries that came); /eia, /fred, /layer, and /down that fails for good."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
            seen.append((at.path, q))
            if at.path == "/down":
                return self.send_error(400)
            if at.path == "/fred":
                body = "DATE,V\n" + "".join(f"{d},{70 + i if i % 7 else '.'}\n" for i, d in enumerate(DAYS))
            elif at.path == "/eia":
                days = [d for d in DAYS if q.get("start", "0") <= str(d) <= q.get("end", "9")]
                offset, n = int(q["offset"]), int(q["length"])
                body = json.dumps({"response": {"data": [{"period": str(d), "value": "x" if d == DAYS[3] else str(80 + d.day)} for d in days[offset : offset + n]]}})
            elif at.path == "/layer":
                body = json.dumps({"fields": FIELDS})
            else:
                rows = ROWS if "IN" not in q["where"] else [r for r in ROWS if f"'{r['portid']}'" in q["where"]]
                if q.get("returnDistinctValues"):
                    rows = [dict(t) for t in {tuple((k, r[k]) for k in q["outFields"].split(",")) for r in rows}]
                offset, n = int(q["resultOffset"]), int(q["resultRecordCount"])
                body = json.dumps({"features": [{"attributes": r} for r in rows[offset : offset + n]], "exceededTransferLimit": offset + n < len(rows)})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_prices(spark, service, monkeypatch):
    root, seen = service
    monkeypatch.setenv("EIA_API_KEY", "k")
    rest.register(spark)
    read = spark.read.format("price_series").options(url=f"{root}/eia", series="RBRTE", start="2023-12-01", end="2024-01-31", pagesize=10, token="k").load()
    got = read.orderBy("date").collect()
    assert read.rdd.getNumPartitions() == 2 and [r.date for r in got] == [d for d in DAYS if d <= dt.date(2024, 1, 31) and d != DAYS[3]]
    fell = ingest.prices(spark, "brent", "2024-01-01", None, eia_url=f"{root}/down", fred_url=f"{root}/fred").collect()
    assert {r.source for r in fell} == {"fred"} and len(fell) == sum(d.year == 2024 and i % 7 > 0 for i, d in enumerate(DAYS))
    with pytest.raises(ValueError, match="unknown"):
        ingest.prices(spark, "gold")


def test_layer_and_directory(spark, service, tmp_path):
    root, seen = service
    rest.register(spark)
    layer = spark.read.format("map_layer").options(url=f"{root}/layer", pagesize=50).load()
    assert layer.schema.simpleString() == "struct<ObjectId:bigint,date:timestamp,portid:string,portname:string,n_tanker:bigint>" and layer.count() == len(ROWS)
    ids = ingest.id_map(spark, f"{root}/layer", "port")
    assert [tuple(r) for r in ids.collect()] == [("p3", "Elsewhere"), ("chokepoint6", "Hormuz"), ("p2", "Ras Tanura")]
    ingest.save_id_map(ids, f"{tmp_path}/ids")
    n = len(seen)
    assert ingest.id_map(spark, f"{root}/layer", "port", f"{tmp_path}/ids").count() == 3 and len(seen) == n
    ports = {"a": config.Port("a", "ras tanura", "gulf_export"), "b": config.Port("b", "nowhere", "gulf_export")}
    cat = Catalog(spark, f"{tmp_path}/lake")
    stamp, lost = ingest.ingest_ports(cat, f"{root}/layer", ports)
    rows, metrics = ingest.observed(cat.read_vintage("portwatch_ports"), "ports")
    assert {r.port_id for r in rows.collect()} == {"p2"} and lost == ["b"] and stamp
    assert metrics.get["rows"] == len(DAYS) and metrics.get["first"] == DAYS[0]
    assert any("IN" in q.get("where", "") or "=" in q.get("where", "").replace("1=1", "") for _, q in seen)


def test_files_of_zones_and_ports(tmp_path, capsys):
    (tmp_path / "z.yaml").write_text("chokepoints:\n  here:\n    portwatch_id: c1\n    gate: [[1, 1], [1, 2]]\n    zone: [[0, 0], [3, 0], [3, 3], [0, 3]]\n    direction_positive: in\n    direction_negative: out\n    collect_live: true\n")
    (tmp_path / "p.yaml").write_text("ports:\n  - {key: a, match_name: A, group: g, portwatch_id: null}\n")
    (tmp_path / "bad.yaml").write_text("chokepoints:\n  x: {portwatch_id: c, gate: [[1, 95], [1, 2]], zone: [[0, 0], [3, 0], [3, 3]], direction_positive: a, direction_negative: b}\n")
    z = config.load_zones(str(tmp_path / "z.yaml"))["here"]
    assert z.live and z.feed_box == [[0.0, 0.0], [3.0, 3.0]] and config.load_ports(str(tmp_path / "p.yaml"))["a"].group == "g"
    assert jobs.main(["--zones", str(tmp_path / "z.yaml"), "validate-gates"]) == 0 and capsys.readouterr().out.startswith("here: gate")
    with pytest.raises(ValueError, match="lon/lat"):
        config.load_zones(str(tmp_path / "bad.yaml"))


def test_verbs_from_ingest_to_report(spark, service, tmp_path, capsys):
    root, _ = service
    run = lambda *a: jobs.main(["--root", f"{tmp_path}/lake", "--log-level", "ERROR", *a])
    (tmp_path / "p.yaml").write_text("ports:\n  - {key: a, match_name: Ras Tanura, group: gulf_export}\n")
    with open(tmp_path / "e.csv", "w", newline="") as f:
        csv.writer(f).writerows([("date", "event", "category", "source_url"), ("2024-01-20", "two, with a comma", "attack", "u"), ("2023-12-20", "one", "policy", "u")])
    assert run("ingest-prices", "--prefer", "fred", "--fred-url", f"{root}/fred") == 0
    assert run("ingest-portwatch", "--chokepoints-url", f"{root}/layer", "--ports-url", f"{root}/layer", "--ports", f"{tmp_path}/p.yaml") == 0
    assert run("build-features", "--ports", f"{tmp_path}/p.yaml", "--events", f"{tmp_path}/e.csv") == 0
    assert run("report", "--output", f"{tmp_path}/r.md", "--horizons", "1", "--min-train", "20") == 0
    table = Catalog(spark, f"{tmp_path}/lake").read_processed("features_daily")
    assert {"hormuz_n_tanker", "port_gulf_export_n_tanker", "event_attack", "days_since_event"} <= set(table.columns)
    assert table.agg(F.sum("event_attack")).first()[0] == 1 and "two, with a comma" in (tmp_path / "r.md").read_text()
    assert run("verify-endpoints", f"{root}/layer", f"{root}/down") == 1 and "portname" in capsys.readouterr().out
    assert run("resolve-ids", "--url", f"{root}/layer", "--save", f"{tmp_path}/ids") == 0 and run("status") == 0


def test_var_model_is_least_squares_at_the_chosen_order(spark):
    rng, v = np.random.default_rng(5), [np.zeros(2)]
    a = np.array([[0.5, 0.2], [0.0, -0.3]])
    for _ in range(1500):
        v.append(a @ v[-1] + rng.normal(size=2))
    rows = [(DAYS[0] + dt.timedelta(i), float(x), float(y)) for i, (x, y) in enumerate(v)]
    m = {(r.equation, r.term): r.coef for r in dynamics.var_model(spark.createDataFrame(rows, "date date, x double, y double"), ["x", "y"], 3).collect()}
    v = np.array(v)
    p = (len(m) // 2 - 1) // 2
    x = np.column_stack([np.ones(len(v) - p), *[v[p - j : len(v) - j] for j in range(1, p + 1)]])
    b = np.linalg.lstsq(x, v[p:], rcond=None)[0]
    terms = ["const", *[f"L{j}.{c}" for j in range(1, p + 1) for c in "xy"]]
    assert p >= 1 and all(abs(m[c, t] - b[i, k]) < 1e-8 for k, c in enumerate("xy") for i, t in enumerate(terms))
