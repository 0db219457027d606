import datetime as dt
import json
import os

import pytest

from tests.conftest import rows
from tidemart.operators.silver import clean
from tidemart.plans import kpi, lakehouse
from tidemart.streaming import events as ev, ingest

AS_OF = "2024-06-01"


def _order(n, products, user="U1", day="2024-01-05"):
    return {"event_type": "order_created", "transaction_id": f"T{n}", "user_id": user, "store_id": "ST_001",
            "timestamp": f"{day}T10:00:00", "products": [{"product_id": p, "amount": a} for p, a in products]}


def _user(uid, city):
    return {"event_type": "user_update", "user_id": uid, "name": uid, "email": f"{uid}@x", "city": city,
            "signup_date": "2024-01-01"}


EVENTS = [
    _order(1, [("P1", 10.5), ("P2", 4.0), ("P3", 1.25)]),
    _order(2, []),
    _user("U1", "Rome"),
    {"event_type": "product_update", "product_id": "P1", "product_name": "pen", "category": "office", "price": 10.5},
    {"event_type": "inventory_update", "product_id": "P1", "store_id": "ST_001", "stock_level": 4, "reorder_point": 9,
     "last_restock_date": "2024-01-02", "stock_status": "low_stock"},
    {"event_type": "shipment_update", "shipment_id": "H1", "transaction_id": "T1", "origin_store_id": "ST_001",
     "dest_store_id": "ST_002", "shipped_date": "2024-01-06", "delivered_date": None, "delivery_days": None,
     "carrier": "post", "tracking_number": "K1", "status": "shipped", "shipping_cost": 3.5},
    {"event_type": "price_alert", "product_id": "P9"},
    _order(1, [("P1", 99.0)], day="2024-01-09"),   # the same line again, later: the first one stays
    _order(3, [("P1", 2.0)], user="U2"),
    _user("U2", "Oslo"),
    _order(1, [("P2", 3.0)], day="2024-01-01"),    # the same line with an earlier time: it replaces
]
LINES = [json.dumps(e) for e in EVENTS] + ['{"event_type": "order_created", "transac', "", "[1, 2]", '"text"', "{}"]


def _frame(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def test_parse_routes_and_counts(spark):
    events = ev.parse(_frame(spark))
    assert ev.malformed(events).count() == 5
    assert rows(ev.type_counts(events)) == sorted([
        ("order_created", 5), ("user_update", 2), ("product_update", 1), ("inventory_update", 1),
        ("shipment_update", 1), ("price_alert", 1), ("malformed", 5)], key=repr)
    routed = {k: v.count() for k, v in ev.route(ev.well_formed(events)).items()}
    assert routed == {"transactions": 6, "users": 2, "products": 1, "inventory": 1, "shipments": 1}


def test_order_lines(spark):
    got = rows(ev.order_lines(ev.well_formed(ev.parse(_frame(spark)))).filter("timestamp like '2024-01-05%'"))
    assert got[0] == ("T1", "U1", "P1", "2024-01-05T10:00:00", "10.5", "ST_001")
    assert len(got) == 4


def _batch_silver(spark):
    routed = ev.route(ev.well_formed(ev.parse(_frame(spark))))
    return {e: rows(clean(e, df, AS_OF)) for e, df in routed.items()}


@pytest.mark.parametrize("files,refresh_every", [(1, 1), (3, 2), (7, 3)])
def test_stream_equals_batch_for_any_split(spark, tmp_path, files, refresh_every):
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    landing.mkdir()
    for i in range(files):
        (landing / f"events_{i}.jsonl").write_text("\n".join(LINES[i::files]) + "\n")
    ingest.run_available(spark, str(landing), root, str(tmp_path / "cp"), AS_OF, refresh_every, max_files=1)
    silver = {e: rows(df) for e, df in lakehouse.read_silver(spark, root).items()}
    assert silver == _batch_silver(spark)
    gold = lakehouse.read_gold(spark, root)
    assert rows(kpi.summary_kpis(gold)) == [(10.5 + 3.0 + 1.25 + 2.0, 2, 2)]
    seen = ingest.metrics(spark, root).groupBy("event_type").sum("events")
    assert rows(seen) == rows(ev.type_counts(ev.parse(_frame(spark).filter("value <> ''")))) or files
    assert spark.read.parquet(f"{root}/quarantine").count() >= 4


def test_new_rows_meet_only_their_own_keys(spark, tmp_path):
    """Folding a batch into a larger table gives what cleaning all rows at once gives."""
    def rows_of(batch, n, price):
        return spark.range(n).selectExpr(
            "concat('P', id) as product_id", "'x' as product_name", "'c' as category",
            f"cast({price} as string) as price", f"{batch} as batch")

    root = str(tmp_path)
    ingest.fold(spark, root, "products", rows_of(0, 500, 5), AS_OF)
    ingest.fold(spark, root, "products", rows_of(1, 7, 9).unionByName(rows_of(1, 3, 0)), AS_OF)
    got = rows(lakehouse.read_silver(spark, root)["products"])
    assert len(got) == 500 and sum(r[3] == 9.0 for r in got) == 7


@pytest.mark.parametrize("files", [1, 3])
def test_what_arrives_last_stays_for_any_split(spark, tmp_path, files):
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    landing.mkdir()
    stock = [json.dumps({"event_type": "inventory_update", "product_id": "P1", "store_id": "S1", "stock_level": n, "reorder_point": 1})
             for n in (7, 5, 9, 3, 4, 6)]
    for i in range(files):
        step = len(stock) // files
        path = landing / f"part_{files - i}.jsonl"  # names are not in the order of arrival
        path.write_text("\n".join(stock[i * step:(i + 1) * step]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    ingest.run_available(spark, str(landing), root, str(tmp_path / "cp"), AS_OF, max_files=1 if files > 1 else None)
    assert [r.stock_level for r in lakehouse.read_silver(spark, root)["inventory"].collect()] == [6]


def test_gold_that_lags_is_built_and_failures_are_raised(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ingest.land(_frame(spark), 0, root)
    build = lakehouse.build_gold
    monkeypatch.setattr(ingest.lakehouse, "build_gold", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        ingest.catch_up(spark, root, 0, AS_OF)  # dies between silver and gold
    assert "fact_transactions" not in lakehouse.read_gold(spark, root)

    def failing(run, *args, **more):
        run.status.append(("gold", "fact_transactions", None, "failed: ValueError: x"))
    monkeypatch.setattr(ingest.lakehouse, "build_gold", failing)
    with pytest.raises(RuntimeError, match="fact_transactions"):
        ingest.catch_up(spark, root, 0, AS_OF)
    monkeypatch.setattr(ingest.lakehouse, "build_gold", build)
    ingest.catch_up(spark, root, 0, AS_OF)
    assert lakehouse.read_gold(spark, root)["fact_transactions"].count() == 4


def test_restart_continues_and_replayed_batches_change_nothing(spark, tmp_path):
    landing, root, cp = tmp_path / "landing", str(tmp_path / "lake"), str(tmp_path / "cp")
    landing.mkdir()
    (landing / "a.jsonl").write_text(json.dumps(_order(1, [("P1", 5.0)])) + "\n" + json.dumps(_user("U1", "Rome")) + "\n")
    ingest.run_available(spark, str(landing), root, cp, AS_OF)
    (landing / "b.jsonl").write_text(json.dumps(_order(2, [("P1", 7.0)])) + "\n" + json.dumps(_user("U1", "Oslo")) + "\n")
    ingest.run_available(spark, str(landing), root, cp, AS_OF)

    def state():
        return {n: rows(df) for n, df in lakehouse.read_silver(spark, root).items()}

    after = state()
    assert [r[0] for r in after["transactions"]] == ["T1", "T2"]
    assert after["users"] == [("U1", "U1", "U1@x", "Oslo", dt.date(2024, 1, 1))]
    history = lakehouse.read_gold(spark, root)["dim_users"]
    assert rows(history.select("city", "is_current")) == [("Oslo", True), ("Rome", False)]

    replay = spark.read.text(str(landing / "b.jsonl"))
    ingest.land(replay, 1, root)
    rows_again = spark.read.option("basePath", f"{root}/bronze/users").parquet(f"{root}/bronze/users/batch=000000000001")
    ingest.fold(spark, root, "users", rows_again, AS_OF)
    ingest.refresh_gold(spark, root, AS_OF)
    assert state() == after
    assert lakehouse.read_gold(spark, root)["dim_users"].count() == 2
    ingest.run_available(spark, str(landing), root, cp, AS_OF)  # nothing new
    assert state() == after


# -- state in the state store -------------------------------------------------------------------

def test_running_totals_survive_a_restart(spark, tmp_path):
    from tidemart.streaming import state

    landing, root, cp = tmp_path / "landing", str(tmp_path / "lake"), str(tmp_path / "cp")
    landing.mkdir()
    assert state.running_totals(spark, root).collect() == []
    want = {}
    for part in range(3):
        (landing / f"{part}.jsonl").write_text("\n".join(LINES[part::3]) + "\n")
        for _ in range(2):  # the second start finds nothing new
            state.start_totals(spark, str(landing), root, cp, None).awaitTermination()
        seen = [x for x in (LINES[i::3] for i in range(part + 1)) for x in x]
        frame = spark.createDataFrame([(x,) for x in seen], "value string")
        want = dict(rows(ev.type_counts(ev.parse(frame))))
        assert {r.event_type: r.events for r in state.running_totals(spark, root).collect()} == want
    assert sum(want.values()) == len(LINES)


def _line(n, product, day, amount=1.0):
    return json.dumps(_order(n, [(product, amount)], day=day))


def test_repeats_within_the_bound_go_and_state_is_forgotten(spark, tmp_path):
    from tidemart.streaming import state

    landing, out, cp = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()
    late, progress, batches = [], [], [
        [_line(1, "P1", "2024-01-01"), _line(1, "P2", "2024-01-01"), _line(1, "P1", "2024-01-01")],
        [_line(2, "P1", "2024-01-03"), _line(1, "P1", "2024-01-01")],      # a repeat two days later
        [_line(3, "P1", "2024-01-20"), json.dumps(_order(7, [("P1", 1.0)]) | {"timestamp": "?"})],
        [_line(4, "P1", "2024-01-20"), _line(3, "P1", "2024-01-20")],
        [_line(1, "P1", "2024-01-01"), _line(5, "P1", "2024-01-21")],      # far behind the bound: late
    ]
    assert state.read_order_lines(spark, out).collect() == []
    for i, lines in enumerate(batches):
        (landing / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
        query = state.start_order_lines(spark, str(landing), out, cp, "5 days", None)  # a restart each time
        query.awaitTermination()
        last = [p for p in query.recentProgress if p["stateOperators"]]
        progress.append(min(p["stateOperators"][0]["numRowsTotal"] for p in last))
        late.append(sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in last))
    got = sorted((r.transaction_id, r.product_id) for r in state.read_order_lines(spark, out).collect())
    assert got == [("T1", "P1"), ("T1", "P2"), ("T2", "P1"), ("T3", "P1"), ("T4", "P1"), ("T5", "P1"), ("T7", "P1")]
    assert late[-1] == 1 and progress[1] == 3 and progress[-1] <= 3  # T1 and T2 are forgotten


def test_the_bounded_stream_equals_the_exact_fold_inside_the_bound(spark, tmp_path):
    from tidemart.streaming import state

    landing, out, root = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "lake")
    landing.mkdir()
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    for i in range(0, 28, 4):
        own = [_line(n, f"P{n % 5}", days[n], 1.0 + n) for n in range(i, i + 4)]
        again = [_line(n, f"P{n % 5}", days[n], 1.0 + n) for n in range(max(0, i - 4), i)]
        path = landing / f"{i:02d}.jsonl"
        path.write_text("\n".join(own + again + own[:2]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    state.start_order_lines(spark, str(landing), out, str(tmp_path / "cp1"), "9 days", None, max_files=1).awaitTermination()
    ingest.run_available(spark, str(landing), root, str(tmp_path / "cp2"), AS_OF, max_files=3)
    want = lakehouse.read_silver(spark, root)["transactions"]
    assert rows(state.read_order_lines(spark, out).select(*want.columns)) == rows(want) and want.count() == 28
