"""Steps whose cost has to follow the input."""

import ipaddress
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from wirelight.functions.ip import key_text, with_ip_keys
from wirelight.plans import alert_queries
from wirelight.sinks.events import write_alerts
from wirelight.sources.documents import numbered_pages, pages
from wirelight.sources.search_config import Search
from wirelight.streaming.state import Sessions


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_address_text_takes_two_passes_of_patterns(spark):
    rnd = random.Random(3)
    texts = [":".join(f"{rnd.choice([0, 0, 0, 15, rnd.randrange(65536)]):04x}" for _ in range(8)) for _ in range(400)]
    texts += ["::", "::1", "1::", "0:0:1:0:0:1:0:0", "1:0:2:0:3:0:4:0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]
    rows = with_ip_keys(spark.createDataFrame([(t, t) for t in texts], "given string, ip string"), {"k": "ip"}, {"k": "shown"})
    for r in rows.collect():
        address = ipaddress.ip_address(r.given)
        assert r.shown == str(address.ipv4_mapped or address), r
    assert _plan(spark.range(1).select(key_text(F.col("id").cast("string")).alias("t"))).count("regexp_replace") <= 2


class _Handle:
    """A key's state and timers, without Spark."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class _Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_runs_of_unordered_rows_are_not_held():
    alive, most = set(), 0

    class Seen(Row):
        def __del__(self):
            alive.discard(id(self))

    def rows(times):
        nonlocal most
        for n, at in times:
            one = Seen(_at=at, _order={"ts": at, "n": n}, _row=(n, at))
            alive.add(id(one))
            most = max(most, len(alive))
            yield one

    rnd = random.Random(1)
    for horizon in (0, 3, 40):
        handle, judge = _Handle(), Sessions(horizon)
        judge.init(handle)
        runs = []
        for batch in range(4):
            times = [(batch * 1000 + n, rnd.randrange(800)) for n in range(60)]
            got = {r["_row"] for r in judge.handleInputRows(None, rows(times), _Clock())}
            want = set()
            # all rows so far by brute force: no earlier row, or one of a run in reach
            for n, at in sorted(times, key=lambda t: (t[1], t[0])):
                covered = any(a <= at <= b + horizon for a, b in runs)
                if not covered:
                    want.add((n, at))
                runs.append((at, at))
                runs.sort()
                merged = [runs[0]]
                for a, b in runs[1:]:
                    if a <= merged[-1][1] + horizon:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], b))
                    else:
                        merged.append((a, b))
                runs = merged
            assert got == want
            assert list(zip(handle.value[0], handle.value[1], strict=True)) == runs
    handle, judge, most = _Handle(), Sessions(10**6), 0
    judge.init(handle)
    assert len(list(judge.handleInputRows(None, rows([(n, -n % 997) for n in range(5000)]), _Clock()))) == 1
    assert most < 10


def test_pages_are_numbered_in_one_go(spark, monkeypatch):
    from wirelight.sources import documents

    rows = [(f"{n:04}", n // 3 % 40) for n in range(1003)]
    docs = spark.createDataFrame(rows, "id string, s int").select(
        "id", F.lit("{}").alias("source"), F.lit(None).cast("map<string,array<string>>").alias("fields"), F.timestamp_seconds("s").alias("ingested"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    got = numbered_pages(docs.repartition(7), 10).collect()
    assert {r.id: r.page for r in got} == {d: n // 10 for n, d in enumerate(want)}
    searches = []
    monkeypatch.setattr(documents, "search", lambda found, *_: searches.append(1) or found)
    found = [[r.id for r in p.collect()] for p in pages(docs, Search("dns", "ecs", page_size=250))]
    assert [d for p in found for d in p] == want and [len(p) for p in found] == [250] * 4 + [3]
    assert len(searches) == 1
    assert list(pages(docs.where("false"), Search("dns", "ecs", page_size=250))) == []


def test_a_table_with_splits_enough_is_not_shuffled(spark, tmp_path, monkeypatch):
    from wirelight.plans.views import read_table

    spark.range(200000).repartition(1).write.option("parquet.block.size", 1 << 16).parquet(f"{tmp_path}/big.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        assert "Repartition" not in _plan(read_table(spark, str(tmp_path), "big"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.range(3).repartition(1).write.parquet(f"{tmp_path}/small.parquet")
    assert "Repartition" in _plan(read_table(spark, str(tmp_path), "small"))


def test_alerts_shuffle_ids_and_one_sink_keeps_no_copy(spark, sf_dir, tmp_path, monkeypatch):
    plan = alert_queries._alert_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set(struct" not in plan and "collect_set(if" not in plan and plan.count("partial_collect_set") <= 1
    from pyspark.sql.classic.dataframe import DataFrame

    kept = []
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: kept.append(1) or persist(df, *a))
    alerts = alert_queries._enriched(spark, sf_dir).limit(5)
    write_alerts(alerts, {"json": f"{tmp_path}/json"}, 0)
    assert not kept and spark.read.text(f"{tmp_path}/json").count() == 5
    write_alerts(alerts, {"json": f"{tmp_path}/json2", "cef": f"{tmp_path}/cef"}, 0)
    assert kept
