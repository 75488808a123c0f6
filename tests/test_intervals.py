"""Networks of any number against every address, one by one."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wirelight.operators import intervals
from wirelight.operators.networks import cidr_join, cidr_join_sorted


def nested(rng, n):
    """Networks inside of each other, side by side, equal ones, and networks at the ends of the address space."""
    out = ["0.0.0.0/0", "255.255.255.255/32", "255.255.255.0/24", "0.0.0.0/32", "::/0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "10.0.0.0/8", "10.255.255.0/24", "bad", None, "10.1.2.3"][rng.randrange(2) :]
    for _ in range(n):
        if rng.random() < 0.3:
            base = ipaddress.ip_address(0x20010DB8 << 96 | rng.getrandbits(rng.choice([8, 30, 70])))
            out.append(str(ipaddress.ip_network((base, rng.randrange(20, 129)), strict=False)))
        else:
            base = ipaddress.ip_address(rng.choice([0x0A000000, 0x0A010000, 0xC0A80000]) | rng.getrandbits(rng.choice([8, 16, 24])))
            out.append(str(ipaddress.ip_network((base, rng.randrange(6, 33)), strict=False)))
    return out


def addresses(rng, nets, n):
    out = [None, "no address", "255.255.255.255", "0.0.0.0", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    known = [ipaddress.ip_network(x) for x in nets if x and x != "bad"]
    for _ in range(n):
        net = rng.choice(known)
        at = int(net[0]) + rng.choice([-1, 0, 1, net.num_addresses - 1, net.num_addresses, rng.randrange(net.num_addresses)])
        top = (1 << net.max_prefixlen) - 1
        out.append(str(type(net[0])(max(0, min(top, at)))))
    return out


def holding(nets, ip):
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return []
    return sorted({str(i) for i, x in enumerate(nets) if x and x != "bad" and address in ipaddress.ip_network(x)})


@pytest.mark.parametrize("seed", [1, 2])
def test_every_network_that_holds_an_address(spark, monkeypatch, seed):
    rng = random.Random(seed)
    nets = nested(rng, 150)
    nets += nets[20:30]
    ips = addresses(rng, nets, 600) + ["10.1.2.3"] * 300
    monkeypatch.setattr(intervals, "LEAST_PART", 40)
    monkeypatch.setattr(intervals, "PARTS", 7)
    rows = spark.createDataFrame(list(enumerate(ips)), "n long, ip string").withColumn("_range", F.lit("clash"))
    table = spark.createDataFrame([(x, str(i)) for i, x in enumerate(nets)], "cidr string, tag string")
    found = cidr_join_sorted(rows, "ip", table, "cidr", "tag", "tags")
    assert found.columns == [*rows.columns, "tags"]
    got = {r.n: r.tags for r in found.collect()}
    assert got == {n: holding(nets, ip) if ip else [] for n, ip in enumerate(ips)}
    small = {r.n: r.tags for r in cidr_join(rows, "ip", table, "cidr", "tag", "tags").collect()}
    assert small == got


def test_no_networks_and_no_rows(spark):
    none = spark.createDataFrame([], "cidr string, tag string")
    rows = spark.createDataFrame([(1, "10.0.0.1"), (2, None)], "n long, ip string")
    assert sorted((r.n, r.tags) for r in cidr_join_sorted(rows, "ip", none, "cidr", "tag", "tags").collect()) == [(1, []), (2, [])]
    assert cidr_join_sorted(rows.limit(0), "ip", spark.createDataFrame([("10.0.0.0/8", "a")], "cidr string, tag string"), "cidr", "tag", "tags").count() == 0


def test_events_are_shuffled_once(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string")).alias("ip"), F.repeat(F.lit("x"), 50).alias("wide"))
    table = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.0.0.64/26", "b")], "cidr string, tag string")
    plan = cidr_join_sorted(rows, "ip", table, "cidr", "tag", "tags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    assert sum("repeat(x" in line or "wide" in line for line in plan.split("\n") if "Join" in line) <= 1


def _windows_columns(plan):
    """Names of all columns that window steps of a plan read."""
    found = []
    if plan.nodeName() == "Window":
        out = plan.children().head().output()
        found += [out.apply(i).name() for i in range(out.size())]
    for i in range(plan.children().size()):
        found += _windows_columns(plan.children().apply(i))
    return found


def test_ranges_are_counted_once_and_unread_columns_stay_behind(spark, monkeypatch):
    """Ranges of both addresses come from one pass over the events, not from the rows of the first join."""
    from wirelight.operators import scope
    from wirelight.plans.scope_queries import GROUPS
    from wirelight.sources.scope_file import scope_frame

    counted = []
    real = intervals.materialise

    def noted(df, name):
        if name == "ranges":
            counted.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(intervals, "materialise", noted)
    ips = ["10.1.2.3", "192.168.4.4", None, "8.8.8.8", "fd00::1", "bad", "172.16.0.9"]
    rows = [(i, ips[i % 7], ips[i % 5], f"never read {i}") for i in range(200)]
    events = spark.createDataFrame(rows, "id int, srcIP string, destIP string, note string")
    table = scope_frame(spark, GROUPS)
    found = scope.scope_join(events, table, "ip", flag=True, by_order=True)
    assert len(counted) == 1 and "Window" not in counted[0]
    assert found.columns == [*events.columns, "keep", "reason"]
    wanted = scope.scope_ip(events, GROUPS, flag=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    plan = found.select("id", "keep")._jdf.queryExecution().optimizedPlan()
    assert not any("note" in c for c in _windows_columns(plan))
