"""Malformed rows in fail mode, mapped networks, record types, LEEF without time, two document polls."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wirelight.functions.ip import cidr_prefixes, with_cidr_keys
from wirelight.functions.values import dns_type_name
from wirelight.operators.networks import network_prefixes
from wirelight.session import work_dir
from wirelight.sources.suricata import suricata_dns
from wirelight.streaming.jobs import started_at


def test_fail_mode_fails_whatever_is_selected(spark):
    lines = spark.createDataFrame([("{broken", "f")], "value string, source_file string")
    assert suricata_dns(lines, on_error="keep").where("_error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="(?i)suricata|json"):
        suricata_dns(lines).count()
    with pytest.raises(Exception, match="(?i)suricata|json"):
        suricata_dns(lines).select("query").collect()


@pytest.mark.parametrize("net", ["::ffff:a00:0/104", "::ffff:1.2.3.4/64", "::ffff:1.2.3.0/120", "10.0.0.0/9", "2001:db8::/33"])
def test_networks_agree_with_the_driver_form(spark, net):
    frame = with_cidr_keys(spark.createDataFrame([(net,)], "c string"), "c", "k")
    assert sorted(frame.select(cidr_prefixes("c", "k")).first()[0]) == sorted(network_prefixes(net))


def test_record_types(spark):
    frame = spark.createDataFrame([(256,), (257,), (999,)], "n int")
    assert [r[0] for r in frame.select(dns_type_name("n")).collect()] == ["URI", "CAA", "Unknown"]


def test_start_of_a_search_is_kept(spark):
    check = work_dir(spark, "start")
    first = datetime(2024, 1, 20, 1, 2, 3, 456789, tzinfo=timezone.utc)
    assert started_at(spark, check, first) == first
    later = started_at(spark, check, datetime(2025, 1, 1))
    assert later == first and later.utcoffset() == timedelta(0)
