"""Ordered network sources: the first that knows an address wins."""

import pytest

from pyspark.sql import functions as F
from tarnwell.operators import enrich
from tarnwell.sources import files

PROXIES = ['"16777216","16777471","DCH","US","x"', '"16777472","16777727","-","-","-"', '"3232235776","3232236031","TOR","DE","x"', '"3106996224","3106996479","DCH","-","-"']


def known(spark, rows, asn_types=None, **ranges):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ip string, net_hint string").withColumn("ip_number", files.ipv4(F.col("ip")))
    got = enrich.networks_known(df, ranges, {"AS14061": "hosting"} if asn_types is None else asn_types).orderBy("i").collect()
    return [(r["network_type"], r["network_source"], r["confidence"]) for r in got]


def lines(spark, text):
    return spark.createDataFrame([(x, "f") for x in text], "line string, file string")


def test_first_source_that_knows(spark):
    ranges = {"demo_list": enrich.network_table(spark), "ip2proxy": files.proxy_ranges(lines(spark, PROXIES), {"DCH": "hosting", "TOR": "tor"}), "cgnat_list": files.network_list(lines(spark, ["49.36.0.0/16 # carrier", "1.0.0.0/8"]))}
    rows = [("185.220.101.7", None), ("192.0.2.44", "AS14061"), ("198.51.100.9", None), ("203.0.113.200", None), ("49.36.128.77", "AS14061"), ("45.12.1.1", "AS14061 DigitalOcean"), ("10.1.2.3", None), ("10.1.2.3", "as14061"), ("8.8.4.4", "AS1"), (None, "AS14061"), ("no address", None), ("1.0.0.99", None), ("192.168.1.5", None), ("1.0.1.5", None)]
    assert known(spark, rows, **ranges) == [
        ("hosting", "demo_list", 0.9), ("vpn", "demo_list", 0.9), ("tor", "demo_list", 0.9), ("hosting", "demo_list", 0.9), ("mobile", "cgnat_list", 0.6), ("hosting", "asn_map", 0.4), ("unknown", "special", 0.3), ("hosting", "asn_map", 0.4),
        ("unknown", "none", 0.0), ("unknown", "none", 0.0), ("unknown", "none", 0.0), ("hosting", "ip2proxy", 0.8), ("tor", "ip2proxy", 0.8), ("mobile", "cgnat_list", 0.6),
    ]


def test_sources_that_are_missing_know_nothing(spark):
    assert known(spark, [("185.220.101.7", None), ("192.0.2.44", "AS5"), ("8.8.4.4", None)], {}) == [("unknown", "none", 0.0), ("unknown", "special", 0.3), ("unknown", "none", 0.0)]
    assert known(spark, [], demo_list=enrich.network_table(spark)) == []
    with pytest.raises(ValueError):
        known(spark, [], other=enrich.network_table(spark))
