"""Addresses and networks against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from watchtide.functions.addresses import address_bits, in_network
from watchtide.operators import context

ODD = [
    "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:::2", ":1", "1:", ":", "FE80::A%eth0", "fe80::a%", "fe80::a%b%c",
    "::ffff:10.1.2.3", "::10.1.2.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::", "g::", "12345::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::8000:0:0:0", "10.0.0.1", "10.0.0.01", "10.0.0.1\n", "::1\n", "255.255.255.255", "256.1.1.1",
    "1.2.3", "", " ", "x", "10.0.0.1/8", None,
]


def number(ip):
    try:
        found = ipaddress.ip_address(ip)
    except ValueError:
        return None
    return (found.version, int(found) << 96 if found.version == 4 else int(found))


def test_addresses_as_bits(spark):
    rng = random.Random(3)
    texts = ODD + [str(ipaddress.IPv6Address(rng.getrandbits(rng.choice([16, 64, 128])))) for _ in range(200)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", address_bits(F.col("ip")).alias("a")).collect()
    got = {r["ip"]: r["a"] and (r["a"]["version"], (r["a"]["hi"] % 2**64 << 64) + r["a"]["lo"] % 2**64) for r in rows}
    assert got == {t: number(t) for t in texts}


@pytest.mark.parametrize("cidr", ["10.1.0.0/16", "0.0.0.0/0", "10.0.0.1/32", "::/0", "fe80::/10", "2001:db8::/63", "2001:db8::/64", "2001:db8:0:0:8000::/65", "::1/128"])
def test_single_networks(spark, cidr):
    network, rng = ipaddress.ip_network(cidr), random.Random(5)
    near = [str(type(network[0])(min(max(int(n) + d, 0), 2**network.max_prefixlen - 1))) for n in (network[0], network[-1]) for d in (-1, 0, 1)]
    texts = ODD + near + [str(network[rng.randrange(network.num_addresses)]) for _ in range(5)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", in_network(F.col("ip"), cidr)).collect()}
    assert got == {t: None if number(t) is None else ipaddress.ip_address(t) in network for t in texts}


def made(rng, n):
    """Networks that nest, in both versions, with repeats and ties of place."""
    found = []
    for i in range(n):
        v6, full = i % 2, 128 if i % 2 else 32
        length = rng.choice([0, 8, 31, 32, 63, 64, 65, 96, 127, 128] if v6 else [0, 8, 15, 16, 17, 24, 32])
        base = (0x20010DB8 << 96) + rng.getrandbits(6) * (2**60 + 1) if v6 else (10 << 24) + rng.getrandbits(24)
        text = str(ipaddress.ip_network((base >> full - length << full - length, length)))
        found.append((f"z{i}", rng.randrange(n), text))
    return found


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_zone_table(spark, threshold):
    rng = random.Random(7)
    networks = [x for x in made(rng, 400) if not x[2].endswith("/0")] + [("none", 0, None)]
    hot = ["10.7.7.7"] * 500
    texts = hot + ODD + [f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(4)}" for _ in range(300)] + ["11.0.0.1"]
    texts += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + rng.getrandbits(6) * (2**60 + 1) + rng.getrandbits(2))) for _ in range(300)]
    events = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "event_id int, ip string, zone string, _deal int").repartition(5)
    parsed = sorted((p, z, ipaddress.ip_network(n)) for z, p, n in networks if n)

    def zone(t):
        if number(t) is None:
            return None
        a = ipaddress.ip_address(t)
        return next((z for _, z, n in parsed if a in n), "external")

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = context.with_zones(events, spark.createDataFrame(networks, "zone string, place int, network string"), "ip")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Cartesian", "NestedLoop"))
        got = {r["event_id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {i: got[i]["ip.location"] for i in got} == {i: zone(t) for i, t in enumerate(texts)}
    assert got[0]["zone"] == "clash" and out.columns == [*events.columns, "ip.location"]


def test_zone_table_empty_and_broken(spark):
    events = spark.createDataFrame([("1.2.3.4", "old"), ("x", "old"), (None, "old"), ("1.2.3.4", "old")], "ip string, `ip.location` string")
    table = lambda *rows: spark.createDataFrame(rows, "zone string, place int, network string")
    got = context.with_zones(events, table(), "ip").collect()
    assert sorted((str(r[0]), str(r[1])) for r in got) == [("1.2.3.4", "external")] * 2 + [("None", "None"), ("x", "None")]
    assert context.with_zones(events.limit(0), table(("z", 0, "0.0.0.0/0")), "ip").count() == 0
    assert context.with_zones(events, table(("z", 0, "1.2.3.4"), ("all", 1, "0.0.0.0/0")), "ip").where("`ip.location` = 'z'").count() == 2
    for bad in ("1.2.3.4/24", "1.2.3.0/33", "x", "1.2.3.0/", "::1/64", ""):
        with pytest.raises(Exception, match="no network"):
            context.with_zones(events, table(("z", 0, bad)), "ip").collect()


def test_a_long_list_keeps_the_plan(spark):
    named = "concat('10.', id div 65536, '.', id div 256 % 256, '.', id % 256)"
    events = spark.range(50_000).selectExpr("id", f"{named} AS ip")

    def located(n):
        return context.with_zones(events, spark.range(n).selectExpr("concat('z', id) AS zone", "id AS place", f"{named} || '/32' AS network"), "ip")

    assert located(100_000).where("`ip.location` = concat('z', id)").count() == 50_000
    size = [len(located(n)._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 100_000)]
    assert abs(size[0] - size[1]) < 200


def test_addresses_and_networks_are_parsed_once(spark, tmp_path):
    """Parsing stands above the distinct addresses and the grouped networks, in the optimized plan too."""
    from pyspark.sql import functions as F

    from watchtide.operators.context import with_zones

    spark.range(1000).select(F.concat(F.lit("10.0.0."), F.col("id") % 3).alias("ip")).write.parquet(f"{tmp_path}/events")
    spark.range(1000).select(F.lit("z").alias("zone"), F.col("id").alias("place"), F.lit("10.0.0.0/31").alias("network")).write.parquet(f"{tmp_path}/networks")
    found = with_zones(spark.read.parquet(f"{tmp_path}/events"), spark.read.parquet(f"{tmp_path}/networks"), "ip")
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "lambda" in line:  # what parses
            below = [line, *(x for x in lines[i + 1 :] if indent(x) > indent(line))]
            assert any("Aggregate [_ip" in x or "Aggregate [network" in x for x in below), line[:200]
    assert {(r["ip"], r["ip.location"]) for r in found.collect()} == {("10.0.0.0", "z"), ("10.0.0.1", "z"), ("10.0.0.2", "external")}
