"""External context of events: network zones, asset inventory, and the confidence boosts of rules."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.addresses import address_bits, first_bits, in_network, network_bits
from watchtide.operators.predicates import Field, Fields, _typed


class Provider(Protocol):
    """Resolves context keys to columns."""

    def supports(self, key: str) -> bool: ...

    def resolve(self, key: str, fields: Fields) -> Field: ...


class Networks:
    """`<address field>.location`: the first zone, in the order given, with a network that holds the address; else external. No address: null."""

    def __init__(self, zones: dict[str, list[str]]):
        self.zones = zones

    def supports(self, key: str) -> bool:
        return key.endswith(".location")

    def resolve(self, key: str, fields: Fields) -> Field:
        field = fields.get(key.removesuffix(".location"))
        if field is None:
            return Field(F.lit(None).cast("string"), "string")
        return Field(self.zone(field.column), "string")

    def zone(self, ip: Column) -> Column:
        found = F.when(address_bits(ip).isNull(), F.lit(None).cast("string"))
        for zone, networks in self.zones.items():
            for cidr in networks:
                found = found.when(F.coalesce(in_network(ip, cidr, strict=True), F.lit(False)), zone)
        return found.otherwise("external")


class Located:
    """`<address field>.location`, from columns that with_zones has joined."""

    def supports(self, key: str) -> bool:
        return key.endswith(".location")

    def resolve(self, key: str, fields: Fields) -> Field:
        return fields.get(key, Field(F.lit(None).cast("string"), "string"))


#: Tasks over which the rows of one address, or the addresses of one network, are dealt.
DEALT = 16


def with_zones(events: DataFrame, networks: DataFrame, address: str) -> DataFrame:
    """events with `<address>.location`, as Networks gives it, for zone lists of any length.

    networks: zone, place (the least holds; ties by zone), network (address/length); null networks are ignored, what is
    no network fails. No address: null; without networks: external. A column of the result's name is replaced.
    Each distinct address asks, for every prefix length that occurs (at most 33 of IPv4 and 129 of IPv6), by equality.
    """
    location = f"{address}.location"
    spelled = networks.where("network IS NOT NULL").groupBy("network").agg(F.min(F.struct("place", "zone")).alias("_one"))  # repeated networks are parsed once
    known = spelled.select("_one", network_bits(F.col("network")).alias("_n"))
    # never null, and told so: else Spark tests the parsed keys of the join below for null, before networks are grouped
    known = known.select("_one", *(F.coalesce(F.col(f"_n.{c}"), F.lit(0)).alias(c) for c in ("version", "length", "hi", "lo")))
    prefixes = known.groupBy("version", "length", "hi", "lo").agg(F.min("_one").alias("_best"))
    lengths = prefixes.select("version", "length").distinct()  # 162 rows at most
    own = events.select(F.struct(*(F.col(f"`{c}`") for c in events.columns if c != location)).alias("_row"), F.col(f"`{address}`").cast("string").alias("_ip"))
    # no filter on what is parsed: Spark would push it below the distinct and parse every event's address
    asked = own.select("_ip").distinct().select("_ip", address_bits(F.col("_ip")).alias("_a"))
    asked = asked.select("_ip", "_a.*").join(F.broadcast(lengths), "version", "left").select(
        "_ip", "version", "length", first_bits(F.col("hi"), F.col("length")).alias("hi"), first_bits(F.col("lo"), F.col("length") - 64).alias("lo"), F.pmod(F.xxhash64("_ip"), F.lit(DEALT)).cast("int").alias("_deal")
    )
    dealt = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_deal")
    met = asked.join(prefixes.select("*", dealt), ["version", "length", "hi", "lo", "_deal"], "left")
    zones = met.groupBy("_ip").agg(F.when(F.max("version").isNotNull(), F.coalesce(F.min("_best")["zone"], F.lit("external"))).alias("_zone"))
    own = own.withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(DEALT)))  # an address may hold most rows
    return own.join(zones.select("*", dealt), ["_ip", "_deal"], "left").select("_row.*", F.col("_zone").alias(location))


class Assets:
    """`<address field>.role` and `.category`, from columns that with_assets has joined."""

    def supports(self, key: str) -> bool:
        return ".role" in key or ".category" in key

    def resolve(self, key: str, fields: Fields) -> Field:
        what = "role" if ".role" in key else "category"
        return fields.get(f"{key.split('.' + what)[0]}.{what}", Field(F.lit(None).cast("string"), "string"))


def with_assets(events: DataFrame, assets: DataFrame, address: str) -> DataFrame:
    """events with `<address>.role` and `<address>.category`, null for unknown addresses; assets: ip (unique), role, category. Spark broadcasts assets only if they are small."""
    known = assets.select(F.col("ip").alias("_ip"), F.col("role").alias(f"{address}.role"), F.col("category").alias(f"{address}.category"))
    return events.join(known, events[address] == known["_ip"], "left").drop("_ip")


class Composite:
    """The first supporting provider answers, even with null."""

    def __init__(self, *providers: Provider):
        self.providers = providers

    def supports(self, key: str) -> bool:
        return any(p.supports(key) for p in self.providers)

    def resolve(self, key: str, fields: Fields) -> Field:
        return next(p for p in self.providers if p.supports(key)).resolve(key, fields)


def boost(rule: dict, fields: Fields, provider: Provider | None) -> tuple[Column, Column]:
    """The boost of a rule's matched context conditions, and the outcome of each as 'context: outcome' texts."""
    total, said = F.lit(0.0), []
    for c in (rule.get("external_context") or {}).get("conditions", []):
        key = c["context"]
        if provider is None or not provider.supports(key):
            said.append(F.lit(f"{key}: context_provider_unavailable"))
            continue
        field = provider.resolve(key, fields)
        met = F.coalesce(_typed(field, c.get("operator", "=="), c.get("value")), F.lit(False))
        total = total + F.when(field.column.isNotNull() & met, max(0.0, float(c.get("confidence_boost", 0.0)))).otherwise(0.0)
        said.append(F.concat(F.lit(f"{key}: "), F.when(field.column.isNull(), "context_unavailable").when(met, "matched").otherwise("not_matched")))
    return total, F.array(*said) if said else F.array().cast("array<string>")
