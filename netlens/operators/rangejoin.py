"""Address -> address-block join (city, AS and the like).

Spark has no interval join and a nested loop over all blocks is out of the
question. But blocks are networks, and there are few prefix lengths: an address is
listed once per length that occurs in the table, under its first bits, and meets
the block with just these bits in an equi-join. Every pair that meets is a hit; the
longest prefix wins. The join runs on distinct addresses, so a hot address costs
one row per length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.ip import ip_key, v4_text
from netlens.plans.staging import computed

def keyed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks given as IPv4 numbers (start_num, end_num, prefix_len) with binary keys.
    A range that is not the network of its prefix length is an error."""
    size = F.pow(F.lit(2), 32 - F.col("prefix_len")).cast("bigint")
    network = (F.col("start_num") % size == 0) & (F.col("end_num") - F.col("start_num") + 1 == size)
    wrong = F.raise_error(F.concat(F.lit("not a network: "), F.col("start_num").cast("string")))
    start = F.when(network, F.col("start_num")).otherwise(wrong.cast("bigint"))
    return (
        blocks.withColumn("start_key", ip_key(v4_text(start)))
        .withColumn("end_key", ip_key(v4_text("end_num")))
        .drop("start_num", "end_num")
    )


def cidr_blocks(blocks: DataFrame, cidr: str = "network") -> DataFrame:
    """Blocks given as CIDR text (either family) with keys and prefix length."""
    base = F.split(F.col(cidr), "/").getItem(0)
    length = F.split(F.col(cidr), "/").getItem(1).try_cast("int")
    is_v6 = base.contains(":")
    digits = F.hex(ip_key(base))
    bits = F.when(is_v6, length).otherwise(length + 96)
    kept, partial = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substr(digits, kept + 1, F.lit(1)), 16, 10).try_cast("int")
    # Host bits inside the first partly covered digit, then whole digits.
    host = F.element_at(F.array(F.lit(15), F.lit(7), F.lit(3), F.lit(1)), partial + 1)
    head = F.substr(digits, F.lit(1), kept)

    def filled(low: bool) -> Column:
        edge = digit.bitwiseAND(F.lit(15) - host) if low else digit.bitwiseOR(host)
        tail = F.concat(head, F.hex(edge))
        whole = F.when(kept >= 32, digits).otherwise(F.rpad(tail, 32, "0" if low else "F"))
        return F.unhex(whole)

    return (
        blocks.withColumn("start_key", filled(True))
        .withColumn("end_key", filled(False))
        .withColumn("prefix_len", length)
        .where(F.col("start_key").isNotNull() & F.col("end_key").isNotNull())
    )


MAPPED = "0" * 20 + "FFFF"  # IPv4 addresses are keys with these first digits


def _first_bits(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a key as text: whole hexadecimal digits, then what
    the last digit holds of them."""
    digits, whole, partial = F.hex(key), F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(partial > 0, F.floor(digit / F.pow(F.lit(2), 4 - partial)).cast("string"))
    return F.concat_ws(":", bits.cast("string"), F.substr(digits, F.lit(1), whole), rest)


def _bits(blocks: DataFrame) -> Column:
    """Prefix length within the 128 bits of a key."""
    mapped = F.hex("start_key").startswith(MAPPED) & F.hex("end_key").startswith(MAPPED)
    return F.when(mapped, F.col("prefix_len") + 96).otherwise(F.col("prefix_len")).cast("int")


def attach_block(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """``keys`` (one row per ``ip``) with the columns of the narrowest block that
    holds the address, NULL where none does. ``blocks`` has start_key, end_key and
    prefix_len. One pass: ``keys`` is read once."""
    carried = [c for c in keys.columns if c != "ip"]
    attributes = [c for c in blocks.columns if c not in ("start_key", "end_key", "prefix_len")]
    # Computed apart, so that no test of the key moves below the caller's distinct.
    keyed = computed(keys, {"_key": ip_key("ip")})
    networks = blocks.withColumn("_bits", _bits(blocks))
    # At most 129 lengths, whatever the table holds.
    lengths = networks.agg(F.sort_array(F.collect_set("_bits")).alias("l")).scalar()
    nowhere = F.array(F.lit(None).cast("int"))
    usable = F.when(F.col("_key").isNotNull() & (F.size(lengths) > 0), lengths).otherwise(nowhere)
    probes = keyed.withColumn("_length", F.explode(usable))
    probes = probes.withColumn("_prefix", _first_bits(F.col("_key"), F.col("_length"))).drop("_length")
    found = F.when(F.col("prefix_len").isNotNull(), F.struct("prefix_len", *[F.col(f"_a_{c}") for c in attributes]))
    named = networks.select(
        "prefix_len", _first_bits(F.col("start_key"), F.col("_bits")).alias("_network"), *[F.col(c).alias(f"_a_{c}") for c in attributes]
    )
    best = probes.join(named, F.col("_prefix") == F.col("_network"), "left").groupBy("ip", *carried).agg(F.max(found).alias("_block"))
    return best.select("ip", *carried, *[F.col(f"_block._a_{c}").alias(c) for c in attributes])


def range_join(ips: DataFrame, blocks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Distinct addresses of ``ips`` with the columns of their block."""
    wanted = ips.select(F.col(ip_col).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    return attach_block(wanted, blocks).withColumnRenamed("ip", ip_col)
