"""Firewall rule names: what they say about chain, index, action and direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlens.config import VPN_PREFIXES, NetConfig
from netlens.functions.ip import ColumnLike, as_col, is_bcast_or_mcast, one_of

# Shapes of a rule name and the action words of a description.
LEGACY_RULE = r"^(.+?)-(A|B|D|R)-([0-9]+)(?:-[A-Z])?$"
ZONE_INDEX_RULE = r"^([A-Z][A-Z0-9]*_[A-Z][A-Z0-9]*)-([0-9]+)$"
ACTION_WORD = r"(?i)\b(block|drop|reject|allow)\b"

RULE_TYPE = (
    "struct<format:string,chain:string,index:bigint,action_code:string,"
    "resolved_action:string,action_source:string,desc_hint:string>"
)


def is_redirect_rule(rule: ColumnLike) -> Column:
    rule = as_col(rule)
    return F.coalesce(rule.contains("DNAT") | rule.contains("PREROUTING"), F.lit(False))


def action_word(desc: ColumnLike) -> Column:
    """First action word of a description; drop and reject mean block."""
    word = F.lower(F.regexp_extract(as_col(desc), ACTION_WORD, 1))
    return F.when(word == "allow", "allow").when(word != "", "block")


def rule_parse(rule: ColumnLike, desc: ColumnLike | None = None) -> Column:
    """Struct describing a rule name, NULL for a name of no known shape."""
    rule = as_col(rule)
    hint = action_word(desc) if desc is not None else F.lit(None).cast("string")

    def made(fmt, chain, index, code, action, source, hint_=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(fmt).alias("format"), chain.alias("chain"), index.alias("index"),
            (none if code is None else code).alias("action_code"),
            (none if action is None else action).alias("resolved_action"),
            F.lit(source).alias("action_source"),
            (none if hint_ is None else hint_).alias("desc_hint"),
        )

    code = F.regexp_extract(rule, LEGACY_RULE, 2)
    legacy = made(
        "legacy", F.regexp_extract(rule, LEGACY_RULE, 1),
        F.regexp_extract(rule, LEGACY_RULE, 3).try_cast("bigint"),
        code, F.when(code == "A", "allow").otherwise("block"), "rule_name",
    )
    zone_index = made(
        "zone_index", F.regexp_extract(rule, ZONE_INDEX_RULE, 1),
        F.regexp_extract(rule, ZONE_INDEX_RULE, 2).try_cast("bigint"),
        None, None, "default", hint,
    )
    redirect = made(
        "redirect", rule, F.lit(None).cast("bigint"), None, F.lit("redirect"), "rule_name"
    )
    return (
        F.when(is_redirect_rule(rule), redirect)
        .when(rule.rlike(LEGACY_RULE), legacy)
        .when(rule.rlike(ZONE_INDEX_RULE), zone_index)
        .cast(RULE_TYPE)
    )


def action_of(rule: ColumnLike, desc: ColumnLike | None = None) -> Column:
    """Action a rule name implies; an unknown shape counts as allow."""
    rule = as_col(rule)
    hint = action_word(desc) if desc is not None else F.lit(None).cast("string")
    code = F.regexp_extract(rule, LEGACY_RULE, 2)
    return (
        F.when(rule.isNull() | (rule == ""), F.lit(None).cast("string"))
        .when(is_redirect_rule(rule), "redirect")
        .when(code == "A", "allow")
        .when(code != "", "block")
        .when(rule.rlike(ZONE_INDEX_RULE), hint)
        .otherwise("allow")
    )


def has_vpn_prefix(iface: ColumnLike) -> Column:
    iface = as_col(iface)
    test = F.lit(False)
    for prefix, _, _ in VPN_PREFIXES:
        test = test | iface.startswith(prefix)
    return F.coalesce(test, F.lit(False))


def direction_of(
    iface_in: ColumnLike,
    iface_out: ColumnLike,
    rule: ColumnLike,
    src: ColumnLike,
    dst: ColumnLike,
    cfg: NetConfig,
    src_is_own_wan: Column | None = None,
) -> Column:
    """Traffic direction; the order of the branches is the priority order.

    ``src_is_own_wan`` replaces the test against ``cfg.wan_ips`` when the own
    addresses were learned from the data (see ``plans.parse.learn_wan_ips``).
    """
    i = F.coalesce(as_col(iface_in), F.lit(""))
    o = F.coalesce(as_col(iface_out), F.lit(""))
    wan_in, wan_out = one_of(i, cfg.wan_interfaces), one_of(o, cfg.wan_interfaces)
    own = one_of(src, cfg.wan_ips) if src_is_own_wan is None else src_is_own_wan
    between_lans = F.when(has_vpn_prefix(i) | has_vpn_prefix(o), "vpn").otherwise("inter_vlan")
    return (
        F.when((i == "") & (o == ""), F.lit(None).cast("string"))
        .when(is_bcast_or_mcast(dst), "local")
        .when(own & ~wan_out, "local")
        .when(is_redirect_rule(rule), "nat")
        .when(o == "", F.when(wan_in, "inbound").otherwise("local"))
        .when(wan_in & ~wan_out, "inbound")
        .when(~wan_in & wan_out, "outbound")
        .when(~wan_in & ~wan_out & (i != o), between_lans)
        .otherwise("local")
    )
