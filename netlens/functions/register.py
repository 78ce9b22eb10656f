"""The most used column functions under names usable in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from netlens.config import VPN_PREFIXES, NetConfig
from netlens.functions import ip, rules


def _quoted(text: str) -> str:
    """SQL string literal, taken as it is (regular expressions keep their backslashes)."""
    return "r'" + text + "'"


def _in_list(column: str, values) -> str:
    listed = ", ".join(_quoted(v) for v in values)
    return f"coalesce({column} IN ({listed}), false)" if listed else "false"


def _cidr(prefix: int) -> str:
    whole, bits = divmod(prefix, 8)
    parts = [f"substring_index(ip, '.', {whole})"]
    if bits:
        mask = (0xFF << (8 - bits)) & 0xFF
        parts.append(f"(try_cast(substring_index(substring_index(ip, '.', {whole + 1}), '.', -1) AS INT) & {mask})")
    parts += ["'0'"] * (4 - whole - (1 if bits else 0))
    return f"CASE WHEN ip RLIKE {_quoted(ip.V4_PATTERN)} THEN concat(concat_ws('.', {', '.join(parts)}), '/{prefix}') END"


def _direction(cfg: NetConfig) -> str:
    vpn = " OR ".join(f"startswith({i}, '{p}')" for p, _, _ in VPN_PREFIXES for i in ("i", "o"))
    wan_in, wan_out = _in_list("i", cfg.wan_interfaces), _in_list("o", cfg.wan_interfaces)
    text = f"""CASE WHEN i = '' AND o = '' THEN NULL
     WHEN dst RLIKE {_quoted(ip.BROADCAST_OR_MULTICAST)} THEN 'local'
     WHEN {_in_list('src', cfg.wan_ips)} AND NOT {wan_out} THEN 'local'
     WHEN contains(rule, 'DNAT') OR contains(rule, 'PREROUTING') THEN 'nat'
     WHEN o = '' THEN CASE WHEN {wan_in} THEN 'inbound' ELSE 'local' END
     WHEN {wan_in} AND NOT {wan_out} THEN 'inbound' WHEN NOT {wan_in} AND {wan_out} THEN 'outbound'
     WHEN NOT {wan_in} AND i <> o THEN CASE WHEN {vpn} THEN 'vpn' ELSE 'inter_vlan' END ELSE 'local' END"""
    names = "coalesce(iface_in, '') AS i, coalesce(iface_out, '') AS o"
    return f"(SELECT {text} FROM (SELECT {names}, rule, src, dst))"


def sql_functions(cfg: NetConfig) -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body)."""
    nothing = "CAST(NULL AS STRING)"
    legacy, zone = _quoted(rules.LEGACY_RULE), _quoted(rules.ZONE_INDEX_RULE)
    code = f"regexp_extract(rule, {legacy}, 2)"
    word = f"lower(regexp_extract(descr, {_quoted(rules.ACTION_WORD)}, 1))"
    names = "'format', {}, 'chain', {}, 'index', {}, 'action_code', {}, 'resolved_action', {}, 'action_source', {}, 'desc_hint', {}"

    def made(*values: str) -> str:
        return f"named_struct({names.format(*values)})"

    redirect = made("'redirect'", "rule", "CAST(NULL AS BIGINT)", nothing, "'redirect'", "'rule_name'", nothing)
    by_code = made(
        "'legacy'", f"regexp_extract(rule, {legacy}, 1)", f"try_cast(regexp_extract(rule, {legacy}, 3) AS BIGINT)", code,
        f"CASE WHEN {code} = 'A' THEN 'allow' ELSE 'block' END", "'rule_name'", nothing,
    )
    by_zone = made(
        "'zone_index'", f"regexp_extract(rule, {zone}, 1)", f"try_cast(regexp_extract(rule, {zone}, 2) AS BIGINT)", nothing,
        nothing, "'default'", f"CASE WHEN {word} = 'allow' THEN 'allow' WHEN {word} <> '' THEN 'block' END",
    )
    return {
        "is_public_ip_sql": ("ip STRING", "BOOLEAN", f"coalesce(NOT ip RLIKE {_quoted(ip.PRIVATE)}, false)"),
        **{f"cidr{n}_of": ("ip STRING", "STRING", _cidr(n)) for n in (8, 16, 22, 24)},
        "rule_parse": (
            "rule STRING, descr STRING", rules.RULE_TYPE,
            f"CASE WHEN contains(rule, 'DNAT') OR contains(rule, 'PREROUTING') THEN {redirect}"
            f" WHEN rule RLIKE {legacy} THEN {by_code} WHEN rule RLIKE {zone} THEN {by_zone} END",
        ),
        "direction_of": (
            "iface_in STRING, iface_out STRING, rule STRING, src STRING, dst STRING", "STRING", _direction(cfg),
        ),
        "csv_safe": (
            "cell STRING", "STRING",
            r"coalesce(CASE WHEN cell RLIKE r'(?s)^(?:[=+@;\t\r\n\x00]|-(?![0-9]|\.[0-9]))' THEN concat('\'', cell) ELSE cell END, '')",
        ),
    }


def register(spark: SparkSession, cfg: NetConfig = NetConfig()) -> list[str]:
    """Create the temporary functions; Catalyst inlines their bodies. The CIDR
    functions cover IPv4; ``functions.ip.cidr_of`` does both families."""
    made = []
    for name, (parameters, kind, body) in sql_functions(cfg).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(name)
    return made
