"""Zone map, log-to-policy matching and action resolution."""

import pytest

from netlens.operators import policy as pol
from netlens.plans.maintenance import backfill_actions

ZONES = [
    ("z-int", "Internal", ["n1", "n2"], ("SYSTEM",)), ("z-ext", "External", [], ("SYSTEM",)), ("z-gw", "Gateway", [], ("SYSTEM",)),
    ("z-vpn", "Vpn", [], None), ("z-iot", "IoT", ["n3"], ("USER",)), ("z-lab", "Lab", None, ("USER",)), (None, "skipped", [], None),
]
NETWORKS = [("n1", "Default", "br0", None), ("n2", "Office", "br10", 10), ("n3", "Things", "br20", 20), ("n4", "No interface", None, 4)]
WANS = [("WAN", "eth3", "203.0.113.7", True), ("", "eth9", None, False)]
VPNS = [("wgsrv1", "WGD SRV", "10.9.0.0/24"), ("tun0", "", None)]


def policy(id_, src, dst, action, index, enabled=True, origin="USER"):
    return (id_, id_.upper(), (src,), (dst,), (action,), index, True, enabled, (origin,))


POLICIES = [
    policy("p1", "z-int", "z-ext", "ALLOW", 100), policy("p2", "z-int", "z-ext", "BLOCK", 100),
    policy("p3", "z-iot", "z-ext", "BLOCK", 7), policy("p4", "z-iot", "z-ext", "BLOCK", 8, origin="DERIVED"),
    policy("p5", "z-iot", "z-ext", "BLOCK", 8), policy("p6", "z-iot", "z-int", "BLOCK", 9, enabled=False),
    policy("p7", "z-iot", "z-int", "ALLOW", 10, origin="DERIVED"), policy("p8", "z-vpn", "z-gw", "ALLOW", 5),
    policy("p9", "z-vpn", "z-gw", "ALLOW", 6), policy("p10", "z-vpn", "z-gw", "ALLOW", 6), policy("p11", "z-int", "z-gw", "REJECT", 11),
]


@pytest.fixture(scope="module")
def zmap(spark):
    return pol.zone_map(
        pol.with_position(spark, ZONES, pol.ZONE_SCHEMA), pol.with_position(spark, NETWORKS, pol.NETWORK_SCHEMA),
        pol.with_position(spark, WANS, pol.WAN_SCHEMA), pol.with_position(spark, VPNS, pol.VPN_SCHEMA),
    ).cache()


@pytest.fixture(scope="module")
def policies(spark):
    return pol.with_position(spark, POLICIES, pol.POLICY_SCHEMA).cache()


def test_zone_map(zmap):
    rows = zmap.orderBy("zone_pos", "iface_pos").collect()
    assert [(r.zone_id, r.chain_name, r.interface, r.network_name, r.vlan) for r in rows] == [
        ("z-int", "LAN", "br0", "Default", None), ("z-int", "LAN", "br10", "Office", 10), ("z-ext", "WAN", "eth3", "WAN", None),
        ("z-gw", "LOCAL", None, None, None), ("z-vpn", "VPN", "wgsrv1", "WGD SRV", None), ("z-vpn", "VPN", "tun0", "tun0", None),
        ("z-iot", "CUSTOM1", "br20", "Things", 20), ("z-lab", "CUSTOM2", None, None, None),
    ]
    assert {r.zone_id: r.origin for r in rows}["z-vpn"] == "UNKNOWN"


CASES = [
    ("br0", "eth3", "LAN_WAN-A-100", "matched", "p1"), ("br0", "eth3", "LAN_WAN-B-100", "matched", "p2"),
    ("br0", "eth3", "LAN_WAN-100", "ambiguous", None), ("br20", "eth3", "CUSTOM1_WAN-7", "matched", "p3"),
    ("br20", "eth3", "CUSTOM1_WAN-8", "matched", "p5"), ("br20", "br0", "CUSTOM1_LAN-9", "uncontrollable", "p6"),
    ("br20", "br0", "CUSTOM1_LAN-A-10", "uncontrollable", "p7"), ("wgsrv1", "", "VPN_LOCAL-5", "matched", "p8"),
    ("wgsrv1", None, "VPN_LOCAL-A-5", "matched", "p8"), ("wgsrv1", None, "VPN_LOCAL-6", "ambiguous", None),
    ("br99", "eth3", "LAN_WAN-100", "unmatched", None), ("br0", "eth77", "LAN_WAN-100", "unmatched", None),
    (None, "eth3", "LAN_WAN-100", "unmatched", None), ("br0", "eth3", "LAN_WAN-A-5", "unmatched", None),
    ("br0", "eth3", "PREROUTING-DNAT-1", "unsupported", None), ("br0", "eth3", "LAN_WAN-R-100", "unsupported", None),
    ("br0", "eth3", "free text", "unsupported", None), ("br0", "eth3", None, "unsupported", None),
]


def test_match_policy(spark, zmap, policies):
    logs = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(CASES * 2)], "id int, interface_in string, interface_out string, rule_name string"
    )
    rows = pol.match_policy(logs, zmap, policies).orderBy("id").collect()
    assert [(r.status, r.policy_id) for r in rows] == [c[3:] for c in CASES] * 2
    first = rows[0]
    assert (first.policy_action, first.src_zone, first.dst_zone, first.policy_logging) == ("allow", "Internal", "External", True)
    assert rows[5].message == "disabled rule, cannot be toggled" and rows[5].policy_action is None


def test_resolve_and_backfill_action(spark, zmap, policies):
    cases = [
        ("br0", "eth3", "LAN_WAN-100", None, "block", "allow"),  # the first policy decides
        ("br20", "eth3", "CUSTOM1_WAN-7", "Allow me", "allow", "block"),  # policy before description
        ("br0", "eth3", "LAN_WAN-55", "Drop this", "allow", "block"),  # description only
        ("br0", None, "LAN_LOCAL-11", "nothing", "allow", "allow"),  # neither allows nor blocks
        ("br0", "eth3", "LAN_WAN-A-100", "Block", "allow", "allow"),  # not a zone-index rule
        ("br20", "br0", "CUSTOM1_LAN-9", None, None, "block"),  # disabled policies still decide
    ]
    logs = spark.createDataFrame(
        [(i, "firewall", *c[:5]) for i, c in enumerate(cases)],
        "id int, log_type string, interface_in string, interface_out string, rule_name string, rule_desc string, rule_action string",
    )
    fixed = backfill_actions(logs, zmap, policies).orderBy("id").collect()
    assert [r.rule_action for r in fixed] == [c[5] for c in cases]
