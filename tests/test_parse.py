"""Line formats, literal cases."""

import pytest

from netlens.config import NetConfig
from netlens.functions import rules
from netlens.plans import parse

NOW = "2024-02-10 12:00:00"
CFG = NetConfig(wan_ips=("203.0.113.7",))
HEAD = "Feb  8 16:43:49 GW "


def parsed(spark, lines, cfg=CFG, now=NOW):
    df = spark.createDataFrame([(i, text) for i, text in enumerate(lines)], "n int, raw_log string")
    out = parse.derive(parse.parse_lines(df, cfg, now), cfg)
    return [r.asDict() for r in out.orderBy("n").collect()]


def only(row, **expected):
    assert {k: row[k] for k in expected} == expected


def test_firewall_lines(spark):
    rows = parsed(
        spark,
        [
            HEAD + 'kernel: [WAN_LAN-B-4000000003-D]IN=ppp0 OUT=br10 MAC=aa:aa:aa:aa:aa:aa:BB:00:00:00:00:01:08:00 SRC=8.8.8.8 DST=192.168.1.2',
            HEAD + "[WAN_LAN-B-4000000003-D]IN=ppp0 OUT=br10 MAC=aa:aa:aa:aa:aa:aa:bb:00:00:00:00:01:08:00"
            " SRC=8.8.8.8 DST=192.168.1.2 PROTO=TCP SPT=5000 DPT=443",
            HEAD + '[GUEST_WAN-30004] DESCR="[GUEST_WAN]Block all" IN=br5 OUT=ppp0 SRC=192.168.5.2 DST=9.9.9.9 PROTO=UDP SPT=1 DPT=53',
            HEAD + "IN=br5 OUT= SRC=2001:DB8:0:0:0:0:0:1 DST=ff02::1 PROTO=ICMP",
            HEAD + '[X-A-1] DESCR="" IN=br5 OUT=br6 SRC=999.1.1.1 DST=192.168.1.3 PROTO=TCP MAC=aa:bb:cc',
            HEAD + '[something] DESCR="no fields"',
        ],
    )
    only(rows[0], log_type="system", parse_error=None)  # no PROTO
    only(
        rows[1], log_type="firewall", rule_name="WAN_LAN-B-4000000003-D", interface_in="ppp0", interface_out="br10",
        src_ip="8.8.8.8", dst_ip="192.168.1.2", protocol="tcp", src_port=5000, dst_port=443,
        mac_address="bb:00:00:00:00:01", rule_action="block", direction="inbound", rule_desc=None,
    )
    only(rows[2], rule_desc="[GUEST_WAN]Block all", rule_action="block", direction="outbound")
    only(rows[3], src_ip="2001:db8::1", dst_ip="ff02::1", interface_out=None, direction="local", rule_name=None, rule_action=None)
    only(rows[4], src_ip=None, dst_ip="192.168.1.3", mac_address=None, rule_desc="", direction="inter_vlan", rule_action="allow")
    only(rows[5], log_type="firewall", rule_name="something", rule_desc="no fields", direction=None, rule_action="allow")


def test_dns_lines(spark):
    rows = parsed(
        spark,
        [HEAD + "dnsmasq[1]: " + text for text in (
            "query[AAAA] example.com from 192.168.1.5", "reply example.com is 93.184.216.34",
            "forwarded example.com to 9.9.9.9", "cached example.com is <CNAME>", "reply but nothing else",
        )],
    )
    only(rows[0], log_type="dns", dns_type="AAAA", dns_query="example.com", src_ip="192.168.1.5", dns_answer=None)
    only(rows[1], dns_query="example.com", dns_answer="93.184.216.34", dns_type=None)
    only(rows[2], dns_query="example.com", dst_ip="9.9.9.9", src_ip=None)
    only(rows[3], dns_query="example.com", dns_answer="<CNAME>")
    only(rows[4], log_type="dns", dns_query=None, dns_answer=None)


def test_dhcp_lines(spark):
    mac = "aa:bb:cc:dd:ee:ff"
    rows = parsed(
        spark,
        [HEAD + "dnsmasq-dhcp[1]: " + text for text in (
            f"DHCPACK(br0) 192.168.1.5 {mac} laptop", f"DHCPACK(br0) 192.168.1.5 {mac}", f"DHCPDISCOVER(br0) {mac}",
            f"DHCPDISCOVER(br0) 192.168.1.9 {mac}", f"DHCPREQUEST(br0) 192.168.1.5 {mac}", f"DHCPOFFER(br0) 192.168.1.5 {mac}",
            "something else",
        )],
    )
    only(rows[0], log_type="dhcp", dhcp_event="DHCPACK", interface_in="br0", src_ip="192.168.1.5", mac_address=mac, hostname="laptop")
    only(rows[1], dhcp_event="DHCPACK", hostname=None)
    only(rows[2], dhcp_event="DHCPDISCOVER", src_ip=None, mac_address=mac)
    only(rows[3], dhcp_event="DHCPDISCOVER", src_ip="192.168.1.9")
    only(rows[4], dhcp_event="DHCPREQUEST", hostname=None)
    only(rows[5], dhcp_event="DHCPOFFER")
    only(rows[6], log_type="dhcp", dhcp_event=None, mac_address=None)


def test_wifi_and_system_lines(spark):
    rows = parsed(
        spark,
        [HEAD + text for text in (
            "hostapd: ath0: STA aa:bb:cc:dd:ee:ff IEEE 802.11: associated",
            "hostapd: ath0: STA aa:bb:cc:dd:ee:ff did something",
            'stahtd: {"mac":"aa:bb:cc:dd:ee:ff","event_type":"fixup"}',
            'stahtd: {"mac":"aa:bb:cc:dd:ee:ff","message_type":"tracker"}',
            'stahtd: {"mac":"aa:bb:cc:dd:ee:ff"}', "stahtd: {broken", "systemd[1]: started",
        )],
    )
    only(rows[0], log_type="wifi", wifi_event="associated", mac_address="aa:bb:cc:dd:ee:ff")
    only(rows[1], wifi_event="ath0", mac_address="aa:bb:cc:dd:ee:ff")
    only(rows[2], wifi_event="fixup", mac_address="aa:bb:cc:dd:ee:ff")
    only(rows[3], wifi_event="tracker")
    only(rows[4], wifi_event="stahtd", mac_address="aa:bb:cc:dd:ee:ff")
    only(rows[5], wifi_event="stahtd", mac_address=None)
    only(rows[6], log_type="system", direction=None)


def test_header_priority_and_quarantine(spark):
    rows = parsed(
        spark,
        [
            "<13>" + HEAD + "systemd[1]: x", "no header here", "Feb 30 10:00:00 GW x", "Févr  3 10:00:00 hôte y",
            "Feb  8 10:00:00 GW [" + "R" * 120 + "]IN=a OUT=b SRC=1.1.1.1 DST=2.2.2.2 PROTO=TCP", "Feb  8 25:00:00 GW x",
        ],
    )
    only(rows[0], parse_error=None, log_type="system", raw_log="<13>" + HEAD + "systemd[1]: x")
    assert [r["parse_error"] for r in rows[1:]] == ["header", "timestamp", None, "size", "timestamp"]
    assert rows[3]["timestamp"].month == 1  # an unknown month counts as January


@pytest.mark.parametrize(
    "line, now, tz, expected",
    [
        ("Feb  8 16:43:49", "2024-02-10 12:00:00", "UTC", "2024-02-08 16:43:49"),
        ("Dec 31 23:59:59", "2024-01-01 00:00:05", "UTC", "2023-12-31 23:59:59"),
        ("Mar  1 00:00:00", "2024-02-29 23:59:00", "UTC", "2024-03-01 00:00:00"),
        ("Feb  8 16:00:00", "2024-02-10 12:00:00", "America/New_York", "2024-02-08 21:00:00"),
        ("Jul  1 12:00:00", "2024-07-02 12:00:00", "Europe/Berlin", "2024-07-01 10:00:00"),
    ],
)
def test_timestamps(spark, line, now, tz, expected):
    (row,) = parsed(spark, [line + " GW x"], NetConfig(timezone=tz), now)
    assert str(row["timestamp"]) == expected


def test_source_mac(spark):
    df = spark.createDataFrame([("1:2:3:4:5:6:7:8:9:a:b:c:08:00",), ("1:2:3",), (None,)], "m string")
    assert [r[0] for r in df.select(parse.source_mac("m")).collect()] == ["7:8:9:a:b:c", "1:2:3", None]


DIRECTIONS = [
    (None, None, "R", None, None, None), ("ppp0", "br0", "R", None, None, "inbound"), ("br0", "ppp0", "R", None, None, "outbound"),
    ("br0", "br5", "R", None, None, "inter_vlan"), ("br0", "br0", "R", None, None, "local"), ("ppp0", None, "R", None, None, "inbound"),
    ("br0", "", "R", None, None, "local"), ("wgsrv1", "br0", "R", None, None, "vpn"), ("br0", "tunovpnc1", "R", None, None, "vpn"),
    ("ppp0", "br0", "PREROUTING-DNAT-1", None, None, "nat"), ("br0", "ppp0", "R", None, "255.255.255.255", "local"),
    ("br0", "ppp0", "R", None, "224.0.0.251", "local"), ("br0", "br5", "R", "203.0.113.7", None, "local"),
    ("br0", "ppp0", "R", "203.0.113.7", None, "outbound"), (None, "br5", "R", None, None, "inter_vlan"),
    ("ppp0", "ppp0", "R", None, None, "local"), ("ppp0", "", "X-DNAT", None, None, "nat"),
]


def test_direction(spark):
    df = spark.createDataFrame(DIRECTIONS, "i string, o string, rule string, src string, dst string, want string")
    for row in df.withColumn("got", rules.direction_of("i", "o", "rule", "src", "dst", CFG)).collect():
        assert row.got == row.want, row


ACTIONS = [
    ("WAN_LAN-A-1", None, "allow"), ("WAN_LAN-B-1", None, "block"), ("WAN_LAN-D-1-D", None, "block"), ("WAN_LAN-R-1", None, "block"),
    ("X-DNAT-1", None, "redirect"), ("PREROUTING", None, "redirect"), ("LAN_WAN-3", None, None), ("LAN_WAN-3", "Drop it", "block"),
    ("LAN_WAN-3", "we ALLOW it", "allow"), ("LAN_WAN-3", "blocked", None), ("odd name", None, "allow"), (None, "Block", None), ("", None, None),
]


def test_action_and_rule_parse(spark):
    df = spark.createDataFrame(ACTIONS, "rule string, descr string, want string")
    for row in df.withColumn("got", rules.action_of("rule", "descr")).withColumn("p", rules.rule_parse("rule", "descr")).collect():
        assert row.got == row.want, row
        if row.p is not None and row.rule:
            assert (row.p.resolved_action or row.p.desc_hint) == row.want
    one = spark.createDataFrame([("CUSTOM2_WAN-A-4000000003-D",)], "r string").select(rules.rule_parse("r").alias("p")).first().p
    assert (one.format, one.chain, one["index"], one.action_code, one.action_source) == ("legacy", "CUSTOM2_WAN", 4000000003, "A", "rule_name")


def test_learned_wan_ip(spark):
    lines = [
        HEAD + "[WAN_LOCAL-A-1]IN=ppp0 OUT= SRC=8.8.8.8 DST=9.9.9.10 PROTO=TCP",
        HEAD + "[LAN_WAN-A-1]IN=br0 OUT=br5 SRC=9.9.9.10 DST=192.168.1.1 PROTO=TCP",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, raw_log string")
    rows = parse.derive_learning(parse.good_rows(parse.parse_lines(df, NetConfig(), NOW)), NetConfig())
    assert [r.direction for r in rows.orderBy("n").collect()] == ["inbound", "local"]
    assert [r.wan_ip for r in parse.learn_wan_ips(rows, ["ppp0"]).collect()] == ["9.9.9.10"]


def test_drop_disabled(spark):
    df = spark.createDataFrame([("wifi",), ("dns",), ("system",)], "log_type string")
    assert [r[0] for r in parse.drop_disabled(df, ["wifi", "dns"]).orderBy("log_type").collect()] == ["dns", "system"]
    assert parse.drop_disabled(df, []).count() == 3
