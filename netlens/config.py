"""Settings of one site and the fixed values the log format and its users rely on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta

# Selectable time ranges.
TIME_RANGES = {
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
    "60d": timedelta(days=60),
    "90d": timedelta(days=90),
    "180d": timedelta(days=180),
    "365d": timedelta(days=365),
}
DEFAULT_RANGE = "24h"

# Chart bucket per time range; anything else is charted by day.
TIME_BUCKETS = {
    "1h": "hour", "6h": "hour", "24h": "hour",
    "7d": "day", "30d": "day", "60d": "day",
    "90d": "week",
    "180d": "month", "365d": "month",
}

# VPN interface prefixes in match order (first match wins, so
# "tunovpnc" stands before "tun") with their badge and description.
VPN_PREFIXES = (
    ("wgsrv", "WGD SRV", "WireGuard Server"),
    ("wgclt", "WGD CLT", "WireGuard Client"),
    ("wgsts", "S MAGIC", "Site Magic"),
    ("tlprt", "TELEPORT", "Teleport"),
    ("vti", "S2S IPSEC", "Site-to-Site IPsec"),
    ("tunovpnc", "OVPN CLT", "OpenVPN Client"),
    ("tun", "OVPN TUN", "OpenVPN / Tunnel 1"),
    ("vtun", "OVPN VTN", "OpenVPN / Tunnel 2"),
    ("l2tp", "L2TP SRV", "L2TP Server"),
)

# Firewall zone name (lower case) -> chain name.
ZONE_CHAINS = {
    "internal": "LAN",
    "external": "WAN",
    "gateway": "LOCAL",
    "hotspot": "GUEST",
    "vpn": "VPN",
    "dmz": "DMZ",
}

# DNS-query status -> action; any other status is allowed.
DNS_STATUS_ACTIONS = {
    "FORWARDED": "allow",
    "CACHE": "allow",
    "RETRIED": "allow",
    "RETRIED_DNSSEC": "allow",
    "ALREADY_FORWARDED": "allow",
    "GRAVITY": "block",
    "REGEX": "block",
    "DENYLIST": "block",
    "EXTERNAL_BLOCKED_IP": "block",
    "EXTERNAL_BLOCKED_NULL": "block",
    "EXTERNAL_BLOCKED_NXRA": "block",
    "SPECIAL_DOMAIN": "block",
    "DBBUSY": "block",
}
DNS_RESOLVABLE_TYPES = ("A", "AAAA")
DNS_FAILED_REPLIES = ("NXDOMAIN", "NODATA", "SERVFAIL", "REFUSED", "NONE")

# How long a reverse-name answer stays valid, by its status.
RDNS_TTL_SECONDS = {"success": 86_400, "failure": 604_800, "transient": 3_600}

# Lower bounds of the threat bands, highest first.
THREAT_BANDS = ((75, "Critical"), (50, "High"), (25, "Medium"), (1, "Low"), (0, "Clean"))

# Abuse category codes.
ABUSE_CATEGORIES = {
    1: "DNS Compromise", 2: "DNS Poisoning", 3: "Fraud Orders", 4: "DDoS Attack",
    5: "FTP Brute-Force", 6: "Ping of Death", 7: "Phishing", 8: "Fraud VoIP",
    9: "Open Proxy", 10: "Web Spam", 11: "Email Spam", 12: "Blog Spam",
    13: "VPN IP", 14: "Port Scan", 15: "Hacking", 16: "SQL Injection",
    17: "Spoofing", 18: "Brute-Force", 19: "Bad Web Bot", 20: "Exploited Host",
    21: "Web App Attack", 22: "SSH", 23: "IoT Targeted",
}

# A parameter whose name contains one of these is masked.
SENSITIVE_KEYS = ("password", "secret", "token", "api_key", "credentials", "ssn", "credit_card")

# The six detail columns a reputation row carries besides score and categories.
ABUSE_DETAILS = (
    "abuse_usage_type", "abuse_hostnames", "abuse_total_reports",
    "abuse_last_reported", "abuse_is_whitelisted", "abuse_is_tor",
)


@dataclass(frozen=True)
class NetConfig:
    """What a site knows about itself. Small by nature: it is written by hand or
    read from one controller, so expressions may carry it as literals."""

    wan_interfaces: tuple[str, ...] = ("ppp0",)
    wan_ips: tuple[str, ...] = ()
    gateway_vlans: Mapping[str, int | None] = field(default_factory=dict)
    wan_ip_names: Mapping[str, str] = field(default_factory=dict)
    # interface -> (cidr, badge)
    vpn_networks: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    interface_labels: Mapping[str, str] = field(default_factory=dict)
    dns_enrichment: str = "both"  # none | geoip | threat | both
    rdns_enabled: bool = True
    timezone: str = "UTC"

    @property
    def gateway_ips(self) -> tuple[str, ...]:
        return tuple(sorted(self.gateway_vlans))

    @property
    def own_ips(self) -> tuple[str, ...]:
        """Addresses that belong to the site itself and are never enriched."""
        return tuple(dict.fromkeys((*self.wan_ips, *self.gateway_ips)))

    @property
    def excluded_top_ips(self) -> tuple[str, ...]:
        """Addresses left out of the top-talker lists."""
        return tuple(dict.fromkeys(("0.0.0.0", *self.wan_ips)))
