"""Column builders that the feature groups share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ever(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def kinds(value: str | Column) -> Column:
    """How many different values there are. A set for each session, of a domain that the wire format bounds: a distinct count would have Spark copy every packet once for each such column."""
    return F.size(F.collect_set(F.col(value) if isinstance(value, str) else value)).cast("long")


def only(value, cond: Column | None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value if cond is None else F.when(cond, value)


def or_zero(c: Column, zero=0) -> Column:
    return F.coalesce(c, F.lit(zero))


def real(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, other=0.0) -> Column:
    """``a / b`` where ``b`` is above 0, else ``other``."""
    return F.when(b > 0, a.cast("double") / b).otherwise(other if isinstance(other, Column) else F.lit(other))


def first(value: str | Column, cond: Column | None = None) -> Column:
    """The value of the first packet that meets the condition."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, F.col("pos")) if cond is None else F.min_by(value, F.when(cond, F.col("pos")))


def last(value: str | Column, cond: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.col("pos")) if cond is None else F.max_by(value, F.when(cond, F.col("pos")))


def percentiles(value: Column, shares: list[float]) -> Column:
    """Exact percentiles with linear interpolation, an array; one buffer for all of them."""
    return F.percentile(value, F.array(*map(F.lit, shares)))


def bits(*parts: tuple[Column, int]) -> Column:
    """The sum of the bits whose conditions hold."""
    total = F.lit(0)
    for cond, bit in parts:
        total = total + F.when(cond, F.lit(bit)).otherwise(F.lit(0))
    return total


def hashed_ip(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), ip).cast("binary"), 256), 1, 16)


def flow_id(salt: str) -> Column:
    """Identity of the endpoint pair, the same for all its sessions."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.concat_ws(":", "ip_a", F.col("port_a").cast("string"), "ip_b", F.col("port_b").cast("string"), F.col("protocol").cast("string"))).cast("binary"), 256), 1, 32)


def is_grease(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A


def ja3_string(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    """Version and four lists, reserved values left out."""
    lists = [F.array_join(F.transform(F.filter(a, lambda v: ~is_grease(v)), lambda v: v.cast("string")), "-") for a in (ciphers, extensions, curves)]
    return F.concat_ws(",", version.cast("string"), *lists, F.array_join(F.transform(formats, lambda v: v.cast("string")), "-"))


def ja3s_string(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), cipher.cast("string"), F.array_join(F.transform(F.filter(extensions, lambda v: ~is_grease(v)), lambda v: v.cast("string")), "-"))


def rounded(value: Column, policy: str = "none") -> Column:
    """A value under a policy: ``none`` keeps it, ``integer`` cuts the fraction, ``decimals_N`` rounds to N places."""
    if policy == "none":
        return value
    if policy == "integer":
        return value.cast("long")
    return F.round(value, int(policy.removeprefix("decimals_")))


#: The service names of ports that have one.
PORT_NAMES = {
    20: "ftp-data",
    21: "ftp",
    22: "ssh",
    23: "telnet",
    25: "smtp",
    53: "dns",
    67: "dhcp",
    68: "dhcp",
    69: "tftp",
    80: "http",
    110: "pop3",
    119: "nntp",
    123: "ntp",
    143: "imap",
    161: "snmp",
    162: "snmp-trap",
    443: "https",
    445: "smb",
    465: "smtps",
    514: "syslog",
    587: "smtp-submission",
    636: "ldaps",
    853: "dns-over-tls",
    993: "imaps",
    995: "pop3s",
    1080: "socks",
    1194: "openvpn",
    1433: "mssql",
    1521: "oracle",
    1723: "pptp",
    3306: "mysql",
    3389: "rdp",
    5060: "sip",
    5061: "sips",
    5222: "xmpp",
    5432: "postgresql",
    5900: "vnc",
    6379: "redis",
    6667: "irc",
    8080: "http-alt",
    8443: "https-alt",
    8888: "http-alt",
    9000: "php-fpm",
    9200: "elasticsearch",
    27017: "mongodb",
}


def port_class(port: Column) -> tuple[Column, Column]:
    """Name and number of a port: its service's name, or its range's; 1 below 1024, 2 below 49152, 3 above."""
    number = F.when(port < 1024, F.lit(1)).when(port < 49152, F.lit(2)).otherwise(F.lit(3))
    range_ = F.element_at(F.array(*map(F.lit, ("system", "registered", "dynamic"))), number)
    names = F.create_map(*(F.lit(x) for pair in PORT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, port), range_), number
