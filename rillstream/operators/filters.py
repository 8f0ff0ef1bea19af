"""Packet filters: capture expressions, and the sockets of a process."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}
_TOKEN = re.compile(r"\s*(\(|\)|!|&&|\|\||<=|>=|[^\s()!&|]+)")


class _Reader:
    """Recursive descent over ``or`` < ``and`` < ``not`` < primitive."""

    def __init__(self, text: str):
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if (t := self.peek()) is None:
            raise ValueError("the filter breaks off")
        self.at += 1
        return t

    def any(self) -> Column:
        out = self.all()
        while self.peek() in ("or", "||"):
            self.take()
            out = out | self.all()
        return out

    def all(self) -> Column:
        out = self.one()
        while self.peek() in ("and", "&&"):
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() in ("not", "!"):
            self.take()
            return ~self.one()
        if self.peek() == "(":
            self.take()
            out = self.any()
            if self.take() != ")":
                raise ValueError("a bracket is open")
            return out
        return self.primitive()

    def primitive(self) -> Column:
        word, side, proto = self.take(), None, None
        if word in PROTOCOLS:
            proto = F.col("protocol") == PROTOCOLS[word]
            if self.peek() not in ("src", "dst", "port", "portrange", "host", "net"):
                return proto
            word = self.take()
        elif word in ("ip", "ip6"):
            return F.coalesce(F.col("ip_version"), F.lit(4)) == (4 if word == "ip" else 6)
        if word in ("src", "dst"):
            side, word = word, self.take()
        if word in ("less", "greater"):
            return F.col("total_len") <= int(self.take()) if word == "less" else F.col("total_len") >= int(self.take())
        if word == "vlan":
            return F.col("vlan_id").isNotNull()
        test = self.test(word)
        sides = [side] if side else ["src", "dst"]
        out = test(sides[0])
        for s in sides[1:]:
            out = out | test(s)
        return out if proto is None else proto & out

    def test(self, word: str):
        if word == "host":
            value = self.take()
            return lambda s: F.col(f"{s}_ip") == value
        if word == "net":
            value = self.take()
            return lambda s: _in_net(F.col(f"{s}_ip"), value)
        if word == "port":
            value = int(self.take())
            return lambda s: F.col(f"{s}_port") == value
        if word == "portrange":
            low, high = map(int, self.take().split("-"))
            return lambda s: F.col(f"{s}_port").between(low, high)
        raise ValueError(f"unknown word {word!r} in the filter")


def _in_net(ip: Column, net: str) -> Column:
    """Whether an IPv4 address is in ``a.b.c.d/n``."""
    base, _, bits = net.partition("/")
    n = int(bits or 32)
    number = lambda c: sum((F.try_element_at(F.split(c, r"\."), F.lit(k + 1)).try_cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0))
    want = sum(int(x) * 256 ** (3 - k) for k, x in enumerate(base.split(".")))
    return F.coalesce(F.shiftright(number(ip), 32 - n) == want >> (32 - n), F.lit(False))


def expression(text: str) -> Column:
    """A capture filter as a condition: protocols, ``host``, ``net``, ``port``, ``portrange`` with ``src`` or ``dst``, ``less``, ``greater``, ``vlan``, ``and``, ``or``, ``not`` and brackets."""
    reader = _Reader(text)
    out = reader.any()
    if reader.peek() is not None:
        raise ValueError(f"the filter goes on with {reader.peek()!r}")
    return out


def of_sockets(packets: DataFrame, sockets: DataFrame) -> DataFrame:
    """Packets that meet a socket: ``protocol, local_ip, local_port, remote_ip, remote_port``, in either direction.

    A null or unspecified remote end stands for any (a listening socket), and so does an unspecified local address. Exact sockets are met by an equality join; the others,
    which are few, by their local port, and the condition on addresses.
    """
    any_ip = ("", "0.0.0.0", "::", "*")
    open_ = F.col("remote_ip").isNull() | F.col("remote_ip").isin(*any_ip) | F.coalesce(F.col("remote_port") == 0, F.lit(True))
    exact = sockets.where(~open_).distinct()
    turned = exact.select("protocol", F.col("remote_ip").alias("local_ip"), F.col("remote_port").alias("local_port"), F.col("local_ip").alias("remote_ip"), F.col("local_port").alias("remote_port"))
    ends = exact.select(turned.columns).unionByName(turned).distinct().toDF("protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    keys = ends.columns
    met = packets.join(ends, keys, "left_semi")
    wild = sockets.where(open_).select(F.col("protocol").alias("s_protocol"), F.col("local_port").alias("s_port"), F.when(~F.col("local_ip").isin(*any_ip), F.col("local_ip")).alias("s_ip")).distinct()
    rest = packets.join(ends, keys, "left_anti")
    fits = lambda s: (F.col(f"{s}_port") == F.col("s_port")) & (F.col("protocol") == F.col("s_protocol")) & (F.col("s_ip").isNull() | (F.col("s_ip") == F.col(f"{s}_ip")))
    from_ = rest.join(wild, fits("src"), "left_semi")
    to = rest.join(wild, fits("src"), "left_anti").join(wild, fits("dst"), "left_semi")
    return met.unionByName(from_).unionByName(to)


def observed(packets: DataFrame, name: str = "packets") -> DataFrame:
    """The packets, with counts that a listener can read while they pass: packets, bytes, and packets without a protocol that is known."""
    known = F.col("protocol").isin(*PROTOCOLS.values())
    return packets.observe(name, F.count(F.lit(1)).alias("packets"), F.sum("total_len").alias("bytes"), F.count_if(~known).alias("other"))


def differences(features: DataFrame, golden: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Where features differ from golden ones: ``keys, feature, got, want``; numbers within the tolerance, and null, NaN and empty text, are equal."""
    shared = [c for c in golden.columns if c in features.columns and c not in keys]
    text = lambda df, c: F.nullif(F.nullif(df[c].cast("string"), F.lit("")), F.lit("NaN"))
    both = features.alias("f").join(golden.alias("g"), keys, "full_outer")
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), text(features, c).alias("got"), text(golden, c).alias("want")) for c in shared))
    each = both.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    number = F.abs(F.col("got").try_cast("double") - F.col("want").try_cast("double")) <= tolerance
    return each.where(~(F.col("got").eqNullSafe(F.col("want")) | F.coalesce(number, F.lit(False))))
