"""Packet captures as a Spark data source: ``spark.read.format("capture").load(folder or file)``.

Classic captures (both byte orders, micro- and nanoseconds) and next-generation ones (section, interface and enhanced or simple packet blocks), with
Ethernet, VLAN tags, raw IP, Linux cooked and loopback links; IPv4, IPv6 with extension headers, TCP with options, UDP and ICMP. Other
packets are left out. A file is one partition, read as a stream; so many small captures spread over the cluster.
"""

from __future__ import annotations

import ipaddress
import os
import struct
import time
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import PACKET_DDL, packet_names

#: Bytes of a payload that are kept, unless the option ``payloadBytes`` says otherwise.
PAYLOAD = 256
SUFFIXES = (".pcap", ".pcapng", ".cap")
#: Link types by their numbers.
ETHERNET, RAW, LOOPBACK, COOKED = {1}, {12, 14, 101, 228, 229}, {0, 108}, {113}


def classic(f: BinaryIO, head: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(nanoseconds, link type, bytes) of a classic capture's packets; stops where the file breaks off."""
    order = "<" if head in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    unit = 1 if head in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1000
    rest = f.read(20)
    if len(rest) < 20:
        return
    link = struct.unpack(order + "I", rest[16:])[0] & 0xFFFF
    while len(h := f.read(16)) == 16:
        seconds, part, size, _ = struct.unpack(order + "IIII", h)
        data = f.read(size)
        if len(data) < size:
            return
        yield seconds * 1_000_000_000 + part * unit, link, data


def next_generation(f: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """The same of a next-generation capture; the file stands behind the first block's type."""
    order, links, first = "<", [], True
    while True:
        kind = b"\x0a\x0d\x0d\x0a" if first else f.read(4)
        first = False
        if len(kind) < 4:
            return
        size = f.read(4)
        if kind == b"\x0a\x0d\x0d\x0a":
            magic = f.read(4)
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
            f.read(struct.unpack(order + "I", size)[0] - 12)
            continue
        if len(size) < 4:
            return
        body = f.read(struct.unpack(order + "I", size)[0] - 8)[:-4]
        number = struct.unpack(order + "I", kind)[0]
        if number == 1 and len(body) >= 8:
            links.append((struct.unpack(order + "H", body[:2])[0], _resolution(body[8:], order)))
        elif number == 6 and len(body) >= 20:
            where, high, low, kept, _ = struct.unpack(order + "IIIII", body[:20])
            if where < len(links):
                link, per_second = links[where]
                yield ((high << 32) | low) * 1_000_000_000 // per_second, link, body[20 : 20 + kept]
        elif number == 3 and links and len(body) >= 4:
            yield 0, links[0][0], body[4 : 4 + struct.unpack(order + "I", body[:4])[0]]


def _resolution(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 9 and size:
            power = options[at + 4]
            return 2 ** (power & 0x7F) if power & 0x80 else 10**power
        if not code:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def mac(raw: bytes) -> str:
    return raw.hex(":")


def link_layer(link: int, data: bytes) -> tuple[dict, bytes] | None:
    """Facts of the link's header and the IP packet behind it."""
    if link in RAW:
        return {}, data
    if link in LOOPBACK:
        return {}, data[4:]
    if link in COOKED:
        return {"eth_type": int.from_bytes(data[14:16], "big")}, data[16:]
    if link not in ETHERNET or len(data) < 14:
        return None
    out: dict = {"dst_mac": mac(data[:6]), "src_mac": mac(data[6:12])}
    kind, at = int.from_bytes(data[12:14], "big"), 14
    while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
        out.setdefault("vlan_id", int.from_bytes(data[at : at + 2], "big") & 0xFFF)
        kind, at = int.from_bytes(data[at + 2 : at + 4], "big"), at + 4
    out["eth_type"] = kind
    if kind in (0x0800, 0x86DD):
        return out, data[at:]
    return ({}, data) if data[0] >> 4 in (4, 6) and not kind else None


def tcp_options(raw: bytes) -> dict:
    out: dict = {"tcp_options_raw": raw, "tcp_sack_permitted": False}
    at = 0
    while at < len(raw) and raw[at]:
        if raw[at] == 1:
            at += 1
            continue
        size = raw[at + 1] if at + 1 < len(raw) else 0
        if size < 2 or at + size > len(raw):
            break
        kind, body = raw[at], raw[at + 2 : at + size]
        if kind == 2 and size == 4:
            out["tcp_mss"] = int.from_bytes(body, "big")
        elif kind == 3 and size == 3:
            out["tcp_window_scale"] = body[0]
        elif kind == 4:
            out["tcp_sack_permitted"] = True
        elif kind == 5 and len(body) >= 8:
            n = [int.from_bytes(body[k : k + 4], "big") for k in range(0, len(body) - 3, 4)]
            out["tcp_sack_blocks"] = list(zip(n[::2], n[1::2]))
        elif kind == 8 and size == 10:
            out["tcp_timestamp"] = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:], "big"))
        at += size
    return out


def ip_layer(data: bytes) -> tuple[dict, int, bytes] | None:
    """Facts of an IP header, the protocol, and what it carries."""
    if len(data) < 20:
        return None
    version = data[0] >> 4
    if version == 4:
        head, total = (data[0] & 15) * 4, int.from_bytes(data[2:4], "big")
        if head < 20 or len(data) < head:
            return None
        out = {"ip_version": 4, "ip_tos": data[1], "ip_id": int.from_bytes(data[4:6], "big"), "ip_flags": data[6] >> 5, "ip_ttl": data[8], "total_len": total}
        out |= {"src_ip": str(ipaddress.IPv4Address(data[12:16])), "dst_ip": str(ipaddress.IPv4Address(data[16:20]))}
        late = int.from_bytes(data[6:8], "big") & 0x1FFF
        return out, data[9], b"" if late else data[head : total if total else None]
    if version == 6 and len(data) >= 40:
        word, size = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:6], "big")
        out = {"ip_version": 6, "ipv6_traffic_class": word >> 20 & 0xFF, "ipv6_flow_label": word & 0xFFFFF, "ip_ttl": data[7], "total_len": size + 40}
        out |= {"src_ip": str(ipaddress.IPv6Address(data[8:24])), "dst_ip": str(ipaddress.IPv6Address(data[24:40]))}
        proto, at = data[6], 40
        while proto in (0, 43, 44, 60) and at + 8 <= len(data):
            step = 8 if proto == 44 else (data[at + 1] + 1) * 8
            proto, at = data[at], at + step
        return out, proto, data[at : 40 + size]
    return None


def packet(nanos: int, link: int, data: bytes, keep: int = PAYLOAD) -> dict | None:
    """A captured frame as a packet row, without its file and number; nothing for what is not IP."""
    if (found := link_layer(link, data)) is None or (ip := ip_layer(found[1])) is None:
        return None
    out, proto, body = found[0] | ip[0], ip[1], ip[2]
    out |= {"ts_us": nanos // 1000, "protocol": proto, "src_port": 0, "dst_port": 0}
    payload = body
    if proto == 6 and len(body) >= 20:
        head = max(20, (body[12] >> 4) * 4)
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big"), "tcp_seq": int.from_bytes(body[4:8], "big"), "tcp_ack": int.from_bytes(body[8:12], "big")}
        out |= {"tcp_flags": body[13], "tcp_window": int.from_bytes(body[14:16], "big")} | tcp_options(body[20:head])
        payload = body[head:]
    elif proto == 17 and len(body) >= 8:
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big")}
        payload = body[8:]
    elif proto in (1, 58) and len(body) >= 4:
        out |= {"icmp_type": body[0], "icmp_code": body[1]}
        if len(body) >= 8 and body[0] in (0, 8, 128, 129):
            out |= {"icmp_id": int.from_bytes(body[4:6], "big"), "icmp_seq": int.from_bytes(body[6:8], "big")}
        payload = body[8:]
    return out | {"payload_len": len(payload), "raw_payload": payload[:keep] if payload and keep else None}


def frames(path: str) -> Iterator[tuple[int, int, bytes]]:
    with open(path, "rb") as f:
        head = f.read(4)
        if head == b"\x0a\x0d\x0d\x0a":
            yield from next_generation(f)
        elif head in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
            yield from classic(f, head)
        else:
            raise ValueError(f"{path} is not a packet capture")


def captures(path: str) -> list[str]:
    """The capture files of a folder, itself only, or the one file."""
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(SUFFIXES))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def rows(path: str, keep: int) -> Iterator[tuple]:
    names = packet_names()
    for number, frame in enumerate(frames(path)):
        if (p := packet(*frame, keep)) is not None:
            p |= {"file_id": os.path.basename(path), "ord": number}
            yield tuple(p.get(n) for n in names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], int(options.get("payloadBytes", PAYLOAD))

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in captures(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows(partition.path, self.keep)


class _Stream(DataSourceStreamReader):
    """New files of a folder, each read once, in whatever order they come; the offset names the files taken so far.

    A file that has grown since the look before is left for a later one, and so is one that was written to less than ``settleSeconds`` (0) ago:
    set that where writers append to files in the folder.
    """

    def __init__(self, options: dict):
        self.path, self.keep = options["path"], int(options.get("payloadBytes", PAYLOAD))
        self.settle = float(options.get("settleSeconds", 0))
        self.sizes: dict[str, int] = {}
        self.taken: set[str] = set()

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        sizes = {}
        for p in captures(self.path):
            name, found = os.path.basename(p), os.stat(p)
            sizes[name] = found.st_size
            if time.time() - found.st_mtime >= self.settle and self.sizes.get(name, found.st_size) == found.st_size:
                self.taken.add(name)
        self.sizes = sizes
        return {"files": sorted(self.taken)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = set(end["files"]) - set(start["files"])
        self.taken |= set(end["files"])  # after a restart, what was taken before
        return [_File(p) for p in captures(self.path) if os.path.basename(p) in new]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows(partition.path, self.keep)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """``spark.dataSource.register(CaptureSource)`` makes the format ``capture``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET_DDL.strip()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
