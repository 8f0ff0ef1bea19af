"""Feature groups of payloads: TLS, QUIC, SSH, DNS, HTTP/2 and byte entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import parsers as P
from ..functions.columns import count, ever, first, ja3_string, ja3s_string, only, or_zero, ratio, real
from .base import Columns, Group
from .flow_features import bwd, fwd, in_order

EMPTY = ""


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def named(value: Column, names: dict[int, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value.cast("int")), other)


def hexed(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def byte(at: int, of: str = "raw_payload") -> Column:
    """The byte at a place of the payload, null beyond its end."""
    return F.conv(F.nullif(F.hex(F.substring(F.col(of), at + 1, 1)), F.lit("")), 16, 10).cast("int")


# tls ------------------------------------------------------------------------

#: Names of versions and of key exchange groups.
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_GROUPS = {
    0x0017: "secp256r1",
    0x0018: "secp384r1",
    0x0019: "secp521r1",
    0x001D: "x25519",
    0x001E: "x448",
    0x0100: "ffdhe2048",
    0x0101: "ffdhe3072",
    0x0102: "ffdhe4096",
    0x0103: "ffdhe6144",
    0x0104: "ffdhe8192",
    0x6399: "X25519Kyber768Draft00",
    0x0200: "secp256r1_kyber768",
}


def tls_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("tls", F.when(byte(0) == P.HANDSHAKE, P.tls_facts("raw_payload")))


def tls_aggregate(cfg: Config) -> Columns:
    t = F.col("tls")
    return {
        "x_ch": first(t, fwd() & (t["kind"] == P.CLIENT_HELLO)),
        "x_sh": first(t, bwd() & (t["kind"] == P.SERVER_HELLO)),
        "x_ske": first(t["exchange"], bwd() & t["exchange"].isNotNull()),
        "x_certs": first(t["certificates"], bwd() & t["certificates"].isNotNull()),
        "x_n": count(byte(0) == P.HANDSHAKE),
    }


def tls_finish(cfg: Config) -> Columns:
    c = F.col
    ch, sh, ske, certs = c("x_ch"), c("x_sh"), c("x_ske"), F.coalesce("x_certs", F.array().cast("array<int>"))
    seen = ch.isNotNull()
    has = lambda ext: F.coalesce(F.array_contains(ch["extensions"], ext), F.lit(False))
    ticket, psk, early = has(P.TICKET), has(P.PRE_SHARED_KEY), has(P.EARLY_DATA)
    sid = or_zero(ch["session_id_len"])
    n = F.size(certs)
    group = F.coalesce(ske["group"], ch["share_group"])
    name = F.coalesce(ske["name"], named(group, TLS_GROUPS, F.concat(F.lit("unknown(0x"), hexed(group, 4), F.lit(")"))))
    version = ch["version"]
    ja3 = F.md5(ja3_string(version, ch["ciphers"], ch["extensions"], ch["curves"], ch["formats"]).cast("binary"))
    ja3s = F.md5(ja3s_string(sh["version"], sh["cipher"], sh["extensions"]).cast("binary"))
    return {
        "tls_detected": seen,
        "tls_version": or_zero(version),
        "tls_version_str": text(F.when(version.isNotNull(), named(version, TLS_VERSIONS, F.concat(F.lit("Unknown (0x"), hexed(version, 4), F.lit(")"))))),
        "tls_cipher_suite": or_zero(sh["cipher"]),
        "tls_cipher_count": or_zero(F.when(ch["ciphers"].isNotNull(), F.size(ch["ciphers"]))),
        "tls_extension_count": or_zero(F.when(ch["whole"], F.size(ch["extensions"]))),
        "tls_sni": text(ch["sni"]),
        "tls_alpn": text(ch["alpn"]),
        "ja3_hash": text(F.when(ch["whole"], ja3)),
        "ja3s_hash": text(F.when(sh["whole"], ja3s)),
        "tls_handshake_packets": c("x_n"),
        "tls_cert_count": n,
        "tls_cert_total_length": F.aggregate(certs, F.lit(0).cast("long"), lambda a, v: a + v),
        "tls_cert_first_length": or_zero(F.get(certs, F.lit(0))),
        "tls_cert_chain_length": n,
        "tls_session_id_len": sid,
        "tls_session_ticket_ext": ticket,
        "tls_session_resumed": seen & (n == 0) & ((sid > 0) | ticket | psk),
        "tls_psk_ext": psk,
        "tls_early_data_ext": early,
        "tls_key_exchange_group": or_zero(group),
        "tls_key_exchange_group_name": text(F.when(group.isNotNull(), name)),
        "tls_key_exchange_length": or_zero(F.coalesce(ske["bits"], ch["share_bits"])),
    }


# quic -----------------------------------------------------------------------


def quic_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    size, b0 = F.octet_length("raw_payload"), byte(0)
    udp = F.col("protocol") == 17
    long = udp & (b0.bitwiseAND(F.lit(0xC0)) == 0xC0) & (size >= 5)
    short = udp & (b0.bitwiseAND(F.lit(0xC0)) == 0x40) & (size >= 2)
    df = df.withColumns({"quic_long": F.coalesce(long, F.lit(False)), "quic_short": F.coalesce(short, F.lit(False)), "quic_b0": b0})
    spin = F.when(F.col("quic_short"), F.col("quic_b0").bitwiseAND(F.lit(0x20)))
    earlier = in_order().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("quic_flip", F.col("quic_short") & (spin != F.last(spin, ignorenulls=True).over(earlier)))
    shown = F.when(F.col("quic_long"), P.quic_facts("raw_payload"))
    return df.withColumn("quic", shown)


def quic_aggregate(cfg: Config) -> Columns:
    c = F.col
    dcid = byte(5)
    at = F.expr("try_cast(conv(nullif(hex(substring(raw_payload, 7 + try_cast(conv(nullif(hex(substring(raw_payload, 6, 1)), ''), 16, 10) AS INT), 1)), ''), 16, 10) AS INT)")
    head = F.struct(
        c("quic_long").alias("long"),
        c("quic_b0").alias("b0"),
        F.octet_length("raw_payload").alias("size"),
        F.conv(F.nullif(F.hex(F.substring("raw_payload", 2, 4)), F.lit("")), 16, 10).cast("long").alias("version"),
        dcid.alias("dcid"),
        at.alias("scid"),
        c("quic").alias("shown"),
    )
    initial = c("quic_long") & (F.octet_length("raw_payload") > 5) & (c("quic_b0").bitwiseAND(F.lit(0x30)) == 0)
    return {"k_first": first(head, c("quic_long") | c("quic_short")), "k_initial": count(initial), "k_flip": ever(c("quic_flip"))}


def quic_finish(cfg: Config) -> Columns:
    q = F.col("k_first")
    long = F.coalesce(q["long"] & (q["size"] >= 6), F.lit(False))
    kind = F.shiftright(q["b0"].bitwiseAND(F.lit(0x30)), 4)
    v = F.when(long, q["version"])
    draft = v.bitwiseAND(F.lit(0xFFFFFF00)) == 0xFF000000
    shown = F.when(draft, F.concat(F.lit("QUIC draft-"), v.bitwiseAND(F.lit(0xFF)).cast("string"))).when(v == 1, "QUIC v1").when(v == 0x6B3343CF, "QUIC v2").otherwise(F.concat(F.lit("Unknown (0x"), hexed(v, 8), F.lit(")")))
    whole = long & q["scid"].isNotNull()
    return {
        "quic_detected": q.isNotNull(),
        "quic_version": or_zero(v),
        "quic_version_str": text(F.when(v.isNotNull(), shown)),
        "quic_dcid_len": or_zero(F.when(long, q["dcid"])),
        "quic_scid_len": or_zero(F.when(long, q["scid"])),
        "quic_pn_length": F.when(q.isNotNull() & (whole | ~q["long"]), q["b0"].bitwiseAND(F.lit(3)) + 1).otherwise(F.lit(0)),
        "quic_initial_packets": F.col("k_initial"),
        "quic_0rtt_detected": long & (kind == 1),
        "quic_retry_detected": long & (kind == 3),
        "quic_spin_bit": F.col("k_flip") | F.coalesce(~q["long"] & (q["b0"].bitwiseAND(F.lit(0x20)) != 0), F.lit(False)),
        "quic_alpn": text(q["shown"]["alpn"]),
        "quic_sni": text(q["shown"]["sni"]),
    }


# ssh ------------------------------------------------------------------------


def ssh_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    df = df.withColumn("ssh", F.when(F.col("protocol") == 6, P.ssh_facts("raw_payload")))
    new = F.max((F.col("ssh.message") == P.NEWKEYS).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("ssh_after", F.coalesce((new == 1) & (F.col("ssh.message") != P.NEWKEYS), F.lit(False)))


def ssh_aggregate(cfg: Config) -> Columns:
    s = F.col("ssh")
    out = {"y_kex": count(s["message"].between(20, 49)), "y_after": count(F.col("ssh_after"))}
    for name, here in (("client", fwd()), ("server", bwd())):
        out |= {f"y_{name}": first(s, here & s["banner"]), f"y_{name}_lists": first(F.struct(s[f"{name}_lists"].alias("v")), here & (s["message"] == P.KEXINIT))}
    return out


def ssh_finish(cfg: Config) -> Columns:
    c, s = F.col("y_client"), F.col("y_server")
    digest = lambda side: text(F.md5(F.col(f"y_{side}_lists.v").cast("binary")))
    return {
        "ssh_detected": c.isNotNull() | s.isNotNull(),
        "ssh_version": text(F.coalesce(F.nullif(c["version"], F.lit("")), s["version"])),
        "ssh_client_software": text(c["software"]),
        "ssh_server_software": text(s["software"]),
        "ssh_client_version": text(c["version"]),
        "ssh_server_version": text(s["version"]),
        "ssh_hassh": digest("client"),
        "ssh_hassh_server": digest("server"),
        "ssh_kex_packets": F.col("y_kex"),
        "ssh_encrypted_packets": F.col("y_after"),
    }


# dns ------------------------------------------------------------------------

#: Names of record types and response codes.
DNS_TYPES = {1: "A", 28: "AAAA", 5: "CNAME", 15: "MX", 16: "TXT", 2: "NS", 6: "SOA", 12: "PTR", 33: "SRV", 65: "HTTPS", 255: "ANY"}
DNS_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}


def dns_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    fits = (F.col("protocol") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53)) & (F.octet_length("raw_payload") >= 12)
    return df.withColumn("dns", F.when(fits, P.dns_facts("raw_payload")))


def dns_aggregate(cfg: Config) -> Columns:
    return {"n_first": first("dns", F.col("dns").isNotNull())}


def dns_finish(cfg: Config) -> Columns:
    d = F.col("n_first")
    is_ = lambda f: F.coalesce(d[f], F.lit(False))
    code = F.when(d["response"], d["code"])
    return {
        "dns_detected": d.isNotNull(),
        "dns_query_name": text(d["name"]),
        "dns_query_type": or_zero(d["type"]),
        "dns_query_type_str": text(F.when(d["type"].isNotNull(), named(d["type"], DNS_TYPES, F.concat(F.lit("TYPE"), d["type"].cast("string"))))),
        "dns_response_code": F.coalesce(code, F.lit(-1)),
        "dns_response_code_str": text(F.when(code.isNotNull(), named(code, DNS_CODES, F.concat(F.lit("RCODE"), code.cast("string"))))),
        "dns_answer_count": or_zero(d["answers"]),
        "dns_authority_count": or_zero(d["authority"]),
        "dns_additional_count": or_zero(d["additional"]),
        "dns_min_ttl": or_zero(d["min_ttl"]),
        "dns_max_ttl": or_zero(d["max_ttl"]),
        "dns_is_query": F.coalesce(~d["response"], F.lit(False)),
        "dns_is_response": is_("response"),
        "dns_truncated": is_("truncated"),
        "dns_recursion_desired": is_("desired"),
        "dns_recursion_available": is_("available"),
    }


# entropy --------------------------------------------------------------------


def entropy_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """The part of each payload within the first bytes of its side, so that what a session gathers is bounded."""
    size = F.coalesce(F.octet_length("raw_payload"), F.lit(0))
    before = {}
    for name, here in (("f", fwd()), ("b", bwd())):
        before[name] = or_zero(F.sum(F.when(here, size)).over(in_order().rowsBetween(Window.unboundedPreceding, -1)))
    spent = F.when(fwd(), before["f"]).otherwise(before["b"])
    left = F.greatest(F.lit(cfg.entropy_sample_bytes) - spent, F.lit(0)).cast("int")
    return df.withColumn("sampled", F.when((size > 0) & (left > 0), F.substring(F.col("raw_payload"), F.lit(1), left)))


def entropy_aggregate(cfg: Config) -> Columns:
    part = lambda here: F.array_sort(F.collect_list(only(F.struct("pos", "sampled"), here & F.col("sampled").isNotNull())))
    return {"b_f": part(fwd()), "b_b": part(bwd())}


def entropy_finish(cfg: Config) -> Columns:
    whole = lambda parts: F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["sampled"]))
    f, b = whole(F.col("b_f")), whole(F.col("b_b"))
    facts, ef, eb = P.entropy_facts(F.concat(f, b)), P.entropy_facts(f), P.entropy_facts(b)
    n = or_zero(facts["n"])
    a, r = real(ef["entropy"]), real(eb["entropy"])
    return {
        "entropy_payload": real(facts["entropy"]),
        "entropy_initiator": a,
        "entropy_responder": r,
        "entropy_ratio": F.when(r > 0, a / r).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
        "byte_distribution_uniformity": real(facts["uniformity"]),
        "printable_ratio": ratio(or_zero(facts["printable"]), n),
        "null_ratio": ratio(or_zero(facts["zero"]), n),
        "high_byte_ratio": ratio(or_zero(facts["high"]), n),
        "payload_bytes_sampled": n,
    }


# http2 ----------------------------------------------------------------------


def http2_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Frames count from the first packet on that opens or looks like the protocol."""
    df = df.withColumn("h2", F.when(F.col("protocol") == 6, P.http2_facts("raw_payload")))
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("h2_on", F.coalesce(F.max((F.col("h2.preface") | F.col("h2.like")).cast("int")).over(so_far) == 1, F.lit(False)) & F.col("h2").isNotNull())
    three = F.lit(False)
    for mark in (b"\x02h3", b"\x05h3-29", b"\x05h3-34"):
        three = three | F.hex("raw_payload").rlike("^(..)*" + mark.hex().upper())
    ports = (F.col("src_port") == 443) | (F.col("dst_port") == 443)
    return df.withColumn("h3", F.coalesce((F.col("protocol") == 17) & ports & (F.octet_length("raw_payload") > 10) & three, F.lit(False)))


def http2_aggregate(cfg: Config) -> Columns:
    h, on = F.col("h2"), F.col("h2_on")
    kind = lambda k: or_zero(F.sum(only(F.size(F.filter(h["types"], lambda t: t == k)), on)))
    out = {f"z_{k}": kind(k) for k in (0, 1, 4, 5, 7, 8)}
    # ids of streams: two suffice to tell several from one, all are needed for the estimate
    streams = F.array_distinct(F.flatten(F.collect_set(only(F.array_distinct(h["streams"]), on))))
    return out | {"z_on": ever(on), "z_preface": ever(h["preface"]), "z_n": or_zero(F.sum(only(F.size(h["types"]), on))), "z_streams": F.size(streams), "z_3": ever(F.col("h3"))}


def http2_finish(cfg: Config) -> Columns:
    c = F.col
    return {
        "http2_detected": c("z_on"),
        "http3_detected": c("z_3"),
        "http2_preface_seen": c("z_preface"),
        "http2_frame_count": c("z_n"),
        "http2_data_frames": c("z_0"),
        "http2_headers_frames": c("z_1"),
        "http2_settings_frames": c("z_4"),
        "http2_push_promise_frames": c("z_5"),
        "http2_goaway_frames": c("z_7"),
        "http2_window_update_frames": c("z_8"),
        "http2_streams_estimate": c("z_streams"),
        "http2_server_push": c("z_5") > 0,
        "http2_multiplexed": c("z_streams") > 1,
        "http_version": F.when(c("z_3"), F.lit("h3")).when(c("z_on"), F.lit("h2")).otherwise(F.lit(EMPTY)),
    }


GROUPS = (
    Group("tls", "core", tls_aggregate, tls_finish, tls_prepare),
    Group("quic", "extended", quic_aggregate, quic_finish, quic_prepare),
    Group("ssh", "extended", ssh_aggregate, ssh_finish, ssh_prepare),
    Group("dns", "extended", dns_aggregate, dns_finish, dns_prepare),
    Group("entropy", "extended", entropy_aggregate, entropy_finish, entropy_prepare),
    Group("http2", "extended", http2_aggregate, http2_finish, http2_prepare),
)
