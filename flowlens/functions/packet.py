"""Packet header fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# UDP protocol number, QUIC port, header form bits of the first byte.
UDP = 17
QUIC_PORT = 443
LONG_HEADER_BIT = 0x80
SHORT_HEADER_BIT = 0x40


def is_quic_candidate(protocol: Column, sport: Column, dport: Column) -> Column:
    return (protocol == UDP) & ((sport == QUIC_PORT) | (dport == QUIC_PORT))


def header_hint(payload: Column) -> Column:
    """Header form read from the first payload byte."""
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    return (
        F.when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "empty")
        .when(first.bitwiseAND(LONG_HEADER_BIT) != 0, "quic-long")
        .when(first.bitwiseAND(SHORT_HEADER_BIT) != 0, "quic-short")
        .otherwise("unknown")
    )


def payload_head(payload: Column, length: int = 6) -> Column:
    """First bytes as lower-case hex text."""
    return F.lower(F.hex(F.substring(F.coalesce(payload, F.lit(b"")), 1, length)))


def canonical_key(src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """One key for both directions: the smaller of the two endpoint orders."""

    def endpoints(a: Column, a_port: Column, b: Column, b_port: Column) -> Column:
        return F.struct(a.alias("src"), a_port.alias("sport"), b.alias("dst"), b_port.alias("dport"))

    return F.least(endpoints(src, sport, dst, dport), endpoints(dst, dport, src, sport))


def direction(src: Column, local_addresses: Iterable[str]) -> Column:
    """1 for packets sent by a local address, -1 otherwise."""
    return F.when(src.isin(list(local_addresses)), 1).otherwise(-1)
