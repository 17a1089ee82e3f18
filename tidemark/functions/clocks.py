"""Clocks: offsets of a host against a time server, and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_ms(sent: Column, received: Column, answered: Column, back: Column) -> Column:
    """Host clock less reference in milliseconds, from seconds: sent and back by the host, received and answered by the
    server; null where the server was not synchronised (an answer at or before 0)."""
    server_less_host = ((received - sent) + (answered - back)) / 2.0
    return F.when(answered > 0, -server_less_host * 1000.0)


def age_s(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 1e6


def cadence_s(count: Column, span_s: Column) -> Column:
    """Mean seconds between rows; null below two rows."""
    return F.when(count > 1, span_s / (count - 1))
