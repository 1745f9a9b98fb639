"""File names, addresses and timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from mediamatch.schema import EXTENSION_MIME

# Patterns for the two textual address families.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^({_OCTET}\.){{3}}{_OCTET}$"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"^(({_H}:){{7}}{_H}|({_H}:){{1,7}}:|({_H}:){{1,6}}:{_H}|({_H}:){{1,5}}(:{_H}){{1,2}}"
    rf"|({_H}:){{1,4}}(:{_H}){{1,3}}|({_H}:){{1,3}}(:{_H}){{1,4}}|({_H}:){{1,2}}(:{_H}){{1,5}}"
    rf"|{_H}:(:{_H}){{1,6}}|:((:{_H}){{1,7}}|:))$"
)
# The last two groups may be written as a dotted quad; "::" stands for at least one group before it.
_QUAD = rf"({_OCTET}\.){{3}}{_OCTET}"
_BEFORE_QUAD = [rf"({_H}:){{6}}"] + [
    rf"{_H}(:{_H}){{{left - 1}}}::({_H}:){{0,{5 - left}}}" if left else rf"::({_H}:){{0,5}}" for left in range(6)
]
IPV6_QUAD = rf"^({'|'.join(_BEFORE_QUAD)}){_QUAD}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def mime_from_name(name: Column | str, stored: Column | str | None = None) -> Column:
    """Stored type unless it is empty, else the type of the file extension, else ''."""
    table = F.create_map(*[F.lit(v) for pair in EXTENSION_MIME.items() for v in pair])
    by_name = F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(_col(name), r"\.([^./]+)$", 1))), F.lit(""))
    if stored is None:
        return by_name
    return F.coalesce(F.nullif(_col(stored), F.lit("")), by_name)


def is_address(text: Column) -> Column:
    return text.rlike(IPV4) | text.rlike(IPV6) | text.rlike(IPV6_QUAD)


def client_address(peer: Column | str, forwarded: Column | str, trusted: Sequence[str]) -> Column:
    """Client of a request that came through proxies.

    A trusted peer is replaced by the last entry of the forwarded list that is an address and not
    itself trusted; in every other case the peer is the client.
    """
    peer, forwarded = F.trim(_col(peer)), _col(forwarded)
    if not trusted:
        return peer
    chain = F.reverse(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda hop: F.trim(hop)))
    usable = F.filter(chain, lambda hop: ~hop.isin(*trusted) & is_address(hop))
    return F.when(peer.isin(*trusted), F.coalesce(F.try_element_at(usable, F.lit(1)), peer)).otherwise(peer)


def client_key(address: Column | str) -> Column:
    """Opaque bucket key of a client; clients without an address share one bucket."""
    return F.sha2(F.coalesce(F.nullif(_col(address), F.lit("")), F.lit("unknown")), 256)


def epoch_to_text(seconds: Column | str) -> Column:
    """Epoch seconds to UTC date-time text; the session time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(_col(seconds)), "yyyy-MM-dd HH:mm:ss")
