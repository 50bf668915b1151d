"""MAC addresses and device codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The MAC format, the characters a device code keeps, code lengths.
MAC_PATTERN = "^([0-9A-F]{2}:){5}[0-9A-F]{2}$"
NOT_IN_CODE = r"[^A-Za-z0-9\-_]"
CODE_LENGTH = 40
CODE_STEM_LENGTH = 36
# Fixed value: the whitespace that is stripped from both ends of texts.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def canonical_mac(text: Column) -> Column:
    return F.upper(stripped(text))


def is_mac(mac: Column) -> Column:
    return F.coalesce(mac.rlike(MAC_PATTERN), F.lit(False))


def mac_from_hex(text: Column) -> Column:
    """A MAC from loosely typed text: hex digits only, at most 12, a colon every two."""
    digits = F.substring(F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", "")), 1, 12)
    return F.regexp_replace(digits, "(..)(?=.)", "$1:")


def name_or_mac(name: Column, mac: Column) -> Column:
    return F.coalesce(F.nullif(stripped(name), F.lit("")), mac)


def device_code(name: Column, mac: Column) -> Column:
    """A device code from its name, or from the MAC when nothing usable is left."""
    kept = F.btrim(F.substring(F.regexp_replace(name, NOT_IN_CODE, "-"), 1, CODE_LENGTH), F.lit("-"))
    tail = F.right(F.replace(mac, F.lit(":"), F.lit("")), F.lit(6))
    return F.coalesce(F.nullif(kept, F.lit("")), F.concat(F.lit("MAC-"), tail))


def suffixed_code(code: Column, mac: Column) -> Column:
    """The second choice when a code is in use: shortened, plus the last four hex digits."""
    tail = F.right(F.replace(mac, F.lit(":"), F.lit("")), F.lit(4))
    return F.concat(F.substring(code, 1, CODE_STEM_LENGTH), F.lit("-"), tail)
