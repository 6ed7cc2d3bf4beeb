"""Look-alike classes from the Unicode security data (problem 8).

The data come with ICU, which Spark ships (``icu4j``): a map from characters to
prototypes, equal for characters that look alike.  It is read from the jar on
the driver and sent to the tasks; where there is no jar, the pairs of
``lookalike`` alone are used.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zipfile
from functools import lru_cache
from glob import glob

# The data file's name and magic number.
ENTRY = "com/ibm/icu/impl/data/icudata/confusables.cfu"
MAGIC = 0x3845FDEF


def _jar() -> str | None:
    try:
        import pyspark
    except ImportError:
        return None
    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME") or ""]
    found = [p for h in homes if h for p in sorted(glob(os.path.join(h, "jars", "icu4j-*.jar")))]
    return found[0] if found else None


def _parse(data: bytes) -> dict[str, str]:
    """Keys hold a code point in 24 bits and the prototype's length less one in 8; values a UTF-16 unit, or where the string begins."""
    body = data[struct.unpack(">H", data[:2])[0] :]
    magic, _, _, keys, n, values, _, strings, units = struct.unpack(">9i", body[:36])
    if magic != MAGIC:
        raise ValueError("unknown format of the confusables")
    text = body[strings : strings + 2 * units]
    out = {}
    for key, value in zip(struct.unpack(f">{n}i", body[keys : keys + 4 * n]), struct.unpack(f">{n}H", body[values : values + 2 * n])):
        length = (key >> 24 & 0xFF) + 1
        raw = struct.pack(">H", value) if length == 1 else text[2 * value : 2 * (value + length)]
        out[chr(key & 0xFFFFFF)] = raw.decode("utf-16-be")
    return out


@lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """character -> prototype; empty where the data are not there."""
    jar = _jar()
    if jar is None:
        return {}
    with zipfile.ZipFile(jar) as z:
        return _parse(z.read(ENTRY)) if ENTRY in z.namelist() else {}


def kind(ch: str, prototype: str) -> str | None:
    """``u`` upper case, ``l`` lower case, ``o`` letters without case; None for what is no letter.

    A caseless letter that is drawn like an ASCII capital counts as a capital.
    """
    cat = unicodedata.category(ch)
    if cat in ("Lu", "Lt"):
        return "u"
    if cat == "Ll":
        return "l"
    if cat == "Lo":
        return "u" if len(prototype) == 1 and prototype.isascii() and prototype.isupper() else "o"
    return None
