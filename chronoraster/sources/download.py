"""Driver-side downloads: search parameters, validated fetches, retries, mirrors."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from urllib.request import urlopen

from chronoraster.sources.files import posix_cksum

MOST_WAIT = 450  # seconds between two rounds
TEMP = ".part"


@dataclass(frozen=True)
class Wanted:
    """A file to fetch; size and checksum are checked where they are given."""

    name: str
    url: str
    size: int | None = None
    checksum_type: str | None = None
    checksum: str | None = None


def search_parameters(products: list[str], version: str, begin: date | None = None, end: date | None = None, aoi: tuple[float, ...] | None = None) -> list[dict[str, str]]:
    """One catalogue query per product: temporal range, and a point (2 numbers) or a box (4)."""
    base: dict[str, str] = {"version": version}
    if begin or end:
        base["temporal"] = f"{begin.isoformat() + 'T00:00:00Z' if begin else ''},{end.isoformat() + 'T23:59:59Z' if end else ''}"
    if aoi is not None:
        if len(aoi) not in (2, 4):
            raise ValueError("an area has 2 or 4 numbers")
        base["point" if len(aoi) == 2 else "bounding_box"] = ",".join(map(str, aoi))
    return [{"short_name": p.upper()} | base for p in products]


def waits() -> Iterator[int]:
    """Seconds before each further round: 1, 2, 4, ... up to ``MOST_WAIT``."""
    n = 0
    while True:
        yield min(MOST_WAIT, 2**n)
        n += 1


def valid(path: Path, want: Wanted) -> bool:
    if want.size is not None and path.stat().st_size != want.size:
        return False
    kind = (want.checksum_type or "").upper().replace("-", "")
    if not want.checksum or not kind:
        return True
    data = path.read_bytes()
    if kind == "CKSUM":
        return str(posix_cksum(data)) == want.checksum
    if kind not in ("MD5", "SHA256"):
        raise ValueError(f"unknown checksum {want.checksum_type}")
    return hashlib.new(kind.lower(), data).hexdigest() == want.checksum.lower()


def fetch(want: Wanted, target: Path, mirror: Path | None = None, overwrite: bool = False) -> bool:
    """Fetch one file; it appears under its name only when complete and valid.

    With ``mirror`` the file is kept there and linked from ``target``.
    """
    final, keep = target / want.name, (mirror or target) / want.name
    if final.exists() and not overwrite:
        return True
    if not (keep.exists() and valid(keep, want)) or overwrite:
        temp = keep.with_name(want.name + TEMP)
        try:
            with urlopen(want.url, timeout=60) as source, temp.open("wb") as sink:
                shutil.copyfileobj(source, sink)
            if not valid(temp, want):
                return False
            os.replace(temp, keep)
        except OSError:
            return False
        finally:
            temp.unlink(missing_ok=True)
    if mirror is not None:
        final.unlink(missing_ok=True)
        final.symlink_to(keep)
    return True


def fetch_all(wanted: list[Wanted], target: Path, threads: int = 4, rounds: int = 5, sleep: Callable[[float], None] = time.sleep, **how) -> list[str]:
    """Fetch in parallel; what failed is tried again after a growing wait. Names that could not be fetched."""
    left = list(wanted)
    for n, wait in zip(range(rounds), waits()):
        if n:
            sleep(wait)
        with ThreadPoolExecutor(threads) as pool:
            ok = list(pool.map(lambda w: fetch(w, target, **how), left))
        left = [w for w, good in zip(left, ok) if not good]
        if not left:
            break
    return [w.name for w in left]
