"""Phone numbers: E.164 keys by public numbering plans."""

from __future__ import annotations

import functools
import os
import re
from typing import NamedTuple

from .constants import REGIONS, TWO_DIGIT_CODES

#: Extensions as people and URIs write them.
EXTENSION = re.compile(r"(?i)(?:;ext=|[ \t,;]*(?:\bext(?:ension|n)?\.?|\bx|#)[ \t.:]*)(\d{1,9})\s*$")
TRUNK = {code: trunk for code, trunk in REGIONS.values() if trunk and code not in ("1", "7")}


class Phone(NamedTuple):
    key: str
    display: str
    has_country: bool


def region_code(text: str) -> str | None:
    """A two-letter region, or nothing."""
    code = text.strip().upper()
    return code if len(code) == 2 and code.isalpha() else None


def default_region(environment=os.environ) -> str:
    """The region of the locale (en_IN.UTF-8: IN), or US."""
    for name in ("LC_ALL", "LC_TELEPHONE", "LANG"):
        parts = re.split(r"[.@]", environment.get(name, ""))[0].split("_")
        if len(parts) > 1 and (found := region_code(parts[1])):
            return found
    return "US"


def calling_code(digits: str) -> str:
    return digits[:1] if digits[:1] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def grouped(code: str, national: str) -> str:
    """International form; grouped for the plans below, else in one piece."""
    n = national
    if code == "91" and len(n) == 10:
        parts = [n[:5], n[5:]]
    elif code == "1" and len(n) == 10:
        return f"+1 {n[:3]}-{n[3:6]}-{n[6:]}"
    elif code == "44" and len(n) == 10:
        parts = [n[:2], n[2:6], n[6:]] if n[0] == "2" else [n[:4], n[4:]]
    elif code == "34" and len(n) == 9:
        parts = [n[:3], n[3:5], n[5:7], n[7:]]
    elif code == "49" and len(n) > 6:
        cut = 2 if n[:2] in ("30", "40", "69", "89") else 4 if n[0] == "1" else 3
        parts = [n[:cut], n[cut:]]
    else:
        parts = [n]
    return " ".join(["+" + code, *parts])


@functools.lru_cache(maxsize=100_000)
def phone(raw: str, region: str) -> Phone | None:
    """Key (`+` and digits, or `#` and digits where no plan fits), display and whether it had a country code."""
    digits = re.sub(r"[^0-9]", "", raw)
    if len(digits) < 6:
        return None
    text = raw.strip()
    abroad = text.startswith(("+", "00"))
    body = EXTENSION.sub("", text)
    number = re.sub(r"[^0-9]", "", body)
    if abroad:
        number = number[2:] if text.startswith("00") else number
        code = calling_code(number)
        national = number[len(code) :]
        if national.startswith("0") and TRUNK.get(code) == "0":
            national = national[1:]
    else:
        code, trunk = REGIONS.get(region, ("", ""))
        national = number[len(trunk) :] if trunk and number.startswith(trunk) and len(number) > len(trunk) + 5 and not (code == "1" and len(number) != 11) else number
    if not code or number.startswith("0") and abroad or not 2 <= len(national) <= 15 or re.search(r"[^\W\d_]", body):
        return Phone("#" + digits, text, abroad)
    return Phone(f"+{code}{national}", grouped(code, national), abroad)
