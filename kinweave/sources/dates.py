"""Dates as exporters write them."""

from __future__ import annotations

import re


def _in_range(month: str, day: str) -> bool:
    return month.isascii() and day.isascii() and month.isdigit() and day.isdigit() and 1 <= int(month) <= 12 and 1 <= int(day) <= 31


def clean_date(raw: str) -> str | None:
    """YYYY-MM-DD or --MM-DD where that can be told; nothing for empty dates and placeholders; else as written."""
    s = raw.strip().split("T")[0]
    if re.fullmatch(r"[0/.\-]*", s):
        return None
    digits = re.sub(r"[^0-9]", "", s)
    if s.startswith("--"):
        if len(digits) == 4 and _in_range(digits[:2], digits[2:]):
            return f"--{digits[:2]}-{digits[2:]}"
    elif "/" in s:
        parts = s.split("/")
        if len(parts) == 3 and len(parts[2].encode()) == 4 and _in_range(parts[0], parts[1]):
            return f"{parts[2]}-{parts[0].rjust(2, '0')}-{parts[1].rjust(2, '0')}"
    elif len(digits) == 8 and _in_range(digits[4:6], digits[6:]):
        return f"{digits[:4]}-{digits[4:6]}-{digits[6:]}"
    return s
