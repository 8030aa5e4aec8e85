"""Single contacts of a book by their ids: members for a preview, and photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(contacts: DataFrame, ids: list[int]) -> DataFrame:
    """The contacts of ids that a person picked; no ids, or an id that the book doesn't have, is an error."""
    if not ids:
        raise ValueError("no contact was picked")
    found = contacts.where(F.col("id").isin(sorted(set(ids))))
    missing = sorted(set(ids) - {r["id"] for r in found.select("id").collect()})  # as many as were picked
    if missing:
        raise LookupError(f"not in this book: {', '.join(map(str, missing))}")
    return found


def photo(contacts: DataFrame, contact: int) -> tuple[str, bytes | str] | None:
    """A contact's photo: its type and bytes, or `link` and a URI; None without one or without such a contact."""
    row = contacts.where(F.col("id") == contact).select("photo.*").first()
    if row is None or row["kind"] is None:
        return None
    return (row["mime"], bytes(row["bytes"])) if row["kind"] == "data" else ("link", row["uri"])
