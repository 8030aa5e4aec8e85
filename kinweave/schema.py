"""The contact row and the rows derived from it. Missing strings are empty, not null, unless noted."""

from __future__ import annotations

STRINGS = "array<string>"


def labelled(value: str = "string") -> str:
    """A list of values with vCard types and an optional label."""
    return f"array<struct<value:{value},types:array<string>,label:string>>"


ADDRESS_PARTS = ("po_box", "extended", "street", "locality", "region", "postal_code", "country")
ADDRESS = "struct<" + ",".join(f"{p}:string" for p in ADDRESS_PARTS) + ">"
NAME_PARTS = ("family", "given", "additional", "prefix", "suffix")
NAME = "struct<" + ",".join(f"{p}:string" for p in NAME_PARTS) + ">"
SOURCE = "struct<file:string,index:bigint,line:bigint>"
#: kind is `data` (mime, bytes) or `uri` (uri); null without a photo.
PHOTO = "struct<kind:string,mime:string,bytes:binary,uri:string>"
#: Properties kept as read; params are an ordered multimap.
EXTRAS = "array<struct<group:string,name:string,params:array<struct<k:string,v:string>>,value:string>>"

#: birthday, photo and uid may be null.
CONTACT = {
    "id": "bigint", "source": SOURCE, "formatted_name": "string", "name": NAME, "nicknames": STRINGS, "org": "string", "department": "string", "title": "string",
    "phones": labelled(), "emails": labelled(), "addresses": labelled(ADDRESS), "urls": labelled(), "birthday": "string", "note": "string", "photo": PHOTO,
    "categories": STRINGS, "uid": "string", "extra": EXTRAS,
}
CONTACT_DDL = ", ".join(f"`{k}` {v}" for k, v in CONTACT.items())
ISSUE_DDL = "file string, line bigint, message string"


def blank() -> dict:
    """A contact with nothing in it."""
    empty = {"string": "", NAME: dict.fromkeys(NAME_PARTS, ""), SOURCE: {"file": "", "index": 0, "line": 0}, "bigint": 0, PHOTO: None}
    out = {k: [] if v.startswith("array") else (dict(e) if isinstance(e := empty[v], dict) else e) for k, v in CONTACT.items()}
    return out | {"birthday": None, "uid": None}
