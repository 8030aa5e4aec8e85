"""One contact out of several: the rules by which values survive, as plain functions over contact rows."""

from __future__ import annotations

import math

from . import names
from .names import canonical, fold, name_key, starts_with_title
from .phones import phone

FIELDS = ("name", "birthday", "org", "title", "photo")


def name_is_empty(name: dict) -> bool:
    return not any(v.strip() for v in name.values())


def display_of(row: dict) -> str:
    name = row["name"]
    parts = (name[p].strip() for p in ("prefix", "given", "additional", "family", "suffix"))
    return row["formatted_name"].strip() or " ".join(p for p in parts if p) or row["org"].strip()


def key_of(row: dict) -> names.NameKey:
    return name_key(row["name"]["given"], row["name"]["family"], row["formatted_name"], row["org"])


def address_text(a: dict) -> str:
    return ", ".join(s for v in a.values() if (s := v.strip()))


def is_empty(row: dict) -> bool:
    values = any(f["value"].strip() for c in ("phones", "emails") for f in row[c]) or any(address_text(f["value"]) for f in row["addresses"])
    return not (display_of(row) or values or row["urls"] or row["note"].strip() or row["birthday"] is not None or row["photo"])


def name_quality(row: dict) -> int:
    """How good a name is to keep."""
    key, shown = key_of(row), display_of(row)
    letters = [c for c in shown if c.isalpha()]
    one_case = len(letters) > 1 and (all(c.islower() for c in letters) or all(c.isupper() for c in letters))
    points = {"person": 10, "company": 6, "role": 3, "none": 0}[key.kind]
    points += 4 * bool(key.family) - 5 * (len(key.given) == 1 or len(key.family) == 1) - one_case
    points -= starts_with_title(shown) + 3 * ("(" in shown or "[" in shown) + 2 * (len(canonical(key.given)) > 1)
    return points + min(len(key.given), 8) // 3


def agreement(row: dict, members: list[dict]) -> int:
    """How many other copies back the family name and the given name (or a nickname of it)."""
    own, points = key_of(row), 0
    for other in members:
        if other["id"] != row["id"]:
            key = key_of(other)
            points += bool(own.family) and key.family == own.family
            points += bool(own.given) and own.given in (key.given, *canonical(key.given)[1:])
    return points


def alternatives(values: list[tuple[int, str]], key=str) -> list[dict]:
    """Distinct values in order, each with the ids that have it; blank ones don't count."""
    out: dict[str, dict] = {}
    for i, v in values:
        if v.strip():
            out.setdefault(key(v), {"from": [], "value": v})["from"].append(i)
    return list(out.values())


def photo_bytes(photo: dict | None) -> int:
    return len(photo["bytes"]) if photo and photo["kind"] == "data" else 0


def most_common(found: list[dict], prefer=lambda a: 0) -> int | None:
    best = max(enumerate(found), key=lambda x: (prefer(x[1]), len(x[1]["from"]), -x[0]), default=None)
    return best[1]["from"][0] if best else None


def add_types(into: dict, more: dict) -> None:
    into["types"] += [t for t in dict.fromkeys(more["types"]) if t not in into["types"]]
    if into["label"] is None:
        into["label"] = more["label"]


def united(lists: list[list[dict]], key) -> list[dict]:
    """Labelled values distinct by key: the first value, all types, the first label."""
    out: dict[str, dict] = {}
    for f in (f for fs in lists for f in fs):
        k = key(f["value"])
        if k in out:
            add_types(out[k], f)
        else:
            out[k] = f | {"types": list(f["types"])}
    return list(out.values())


def phone_key(value: str, region: str) -> str:
    found = phone(value, region)
    return found.key if found else value.strip()


def united_phones(members: list[dict], region: str) -> list[dict]:
    """As united(), but a copy with a country code replaces one without."""
    out = united([m["phones"] for m in members], lambda v: phone_key(v, region))
    with_code: dict[str, str] = {}
    for f in (f for m in members for f in m["phones"]):
        if f["value"].lstrip().startswith("+"):
            with_code.setdefault(phone_key(f["value"], region), f["value"])
    for f in out:
        if not f["value"].lstrip().startswith("+"):
            f["value"] = with_code.get(phone_key(f["value"], region), f["value"])
    return out


def email_key(raw: str) -> str | None:
    e = raw.strip().lower().removeprefix("mailto:").strip()
    local, at, domain = e.rpartition("@")
    if not at or not local or "." not in domain:
        return None
    return f"{local.split('+')[0].replace('.', '')}@gmail.com" if domain in ("gmail.com", "googlemail.com") else e


def url_key(raw: str) -> str:
    v = raw.strip().lower()
    for prefix in ("https://", "http://", "www."):
        while v.startswith(prefix):
            v = v[len(prefix) :]
    return v.rstrip("/")


def merged_notes(notes: list[str]) -> str:
    """Paragraphs without those that another one contains, whatever their case, accents and spacing."""
    kept: list[tuple[str, str]] = []
    for para in (p for n in notes for x in n.split("\n\n") if (p := x.strip())):
        key = fold(para)
        if not any(key in k for k, _ in kept):
            kept = [(k, p) for k, p in kept if k not in key] + [(key, para)]
    return "\n\n".join(p for _, p in kept)


def merged_extras(members: list[dict]) -> list[dict]:
    """Properties kept as read, without repeats; a group name that stands for two things gets a new name for the second."""
    out: list[dict] = []
    used: set[str] = set()
    fresh = 0
    content = lambda e: (e["name"], e["value"], [(p["k"], p["v"]) for p in e["params"]])
    for m in members:
        for e in m["extra"]:
            if e["group"] is None and e not in out:
                out.append(e)
        order = [e["group"] for e in m["extra"] if e["group"] is not None]
        for g in (g for i, g in enumerate(order) if i == 0 or g != order[i - 1]):
            own = [e for e in m["extra"] if e["group"] == g]
            there = [content(e) for e in out if e["group"] is not None]
            if any(content(e) in there for e in own):
                continue
            name = g
            while name in used:
                fresh += 1
                name = f"cm{fresh}"
            used.add(name)
            out += [e | {"group": name} for e in own]
    return out


def harvested_nicknames(members: list[dict], base: dict) -> list[str]:
    """Listed nicknames, and first names of other copies that are nicknames of the kept one or the other way round."""
    given = key_of(base).given
    seen, out = {given}, []
    for m in members:
        found, key = list(m["nicknames"]), key_of(m)
        if key.kind == "person" and key.given != given and set(canonical(key.given)) & set(canonical(given)):
            found += [w for w in display_of(m).split() if fold(w) == key.given][:1]
        for n in found:
            if fold(n) not in seen:
                seen.add(fold(n))
                out.append(n)
    return out


def merge(members: list[dict], region: str, choices: dict | None = None) -> tuple[dict, dict, dict]:
    """The merged contact, the picks used and the alternatives of single-valued fields."""
    by_id = {m["id"]: m for m in reversed(members)}
    best_first = sorted(members, key=lambda m: -name_quality(m))
    org = lambda m: f"{m['org']}, {m['department']}" if m["department"] else m["org"]
    pictures = sorted((m for m in members if m["photo"]), key=lambda m: -photo_bytes(by_id[m["id"]]["photo"]))
    offered = {
        "name": alternatives([(m["id"], display_of(m)) for m in best_first], fold),
        "birthday": alternatives([(m["id"], m["birthday"] or "") for m in members]),
        "org": alternatives([(m["id"], org(m)) for m in members], fold),
        "title": alternatives([(m["id"], m["title"]) for m in members], fold),
        "photo": [{"from": [m["id"]], "value": f"{math.ceil(photo_bytes(m['photo']) / 1024)} KB" if m["photo"]["kind"] == "data" else "link"} for m in pictures],
    }
    default = {
        "name": max(members, key=lambda m: (name_quality(m) + agreement(m, members), -m["id"]))["id"],
        "birthday": most_common(offered["birthday"], lambda a: not a["value"].startswith("--")),
        "org": most_common(offered["org"]),
        "title": most_common(offered["title"]),
        "photo": offered["photo"][0]["from"][0] if offered["photo"] else None,
    }
    wanted = choices or {}
    picks = {f: w if (w := wanted.get(f)) is not None and any(w in a["from"] for a in offered[f]) else default[f] for f in FIELDS}
    base = by_id.get(picks["name"], members[0])
    of = lambda f, column, none: by_id[picks[f]][column] if picks[f] is not None else none
    categories: dict[str, str] = {}
    for v in (v for m in members for v in m["categories"]):
        categories.setdefault("".join(c.lower() if c.isascii() else c for c in v), v)
    out = {
        "id": members[0]["id"],
        "source": members[0]["source"],
        "formatted_name": base["formatted_name"],
        "name": base["name"],
        "nicknames": harvested_nicknames(members, base),
        "org": of("org", "org", ""),
        "department": of("org", "department", ""),
        "title": of("title", "title", ""),
        "phones": united_phones(members, region),
        "emails": united([m["emails"] for m in members], lambda v: email_key(v) or v.strip().lower()),
        "addresses": united([m["addresses"] for m in members], lambda a: fold(address_text(a))),
        "urls": united([m["urls"] for m in members], url_key),
        "birthday": of("birthday", "birthday", None),
        "note": merged_notes([m["note"] for m in members]),
        "photo": of("photo", "photo", None),
        "categories": list(categories.values()),
        "uid": base["uid"] if base["uid"] is not None else next((m["uid"] for m in members if m["uid"] is not None), None),
        "extra": merged_extras(members),
    }
    return out, picks, offered
