"""Decisions of a person who reviews groups: a state machine on the driver that ends in a table of merges."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

UNDO_LIMIT = 200


@dataclass(frozen=True)
class Draft:
    """What was decided for a group: merge, apart or nothing yet; members taken out; picks by field."""

    decision: str | None = None
    removed: frozenset[int] = frozenset()
    choices: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Review:
    groups: tuple[tuple[tuple[int, ...], str], ...]  # members and tier
    drafts: tuple[Draft, ...] = ()
    at: int = 0
    history: tuple[tuple[tuple[Draft, ...], int], ...] = field(default=(), repr=False)

    def __post_init__(self):
        if not self.drafts:
            object.__setattr__(self, "drafts", tuple(Draft() for _ in self.groups))

    def members(self, n: int) -> list[int]:
        return [i for i in self.groups[n][0] if i not in self.drafts[n].removed]

    def _changed(self, drafts: dict[int, Draft], at: int | None = None) -> Review:
        new = tuple(drafts.get(i, d) for i, d in enumerate(self.drafts))
        return replace(self, drafts=new, at=self.at if at is None else at, history=(*self.history, (self.drafts, self.at))[-UNDO_LIMIT:])

    def go(self, n: int) -> Review:
        return replace(self, at=max(0, min(n, len(self.groups) - 1)))

    def next(self) -> Review:
        return self.go(self.at + 1)

    def previous(self) -> Review:
        return self.go(self.at - 1)

    def next_open(self, after: int | None = None) -> int:
        """The next undecided group, from the start again after the last; the same one if all are decided."""
        n, start = len(self.groups), self.at if after is None else after
        return next((i for k in range(1, n + 1) if self.drafts[i := (start + k) % n].decision is None), start)

    def choose(self, what: str, contact: int) -> Review:
        d = self.drafts[self.at]
        return self._changed({self.at: replace(d, choices=tuple(sorted((dict(d.choices) | {what: contact}).items())))})

    def split(self, contact: int) -> Review:
        """Takes a member out, or back in; picks from members that are out are dropped."""
        d = self.drafts[self.at]
        removed = d.removed ^ {contact}
        return self._changed({self.at: replace(d, removed=removed, choices=tuple(c for c in d.choices if c[1] not in removed))})

    def decide(self, decision: str) -> Review:
        """merge or apart; a merge of fewer than two is apart. Goes on to the next open group."""
        decision = "apart" if decision == "merge" and len(self.members(self.at)) < 2 else decision
        done = self._changed({self.at: replace(self.drafts[self.at], decision=decision)})
        return replace(done, at=done.next_open())

    def accept_sure(self) -> Review:
        found = {i: replace(d, decision="merge") for i, (d, (_, tier)) in enumerate(zip(self.drafts, self.groups, strict=True)) if tier == "sure" and d.decision is None}
        return self._changed(found) if found else self

    def undo(self) -> Review:
        if not self.history:
            return self
        drafts, at = self.history[-1]
        return replace(self, drafts=drafts, at=at, history=self.history[:-1])

    def merges(self) -> list[tuple[list[int], dict[str, int]]]:
        """For operators.survivorship.claimed()."""
        return [(self.members(i), dict(d.choices)) for i, d in enumerate(self.drafts) if d.decision == "merge"]

    def counts(self) -> dict[str, int]:
        by = [d.decision for d in self.drafts]
        return {"merge": by.count("merge"), "apart": by.count("apart"), "open": by.count(None)}

    def dump(self, fingerprint: str = "") -> str:
        """The state to save, under the fingerprint of the files that it is about."""
        return json.dumps({"of": fingerprint, "at": self.at, "drafts": [[d.decision, sorted(d.removed), list(d.choices)] for d in self.drafts]})

    def load(self, text: str, fingerprint: str = "") -> Review:
        """A saved state; what can't be read, or is of other files or groups, gives the first state."""
        try:
            saved = json.loads(text)
            if saved.get("of", "") != fingerprint:
                raise ValueError
            drafts = tuple(Draft(d, frozenset(map(int, r)), tuple((str(k), int(v)) for k, v in c)) for d, r, c in saved["drafts"])
            if len(drafts) == len(self.groups) and all(d.decision in (None, "merge", "apart") for d in drafts):
                return replace(self, drafts=drafts, at=int(saved["at"]), history=())
        except (AttributeError, ValueError, TypeError, KeyError):
            pass
        return replace(self, drafts=tuple(Draft() for _ in self.groups), at=0, history=())


# The keys of a review and what they do; digits take that member out, or back in.
KEYS = {
    "j": "next", "ArrowRight": "next", "k": "previous", "ArrowLeft": "previous", "Enter": "merge", "m": "merge", "n": "apart", "u": "undo", "A": "accept_sure",
}


def pressed(review: Review, key: str, *, control: bool = False, alt: bool = False) -> Review:
    """The review after a key was pressed; other keys change nothing."""
    if alt or control:
        return review.undo() if control and not alt and key.lower() == "z" else review
    if len(key) == 1 and key in "123456789":
        own = review.groups[review.at][0]
        return review.split(own[int(key) - 1]) if int(key) <= len(own) else review
    does = KEYS.get(key)
    if does in ("merge", "apart"):
        return review.decide(does)
    return getattr(review, does)() if does else review
