"""Where a text stops: its core without what stands after the stop, and whether its last sentence is complete."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: What may stand before or after a text without belonging to it.
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)|<(?:answer|think)>|</\w+>|<br\s*/?>", re.S | re.I)
_INVISIBLE = "​‌‍⁠﻿️"
_TAIL = re.compile(rf"(?:[\s{_INVISIBLE}]|…|\.{{2,}}|</?\w+/?>|```|\*{{2,}}|[(\[{{]\s*(?:…|\.{{2,}}|cut|truncated|continued|cont|more|trimmed|shortened|clipped|end of)[^()\[\]{{}}]*[)\]}}]?|[(\[]\s*[)\]])+\Z", re.I)
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "st mr mrs ms dr prof approx ca cf e.g i.e vs no nr fig vol ed sr sra dra dr mme mlle bzw z.b usw al jr inc ave rd".split()
_ABBREVIATED = re.compile(r"(?:^|[\s(\"“”])(?:" + "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\.\Z", re.I)
_ENDS = re.compile(r"[.!?。！？]['\"“”’»)\]*_]*\Z")
_INSIDE = re.compile(r"[.!?]['\"”’)]*\s+\S|[。！？;；]")
_QUOTES = re.compile(r"[\"“”„«»]")


@dataclass
class Ending:
    """kind: none (no text), list (comma-separated, no full stop) or prose; finished: the last sentence is complete (lists: unknown)."""

    kind: str
    core: str
    finished: bool
    last: str = ""
    inner: list[str] = field(default_factory=list)
    marked: bool = False


def unwrap(text: str | None) -> str:
    """Without thinking blocks, tags and outer white space."""
    return _THINK.sub(" ", text or "").strip().strip(_INVISIBLE).strip()


def core_of(text: str) -> str:
    """Without whatever stands after the stop: tags, ellipses, marks of a cut, symbols."""
    while True:
        t = _TAIL.sub("", text)
        while t and unicodedata.category(t[-1]) in ("So", "Sk", "Cf", "Cs", "Co"):
            t = t[:-1]
        if t == text:
            return t
        text = t


def item_of(text: str) -> str:
    return " ".join(text.lower().split())


def look(text: str | None) -> Ending:
    """How ``text`` stops. Null, empty and marked-up nothing are of kind none."""
    whole = unwrap(text)
    core = core_of(whole)
    if not any(ch.isalnum() for ch in core):
        return Ending("none", core, True)
    items = core.split(",")
    first = next((ch for ch in core if ch.isalpha()), "")
    if not _INSIDE.search(core) and not _ENDS.search(core):
        sizes = sorted(len(i.split()) for i in items)
        if len(items) >= (2 if first.islower() else 4) and sizes[len(sizes) // 2] <= 5 and sizes[-1] <= 9 or len(items) == 1 and first.islower() and sizes[0] <= 5:
            return Ending("list", core, False, item_of(items[-1]), [i for i in map(item_of, items[:-1]) if i], whole != core)
    finished = bool(_ENDS.search(core)) and not _ABBREVIATED.search(core) and len(_QUOTES.findall(core)) % 2 == 0 and core.count("(") <= core.count(")") and core.count("[") <= core.count("]")
    return Ending("prose", core, finished, marked=whole != core)
