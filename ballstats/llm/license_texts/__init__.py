"""Whole texts of known licences, with their line structure, in the spellings that files give them."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator
from importlib.resources import files

# Lines that may stand over a licence's text; texts without an entry hold their own title.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"],
}
RIGHTS = "All rights reserved."  # may follow the copyright line, which is no part of the canonical text
OWNER = re.compile(r"[ \t]*(copyright|\(c\)|©)", re.IGNORECASE)
WIDTHS = range(60, 101)


def _parts(text: str) -> Iterator[str]:
    """The text, and its terms without what stands before or after them."""
    yield text
    terms, end, _ = text.partition("END OF TERMS AND CONDITIONS\n")
    if end:
        yield terms + end
    ruled = re.split(r"\n={60,}\n", text)
    if len(ruled) == 4:
        yield ruled[2]


def _wrapped(text: str) -> Iterator[str]:
    """The text as given, with each paragraph on one line, and, if it is short, wrapped at usual widths.

    A line that starts with "copyright" is no part of the canonical text, so where a text is
    wrapped matters; of wrappings that lose the same lines one is given.
    """
    yield text
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    yield "\n\n".join(paragraphs)
    if len(text) > 4000:
        return
    seen = set()
    for width in WIDTHS:
        lines = [line for p in paragraphs for line in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
        lost = tuple(line for line in lines if OWNER.match(line))
        if lost not in seen:
            seen.add(lost)
            yield "\n".join(lines)


def whole_texts() -> dict[str, list[str]]:
    """The texts of each licence by its id, one for each spelling, title and place of a copyright line."""
    out: dict[str, list[str]] = {}
    for file in sorted(files(__package__).iterdir(), key=lambda f: f.name):
        if not file.name.endswith(".txt"):
            continue
        name = file.name.removesuffix(".txt")
        own: dict[str, None] = {}
        titles = ["", *TITLES.get(name, [])]
        rights = ["", RIGHTS] if name in TITLES else [""]
        for part in _parts(file.read_text(encoding="utf-8")):
            for text in _wrapped(part):
                numbers = [text, re.sub(r"(?m)^\d\. ", "* ", text)] if name.startswith("BSD") else [text]
                links = [x for t in numbers for x in dict.fromkeys((t, t.replace("https://", "http://")))]
                for title in titles:
                    for right in rights:
                        own.update(dict.fromkeys("\n\n".join(x for x in (title, right, t) if x) for t in links))
        out[name] = list(own)
    return out
