"""All keywords of a table found in one walk over a text."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import keyword_pattern

#: Texts that are held as Python strings at once.
SLICE = 64

_END, _OPEN = "\0end", "\0open"  # keys of a node that no token equals


def _marks() -> list[int]:
    """All combining marks."""
    return [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]


def _word_class(marks: list[int]) -> str:
    """What a word consists of, as a class of a pattern: letters, numbers, underscore and combining marks."""
    runs, at = [], 0
    while at < len(marks):
        end = at
        while end + 1 < len(marks) and marks[end + 1] == marks[end] + 1:
            end += 1
        runs.append(f"{chr(marks[at])}-{chr(marks[end])}")
        at = end + 1
    return rf"[\w{''.join(runs)}]+"


class Automaton:
    """A trie of keywords over words and what stands between them.

    A keyword is found where its words stand whole, in any case, with just what it
    has between them; the last word of a prefix root may go on. The distinct words
    of a text meet single words and roots as sets; the text is walked only from
    places where a phrase begins, so time follows the text, not the number of
    phrases. Keywords that begin or end with another sign are searched one by one.
    """

    def __init__(self, keywords: Iterable[str], prefixes: Iterable[str] = ()) -> None:
        marks = _marks()
        self.word = re.compile(_word_class(marks))
        self.cut = re.compile(f"({self.word.pattern})")
        # most texts have no character as high as the first mark, and the large class takes four times as long
        self.high = re.compile(f"[{chr(marks[0])}-{chr(sys.maxunicode)}]")
        self.plain, self.plain_cut = re.compile(r"\w+"), re.compile(r"(\w+)")
        self.single, self.roots, self.trie, self.odd = {}, {}, {}, []
        prefixes = set(prefixes)
        for keyword in dict.fromkeys(keywords):
            parts = self.cut.split(keyword.lower())
            if len(parts) == 1 or parts[0] or parts[-1]:
                self.odd.append((keyword, re.compile(keyword_pattern(keyword, prefixes).replace("(?iU)", "(?i)"))))
            elif len(parts) == 3:
                (self.roots if keyword in prefixes else self.single).setdefault(parts[1], []).append(keyword)
            else:
                *before, last = parts[1:-1]
                node = self.trie
                for part in before:
                    node = node.setdefault(part, {})
                node = node.setdefault(_OPEN, {}) if keyword in prefixes else node.setdefault(last, {})
                node.setdefault(last if keyword in prefixes else _END, []).append(keyword)
        self.lengths = sorted({len(r) for r in self.roots})

    def find(self, text: str | None) -> list[str]:
        """The keywords in a text, each once."""
        if not text:
            return []
        low = text.lower()
        high = not low.isascii() and self.high.search(low)
        # where there are phrases the text is cut once, for its words and for the walk
        parts = (self.cut if high else self.plain_cut).split(low) if self.trie else None
        words = set(parts[1::2] if parts else (self.word if high else self.plain).findall(low))
        found = [k for w in self.single.keys() & words for k in self.single[w]]
        for n in self.lengths:
            found += [k for w in self.roots.keys() & {w[:n] for w in words} if len(w) == n for k in self.roots[w]]
        if self.trie.keys() & words:
            found += self._walk(parts)
        found += [k for k, pattern in self.odd if pattern.search(text)]
        return list(dict.fromkeys(found))

    def _walk(self, parts: list[str]) -> Iterator[str]:
        for at in range(1, len(parts), 2):
            node, i = self.trie.get(parts[at]), at
            while node is not None and i + 1 < len(parts):
                i += 1
                for last, keywords in node.get(_OPEN, {}).items():
                    if parts[i].startswith(last):
                        yield from keywords
                node = node.get(parts[i])
                if node is not None:
                    yield from node.get(_END, ())


def keywords_in(text: Column, keywords: Iterable[str], prefixes: Iterable[str] = ()) -> Column:
    """array<string> of the keywords that a text holds; null and empty texts hold none."""
    automaton = Automaton(keywords, prefixes)  # travels with the plan

    # a batch's texts are Python's a few at a time
    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        parts = [pa.array([automaton.find(t) for t in texts.slice(at, SLICE).to_pylist()], pa.list_(pa.string())) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return find(text)
