"""Sections of a text by its headings: exact, with words around them, misspelt by one letter, or inside running text.

A text is read once, line by line, and the open section is carried along.  That state lives inside one row, so an Arrow batch
of texts is a task's unit and nothing is shuffled; time is in proportion to the text.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# helpers travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names of headings by section.
HEADINGS = {
    "contact": ("contact", "contact information", "personal info", "personal details"),
    "summary": ("summary", "profile", "objective", "professional summary", "about me", "executive summary"),
    "skills": ("skills", "technical skills", "core skills", "core competencies", "skills & tools", "technologies", "key skills", "preferred skills", "preferred qualifications", "desired skills", "nice to have", "keywords"),
    "requirements": ("requirements", "required skills", "job requirements", "prerequisites", "qualifications", "basic qualifications"),
    "experience": ("experience", "work experience", "professional experience", "work history", "employment", "employment history", "career history", "relevant experience", "internship", "internships", "internship experience"),
    "education": ("education", "academic background", "academic qualifications", "education & qualifications"),
    "projects": (
        "projects", "project experience", "project details", "personal projects", "key projects", "academic projects", "selected projects", "technical projects", "projects worked on",
        "projects & certifications", "internship & projects", "recent projects", "major projects", "practical projects", "software projects", "development projects", "academic & personal projects", "independent projects",
    ),
    "certifications": ("certifications", "certificates", "licenses", "certifications & licenses", "licenses & certifications", "trainings", "training & certifications", "courses", "workshops", "online courses"),
    "awards": ("awards", "honors", "achievements", "awards & honors", "awards & achievements"),
    "publications": ("publications", "research publications", "papers"),
    "languages": ("languages", "language proficiency", "languages known"),
    "responsibilities": ("responsibilities", "key responsibilities", "duties", "job responsibilities", "role responsibilities"),
    "benefits": ("benefits", "what we offer"),
}
#: Headings that also open a section inside running text.
INLINE = ("education", "technical skills", "skills", "work experience", "experience", "internship", "internships", "projects", "personal projects", "academic projects", "technical projects", "certifications", "achievements", "languages")
#: Words of a line that may hold a heading among others, and of one that may be misspelt; letters that a misspelt name has at least.
HEADING_WORDS, MISSPELT_WORDS, MISSPELT_LETTERS = 6, 4, 7
#: Lines whose section a batch remembers, and lines that are turned into Arrow columns at a time.
KEPT_LINES, LINES_AT_ONCE = 1 << 14, 1 << 14
#: Characters of a text without any heading line from which on headings are looked for inside it.
RUNNING_TEXT = 1000

_WORDS = re.compile(r"[a-z0-9&]+")
LINE = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("line", T.StringType())])


def _without_one(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _one_apart(a: str, b: str) -> bool:
    """One letter added, missing, changed or swapped with its neighbour, or none."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class Lexicon:
    """Looks headings up: by name, by a run of words, by the names that come out when one letter is left out."""

    def __init__(self, headings: dict[str, tuple[str, ...]] = HEADINGS):
        self.names = {name: section for section, names in headings.items() for name in names}
        self.near: dict[str, list[str]] = {}
        for name in sorted(self.names, key=lambda n: (-len(n), n)):
            if len(name) >= MISSPELT_LETTERS:
                for cut in _without_one(name):
                    self.near.setdefault(cut, []).append(name)
        self.words = {w for name in self.names for w in name.split(" ")}
        sizes = [len(cut) for cut in self.near] or [0]
        self.least, self.most = min(sizes), max(sizes) + 1
        # short lines recur in a batch of texts
        self.section = lru_cache(KEPT_LINES)(self._section)
        self.inline = re.compile(r"\b(" + "|".join(sorted(INLINE, key=len, reverse=True)).replace(" ", r"\s+") + r")\b", re.I)

    def _section(self, line: str) -> str | None:
        """Section that a line opens.  The longest of several names wins, then the first in order of letters."""
        key = line.strip("#*•:_=- \t").lower()
        if key in self.names:
            return self.names[key]
        words = _WORDS.findall(key)
        if not 1 <= len(words) <= HEADING_WORDS:
            return None
        found = []
        # a run of words can only be a name where one of them stands in a name
        for size in range(len(words), 0, -1) if not self.words.isdisjoint(words) else ():
            if len(words) <= MISSPELT_WORDS or size >= len(words) // 2 + 1:
                found += [n for n in (" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if n in self.names]
        if not found and len(words) <= MISSPELT_WORDS:
            whole = " ".join(words)
            cuts = _without_one(whole) if self.least <= len(whole) <= self.most else ()
            found = [n for cut in cuts for n in self.near.get(cut, ()) if _one_apart(whole, n)]
        return self.names[min(found, key=lambda n: (-len(n), n))] if found else None

    def lines(self, text: str) -> list[tuple[int, str, str]]:
        """(place, section, line) of every line that is neither empty nor opens another section than the open one."""
        out, current, opened = [], "header", False
        for pos, raw in enumerate(text.split("\n")):
            line = raw.strip()
            if not line:
                continue
            section = self.section(line) if len(line) < 80 else None
            if section and section != current:
                current, opened = section, True
            else:
                out.append((pos, current, line))
        if not opened and len(text) > RUNNING_TEXT:
            return self.running(out)
        return out

    def running(self, lines):
        """Lines of a text without heading lines, cut where a heading's name stands inside them."""
        out, current = [], "header"
        for pos, _, line in lines:
            at = 0
            for hit in self.inline.finditer(line):
                out.append((pos, current, line[at : hit.start()].strip()))
                current, at = self.names[" ".join(hit[1].lower().split())], hit.end()
            out.append((pos, current, line[at:].strip(" :")))
        return [x for x in out if x[2]]


def section_lines(text: Column, headings: dict[str, tuple[str, ...]] = HEADINGS) -> Column:
    """array<struct<pos, section, line>> of a text; null and empty texts have none."""

    @F.arrow_udf(T.ArrayType(LINE))
    def run(texts):
        import pyarrow as pa

        def columns(rows):
            pos, section, line = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(section, pa.string()), pa.array(line, pa.string())], ["pos", "section", "line"])

        # Python holds the lines of some texts at a time, not those of the batch
        lexicon, ends, rows, done = Lexicon(headings), [0], [], []
        for t in texts:
            found = lexicon.lines(t.as_py() or "")
            ends.append(ends[-1] + len(found))
            rows += found
            if len(rows) >= LINES_AT_ONCE:
                done.append(columns(rows))
                rows = []
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([*done, columns(rows)]))

    return run(text)
