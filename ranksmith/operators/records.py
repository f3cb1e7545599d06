"""Experience, education, project and certificate records of resume sections.

What a line is (title, company, dates, duty) is told from the line and the one before it; what it does to the records depends on
the record that is open.  That state stays inside one text, so a batch of texts is a task's unit, nothing is shuffled, and time is in
proportion to the lines.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# helpers travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BULLETS = "•●▪○*-–—"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_POINT = rf"(?:{_MONTH}\s+\d{{4}}|\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}|(?:19|20)\d{{2}})"
SPAN = re.compile(rf"\(?\b({_POINT})\s*(?:-|–|—|\bto\b)\s*({_POINT}|present|current|now|till date)\b\)?", re.I)
LENGTH = re.compile(r"\b\d+(?:\.\d+)?\+?\s*(?:years?|yrs?|months?)\b", re.I)
YEARS = re.compile(r"\b(?:19|20)\d{2}(?:\s*(?:-|–|—|to)\s*(?:19|20)\d{2})?\b")
OPEN_ENDS = ("present", "current", "now", "till date")

#: Last words of a job title.
ROLES = frozenset("engineer developer architect manager analyst scientist intern trainee lead administrator consultant designer tester associate director officer specialist programmer".split())
#: Words that open a duty, in their base forms; ``duty_words`` makes the others.
DUTIES = "develop build design implement create work manage lead maintain collaborate engineer contribute utilize assist handle spearhead write test deploy automate optimize resolve configure integrate migrate monitor support train".split()
UNLIKE = {"build": "built", "lead": "led", "write": "wrote"}
#: Words that are no company by themselves.
NO_COMPANY = frozenset("present current now experience employment internship internships projects education skills certifications responsibilities achievements summary role designation description".split())
#: Words that mark a company however short its name is.
COMPANY_MARKS = re.compile(r"\b(?:inc|ltd|limited|llc|llp|gmbh|corp|corporation|technologies|solutions|systems|labs|software|services|consulting|group|pvt)\b", re.I)
#: Kinds of employment by the words that tell them, the first that occurs wins; without any it is full-time.
KINDS = {"Internship": "intern internship", "Apprenticeship": "apprentice apprenticeship", "Trainee": "trainee", "Contract": "contract contractor", "Freelance": "freelance freelancer", "Volunteer": "volunteer volunteering", "Part-time": "part-time"}
FULL_TIME = "Full-time"


def duty_words() -> frozenset[str]:
    """Base forms with -s, -ing and -ed; a last e or a doubled consonant follows spelling."""
    out = set(DUTIES) | set(UNLIKE.values())
    for w in DUTIES:
        root = w[:-1] if w.endswith("e") else w
        twice = root + root[-1] if w in ("plan", "transfer") else root
        out |= {w + "s", twice + "ing"} | ({twice + "ed"} if w not in UNLIKE else set())
    return frozenset(out)


_DUTY_WORDS = duty_words()


def words(line: str) -> list[str]:
    return re.findall(r"[a-z0-9+#&'-]+", line.lower())


def is_duty(line: str) -> bool:
    first = words(line)[:1]
    return bool(first) and first[0] in _DUTY_WORDS


def kind_of(line: str) -> str:
    found = set(words(line.replace("part time", "part-time")))
    return next((k for k, names in KINDS.items() if found & set(names.split())), FULL_TIME)


def without_place(part: str) -> tuple[str, str | None]:
    """A name and the place after its last comma: at most two capitalised words."""
    name, comma, place = part.rpartition(",")
    if comma and re.fullmatch(r"\s*[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?\s*", place) and not COMPANY_MARKS.search(place):
        return name.strip(), place.strip()
    return part.strip(), None


def is_title(part: str) -> bool:
    """A few capitalised words of which the last, leaving out numerals, names a role."""
    found = [w for w in words(part) if w not in ("i", "ii", "iii")]
    return 1 <= len(found) <= 6 and found[-1] in ROLES and part[:1].isupper()


def is_company(part: str) -> bool:
    """Up to six words that hold no date and are neither a title, a duty, a section's name nor one short word."""
    found = words(part)
    if not found or len(found) > 6 or len(part) < 2 or part[-1] in ".;" and not COMPANY_MARKS.search(part):
        return False
    if found[0] in NO_COMPANY or is_title(part) or is_duty(part) or any(c.isdigit() for c in part) and (SPAN.search(part) or LENGTH.search(part) or YEARS.search(part)):
        return False
    return part[:1].isupper() and (len(found) > 1 or len(part) > 7 or bool(COMPANY_MARKS.search(part)))


class Line(NamedTuple):
    text: str
    duty: bool
    title: str | None
    company: str | None
    place: str | None
    span: tuple[str, str] | None
    length: str | None
    kind: str


def read_line(raw: str) -> Line:
    """What a line of an experience section says.  Parts stand between bars, commas, dashes in blanks and 'at'."""
    text = raw.strip().lstrip(BULLETS).strip()
    if raw.strip()[:1] in BULLETS:
        return Line(text, True, None, None, None, None, None, FULL_TIME)
    dated = any(c.isdigit() for c in text)
    found = SPAN.search(text) if dated else None
    bare = without_place(re.split(r"\||\s[-–—]\s|\s+at\s", text[: found.start()] if found else text)[0].strip(" ,;:("))[0]
    duty = is_duty(text) and not is_title(bare.split(",")[0])
    span, length = ((found[1], found[2]) if found else None), LENGTH.search(text) if dated else None
    title = company = place = None
    if not duty:
        rest = (text[: found.start()] + "|" + text[found.end() :]) if found else text
        label = re.match(r"(?i)(?:role|designation|company|client|employer)\s*:\s*", rest)
        parts = [p.strip(" ,;:()") for p in re.split(r"\||\s[-–—]\s|\s+at\s+(?=[A-Z])", rest[label.end() :] if label else rest)]
        parts = [p for p in parts if p]
        if label and label[0][0] in "rRdD":
            title = parts[0] if parts else None
        elif label:
            company = parts[0] if parts else None
        else:
            if len(parts) == 1 and is_title(parts[0].split(",")[0]):
                parts = [p.strip() for p in parts[0].split(",") if p.strip()]
            for part in parts:
                name, where = without_place(part)
                if title is None and is_title(name):
                    title, place = name, place or where
                elif company is None and is_company(name) and (len(words(text)) <= 6 or len(parts) > 1 or found):
                    company, place = name, place or where
    return Line(text, duty, title, company, place, span, length[0] if length else None, kind_of(text))


EXPERIENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("company", "title", "employment_type", "start_date", "end_date", "duration", "location")] + [T.StructField("is_current", T.BooleanType()), T.StructField("responsibilities", T.ArrayType(T.StringType())), T.StructField("description", T.StringType())])


def differs(new: str | None, old: str | None) -> bool:
    return bool(new) and bool(old) and new.lower() != old.lower()


def experience(text: str, read=read_line) -> list[dict]:
    """Jobs of an experience section.

    A job opens with the first line that names a title, company, dates or a kind of work.  Another company opens the next one, and so
    does another title that comes with a company or dates, or after duties.  Other lines fill what the open job lacks; duties are its
    responsibilities, and a line that begins in lower case goes on with the one before.
    """
    jobs: list[dict] = []
    for raw in text.split("\n"):
        if not raw.strip() or re.match(r"(?i)\s*(?:academic\s+)?project\s*:", raw):
            continue
        line = read(raw)
        job = jobs[-1] if jobs else None
        says = line.title or line.company or line.span or line.length or line.kind != FULL_TIME
        new = job is None or (not line.duty and (differs(line.company, job["company"]) or differs(line.title, job["title"]) and bool(line.company or line.span or job["responsibilities"])))
        if new and (line.duty or not says):
            continue
        if new:
            job = {"company": None, "title": None, "employment_type": FULL_TIME, "start_date": None, "end_date": None, "duration": None, "location": None, "responsibilities": []}
            jobs.append(job)
        header = not line.duty and bool(line.title or line.company or line.span or line.length and len(words(raw)) <= 4)
        if header or new:
            start, end = line.span or (None, None)
            length = line.length or (f"{start} - {end}" if start else None)
            for k, v in (("company", line.company), ("title", line.title), ("location", line.place), ("start_date", start), ("end_date", end), ("duration", length)):
                job[k] = job[k] or v
            if line.kind != FULL_TIME:
                job["employment_type"] = line.kind
        elif raw.strip()[0].islower() and job["responsibilities"]:
            job["responsibilities"][-1] += " " + line.text
        else:
            job["responsibilities"].append(line.text)
    out = [j for j in jobs if j["title"] or j["company"]]
    for j in out:
        j["is_current"] = (j["end_date"] or "").lower() in OPEN_ENDS
        j["description"] = " ".join(j["responsibilities"]) or " ".join(x for x in (j["company"], j["title"], j["duration"]) if x)
    return out


#: Degrees by canonical name, with their spellings; dots do not matter.
DEGREES = {
    "Bachelor of Technology": ("BTech", "Bachelor of Technology"),
    "Bachelor of Engineering": ("BE", "Bachelor of Engineering"),
    "Master of Engineering": ("ME", "Master of Engineering"),
    "Master of Technology": ("MTech", "Master of Technology"),
    "Bachelor of Science": ("BSc", "BS", "Bachelor of Science"),
    "Master of Science": ("MSc", "MS", "Master of Science"),
    "Bachelor of Computer Applications": ("BCA", "Bachelor of Computer Applications"),
    "Master of Computer Applications": ("MCA", "Master of Computer Applications"),
    "Bachelor of Arts": ("BA", "Bachelor of Arts"),
    "Bachelor of Commerce": ("BCom", "Bachelor of Commerce"),
    "Master of Business Administration": ("MBA", "Master of Business Administration"),
    "Doctor of Philosophy": ("PhD", "Doctor of Philosophy", "Doctorate"),
    "Diploma": ("Diploma",),
    "Higher Secondary (12th)": ("HSC", "Higher Secondary Education", "Higher Secondary Certificate", "Higher Secondary", "Class XII", "Class 12", "12th", "Intermediate", "PUC"),
    "Secondary School (10th)": ("SSLC", "Secondary School Leaving Certificate", "Secondary School Certificate", "Class X", "Class 10", "10th", "Matriculation"),
}
#: Fields of study by canonical name, with their spellings.
FIELDS = {
    "Artificial Intelligence and Data Science": ("Artificial Intelligence and Data Science", "AI DS", "AI and DS"),
    "Computer Science and Business Systems": ("Computer Science and Business Systems", "CSBS"),
    "Computer and Communication Engineering": ("Computer and Communication Engineering", "CCE"),
    "Computer Science and Engineering": ("Computer Science and Engineering", "Computer Science", "CSE"),
    "Electronics and Communication Engineering": ("Electronics and Communication Engineering", "ECE"),
    "Electrical and Electronics Engineering": ("Electrical and Electronics Engineering", "EEE"),
    "Information Technology": ("Information Technology", "IT"),
    "Mechanical Engineering": ("Mechanical Engineering",),
    "Civil Engineering": ("Civil Engineering",),
}
GRADE = re.compile(r"\b(?:C?GPA|percentage|grade)\s*[:-]?\s*\d+(?:\.\d+)?(?:\s*/\s*\d+)?%?|\b\d{1,3}(?:\.\d+)?\s*%", re.I)
INSTITUTION = re.compile(r"(?:[A-Z][\w.'&]*[ ]+){0,5}(?:College|University|Institute|School|Academy|Polytechnic)(?:[ ]+(?:of|for)(?:[ ]+(?:and[ ]+)?[A-Z][\w.'&]*)+)?")
#: A field of study that no table knows: capitalised words that follow 'in' on a degree's line.
OTHER_FIELD = re.compile(r"\)?[ \t]+in[ \t]+([A-Z][A-Za-z.'/-]*(?:[ \t]+(?:(?:and|of|for|&)[ \t]+)?[A-Z][A-Za-z.'/-]*){0,5})")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.']*|&")


def _spelt(phrase: str) -> tuple[str, ...]:
    return tuple(("and" if w == "&" else w.replace(".", "").lower()) for w in _TOKEN.findall(phrase))


def _phrases(table: dict[str, tuple[str, ...]]) -> dict[tuple[str, ...], str]:
    return {_spelt(s): name for name, spellings in table.items() for s in spellings}


_DEGREES, _FIELDS = _phrases(DEGREES), _phrases(FIELDS)
_LONGEST = max(map(len, {**_DEGREES, **_FIELDS}))


def phrase_hits(text: str, table: dict[tuple[str, ...], str], slot: str):
    """(start, end, slot, name) of the phrases of ``table``, the longest at each place; a word of two letters must stand in capitals or dots."""
    tokens = list(_TOKEN.finditer(text))
    spelt = ["and" if t[0] == "&" else t[0].replace(".", "").lower() for t in tokens]
    i = 0
    while i < len(tokens):
        for size in range(min(_LONGEST, len(tokens) - i), 0, -1):
            name = table.get(tuple(spelt[i : i + size]))
            if name and (size > 1 or len(spelt[i]) > 2 or "." in tokens[i][0] or tokens[i][0].isupper()):
                yield tokens[i].start(), tokens[i + size - 1].end(), slot, name
                i += size - 1
                break
        i += 1


EDUCATION = T.StructType([T.StructField(n, T.StringType()) for n in ("degree", "field_of_study", "institution", "year", "grade")])


def education(text: str) -> list[dict]:
    """Degrees of an education section, one to a line, over several lines, or all in one line.

    Degrees, fields, institutions, years and grades are put in the order of the text.  A degree opens a record if the open one has
    a degree; an institution does if the open one has an institution and a degree.  The first value of each slot stays.  A field that
    is not in the table stays as it is written after 'in', unless an institution is named there.
    """
    hits = [*phrase_hits(text, _DEGREES, "degree")]
    taken = [(a, b) for a, b, *_ in hits]
    hits += [h for h in phrase_hits(text, _FIELDS, "field_of_study") if all(h[1] <= a or h[0] >= b for a, b in taken)]
    masked = text
    for a, b, *_ in hits:
        masked = masked[:a] + "|" * (b - a) + masked[b:]
    others = [m for _, b in taken if (m := OTHER_FIELD.match(masked, b)) and not INSTITUTION.search(m[1])]
    hits += [(m.start(1), m.end(1), "field_of_study", m[1].rstrip(".'/-")) for m in others]
    for m in others:
        masked = masked[: m.start(1)] + "|" * (m.end(1) - m.start(1)) + masked[m.end(1) :]
    hits += [(m.start(), m.end(), "institution", m[0].strip()) for m in INSTITUTION.finditer(masked)]
    hits += [(m.start(), m.end(), "grade", m[0]) for m in GRADE.finditer(masked)]
    hits += [(m.start(), m.end(), "year", m[0]) for m in YEARS.finditer(masked)]
    out: list[dict] = []
    for _, _, slot, value in sorted(hits):
        now = out[-1] if out else None
        if now is None or slot == "degree" and now["degree"] or slot == "institution" and now["institution"] and now["degree"]:
            out.append(now := dict.fromkeys(EDUCATION.names))
        now[slot] = now[slot] or value
    return [r for r in out if r["degree"] or r["institution"]]


PROJECT = T.StructType([T.StructField("name", T.StringType()), T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("description", T.StringType())])
_LABEL = re.compile(r"(?i)^(?:key\s+)?projects?\s*\d*\s*[:•–—-]\s*(?P<name>.+)$")
_BARRED = re.compile(r"^(?P<name>[A-Z0-9][^|]{1,80}?)\s*(?:\||\s[–—]\s)\s*(?P<tools>[^|]+)$")
_TOOLED = re.compile(r"(?i)^(?P<name>[A-Z][^:]{1,80}?)\s+(?:technolog(?:y|ies)|tech stack|tools(?: used)?|built with|stack)\s*:\s*(?P<tools>.+)$")
_DATED = re.compile(r"^(?:(?:19|20)\d{2}\s+(?P<late>[A-Z0-9].{1,70}?)|(?P<name>[A-Z0-9].{1,70}?)[\s.]+(?:19|20)\d{2})(?:$|\s+(?=(?P<verb>[A-Z][a-z]+)\b))")
_TOOLS_LINE = re.compile(r"(?i)^(?:technolog(?:y|ies)|tech stack|tools(?: used)?|built with|environment|stack)\s*:\s*(?P<tools>.+)$")


class Head(NamedTuple):
    name: str
    tools: list[str]
    rest: str


def project_head(unit: str, bulleted: bool, following: str | None) -> Head | None:
    """A project that a unit of text opens, by the first form that fits: label, tools after a bar, tools after a label, a year, a title over duties."""
    if bulleted:
        return None
    listed = lambda s: [t for t in (x.strip(" .") for x in re.split(r"[,;]", s)) if 1 < len(t) <= 50 or t in ("C", "R")]
    if m := _LABEL.match(unit):
        barred = _BARRED.match(m["name"])
        return Head(barred["name"], listed(barred["tools"]), "") if barred else Head(m["name"].rstrip(" :"), [], "")
    if (m := _TOOLED.match(unit)) and len(m["name"].split()) <= 8:
        return Head(m["name"], listed(m["tools"]), "")
    if (m := _BARRED.match(unit)) and len(m["name"].split()) <= 8:
        duty = re.search(r"\s(?=[A-Z])", m["tools"])
        cut = next((d.start() for d in re.finditer(r"\s(?=[A-Z][a-z]+\s)", m["tools"]) if is_duty(m["tools"][d.start() :])), None) if duty else None
        return Head(m["name"], listed(m["tools"][:cut]), m["tools"][cut:].strip() if cut is not None else "")
    m = _DATED.match(unit)
    if m and (m["verb"] is None or m["verb"].lower() in _DUTY_WORDS):
        return Head((m["late"] or m["name"]).strip(" .-–—"), [], unit[m.end() :].strip())
    if following is not None and len(unit.split()) <= 8 and unit[:1].isupper() and unit[-1] not in ".,;:" and not is_duty(unit) and is_duty(following):
        return Head(unit, [], "")
    return None


def projects(text: str) -> list[dict]:
    """Projects of a section, whose names are labelled, barred, dated, or stand over their duties, in lines or in running text.

    Units are lines, bullets and sentences.  Paragraphs without any such name open with their first line; a text without any is one
    project, named by its first line if that is short, else by its first five words.  Of projects of one name the first stays.
    """
    units: list[tuple[str, bool, bool]] = []
    for paragraph in re.split(r"\n\s*\n", text):
        first = True
        for raw in paragraph.split("\n"):
            bulleted = raw.strip()[:1] in BULLETS and raw.strip()[:1] != ""
            for k, piece in enumerate(re.split(r"\s*[•●▪○]\s*", raw.strip().lstrip(BULLETS).strip())):
                for j, unit in enumerate(re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", piece)):
                    if unit.strip():
                        units.append((unit.strip(), (bulleted or k > 0) and j == 0, first))
                        first = False
    heads = [project_head(u, b, units[i + 1][0] if i + 1 < len(units) else None) for i, (u, b, _) in enumerate(units)]
    if not any(heads) and units:
        starts = [i for i, (u, b, p) in enumerate(units) if p]
        for i in starts:
            words_of = units[i][0].split()
            heads[i] = Head(" ".join(words_of if len(words_of) <= 8 else words_of[:5]).rstrip(".:"), [], "" if len(words_of) <= 8 else units[i][0])
    out: list[dict] = []
    for (unit, _, _), head in zip(units, heads, strict=True):
        if head:
            out.append({"name": head.name[:255], "tools": list(head.tools), "description": [head.rest] if head.rest else []})
        elif out and (m := _TOOLS_LINE.match(unit)):
            out[-1]["tools"] += [t for t in (x.strip(" .") for x in m["tools"].split(",")) if t and t not in out[-1]["tools"]]
        elif out:
            out[-1]["description"].append(unit)
    seen: set[str] = set()
    kept = [p for p in out if p["name"] and not (p["name"].lower() in seen or seen.add(p["name"].lower()))]
    return [{**p, "description": " ".join(p["description"])} for p in kept]


#: Words that a certificate's name goes on after, and words that go on with one.
JOINING = frozenset("of and in for the with academy".split())
GOING_ON = frozenset("system systems information foundations solutions architect associate engineer developer management field cloud".split())
#: Words that open a certificate, whatever stands before.
ISSUERS = frozenset("aws azure google oracle mongodb certified certificate coursera udemy ccna pmp hackathon".split())
#: Lines of a certificate section that are none.
NO_CERTIFICATE = frozenset("internship internships project projects education experience employment hobbies declaration badge badges".split())


def mended(text: str, lexicon: frozenset[str]) -> str:
    """Words that reading by machine split in two are put together where only the whole is a known word, and names get the blank before a bracket."""
    parts = re.sub(r"(?<=[A-Za-z])\(", " (", text).split(" ")
    out: list[str] = []
    for p in parts:
        if out and p and p.isalpha() and out[-1].isalpha() and (out[-1] + p).lower() in lexicon and not (out[-1].lower() in lexicon and p.lower() in lexicon):
            out[-1] += p
        else:
            out.append(p)
    return " ".join(x for x in out if x)


def certificates(text: str, lexicon: frozenset[str]) -> list[str]:
    """Names of certificates; lines that go on with the one before are joined to it."""
    items: list[str] = []
    for raw in text.split("\n"):
        for piece in re.split(r"\s*[|•●▪]\s*", raw.strip().lstrip(BULLETS + " 0123456789.)")):
            clean = mended(re.sub(r"(?i)[\s,-]*\b\d+\s+badges?\b.*$|,\s*\d{1,2}\s*$|\s*-\s*training\s*$", "", piece.strip()), lexicon)
            first = words(clean)[:1]
            if len(clean) < 2 or not first or set(words(clean)) & NO_CERTIFICATE:
                continue
            before = items[-1] if items else ""
            goes_on = before.endswith("-") or clean[0] == "(" or (words(before) or [""])[-1] in JOINING or clean[0].islower() or first[0] in GOING_ON
            if items and goes_on and first[0] not in ISSUERS:
                items[-1] = f"{before.rstrip('-').strip()} {clean}"
            else:
                items.append(clean)
    return [x[:255] for x in items]


#: Lines whose reading a batch of texts remembers.
KEPT_LINES = 1 << 14


def _lists(text: Column, element: T.DataType, parser) -> Column:
    """``parser()`` gives the function that reads one text, afresh for each batch."""

    @F.arrow_udf(T.ArrayType(element))
    def run(texts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        parse, ends, rows = parser(), [0], []
        for t in texts:
            rows += parse(t.as_py() or "")
            ends.append(len(rows))
        if isinstance(element, T.StructType):
            columns = [pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in element]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, to_arrow_type(f.dataType)) for f in element]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, to_arrow_type(element)))

    return run(text)


def remembering():
    """``experience`` that reads a line of a batch once, however often it stands there."""
    read = lru_cache(KEPT_LINES)(read_line)
    return lambda text: experience(text, read)


def experience_records(text: Column) -> Column:
    """array<struct> of the jobs of an experience section; null and empty texts have none."""
    return _lists(text, EXPERIENCE, remembering)


def education_records(text: Column) -> Column:
    """array<struct> of the degrees of an education section; null and empty texts have none."""
    return _lists(text, EDUCATION, lambda: education)


def project_records(text: Column) -> Column:
    """array<struct> of the projects of a section; null and empty texts have none."""
    return _lists(text, PROJECT, lambda: projects)


def certificate_names(text: Column, lexicon: tuple[str, ...] = ()) -> Column:
    """array<string> of the certificates of a section; ``lexicon`` holds the words that split words are mended to."""
    known = frozenset(w.lower() for w in lexicon)
    return _lists(text, T.StringType(), lambda: lambda t: certificates(t, known))
