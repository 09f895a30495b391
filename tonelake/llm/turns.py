"""Call transcripts as clean speaker turns (problem 1).

A transcript is read once: its lines are cut into labelled stretches of speech, and the full names that it states are noted. From the
names of all its calls a company gets a roster: who its people are, how their names are spelled, and what they do. A call
meets the roster's people whose names sound like its own (phonetic blocks); they settle which of its spellings are names and which
are slips. Then the spellings of its labels are assigned to its people at least total cost, where a further spelling of
one person costs extra, and the stretches become turns: noise stripped, in the order of their times, split into sections.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.mixing import min_cost_flow
from tonelake.storage import one_of_each, small_enough, spread, spread_by, stage

LEAST_WORDS = 4
#: characters from which a line is never a heading
HEADING_CHARS = 200
#: calls in which a name must be stated to be on a company's roster; and how often as many calls must state a name for one that a single call states with
#: one edit, for a person of the same role, to be its slip
ROSTER_CALLS, ESTABLISHED = 2, 10
#: rows of the rosters' blocks that are broadcast at most, so that no company's calls meet in one task; more are joined by a shuffle, whose skew the session's adaptive plan splits
ROSTER_ROWS = 500_000
#: prices of an edit, of an initial, and of a further spelling of the same person
EDIT, INITIAL, FURTHER = 4, 1, 3
# Sounds in brackets, fillers, labels of no person, titles, and what opens the questions.
_SOUND = r"(?:inaudible|laughter|laughs?|crosstalk|cross talk|technical difficult(?:y|ies)|phonetic|applause|music|audio gap|coughs?|coughing|pause|silence|background noise|sic|ph|indiscernible|foreign language|overlapping speakers)"
_NOISE = re.compile(rf"(?i)\[\s*{_SOUND}\s*\]|\(\s*{_SOUND}\s*\)|\*\s*{_SOUND}\s*\*|[♪♫]+|[\[(]\d{{1,2}}:\d\d(?::\d\d)?(?:[.,]\d+)?[\])]")
_FILLER = re.compile(r"(?i)(?<![\w'-])(?:u+m+|u+h+|e+r+|a+h+|h+m+|m+hm+|mm+|you know|i mean)(?:\.{2,}|…|[,.])?(?![\w'-])")
_OPERATORS = {"operator", "the operator", "conference operator", "coordinator", "the coordinator", "conference coordinator", "moderator", "call operator", "phone operator", "telephone operator"}
_NOBODY = re.compile(r"(?i)(?:unknown|unidentified|unnamed|male|female)\s+\w+(?:\s+\w+)?|speaker(?:\s*#?\d+)?|participant|caller|analyst|executive|company representative")
_TITLE_WORDS = set("chief executive financial operating technology accounting revenue officer president chairman chairwoman chair and & of vice senior svp evp ceo cfo coo cto treasurer general counsel head director ir investor relations founder cofounder co-founder managing exec interim global group the secretary controller".split())
# Headings of a transcript's parts, and what a disclaimer about it says.
_SKIP = re.compile(r"(?i)^(?:.{2,90}\bearnings call\b.{0,20}|.*\btranscript\b.*\b(?:produced|provided|prepared|accuracy|guaranteed?|copyright)\b.*|call participants:?|participants:?|prepared remarks:?|questions? and answers?:?|question-and-answer session:?|q\s?&\s?a(?: session)?:?|duration:.*|webvtt.*|\d{1,5}|presentation:?|corporate participants:?|conference call participants:?)$")
# Words for the questions and who asks them, words for beginning, and words of a promise.
_QUESTIONS = re.compile(r"(?i)\b(?:questions?|q\s?&\s?a|question-and-answer|callers?|lines?|floor|queue|star)\b")
_BEGINS = re.compile(r"(?i)\b(?:first|next|following|begin|start|open|now|ready|take|press|turn)(?:s|ing|ed)?\b")
_PROMISE = re.compile(r"(?i)\b(?:later|after (?:the|our|these)(?: prepared)? remarks|following (?:the|our|these) (?:prepared )?(?:remarks|presentation))")
_NAME = r"[A-Z][^\W\d_]+(?:['’-][^\W\d_]+)*"
_FULL = rf"{_NAME}\s+(?:[A-Z]\.\s+)?{_NAME}"
_TIME = r"[\[(]?(\d{1,2}:\d\d:\d\d)(?:[.,]\d+)?[\])]?"
_AT = re.compile(rf"^\s*{_TIME}\s*(?:[-–]\s*)?")
_CUE = re.compile(r"^\s*(\d{1,2}:\d\d:\d\d|\d\d:\d\d)(?:[.,]\d+)?\s*-->")
_SIDED = re.compile(r"^\s*<\s*([AQ])\s*-\s*([^<>]{1,120})>\s*:?\s*")
_INLINE = re.compile(r"^\s*([^:\n]{1,110}?)\s*:(?!\d)\s*")
_DASH = re.compile(r"\s+(?:--|—|–|-)\s+|\s*—\s*")
_HONOUR = re.compile(r"(?i)^(?:mr|mrs|ms|miss|dr|prof|sir|madam)\.?\s+")
_PAIR = re.compile(rf"(?=\b({_NAME})[ \t]+(?:[A-Z]\.[ \t]+)?({_NAME}))\b[A-Z]")
# A full name with what is said beside it: a title after a comma, a dash or in brackets, or a firm after a preposition.
_STATED = re.compile(
    rf"({_FULL})(?:[ ]*\(([^()\n]{{2,60}})\)|[ ]+(?:--|—|–|-)[ ]+([^\n.;:?]{{2,80}})|[ ]+(?:with|at|of|from)[ ]+([A-Z][^\n.;:?,]*)"
    rf"|,[ ]+((?:(?!\s*,?\s+and\s+{_FULL},)[^\n.;:?]){{2,80}}))"
)


@lru_cache(maxsize=100_000)
def role_of(title: str | None) -> str:
    """The role that a title or a firm beside a name tells; unknown for other titles."""
    t = f" {(title or '').lower()} "
    if not t.strip():
        return ""
    for role, pattern in (("CEO", r"chief executive|\bceo\b"), ("CFO", r"chief financial|\bcfo\b"), ("COO", r"chief operating|\bcoo\b"), ("IR", r"investor relations|\bir\b"), ("Analyst", r"\banalyst\b"), ("Operator", r"\boperator\b")):
        if re.search(pattern, t):
            return role
    return "unknown" if is_title(title) else "Analyst"


def bare(title: str) -> str:
    """A title's words alone, to compare it with."""
    return " ".join(re.findall(r"\w+", title.lower()))


def is_title(text: str | None) -> bool:
    words = re.findall(r"[\w&-]+", (text or "").lower())
    return bool(words) and all(w in _TITLE_WORDS for w in words)


def strip_noise(text: str) -> str:
    if _MARKS.search(text):
        text = _NOISE.sub(" ", text)
    text = _FILLER.sub(" ", text)
    return _SPACED_MARK.sub(r"\1", " ".join(text.split()))


_MARKS = re.compile(r"[\[(*♪♫]")
_SPACED_MARK = re.compile(r"\s+([,.;:?!])")


def proper(name: str) -> str:
    """A name in one spelling: single spaces, capitals only where words begin."""
    return " ".join(w.capitalize() if w.isupper() or w.islower() else w for w in name.replace("\xa0", " ").split())


# Consonants by class.
_CONSONANTS, _CLASSES = "bfpvcgjkqsxzdtlmnr", "111122222222334556"


def sounds(name: Column) -> Column:
    """Phonetic blocks of a full name: how the family name sounds (consonants by class, without vowels and repetitions), the given name with the family's first letter, and the reverse."""
    low = F.split(F.lower(name), " ")
    given, family = F.element_at(low, 1), F.element_at(low, -1)
    code = F.regexp_replace(F.regexp_replace(F.translate(family, _CONSONANTS, _CLASSES), "[^0-9]", ""), r"(.)\1+", "$1")
    return F.array(F.concat(F.lit("f"), code), F.concat(F.lit("g"), given, F.substring(family, 1, 1)), F.concat(F.lit("i"), F.substring(given, 1, 1), F.substring(family, 1, 4)))


@lru_cache(maxsize=300_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two strings, at most `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most or len(set(a) ^ set(b)) > 2 * (most - 1):  # an edit changes at most two of the letters that occur
        return most
    before, last = list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], last[j - 2] + 1)
        if min(row) >= most:
            return most
        last, before = before, row
    return min(before[-1], most)


class Label:
    """A label taken apart: kind (operator, nobody, title, name), the name's words, what is said beside it, the side (A or Q)."""

    def __init__(self, text: str, side: str = "") -> None:
        text = re.sub(r"(?i)\s*\(\s*(?:continued|cont'?d\.?)\s*\)", "", text).strip(" ,-")
        self.side, self.words, self.beside = side, [], ""
        self.text = re.sub(r"\s+", " ", text)
        head, *more = _DASH.split(self.text, maxsplit=1)
        if not more and (m := re.match(r"^(.*?)\s*\(([^()]+)\)$", head)):
            head, more = m[1], [m[2]]
        low = head.lower().strip(" .")
        if low in _OPERATORS:
            self.kind = "operator"
            return
        if _NOBODY.fullmatch(head.strip()):
            self.kind = "nobody"
            return
        if is_title(head) or is_title(self.text):
            self.kind, self.beside = "title", self.text if is_title(self.text) else head
            return
        first, comma, rest = head.partition(",")
        if comma:
            if len(first.split()) == 1 and len(rest.split()) == 1 and not is_title(rest) and re.fullmatch(rf"\s*{_NAME}\s*", proper(rest)):
                head = f"{rest} {first}"  # family name first
            else:
                head, more = first, [rest, *more]
        head = _HONOUR.sub("", head.strip())
        self.words = proper(head).split()
        self.beside = " ".join(more).strip(" -")
        self.kind = "name" if 0 < len(self.words) < 5 and all(w[0].isupper() for w in head.split()) and all(re.fullmatch(rf"{_NAME}|[A-Z]\.?", w) for w in self.words) else "none"


@lru_cache(maxsize=100_000)
def label_of(text: str, side: str = "") -> Label:
    return Label(text, side)


def plain(text: str) -> str:
    """Text of any layout without markup: entities, hard spaces, paragraphs, headings."""
    text = html.unescape(text).replace("\xa0", " ") if "&" in text or "\xa0" in text else text
    if "</" in text or "<p" in text or "<br" in text:
        text = re.sub(r"(?i)<(?:/?p|/?div|/?h\d|br|/?li|/?ul)\b[^<>]*>", "\n", text)
        text = re.sub(r"(?i)</?(?:strong|b|i|em|span|u|a|html|body)\b[^<>]*>", "", text)
    return text.replace(_PART, " ").replace(_FIELD, " ")


#: what ends a stretch, and a field of it, where they are stored as one text
_PART, _FIELD = "\x1e", "\x1f"


def is_label(label: Label, families: frozenset[str], bare_line: bool = False) -> bool:
    """Whether what looks like a label names anyone; a single word must sound like a family name of the call."""
    if label.kind in ("operator", "nobody"):
        return True
    if label.kind == "title":
        return not bare_line
    if label.kind != "name":
        return False
    if bare_line and len(label.words) > 1:
        return bool(label.beside)
    if len(label.words) > 1 and (label.beside or label.side or len(label.words) == 2 and len(label.words[0]) > 2 or label.words[0].endswith(".")):
        return True
    if len(label.words) == 1 and label.beside and (is_title(label.beside) or label.side):
        return True
    family = label.words[-1].lower()
    return family in families or any(distance(family, n) <= (1 if len(family) < 5 else 2) for n in families if abs(len(n) - len(family)) < 3)


def stretches(text: str) -> tuple[list[tuple[str, str, str, str]], str]:
    """(label, side, time, speech) of every stretch, in the order of their times where all have one; and the text that nobody speaks, as lines."""
    text = plain(text)
    families = frozenset(b.lower() for _, b in _PAIR.findall(text))
    lines = _unfolded(text.replace("\r\n", "\n").replace("\r", "\n"), families).split("\n")
    if "-->" in text:
        lines = _in_cue_order(lines)
    found: list[list] = []
    unspoken: list[str] = []
    pending = ""
    for line in lines:
        bare = line.strip()
        if m := _CUE.match(bare):
            pending = m[1]
            continue
        if not bare or _is_heading(bare):
            continue
        at = _AT.match(bare)
        time, rest = (at[1], bare[at.end() :]) if at else ("", bare)
        label, speech = None, rest
        if rest[:1] == "<" and (m := _SIDED.match(rest)):
            label, speech = (_clean(m[2]), m[1]), rest[m.end() :]
        elif (m := _INLINE.match(rest)) and is_label(label_of(one := _clean(m[1])), families):
            label, speech = (one, ""), rest[m.end() :]
        elif len(rest) < 110 and not rest.endswith((".", "?", "!", ",", ";")) and is_label(label_of(one := _clean(rest)), families, True):
            label, speech = (one, ""), ""
        if label is not None:
            found.append([*label, time or pending, [speech]])
            pending = ""
        elif not found:
            unspoken.append(rest)
        elif rest is bare or not _is_heading(rest):
            found[-1][3].append(bare if time and not rest else rest)
    out = []
    for label, side, time, parts in found:
        said, *after = _LISTED.split("\n".join(parts), maxsplit=1)
        unspoken += after
        if speech := strip_noise(said):
            out.append((label, side, time, speech))
        elif side == "":
            unspoken.append(label)
    if out and all(t for _, _, t, _ in out):
        out.sort(key=lambda x: tuple(int(p) for p in f"0:{x[2]}".split(":")[-3:]))
    return out, "\n".join(unspoken)


@lru_cache(maxsize=100_000)
def _clean(label: str) -> str:
    return strip_noise(label)


def _is_heading(line: str) -> bool:
    return len(line) < HEADING_CHARS and _SKIP.match(line) is not None


_LISTED = re.compile(r"(?i)\b(?:call )?participants:\s|\bduration: \d")


def _unfolded(text: str, families: frozenset[str]) -> str:
    """A text with a line for each label that follows a time, where calls or parts of them came on one line."""
    out, last = [], 0
    for m in _INSIDE.finditer(text):
        after = text[m.end() : m.end() + 130]
        n = _INLINE.match(after)
        if after[:1] == "<" and _SIDED.match(after) or n and is_label(label_of(_clean(n[1])), families):
            out.append(text[last : m.start()])
            last = m.start()
    return "\n".join([*out, text[last:]])


_INSIDE = re.compile(rf"(?:(?<=\s)|^){_TIME}[ \t]*(?:[-–][ \t]*)?(?!-->|\s|$)")


def _in_cue_order(lines: list[str]) -> list[str]:
    """Caption cues sorted by the time they begin; what stands before the first stays first."""
    cues: list[tuple[tuple, list[str]]] = [((-1,), [])]
    for line in lines:
        if m := _CUE.match(line.strip()):
            cues.append((tuple(int(x) for x in f"0:{m[1]}".split(":")[-3:]), []))
        cues[-1][1].append(line)
    cues[1:] = sorted(cues[1:], key=lambda c: c[0])
    return [line for _, own in cues for line in own]


def stated(parts: list[tuple[str, str, str, str]], unspoken: str) -> dict[str, Counter]:
    """Full names that are spoken or listed with something beside them, and how often with which (role, title). Labels are no statements."""
    found: dict[str, Counter] = defaultdict(Counter)
    listed = strip_noise(unspoken.replace("\n", " ; "))
    for text in (*(speech for *_, speech in parts), listed):
        for m in _STATED.finditer(text):
            name = proper(m[1])
            if is_title(name) or any(w.lower() in _TITLE_WORDS for w in name.split()):
                continue
            title = re.split(r"\s+(?:--|—|–|-)\s+", m[2] or m[3] or m[5] or "")[0]
            if m[4]:
                role = "Analyst"
            elif "analyst" in (m[2] or m[3] or m[5] or "").lower():
                role = "Analyst"
            elif title:
                role = role_of(title)
                if role == "Analyst" and not (m[2] or m[3]):
                    role = ""  # after a comma anything may follow, a clause too
            else:
                role = ""
            found[name][role, bare(title) if is_title(title) else ""] += 1
    return found


def assign(forms: list[str], people: list[str], price, further: int = FURTHER) -> dict[str, str]:
    """Spellings to people at least total price; a price of None forbids. A person's first spelling is at its price, each further one costs `further` more."""
    links = [(f, p, c) for f in forms for p in people if (c := price(f, p)) is not None]
    several = {p for p, n in Counter(p for _, p, _ in links).items() if n > 1}
    if not several:
        return {f: p for f, p, _ in links}
    edges = [("start", f"f{f}", 1, 0) for f in forms]
    edges += [(f"p{p}", "end", 1, 0) for p in people] + [(f"p{p}", "end", len(forms), further) for p in several]
    flow = min_cost_flow([*edges, *((f"f{f}", f"p{p}", 1, c) for f, p, c in links)], "start", "end")
    return {f: p for (f, p, _), n in zip(links, flow[len(edges) :]) if n}


class Call:
    """One call's people: which person each label means.

    parts: its stretches. said: full names that it states, with roles. roster: people of the company who sound like its names: name to (role, calls that state it).
    """

    def __init__(self, parts: list[tuple[str, str, str, str]], said: dict[str, Counter], roster: dict[str, tuple[str, int]]) -> None:
        self.parts = [(label_of(text, side), speech) for text, side, _, speech in parts]
        self.said: dict[str, Counter] = defaultdict(Counter)
        self.titles: dict[str, set[str]] = defaultdict(set)
        for name, told in said.items():
            for (role, title), n in told.items():
                self.said[name][role] += n
                self.titles[name].add(title)
        self.roster = roster
        self.forms = Counter(" ".join(label.words) for label, _ in self.parts if label.kind == "name" and len(label.words) >= 2 and not _INITIAL.fullmatch(label.words[0]))
        self.beside: dict[str, Counter] = defaultdict(Counter)
        for label, _ in self.parts:
            if label.kind == "name" and len(label.words) >= 2 and (label.beside or label.side == "Q") and not _INITIAL.fullmatch(label.words[0]):
                self.beside[" ".join(label.words)][role_of(label.beside) or "Analyst"] += 1
        self.people = self._people()
        self.roles = {p: self._role(p) for p in self.people}
        self.meant = self._meant()

    def _people(self) -> list[str]:
        """The full names of the call without their slips, those that most calls of the company state first, then those that this one states most, then those of most labels."""
        support = {n: (self.roster.get(n, ("", 0))[1], sum(self.said[n].values()) if n in self.said else 0, self.forms[n]) for n in {*self.said, *self.forms}}
        found: list[str] = []
        for name in sorted(support, key=lambda n: ([-x for x in support[n]], n)):
            near = [p for p in found if slip(name, p) is not None]
            if not any(self._is_slip(name, p, support[name]) for p in near):
                found.append(name)
        for name in self.forms:  # a slip of somebody whom the company's other calls state, not this one
            if name in found and support[name][:2] == (0, 0):
                known = [(c, p) for p, (_, c) in self.roster.items() if p not in found and slip(name, p) is not None]
                if known:
                    found[found.index(name)] = max(known)[1]
        return found

    def _is_slip(self, name: str, other: str, support: tuple[int, int, int]) -> bool:
        """Whether a name is a spelling of one with more support. What only labels give is, unless the roster knows it well; what this call states is only if
        the roster doesn't know it, but well the other, one edit away and in the same role."""
        calls, here, _ = support
        if not here:
            return calls < ESTABLISHED
        role, known = self.roster.get(other, ("", 0))
        told = {*self.said[name], *self.beside.get(name, ())}
        return not calls and known >= ESTABLISHED and slip(name, other) == 1 and told <= {role, ""}

    def _meant(self) -> dict[str, str]:
        """The person of each spelling in labels, as far as names alone tell: spellings that fit several people alike are left to the turn."""
        spellings = {" ".join(label.words): label.words for label, _ in self.parts if label.kind == "name"}
        prices = {f: {p: c for p in self.people if (c := fit(f, p)) is not None} for f in spellings}
        open_ = {f for f, c in prices.items() if len(spellings[f]) == 1 or _INITIAL.fullmatch(spellings[f][0])}
        sure = {f for f in prices if f not in open_ and prices[f]}
        chosen = assign(sorted(sure), self.people, lambda f, p: prices[f].get(p))
        for f in open_:
            if prices[f]:
                least = min(prices[f].values())
                alike = [p for p, c in prices[f].items() if c == least]
                if len(alike) == 1:
                    chosen[f] = alike[0]
        self.prices = prices
        return chosen

    def _role(self, person: str) -> str:
        """What the call tells of a person by most votes, else what the company's other calls tell."""
        votes: Counter = Counter()
        for name, told in self.said.items():
            if name == person or name not in self.people and slip(name, person) is not None:
                votes.update({r: 20 * n for r, n in told.items()})
        for name, told in self.beside.items():
            if name == person or name not in self.people and fit(name, person) is not None:
                votes.update(told)
        for role, _ in votes.most_common():
            if role not in ("", "unknown"):
                return role
        if votes["unknown"]:
            return "unknown"
        if self.roster.get(person, ("", 0))[0]:
            return self.roster[person][0]
        own = person.split()[-1].lower()
        asks = any(label.kind == "name" and "?" in speech and label.words[-1].lower() == own for label, speech in self.parts)
        return "Analyst" if asks else "unknown"

    def who(self, label: Label, before: list[str]) -> tuple[str, str]:
        """Name and role. Of people who fit alike, the one on the label's side, then the one named or heard last."""
        if label.kind == "operator":
            return "Operator", "Operator"
        if label.kind == "nobody":
            return "Unknown", "unknown"
        if label.kind == "title":
            role = role_of(label.beside)
            same = [p for p in self.people if (self.roles[p] == role if role != "unknown" else bare(label.beside) in self.titles[p])]
            return (same[0], role) if same else ("Unknown", role or "unknown")
        form = " ".join(label.words)
        if person := self.meant.get(form):
            return person, self.roles[person]
        prices = self.prices[form]
        if not prices:
            return "Unknown", role_of(label.beside) or "unknown"
        least = min(prices.values())
        told = role_of(label.beside) or {"Q": "Analyst", "A": "officer"}.get(label.side, "")
        last = {p: i for i, p in enumerate(before)}
        rank = lambda p: ((self.roles[p] != told) if told not in ("", "officer") else (told == "officer" and self.roles[p] == "Analyst"), -last.get(p, -1))
        person = min((p for p, c in prices.items() if c == least), key=rank)
        return person, self.roles[person]

    def turns(self) -> list[tuple[str, int, str, str, str]]:
        """section, turn_index, speaker_name, speaker_role, text."""
        heard: list[str] = []
        said = []
        for label, speech in self.parts:
            name, role = self.who(label, heard)
            heard.append(name)
            if name == "Operator":
                heard += [p for p in self.people if p in speech]
            said.append((name, role, speech))
        said = [x for x in said if len(x[2].split()) >= LEAST_WORDS]
        asked = [i for i, (_, role, speech) in enumerate(said) if role == "Analyst"]
        start = len(said)
        if asked:
            start = next((i for i in range(asked[0]) if said[i][1] != "Analyst" and said[i][0] != "Unknown" and opens(said[i][0], said[i][2])), asked[0])
        out: list[list] = []
        counts: Counter = Counter()
        for i, (name, role, speech) in enumerate(said):
            section = "qa" if i >= start else "prepared_remarks"
            if out and out[-1][0] == section and out[-1][2] == name:
                out[-1][4].append(speech)
            else:
                out.append([section, counts[section], name, role, [speech]])
                counts[section] += 1
        return [(*x[:4], " ".join(x[4])) for x in out]


_INITIAL = re.compile(r"[A-Z]\.?")


def opens(name: str, speech: str) -> bool:
    """Whether a turn opens the questions: a sentence speaks of questions and of beginning. A promise of later ones or a hand-over to the operator doesn't."""
    if not _QUESTIONS.search(speech):
        return False
    for sentence in re.split(r"(?<=[.!?])\s+", speech):
        if _QUESTIONS.search(sentence) and _BEGINS.search(sentence) and not _PROMISE.search(sentence) and (name == "Operator" or "operator" not in sentence.lower()):
            return True
    return False


@lru_cache(maxsize=300_000)
def slip(form: str, name: str) -> int | None:
    """Edits between two full names if one can be a slip of the other, else None."""
    a, b = form.lower().split(), name.lower().split()
    if len(a) < 2 or len(b) < 2:
        return None
    given, family = distance(a[0], b[0]), distance(a[-1], b[-1])
    return given + family if given <= 1 and family <= 2 and given + family <= 2 else None


@lru_cache(maxsize=300_000)
def fit(form: str, person: str) -> int | None:
    """How badly a label's words fit a person: 0 as stated, more for slips; an initial or a family name alone fit too."""
    words, names = form.lower().split(), person.lower().split()
    last = distance(words[-1], names[-1])
    if last > 2 or last == 2 and len(names[-1]) < 6:
        return None
    if len(words) == 1:
        return EDIT * last
    first = words[0].rstrip(".")
    if len(first) == 1:
        return EDIT * last + INITIAL if names[0].startswith(first) else None
    off = distance(first, names[0])
    return EDIT * (last + off) if off <= 1 or off == 2 and last == 0 else None


def _texts(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("transcript_id").isNotNull()).select(F.col("transcript_id").cast("bigint").alias("k"), F.upper(F.trim(F.col("ticker").cast("string"))).alias("s"), F.col("raw_text").cast("string").alias("t"))
    return rows.where(F.length("t") > 0)


_NAMED = "array<struct<name: string, role: string, title: string, n: int>>"


def _read(texts: DataFrame) -> DataFrame:
    """k, s, parts (the stretches as one text), names (what the call states): each call is parsed here, and nowhere else."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("role", pa.string()), ("title", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                packed, names, labels = [], [], []
                for t in part.column(2):
                    parts, unspoken = stretches(t.as_py())
                    packed.append(_PART.join(_FIELD.join(p) for p in parts))
                    names.append([{"name": n, "role": r, "title": x, "n": c} for n, told in stated(parts, unspoken).items() for (r, x), c in told.items()])
                    words = (label_of(p[0], p[1]).words for p in parts)
                    labels.append(sorted({" ".join(w) for w in words if len(w) > 1 and not _INITIAL.fullmatch(w[0])}))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.string()), pa.array(names, kind), pa.array(labels, pa.list_(pa.string()))], names=["k", "s", "parts", "names", "labels"])

    return texts.mapInArrow(run, f"k bigint, s string, parts string, names {_NAMED}, labels array<string>")


def rosters(read: DataFrame) -> DataFrame:
    """s (company), name, role, calls: the people that at least ROSTER_CALLS of a company's calls state in full, with the role most calls give them (empty if none does)."""
    told = read.where(F.col("s") != "").select("k", "s", F.inline("names")).groupBy("s", "name", "role").agg(F.count_distinct("k").alias("n"))
    role = F.max_by("role", F.struct(~F.col("role").isin("", "unknown"), F.col("role") != "", "n", "role"))
    return told.groupBy("s", "name").agg(role.alias("role"), F.sum("n").alias("calls")).where(F.col("calls") >= ROSTER_CALLS)


def speaker_turns(df: DataFrame) -> DataFrame:
    """transcript_id, section, turn_index, speaker_name, speaker_role, text of every turn of every call with text.

    Rows with the same transcript_id count once; null ids, null or empty texts and texts without a label have no
    turns. Companies compare trimmed and in upper case; a call without company meets no roster. Other columns are ignored.
    """
    read = stage(_read(one_of_each(spread(_texts(df)), ["k"], "t")), "read")
    roster = stage(rosters(read), "roster")
    names = F.array_distinct(F.concat(F.transform("names", lambda x: x["name"]), "labels"))
    wanted = read.where(F.col("s") != "").select("k", "s", F.explode(names).alias("form")).select("k", "s", F.explode(sounds(F.col("form"))).alias("block")).distinct()
    blocks = roster.withColumn("block", F.explode(sounds(F.col("name"))))
    met = wanted.join(F.broadcast(blocks) if small_enough(blocks, ROSTER_ROWS) else blocks, ["s", "block"])
    met = met.groupBy("k").agg(F.collect_set(F.struct("name", "role", F.col("calls").cast("int").alias("calls"))).alias("roster"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, packed, names, people in zip(*(batch.column(i).to_pylist() for i in range(4))):
                parts = [tuple(p.split(_FIELD)) for p in packed.split(_PART)] if packed else []
                said: dict[str, Counter] = defaultdict(Counter)
                for n in names:
                    said[n["name"]][n["role"], n["title"]] += n["n"]
                rows += [(k, *turn) for turn in Call(parts, said, {p["name"]: (p["role"], p["calls"]) for p in people or []}).turns()]
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names=["transcript_id", "section", "turn_index", "speaker_name", "speaker_role", "text"])

    calls = spread_by(read.select("k", "parts", "names").where("parts <> ''"), "k").join(met, "k", "left").select("k", "parts", "names", "roster")
    return calls.mapInArrow(run, "transcript_id bigint, section string, turn_index int, speaker_name string, speaker_role string, text string")
