"""Personal data: e-mail addresses, IP addresses, card and phone numbers, also in disguise.

Plain patterns give the base spans. Then transducers rewrite a text that shows signs of a disguise: letters and
digits that only look Latin become Latin, invisible characters go, "(at)" and "[dot]" and their like become @ and
dots, and so do plain words in addresses; runs of numbers with a spelled digit or a worded dot become digits. Each character of the rewritten text remembers which stretch of the
source it stands for, the same patterns run again, and what they find is mapped back to the source. A span found so
is added unless a base span of its kind covers it, or it only adds a number word of the text around to one; base spans
always stay.

Offsets count code points, ends are exclusive. Null counts as empty: no spans. Rows are treated one by one, so
repeated ids stay; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: from inside the run it would end the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: Characters that look like a Latin letter, digit or sign, and the one that they look like.
LOOKALIKES = dict(zip(
    "аеорсхуіјѕԁһкмтвнАВЕКМНОРСТХІЈЅ" "οαινυκρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹" "․·∙。｡﹒﹫‐‑‒–—−﹣",
    "aeopcxyijsdhkmtbhABEKMHOPCTXIJS" "oaivukptABEZHIKMNOPTYX" "01234567890123456789" "......@-------",
))
#: The full-width forms of all of ASCII.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: All further characters that stand for one sign of ASCII, by their compatibility forms: bold, circled and other letters.
LOOKALIKES |= {chr(c): n for c in range(0x340, 0x20000) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and "!" <= n <= "~" and chr(c) not in LOOKALIKES}
#: Characters without width.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Digits spelled in English, German, French and Spanish.
SPELLED = {w: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for i, w in enumerate(words.split())}
#: Top-level domains that end any address spelled in plain words.
TOP = "com org net edu gov mil info biz int io ai app dev me tv us uk de fr es it eu ch at nl be pl pt se no fi dk ru cn jp in br mx ar ca au nz ie za".split()
#: Words that no domain begins with; after "at" they make "dot" a plain word, unless a domain of TOP follows.
NO_DOMAIN = "the a an this that these those each every any some my your his her its our their it him us me you them which what der die das dem den le la les el los las".split()
#: Spelled digits that extend a base span in any case.
LEAST = 4
#: Digits of a phone number that no fewer words extend.
WHOLE = 11

_ODD = re.compile("[" + "".join(map(re.escape, [*LOOKALIKES, *INVISIBLE])) + "]")
_SIGN = re.compile(r"[\[({<][\x20\t]*(?:(?P<at>at|@|arroba)|(?P<dot>dot|punkt|punto|point|\.))[\x20\t]*[\])}>][\x20\t]*", re.I)
#: Signs of one letter count only together: "alice (a) example (d) com".
_SHORT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\x20?[\[({]a[\])}]\x20?)[A-Za-z0-9-]+(?:\x20?[\[({]d[\])}]\x20?[A-Za-z0-9-]+)+", re.I)
_SHORT_DOT = re.compile(r"\x20?[\[({]d[\])}]\x20?", re.I)
_DOT = r"(?<!\x20)\x20+(?:dot|punkt|punto)\x20+"
_TOP = rf"(?:{'|'.join(TOP)})(?![A-Za-z0-9-])"
#: Words of times of day, which are no labels of a domain unless one of TOP ends it.
TIMES = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty noon midnight am pm".split()
_CLOCK = rf"(?:{'|'.join([*TIMES, *SPELLED])})(?![A-Za-z0-9-])"
_LABEL = rf"(?!{_CLOCK})[A-Za-z0-9-]+"
#: Any last label may follow a domain that is no plain prose, and an @ if all dots are words; those of TOP end any domain
#: but an article alone that goes on in plain words: "at the dot com boom".
_WORDY = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:"
    rf"(?P<at>\x20+(?:at|ät|arroba)\x20+)(?:(?!(?:{'|'.join(NO_DOMAIN)})\x20){_LABEL}(?:(?:{_DOT}|\.){_LABEL})*{_DOT}(?!{_CLOCK})[A-Za-z]{{2,}}(?![A-Za-z0-9-])"
    rf"|(?!(?:{'|'.join(NO_DOMAIN)}){_DOT}[A-Za-z0-9-]+\x20+[A-Za-z])[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*{_DOT}{_TOP})"
    rf"|(?P<sign>\x20*@\x20*)(?:[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])"
    rf"|[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*{_DOT}{_TOP}))",
    re.I,
)
_WORDY_DOT = re.compile(_DOT, re.I)
#: An address with spaces around its signs, under a listed top-level domain.
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\x20+@\x20*|@\x20+)[A-Za-z0-9-]+(?:(?:\x20+\.\x20+|\.)[A-Za-z0-9-]+)*(?:\x20+\.\x20+|\.){_TOP}", re.I)
_SPACED_DOT = re.compile(r"(?<!\x20)\x20+\.\x20+")
#: Four numbers with spaces around the dots, and an address with a space after each of its characters.
_SPACED_IP = re.compile(r"(?<![0-9.])(?<![0-9.]\x20)[0-9]{1,3}(?:\x20{1,2}\.\x20{1,2}[0-9]{1,3}){3}(?![0-9])(?!\x20{1,2}\.\x20{1,2}[0-9])")
_LETTERED = re.compile(r"(?<!\S)(?<!(?<!\S)[A-Za-z0-9._%+-]\x20)(?:[A-Za-z0-9._%+-]\x20){2,}@\x20(?:[A-Za-z0-9-]\x20)+(?:\.\x20(?:[A-Za-z0-9-]\x20)+)*\.\x20(?:[A-Za-z0-9-]\x20)+?[A-Za-z0-9](?!\S|\x20[A-Za-z0-9](?!\S))")
#: Digits with letters among them that look like digits.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]*[OoIl][0-9OoIl]*(?![A-Za-z0-9])")
_DIGIT_LIKE = str.maketrans("OoIl", "0011")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_ONE = rf"(?:(?:double|triple)[\x20]+)?(?:{_WORD}|[0-9]+)"
_NUMBER = re.compile(rf"(?:\b(?:plus|oh)[\x20-]+)?(?<!\w){_ONE}(?:(?:[\x20,-]+|[\x20]*\.[\x20]*|[\x20]+(?:dot|punkt|punto|point)[\x20]+)(?:oh|{_ONE}))+(?!\w)", re.I)
_SPELLED, _NEXT = re.compile(rf"\b(?:oh|{_WORD})\b", re.I), re.compile(r"[.,]\x20")
_NUMBER_PART = re.compile(rf"(?P<times>\b(?:double|triple)[\x20]+)|(?P<plus>\bplus\b)|(?P<word>\b(?:oh|{_WORD})\b)|(?P<dot>\.|\b(?:dot|punkt|punto|point)\b)|(?P<digit>[0-9])|(?P<gap>[\x20,-]+)", re.I)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the undisguised spans."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if first := _DIGIT.search(text):
        at = max(0, first.start() - 1)
        for m in _IP.finditer(text, at):
            if all(len(p) <= 3 and int(p) <= 255 for x in m[0].split(".") if (p := x.lstrip("0") or "0")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if text.find("+", at) >= 0:
            for m in _PHONE.finditer(text, at):
                if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewriting:
    """A rewritten text, and for each of its characters the stretch of the source that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def replace(self, edits: list[tuple[int, int, str]]) -> "Rewriting":
        """Puts other characters in place of stretches; edits: (start, end, new), by start, none overlapping."""
        if edits:
            text, starts, ends, at = [], [], [], 0
            for s, e, new in edits:
                text += [self.text[at:s], new]
                starts += [self.start[at:s], np.full(len(new), self.start[s])]
                ends += [self.end[at:s], np.full(len(new), self.end[e - 1])]
                at = e
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end = (np.concatenate([*x, own[at:]]) for x, own in ((starts, self.start), (ends, self.end)))
        return self


def _looks(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _ODD.finditer(text)]


def _signs(text: str) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for m in _SIGN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in " \t":
            start -= 1
        end = m.end()
        out.append((start, end, "@" if m["at"] else "."))
    return out


def _short(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SHORT.finditer(text):
        out += [(*m.span("at"), "@"), *((*d.span(), ".") for d in _SHORT_DOT.finditer(text, m.end("at"), m.end()))]
    return out


def _wordy(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _WORDY.finditer(text):
        at = m.span("at") if m["at"] else m.span("sign")
        out += [(*at, "@"), *((*d.span(), ".") for d in _WORDY_DOT.finditer(text, at[1], m.end()))]
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _NUMBER.finditer(text):
        parts = list(_NUMBER_PART.finditer(text, *m.span()))
        if any(p.lastgroup in ("word", "times") or (p.lastgroup == "dot" and p[0] != ".") for p in parts):
            times = 1
            for i, p in enumerate(parts):
                if p.lastgroup == "times":
                    times = 2 if p[0][0] in "dD" else 3
                    out.append((*p.span(), ""))
                elif p.lastgroup == "word" or (p.lastgroup == "digit" and times > 1):
                    out.append((*p.span(), times * SPELLED.get(p[0].lower(), p[0] if p.lastgroup == "digit" else "0")))
                    times = 1
                elif p.lastgroup in ("plus", "dot"):
                    out.append((*p.span(), "+" if p.lastgroup == "plus" else "."))
                elif p.lastgroup == "gap" and {q.lastgroup for q in (parts[i - 1 : i] + parts[i + 1 : i + 2])} & {"word", "plus", "dot", "times"}:
                    out.append((*p.span(), ""))
    return out


def _spaced(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPACED.finditer(text):
        out += [(*m.span("at"), "@"), *((*d.span(), ".") for d in _SPACED_DOT.finditer(text, m.end("at"), m.end()))]
    out += [(*d.span(), ".") for m in _SPACED_IP.finditer(text) for d in _SPACED_DOT.finditer(text, *m.span())]
    out += [(i, i + 1, "") for m in _LETTERED.finditer(text) for i in range(*m.span()) if text[i] == " "]
    out.sort()
    return [x for x, before in zip(out, [(0, 0, ""), *out]) if x[0] >= before[1]]


def _mixed(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, text[i].translate(_DIGIT_LIKE)) for m in _MIXED.finditer(text) for i in range(*m.span()) if text[i] in "OoIl"]


def signs_of_disguise(text: str, odd: bool) -> list:
    """The transducers that have something to do in the text. odd: whether it has characters beyond Latin ones."""
    low = text.lower()
    bracket = any(c in text for c in "[({<") or odd
    dots = any(f" {w} " in low for w in ("dot", "punkt", "punto"))
    number = dots or " point " in low or "double " in low or "triple " in low or any(w in low for w in SPELLED)
    spaced = odd or " @" in text or "@ " in text or " . " in text
    mixed = odd or _MIXED.search(text) is not None
    return [f for f, use in ((_looks, odd), (_signs, bracket), (_short, bracket), (_spaced, spaced), (_wordy, dots), (_mixed, mixed), (_numbers, number)) if use]


def _adds_little(text: str, base: tuple[int, int, int], own: tuple[int, int, int]) -> bool:
    """Whether own is the number base, which is whole already, and a few number words of the text around it: an address,
    a card, a phone number of WHOLE digits, or any before a full stop or comma ("3138. One")."""
    beside = (text[own[0] : base[0]], text[base[2] : own[2]])
    if own[1] == 0 or sum(len(_SPELLED.findall(x)) for x in beside) >= LEAST:
        return False
    return KINDS[base[1]] != "phone" or len(_NO_DIGIT.sub("", text[base[0] : base[2]])) >= WHOLE or any(_NEXT.search(x) for x in beside)


def find(text: str, odd: bool = True) -> list[tuple[int, int, int, bool]]:
    """(start, number of the kind, end, whether disguised) by start and kind."""
    base = plain(text)
    spans = [(*x, False) for x in base]
    if todo := signs_of_disguise(text, odd):
        r = Rewriting(text)
        before = r.text
        for f in todo:
            r.replace(f(r.text))
        if r.text is not before:
            starts, ends = ([[x[i] for x in base if x[1] == k] for k in range(len(KINDS))] for i in (0, 2))
            for s, k, e in plain(r.text):
                own = (int(r.start[s]), k, int(r.end[e - 1]))
                # those of a kind don't overlap: only the last that begins before own can cover it
                before = bisect.bisect_right(starts[k], own[0])
                if before and ends[k][before - 1] >= own[2]:
                    continue
                inside = range(bisect.bisect_left(starts[k], own[0]), bisect.bisect_right(starts[k], own[2]))
                if not any(ends[k][i] <= own[2] and _adds_little(text, (starts[k][i], k, ends[k][i]), own) for i in inside):
                    spans.append((*own, True))
    return sorted(set(spans))


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with found: the spans of each row's text, by start and kind."""
    names = list(keep)
    out, arrow = common.schema_of(docs, names, "found array<struct<kind: string, start: int, end: int, disguised: boolean>>")
    struct = arrow.field(len(names)).type.value_type

    def run(batches):
        for batch in batches:
            column = batch.column(len(names))
            data, offsets = common.utf8(column)
            for lo, hi in common.steps(offsets):
                bytes_, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                odd = np.concatenate([[0], np.cumsum((bytes_ >= 0xCD) | (bytes_ == 0xAD) | (bytes_ == 0xB7))])[own]
                found = [find(x, b > a) if x else [] for x, a, b in zip(column.slice(lo, hi - lo).to_pylist(), odd, odd[1:])]
                flat = [x for f in found for x in f]
                values = pa.StructArray.from_arrays([
                    pa.array([KINDS[x[1]] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int32()),
                    pa.array([x[2] for x in flat], pa.int32()), pa.array([x[3] for x in flat], pa.bool_()),
                ], fields=list(struct))
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                yield common.columns(batch, lo, hi, names, {"found": pa.ListArray.from_arrays(ends, values)}, arrow)

    return common.mapped(docs.select(*names, F.col(text)), run, out)


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span, or joined overlapping ones, replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def listed(found: str):
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document: how many plain spans of each kind, their digest, and all spans."""
    found = find_pii(common.table(spark, sf_dir, "documents")).withColumn("base", F.filter("found", lambda x: ~x["disguised"]))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))
