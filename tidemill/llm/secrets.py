"""Secret scans: fixed patterns, and strings that a primed zstandard compressor finds novel in a sensitive context.

The patterns give the base spans.  Beside them, every string of ``CANDIDATE_LEAST`` and more letters, digits and ``+/_.~-`` with a sensitive word anywhere on its line or on
the nearest lines with text before and after, however long these are, is a candidate (one of fewer than ``CERTAIN`` only if it mixes letters with digits or cases inside), and so are the value of ``VALUE_LEAST`` and more characters of
any kind that is assigned to a name with a sensitive word, and the body of every PEM private key; the host of a mail address is none.  A compressor primed with
a dictionary of identifiers and code words compresses the text around the candidate with and without it; the
difference is what the candidate adds.  Names, paths and words that the dictionary or the surroundings hold add a
few bytes, random strings add nearly what their alphabet needs, and those are reported as kind ``novel``.  Copies
of a candidate do not count as its surroundings, unless several stand where no sensitive word is near.

Spans count code points, end exclusive.  Nulls, ties and repeats: a null text is empty; empty texts have no
spans; rows are judged one by one, so repeated rows give repeated results; texts are scanned whole.  Only texts
that hold one of the sensitive words or the start of a pattern are sent to Python at all; the rest cannot match.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns with the least length of what they must catch.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX = r"[0-9a-f]+"
HEX_LEAST = 16
KINDS = ("assign", "access", "hex", "novel")

# Words before a string that make it sensitive, and the identifiers that prime the compressor.
SENSITIVE = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "login", "session", "cookie", "signature")
IDENTIFIERS = (
    "abstract access account action address admin algorithm allocate application argument array assert async attribute authorization "
    "await backend background boolean branch buffer bytes cache callback category certificate channel charset checksum class client "
    "cluster column command comment commit component config connection constant constructor container content context controller "
    "counter create credential current database dataset debug default delete dependency description development device directory "
    "document domain double element enabled encoding endpoint environment error event example exception execute export expression "
    "extension factory feature field filename filter float format framework frontend function gateway generator github global handler "
    "header height hostname identifier image implement import index information initialize input instance integer interface internal "
    "iterator javascript keyword language layout length library listener localhost location logger login manager master maximum member "
    "memory message metadata method minimum model module network number object offset operation option origin output override package "
    "parameter parent parser password path pattern payload permission pipeline plugin pointer policy position prefix primary private "
    "process production profile project property protected protocol provider public python queue random receive record redirect "
    "reference region register release remote render repository request require resource response result return role root runtime "
    "sample schedule schema scope script secret security select sequence server service session setting signature snapshot source "
    "static status storage stream string structure subscription suffix summary super system table target template temporary test "
    "thread throw timeout timestamp token transaction transform true type undefined unique update upload username utility value "
    "variable vector version virtual visible void volume warning website widget width window worker workspace "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx aaaaaaaa "
    "http:// https:// www. .com .org .net /usr/local/bin /var/lib /home/user C:\\Users application/json text/html utf-8 "
)

#: The shortest candidate, the shortest that counts whatever its letters, and the shortest assigned value.
CANDIDATE_LEAST, CERTAIN, VALUE_LEAST = 12, 16, 12
#: A candidate is novel if it adds at least this share of its length to the compressed bytes, or
#: the share ALIKE of what so many random strings of its alphabet add on average.
NOVEL, ALIKE, RANDOM = 0.7, 0.85, 3
#: The same of candidates under CERTAIN and of assigned values.
SHORT_NOVEL, SHORT_ALIKE = 0.8, 0.9
#: Code points of text to either side of a candidate that it is compressed with.
AROUND = 256

_base = (("assign", re.compile(ASSIGN, re.I | re.A), 2, ASSIGN_LEAST), ("access", re.compile(ACCESS), 0, ACCESS_LEAST), ("hex", re.compile(HEX[:-1] + f"{{{HEX_LEAST},}}"), 0, HEX_LEAST))
_candidate = re.compile(rf"(?<!@)(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{{{CANDIDATE_LEAST},}}={{0,2}}")
_mixed = re.compile(r"(?=.*[A-Za-z])(?:.*[0-9]|.*[a-z][A-Z]|.*[A-Z]{2}[a-z])", re.S)
_value = re.compile(rf"(?:{'|'.join(SENSITIVE)})[\w-]*[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*(?:[\"'`]?)([^\s\"'`,;<>]{{{VALUE_LEAST},}})", re.I | re.A)
_line = re.compile(r"[^\n]*[^\s][^\n]*")
_pem = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.{16,}?)(?=-----END |\Z)", re.S)
_classes = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
_sensitive = re.compile("|".join(SENSITIVE), re.I | re.A)
_squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)


class Context:
    """The lines with text of a text, and the sensitive words in it."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [m.span() for m in _line.finditer(text)]
        self.starts = [s for s, _ in self.lines]
        self.words = [m.span() for m in _sensitive.finditer(text)]
        self.word_starts = [s for s, _ in self.words]

    def near(self, start: int, end: int) -> bool:
        """Whether a sensitive word stands on a line of text[start:end], beside it, or on the nearest lines with text before or after."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, max(start, end - 1)) - 1
        low, high = self.lines[max(first - 1, 0)][0], self.lines[min(last + 1, len(self.lines) - 1)][1]
        for k in range(bisect_left(self.word_starts, low), len(self.words)):
            s, e = self.words[k]
            if s >= high:
                return False
            if (e <= start or s >= end) and e <= high:
                return True
        return False

    def novelty(self, start: int, end: int) -> tuple[float, float]:
        """Bytes that text[start:end] adds to its compressed surroundings, by its length and by what random strings of its length and alphabet add."""
        low, own = max(0, start - AROUND), self.text[start:end]
        before, after = self.text[low:start], self.text[end : end + AROUND]
        if own in before or own in after:
            copies = [low + m.start() for m in re.finditer(re.escape(own), self.text[low : end + AROUND]) if low + m.start() != start]
            if sum(not self.near(at, at + len(own)) for at in copies) < 2:
                before, after = before.replace(own, ""), after.replace(own, "")
        size = lambda s: len(_squeeze.compress((before + after + s).encode("utf-8", "surrogatepass")))
        alone = size("")
        usual = sum(size(x) for x in _random(own)) / RANDOM - alone
        return (size(own) - alone) / len(own), (size(own) - alone) / max(usual, 1)

    def novel(self, start: int, end: int, strict: bool = False) -> bool:
        by_length, by_random = self.novelty(start, end)
        return by_length >= (SHORT_NOVEL if strict else NOVEL) or by_random >= (SHORT_ALIKE if strict else ALIKE)


def _random(own: str) -> list[str]:
    """RANDOM strings of the length of ``own`` and of the alphabet of its classes of characters; the same ones for the same string."""
    alphabet = "".join(c for c in _classes if not set(c).isdisjoint(own))
    alphabet += "".join(sorted(set(own) - set(alphabet)))
    draw = random.Random(len(own))
    return ["".join(draw.choices(alphabet, k=len(own))) for _ in range(RANDOM)]


def _spread(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order, and the furthest end up to each."""
    return [s for s, _ in sorted(spans)], list(accumulate((e for _, e in sorted(spans)), max))


def _parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A candidate itself; of an address the parts of its path that are long enough, not its host."""
    if not (text.startswith("//", start) and text[start - 1 : start] == ":"):
        return [(start, end)]
    path = text.find("/", start + 2, end)
    return [m.span() for m in re.compile(rf"[^/]{{{CANDIDATE_LEAST},}}").finditer(text, path, end)] if path >= 0 else []


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    if not text:
        return []
    found = [(kind, m.start(), m.end()) for kind, pattern, group, least in _base for m in pattern.finditer(text) if len(m[group]) >= least]
    base = [(s, e) for _, s, e in found]
    context = Context(text) if _sensitive.search(text) else None
    if context is None:
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    bodies = [m.span(1) for m in _pem.finditer(text)]
    for s, e in bodies:
        s, e = e - len(text[s:e].lstrip()), s + len(text[s:e].rstrip())
        if s < e and context.novel(s, e):
            found.append(("novel", s, e))
            base.append((s, e))
    def free(s: int, e: int) -> bool:
        k = bisect_right(begins, s)
        return not (k and ends[k - 1] > s or k < len(begins) and begins[k] < e)

    covered = lambda s, e: any(a <= s and b >= e for a, b in base[max(0, bisect_right(starts, s) - 3) : bisect_right(starts, s)])
    base.sort()
    starts = [s for s, _ in base]
    for m in _value.finditer(text):
        s, e = m.span(1)
        e = s + len(m[1].rstrip(".!?:)]}"))
        # what the plain alphabet holds whole is a candidate below; a pattern may have caught the beginning of a value
        if e - s >= VALUE_LEAST and not _candidate.fullmatch(text, s, e) and "://" not in text[s:e] and not covered(s, e) and _mixed.match(text[s:e]) and context.novel(s, e, True):
            found.append(("novel", s, e))
    begins, ends = _spread([(s, e) for _, s, e in found])
    for s, e in (span for m in _candidate.finditer(text) for span in _parts(text, *m.span())):
        short = e - s < CERTAIN
        if free(s, e) and not (short and not _mixed.match(text[s:e])) and context.near(s, e) and context.novel(s, e, short):
            found.append(("novel", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _suspect(text: Column) -> Column:
    """The texts that can hold a span; others read as null."""
    return F.when(text.rlike(f"(?i:{'|'.join(SENSITIVE)})|AKIA|[0-9a-f]{{{HEX_LEAST}}}"), text)


def redact_text(text: str | None) -> str | None:
    """``text`` with each run of overlapping spans replaced by the kind of its first, in angle brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in find(text):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``secret_spans``, an array of (kind, start, end) that is empty where nothing is found; a column of that name is replaced."""
    spans = "array<struct<`kind`:string,`start`:int,`end`:int>>"

    @F.pandas_udf(spans)
    def spans_of(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    return docs.withColumn("secret_spans", F.coalesce(spans_of(_suspect(F.col("text"))), F.array().cast(spans)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind, and ``n_chars``, if there is one, brought up to date."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text)

    out = docs.withColumn("text", F.coalesce(redacted(_suspect(F.col("text"))), F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
