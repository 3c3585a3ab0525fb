"""Text cleaning, keys and signals. Column expressions where Spark has the parts; pandas functions for Unicode forms, over titles and names."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text_udf(one):
    """A pandas function of one text column that keeps nulls."""

    def apply(column: Column) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else one(x))

        return run(column)

    return apply


def _bare(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


_QUOTES = str.maketrans({**dict.fromkeys("‘’ʼ`´", "'"), **dict.fromkeys("“”", '"'), **dict.fromkeys("‐‑‒–—−", "-")})

# Names that need no ";" at the end, the longest first.
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Controls and code points that are no characters; surrogates and larger numbers are U+FFFD.
_ODD_NUMBERS = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane << 16 | last for plane in range(17) for last in (0xFFFE, 0xFFFF))]
_ENTITIES = html5 | {f"#{n}": unescape(f"&#{n};") for n in _ODD_NUMBERS}
# What Windows-1252 has for C1 controls, those that it lacks last.
_C1 = sorted(((chr(n), bytes([n]).decode("cp1252", "ignore")) for n in range(0x80, 0xA0)), key=lambda x: x[1] == "")


def _decoded(part: Column, names: Sequence[str]) -> Column:
    """The text of an entity; other parts as they are."""
    listed: dict[str, dict[str, str]] = {}
    for name, value in _ENTITIES.items():
        listed.setdefault(name[0], {})[name] = value
    table = F.from_json(F.lit(json.dumps(listed)), "map<string,map<string,string>>")
    # eight digits are beyond the last character already
    digits = F.concat(F.lit("0"), F.left(F.regexp_extract(part, "^&#[xX]?0*([0-9a-fA-F]*)", 1), F.lit(8)))
    number = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    name = F.when(part.startswith("&#"), F.concat(F.lit("#"), number.cast("string"))).otherwise(F.substring(part, 2, 40))
    # after a byte order mark the next one is a character
    character = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))), "UTF-32")
    numbered = F.when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").otherwise(character)
    old = F.regexp_extract(part, f"^&({'|'.join(names)})", 1)
    opened = F.element_at(F.from_json(F.lit(json.dumps({n: html5[n] for n in names})), "map<string,string>"), old)
    rest = F.when(part.startswith("&#"), numbered).otherwise(F.concat(opened, F.replace(part, F.concat(F.lit("&"), old), F.lit(""))))
    return F.when(part.startswith("&"), F.coalesce(F.element_at(F.element_at(table, F.left(name, F.lit(1))), name), rest, part)).otherwise(part)


def decode_entities(c: Column, unended: Sequence[str] | None = None) -> Column:
    """HTML entities decoded, in up to three passes; with ``unended`` only these names, one at least, count without a ";", and numbers need theirs."""
    names, end = (_OLD_NAMES, ";?") if unended is None else (sorted(unended, key=lambda n: (-len(n), n)), ";")
    entity = rf"&(?:#[0-9]+{end}|#[xX][0-9a-fA-F]+{end}|[A-Za-z][A-Za-z0-9]{{1,30}};|{'|'.join(names)})"
    parts = lambda x: F.regexp_extract_all(x, F.lit(f"{entity}|[^&]+|&"), F.lit(0))
    once = lambda x, _: F.when(x.contains("&") & x.rlike(entity), F.array_join(F.transform(parts(x), lambda part: _decoded(part, names)), "")).otherwise(x)
    # C1 controls are what Windows-1252 text looks like when it was read as Latin-1
    c1, put = "".join(k for k, _ in _C1), "".join(v for _, v in _C1)
    mended = lambda x: F.when(x.rlike("[\x80-\x9f]"), F.translate(x, c1, put)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), c, once, mended)


def _folded_character(c: str) -> str:
    bare = _bare(c).lower()
    return bare if len(bare) == 1 else c


#: Lower case without marks, quotes and dashes unified, of the same length: a place in the folded name is that place in the name.
fold_name = _text_udf(lambda x: "".join(map(_folded_character, x)).translate(_QUOTES))
#: Letters with marks and the letters without them, by Unicode's decomposition, for the scripts before U+2000.
_MARKED = {c: base for c in map(chr, range(0xC0, 0x2000)) if len(base := re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", c))) == 1 and base != c}
#: Lower-case letters and digits between single blanks, with a blank at both ends: whole words can be searched with ``contains``.
latin_key = _text_udf(lambda x: " " + re.sub(r"[\W_]+", " ", _bare(x).lower()).strip() + " ")
#: NFKC, lower case, blanks squeezed.
wide_key = _text_udf(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower()).strip())


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_title(c: Column, decode: bool = True, unended: Sequence[str] | None = None) -> Column:
    """Entities decoded (``unended`` as in :func:`decode_entities`), line breaks as one blank, control characters dropped, trimmed."""
    c = decode_entities(c, unended) if decode else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\r\n  ]+", " "), r"[\x00-\x1F\x7F-\x9F]", ""))


def clean_summary(c: Column, most: int = 500, decode: bool = True, unended: Sequence[str] | None = None) -> Column:
    """Tags out before and after decoding, blanks squeezed, cut to ``most`` characters; empty is null."""
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    c = F.regexp_replace(decode_entities(c, unended), r"<[^>]*>", " ") if decode else c
    return F.nullif(F.rtrim(F.left(squeeze(c), F.lit(most))), F.lit(""))


def author_keys(byline: Column | str) -> Column:
    """Authors of a byline as keys: split at , ; & / | and "and", squeezed, lower-cased, without repeats; of ``mail (Name)`` the name."""
    named = F.regexp_replace(byline, r"[^\s,;&/|()]+@[^\s,;&/|()]+\s*\(([^()]*)\)", "$1")
    parts = F.split(F.regexp_replace(named, r"(?i)[,;&/|]|\band\b", "\u0001"), "\u0001")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(squeeze(p))), lambda p: p != ""))


#: Unicode's composed form.
composed = _text_udf(lambda x: unicodedata.normalize("NFC", x))


def authors(byline: Column | str) -> Column:
    """Authors of a byline as an array of (key, name): parted as by :func:`author_keys`, each once in the form that is written first; see :func:`composed` for bylines whose marks stand apart."""
    named = F.regexp_replace(byline, r"[^\s,;&/|()]+@[^\s,;&/|()]+\s*\(([^()]*)\)", "$1")
    parts = F.filter(F.transform(F.split(F.regexp_replace(named, r"(?i)[,;&/|]|\band\b", "\u0001"), "\u0001"), squeeze), lambda p: p != "")
    keys = F.transform(parts, lambda p: F.lower(p))
    # the place of a key's first occurrence is its own place for the form that stays
    both = F.zip_with(parts, keys, lambda p, k: F.struct(k.alias("key"), p.alias("name")))
    return F.filter(both, lambda x, i: F.array_position(keys, x["key"]) == i + 1)


def has_author(keys: Column, wanted: Column | None) -> Column:
    """Whether one of the author ``keys`` is the wanted one; without a wanted one all rows count."""
    return F.lit(True) if wanted is None else wanted.isNull() | F.exists(keys, lambda k: k == wanted)


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def without_marks(c: Column) -> Column:
    """Without the marks of letters."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}+", "")


def bare_letters(c: Column) -> Column:
    """Lower case, without the marks of letters."""
    return F.lower(without_marks(c))


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, without the marks of letters."""
    return words(bare_letters(c))


def initial(c: Column) -> Column:
    """Index letter: the leading consonant of a Hangul syllable, else the upper-cased first character."""
    first = F.substring(F.trim(c), 1, 1)
    # The nineteen leading consonants in the order of their syllables.
    lead = F.array(*[F.lit(x) for x in "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"])
    code = F.ascii(first)
    return F.when((code >= 0xAC00) & (code <= 0xD7A3), F.element_at(lead, (F.floor((code - 0xAC00) / 588) + 1).cast("int"))).otherwise(F.upper(first))


def scores(title: Column, most: int = 15, units: Sequence[str] = (), names: Sequence[str] = ()) -> Column:
    """Scores in a title as ``low-high``, in order, without repeats; none above ``most`` goals or inside longer numbers.

    Two numbers before one of ``units`` are a range (2-3 weeks).  With ``names``, "name 2 name 1" is a score too; those come after the others.
    """
    chains = F.regexp_extract_all(title, F.lit(r"[\p{L}\p{N}.]*\p{N}(?:\s?[-–]\s?\p{N}[\p{L}\p{N}.]*)+(?:\s+\p{L}+)?"), F.lit(0))
    said = F.transform(chains, lambda c: F.struct(F.regexp_replace(c, r"\s+\p{L}+$|\.+$", "").alias("score"), F.lower(F.regexp_extract(c, r"\s+(\p{L}+)$", 1)).alias("after")))
    said = F.filter(said, lambda c: c.score.rlike(r"^[0-9]{1,2}\s?[-–]\s?[0-9]{1,2}$") & ~c.after.isin(*[u.lower() for u in units] or [" "]))
    pairs = F.transform(said, lambda c: F.transform(F.split(c.score, r"\s?[-–]\s?"), lambda x: x.cast("int")))
    if names:
        name = "(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")"
        spoken = F.regexp_extract_all(title, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}]){name}\s+[0-9]{{1,2}},?\s+{name}\s+[0-9]{{1,2}}(?![\p{{L}}\p{{N}}-])"), F.lit(0))
        bare = lambda x: F.regexp_replace(x, rf"(?i){name}", " ")
        pairs = F.concat(pairs, F.transform(spoken, lambda x: F.transform(F.regexp_extract_all(bare(x), F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int"))))
    fair = F.filter(pairs, lambda p: F.array_max(p) <= most)
    return F.array_distinct(F.transform(fair, lambda p: F.concat_ws("-", F.array_min(p), F.array_max(p))))


@dataclass(frozen=True)
class Roundup:
    """What makes a title one of several stories: phrases anywhere in it, words that open it, and so many commas."""

    phrases: Sequence[str] = ()
    openers: Sequence[str] = ()
    commas: int = 3


def is_roundup(title: Column, signs: Roundup) -> Column:
    """Whether a title gathers several stories, by ``signs``; its words and theirs are lower-case runs of letters, digits and ``&``."""
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}&]+", " ")), F.lit(" "))
    words = spaced(title)
    phrases, openers = (F.array(*[spaced(F.lit(x)) for x in xs]).cast("array<string>") for xs in (signs.phrases, signs.openers))
    listed = F.length(title) - F.length(F.replace(title, F.lit(","), F.lit(""))) >= signs.commas
    return F.exists(phrases, lambda x: words.contains(x)) | F.exists(openers, lambda x: words.startswith(x)) | listed


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_ics(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _folded_line(x: str, octets: int = 75) -> str:
    lines, line, size = [], "", 0
    for c in x:
        n = len(c.encode())
        if size + n > octets:
            lines.append(line)
            line, size = " ", 1
        line, size = line + c, size + n
    return "\r\n".join([*lines, line])


#: Content lines of at most 75 octets, continued with a blank.
fold_ics = _text_udf(_folded_line)


def encode_tags(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.replace(F.replace(t, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))), "|")


def decode_tags(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\|"), lambda t: t != ""), lambda t: F.replace(F.replace(t, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%")))


def final_sound(word: Column) -> Column:
    """How a word ends for the choice of a Korean particle: ``open``, ``rieul``, ``closed``, or null for other scripts and digits apart."""
    last = F.right(F.regexp_replace(word, r"[^\p{L}\p{N}]+$", ""), F.lit(1))
    coda = (F.ascii(last) - 0xAC00) % 28
    digit = F.when(last.isin("0", "3", "6"), "closed").when(last.isin("1", "7", "8"), "rieul").when(last.isin("2", "4", "5", "9"), "open")
    return F.when(F.ascii(last).between(0xAC00, 0xD7A3), F.when(coda == 0, "open").when(coda == 8, "rieul").otherwise("closed")).otherwise(digit)


def with_particle(word: Column, closed: str, opened: str, rieul: str, unknown: str) -> Column:
    """A word with the form of a particle that its last sound asks for."""
    sound = final_sound(word)
    return F.concat(word, F.when(sound == "closed", closed).when(sound == "rieul", rieul).when(sound == "open", opened).otherwise(unknown))


# Korean particles, after a closed and after an open syllable.
PARTICLES = (("은", "는"), ("이", "가"), ("을", "를"), ("과", "와"), ("으로", "로"))


def substitute(text: Column, names: list[tuple[str, str]], particles: Sequence[tuple[str, str]] = ()) -> Column:
    """Whole words or phrases replaced by a dictionary (tens of thousands of entries at most), the longest first.

    One of ``particles`` (after a closed and after an open syllable) right behind a name gets the form that the new
    name asks for; after a final rieul ``으로`` is ``로``.  After other scripts a particle stays as it is.
    """
    table = {a.lower(): b for a, b in names}
    forms = {form: pair for pair in particles for form in pair}
    longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    pattern = re.compile(rf"(?<!\w)({longest(table)})" + (f"({longest(forms)})?" if forms else "()") + r"(?!\w)", re.I) if table else None

    def put(m: re.Match) -> str:
        name, form = table[m[1].lower()], m[2] or ""
        if form and name and "가" <= name[-1] <= "힣":
            coda = (ord(name[-1]) - ord("가")) % 28
            closed, opened = forms[form]
            form = opened if coda == 0 or (coda == 8 and closed == "으로") else closed
        return name + form

    return _text_udf(lambda x: pattern.sub(put, x) if pattern else x)(text)


def latin_spans(text: Column, known: list[str]) -> Column:
    """Runs of Latin words that are not in ``known``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsLatin}[\p{IsLatin}\p{M}\p{N}.'’-]*(?:\s+\p{IsLatin}[\p{IsLatin}\p{M}\p{N}.'’-]*)*)"), F.lit(1))
    return F.array_except(F.array_distinct(runs), F.array(*[F.lit(k) for k in known]).cast("array<string>"))


def srcset_urls(c: Column) -> Column:
    """Urls of a ``srcset`` attribute, in order."""
    return F.filter(F.transform(F.split(c, r",\s+|,$"), lambda p: F.regexp_extract(F.trim(p), r"^\S+", 0)), lambda u: u != "")


def html_tags(c: Column) -> Column:
    """Names of the tags opened in a page, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])"), F.lit(1)), lambda t: F.lower(t))


def fill_template(kind: Column, templates: dict[str, str], fields: dict[str, Column]) -> Column:
    """The template of a row's kind with each ``{field}`` filled in; null where the kind has none or a field it needs is null.

    Each template is cut at its fields beforehand, so braces in a value stay what they are.
    """
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        parts = re.split(r"\{(\w+)\}", template)
        line = F.concat(*[fields[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
        out = F.when(kind == name, line).otherwise(out)
    return out
