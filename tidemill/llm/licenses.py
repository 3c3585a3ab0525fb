"""License scans by conditional compression against licence wordings.

Words that speak of a licence or of copying start candidate blocks: as many words to either side as the longest
template with the differences that are allowed, whatever lines or prose they are.  Each block is compressed alone and
with every template as raw zstandard dictionary; the templates are ranked by the bytes that they take away, and each
that takes away a share of its own bytes is laid over every stretch of the block that could hold it.  A stretch is
confirmed by an exact comparison of wordings: the words of stretch and template are aligned, and the differences may be
few, and may not touch the words that tell one licence or version from another; a short notice behind a negation is none.  It is then compressed itself with the
template, which must take away enough of its bytes.  Of stretches that overlap the one with the fewest words of its
licence's relatives counts, then the one that loses most bytes, then the one with the fewest differences; all others that
are left are reported too, so a text may state several licences.  Identifiers of an SPDX tag are read one by one.

Nulls, ties and repeats: a null or empty text has no blocks; equal shares go to the first template in order;
rows are read one by one and repeated rows give repeated results; texts are read whole.  An empty table gives
an empty result.  Only texts that hold one of the trigger words are sent to Python.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.wordings import SPDX_MORE, TEMPLATES

TRIGGERS = ("licen[cs]e", "copyright", "redistribut", "permission (?:is|to)", "permitted", "creative commons", "rights reserved", "public domain", "spdx")

#: Least share of a stretch's compressed bytes that its template must take away, and most of the words that may differ.
GAIN, DIFFER = 0.3, 0.34
#: Least share of a template's own compressed bytes that it must take away from a block to be laid over it.
TAKEN = 0.15

_trigger = re.compile("|".join(TRIGGERS), re.I)
_word = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]")
_tag = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+\- \t()]+)", re.I | re.A)
_LOWER = {c: c + 32 for c in range(65, 91)}
_spdx = {name.lower(): name for name in [*SPDX_MORE, *(t[0] for t in TEMPLATES)]}
TAG = "spdx-license-identifier: "


#: Words that turn a short notice into its opposite when they stand among the BEFORE words before it in its sentence, and how many words a short notice has at most.
BEFORE = 6
NEGATIONS, SHORT = frozenset(("not", "never", "nor", "neither", "longer", "isn", "cannot")), 12


def _negated(before: str) -> bool:
    return not NEGATIONS.isdisjoint(_word.findall(re.split(r"[.;:!?]\s|\n", before)[-1]))


def _marks(words: list[str]) -> dict[str, int]:
    """Bits of the places of each word."""
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


#: Per template: its number, how many words it has, their places, its pairs of successive words, and the words that must be kept.
_laid = [(i, len(w), _marks(w), frozenset(zip(w, w[1:])), frozenset(t[2])) for i, t in enumerate(TEMPLATES) for w in [_word.findall(t[1])]]
#: Words to either side of a trigger that its statement may reach over.
REACH = int(max(size for _, size, *_ in _laid) / (1 - DIFFER)) + 1
#: Per template the words, not its own, that tell a licence of the same family: GPL from LGPL, say.
_foreign = [{w for name, _, told in TEMPLATES if name != n and set(told) & set(telling) for w in told} - set(_word.findall(t)) for n, t, telling in TEMPLATES]


@lru_cache(None)
def _compressors():
    def make(wording: str | None):
        d = None if wording is None else zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        if d:
            d.precompute_compress(level=9)
        return zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    plain = make(None)
    return plain, [make(t) for _, t, _ in TEMPLATES], [len(plain.compress(t.encode())) for _, t, _ in TEMPLATES]


def regions(words: list[tuple[int, int]], text: str):
    """(first, after last) of the words around trigger words, joined where they overlap."""
    starts = [s for s, _ in words]
    start = end = -1
    for m in _trigger.finditer(text):
        low, high = max(0, bisect_right(starts, m.start()) - 1 - REACH), min(len(words), bisect_left(starts, m.end()) + REACH)
        if start >= 0 and low <= end:
            end = high
            continue
        if start >= 0:
            yield start, end
        start, end = low, high
    if start >= 0:
        yield start, end


def ranked(block: str) -> list[tuple[int, int]]:
    """(bytes taken away from ``block``, template number), the most first; those that take away too few of their own are left out."""
    data = block.lower().encode("utf-8", "surrogatepass")
    plain, primed, own = _compressors()
    alone = len(plain.compress(data))
    taken = ((alone - len(c.compress(data)), i) for i, c in enumerate(primed))
    return sorted(((n, i) for n, i in taken if n >= TAKEN * own[i]), key=lambda x: (-x[0], x[1]))


def differences(block: str, number: int) -> tuple[float, float, bool]:
    """(share of template words missing or changed, share of the aligned stretch's words that are extra, telling words kept)."""
    _, template, telling = TEMPLATES[number]
    a, b = _word.findall(template), _word.findall(block.lower())
    match = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    if not match:
        return 1.0, 1.0, False
    hit = sum(m.size for m in match)
    span = match[-1].b + match[-1].size - match[0].b
    kept = {a[m.a + k] for m in match for k in range(m.size)}
    return 1 - hit / len(a), 1 - hit / span, all(w in kept for w in telling)


def gain_of(stretch: str, number: int) -> tuple[int, float]:
    """(bytes, share) of the compressed stretch, without what an empty one takes, that a template takes away."""
    data = stretch.lower().encode("utf-8", "surrogatepass")
    plain, primed, _ = _compressors()
    alone = len(plain.compress(data))
    taken = alone - len(primed[number].compress(data))
    return taken, taken / max(1, alone - len(plain.compress(b"")))


def stretches(words: list[str], size: int, marks: dict[str, int], pairs: frozenset[tuple[str, str]], telling: frozenset[str]):
    """(first, after last, differences) of the best stretch of ``words`` from each start that may hold a template of ``size`` words.

    A start is a word of the template followed by its next one there, or a telling word.  The words in common are those
    of a longest common subsequence, kept as the zero bits of one integer.
    """
    full = (1 << size) - 1
    # words that are too far from any of the telling ones cannot belong to a stretch
    reach = int(size / (1 - DIFFER)) + 1
    heads = [k for k, w in enumerate(words) if w in telling]
    whole = 0
    for i, first in enumerate(words):
        if i < whole or not (first in telling or (first, words[i + 1] if i + 1 < len(words) else "") in pairs):
            continue
        near = bisect_left(heads, i)
        if near == len(heads) or heads[near] >= i + reach:
            continue
        bits, best, left = full, None, set(telling)
        for j in range(i, min(i + reach, len(words))):
            w = words[j]
            hit = bits & marks.get(w, 0)
            bits = ((bits + hit) | (bits - hit)) & full
            left.discard(w)
            if left or not hit:
                continue
            same = size - bits.bit_count()
            missing, extra = 1 - same / size, 1 - same / (j + 1 - i)
            if missing <= DIFFER and extra <= DIFFER and (best is None or missing + extra < best[0]):
                best = (missing + extra, j + 1)
                if same == size:
                    break
        if best:
            yield i, best[1], best[0]
            if best[0] == 0:
                whole = best[1]


def statements(text: str | None) -> list[dict]:
    """Confirmed licence statements of a text: start, end, license, gain, missing, extra; by start."""
    text = text or ""
    # lower-casing by code point keeps places; the words are of ASCII letters alone
    low = text.translate(_LOWER)
    at = [m.span() for m in _word.finditer(low)]
    found = []
    for first, last in regions(at, text):
        words = [low[s:e] for s, e in at[first:last]]
        has = set(words)
        likely = []
        for _, number in ranked(low[at[first][0] : at[last - 1][1]]) if words else []:
            _, size, marks, pairs, telling = _laid[number]
            if not telling <= has:
                continue
            taken: list[tuple[int, int]] = []
            for i, j, _ in sorted(stretches(words, size, marks, pairs, telling), key=lambda x: (x[2], x[0])):
                if any(i < b and a < j for a, b in taken) or size <= SHORT and _negated(low[at[first + max(0, i - BEFORE)][0] : at[first + i][0]]):
                    continue
                # a name of few words, like one that is a common word elsewhere, must not stand in small letters throughout
                if size <= 3 and text[at[first + i][0] : at[first + j - 1][1]].islower():
                    continue
                s, e = at[first + i][0], at[first + j - 1][1]
                missing, extra, told = differences(low[s:e], number)
                if told and missing <= DIFFER and extra <= DIFFER:
                    taken.append((i, j))
                    less, gain = gain_of(low[s:e], number)
                    if gain >= GAIN:
                        likely.append((len(_foreign[number].intersection(words[i:j])), -less, missing + extra, number, TEMPLATES[number][0], s, e, gain, missing, extra))
        done: list[tuple[int, int]] = []
        for *_, name, s, e, gain, missing, extra in sorted(likely):
            if all(e <= a or b <= s for a, b in done):
                done.append((s, e))
                found.append({"start": s, "end": e, "license": name, "gain": round(gain, 4), "missing": round(missing, 4), "extra": round(extra, 4)})
    for m in _tag.finditer(text):
        for w in re.finditer(r"[a-z0-9.+\-]+", m[1], re.I | re.A):
            name = _spdx.get(re.sub(r"\+$", "-or-later", w[0].translate(_LOWER)), _spdx.get(w[0].translate(_LOWER).removesuffix("+")))
            if name is not None:
                s, e = m.start() if w.start() == 0 else m.start(1) + w.start(), m.start(1) + w.end()
                found.append({"start": s, "end": e, "license": name, "gain": round(_named(TAG + w[0]), 4), "missing": 0.0, "extra": 0.0})
    return sorted(found, key=lambda f: (f["start"], f["end"], f["license"]))


@lru_cache(1000)
def _named(tag: str) -> float:
    """Share of a tag's compressed bytes that its own wording takes away."""
    data = tag.lower().encode()
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
    primed = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    return 1 - len(primed.compress(data)) / len(plain.compress(data))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (code points), license, gain, missing, extra: a row per confirmed statement in ``docs``."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at, rows = [], []
            for i in range(len(texts)):
                more = statements(texts[i].as_py())
                at += [i] * len(more)
                rows += more
            cols = [pa.array([r[k] for r in rows], t) for k, t in (("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("gain", pa.float64()), ("missing", pa.float64()), ("extra", pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *cols], ["doc_id", "start", "end", "license", "gain", "missing", "extra"])

    suspects = docs.select("doc_id", "text").where(F.col("text").rlike(f"(?i){'|'.join(TRIGGERS)}"))
    return suspects.mapInArrow(run, f"doc_id {kind}, `start` int, `end` int, license string, gain double, missing double, extra double")
