"""Byte-level BPE over a corpus: every distinct word is encoded once, its ids are joined back and texts are reassembled by position.

A task cuts its texts into pre-tokens and keeps them, block by block (``BLOCK`` code points of text), as numbers of a
dictionary of the block: a text becomes the sequence of its words' numbers, so the positions need no rows of their own,
and a word goes on once a block however frequent it is.  The dictionaries are dealt out by a hash of the word, the words of a block
and a bucket in one packed row.  A bucket's task encodes each of its distinct words once, by the merges of the rank
file, and answers every block with the ids; the block's task joins them to the numbers and puts the texts together
in order of position.  Decoding joins each id with the table of token bytes, which is as small as the vocabulary and is sent to the tasks.

Pre-tokens are those of the tokenizer's own engine: where the two pattern engines know different characters as letters or numbers,
its view is asked once, for all characters, and put into the pattern.

Nulls, ties and repeats: a null or empty text has no ids; rows are encoded one by one and may repeat; special tokens
are ordinary text.  Texts are whole.  Among equal merges the leftmost goes first, as in the tokenizer.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Code points of text whose words share a dictionary (a longer text has its own).
BLOCK = 6 << 20
#: Buckets of words for each shuffle partition.
BUCKETS = 8
#: The largest vocabulary that is sent to tasks.
MOST_TOKENS = 1 << 20


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64, blank, number)."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(found) > MOST_TOKENS:
        raise ValueError(f"{len(found)} tokens; a vocabulary is expected to have {MOST_TOKENS} at most")
    return found


def _ranges(chars: set[str]) -> str:
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def patterns(pattern: str) -> tuple[str, str, str]:
    """(plain, exact, odd): ``pattern`` itself; one that names the characters the two engines see differently; a class of these characters."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    exact, odd = pattern, set()
    for name in sorted(set(regex.findall(r"\\p\{\w+\}", pattern))):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(name, every))
        more, less = theirs - ours, ours - theirs
        known = f"[{name}--[{_ranges(less)}]]" if less else name
        exact = exact.replace(name, f"[{known}||[{_ranges(more)}]]" if more else known)
        odd |= more | less
    return pattern, f"(?V1){exact}", f"[{_ranges(odd)}]" if odd else r"(?!)"


class Splitter:
    """Cuts texts into pre-tokens."""

    def __init__(self, plain: str, exact: str, odd: str):
        import regex

        self.plain, self.exact, self.odd = regex.compile(plain), regex.compile(exact), regex.compile(odd)

    def __call__(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or not self.odd.search(text) else self.exact).findall(text)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Numbers below 2**32 by their bytes' places, then bytes; compressed."""
    import zstandard

    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.uint64([len(p) for p in parts]).tobytes() + b"".join(parts))


def _unpack(data: bytes, numbers: int, more: int = 0) -> list:
    """``numbers`` arrays, then ``more`` strings of bytes."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    ends = 8 * (numbers + more) + np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint64, numbers + more))]).astype(int)
    parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return [np.frombuffer(p, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() if i < numbers else p for i, p in enumerate(parts)]


def _cells(number: dict[str, int], buckets: int) -> dict[int, bytes]:
    """For each bucket its words of a dictionary with their numbers, packed."""
    held: dict[int, list] = {}
    for w, i in number.items():
        b = w.encode()
        held.setdefault(zlib.crc32(b) % buckets, []).append((i, b))
    return {k: _pack(np.array([i for i, _ in own]), np.array([len(b) for _, b in own]), b"".join(b for _, b in own)) for k, own in held.items()}


class Block:
    """Texts as numbers of their words, in order of position; of the words only one copy stays."""

    def __init__(self, split: Splitter):
        self.split, self.number, self.keys, self.codes, self.held = split, {}, [], [], 0

    def add(self, key: pa.Array, text: str | None) -> None:
        number = self.number
        words = self.split(text) if text else []
        self.keys.append(key)
        self.codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
        self.held += len(text or "")

    def packed(self, buckets: int) -> tuple[list[bytes], dict[int, bytes]]:
        """The texts, with small numbers for frequent words, and the words of each bucket."""
        often = np.zeros(len(self.number), np.int64)
        for c in self.codes:
            np.add.at(often, c, 1)
        place = np.empty(len(often), np.uint32)
        place[np.argsort(-often, kind="stable")] = np.arange(len(often))
        return [_pack(place[c]) for c in self.codes], _cells(dict(zip(self.number, place.tolist())), buckets)


_ENCODERS: dict[int, tuple] = {}


def _encoder(vocabulary: dict[bytes, int]):
    """The merges of a vocabulary over single words; a worker builds it once."""
    import tiktoken

    if id(vocabulary) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(vocabulary)] = vocabulary, tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary, special_tokens={})
    return _ENCODERS[id(vocabulary)][1]


def encode(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ids (array of int) of each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType
    said, sent = patterns(pattern), spark.sparkContext.broadcast(vocabulary)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions

    def code(batches):
        from pyspark import TaskContext

        task, n, split = TaskContext.get().partitionId(), 0, Splitter(*said)

        def rows(block: Block) -> pa.RecordBatch:
            codes, cells = block.packed(buckets)
            of = task * 2**32 + n
            dest = pa.array([of] * len(codes) + [-1 - k for k in cells], pa.int64())
            keys = pa.concat_arrays([*block.keys, pa.nulls(len(cells), block.keys[0].type)])
            return pa.RecordBatch.from_arrays([dest, pa.array([of] * len(dest), pa.int64()), keys, pa.array([*codes, *cells.values()], pa.binary())], ["dest", "block", "key", "data"])

        block = Block(split)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                own = value.as_py()
                if block.held and block.held + len(own or "") > BLOCK:
                    yield rows(block)
                    block, n = Block(split), n + 1
                block.add(batch.column(0).slice(i, 1), own)
        if block.keys:
            yield rows(block)

    coded = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(code, f"dest long, block long, key {kind.simpleString()}, data binary")
    # one shuffle deals texts to their blocks and words to their buckets (below 0); both branches read it
    coded = coded.repartition(partitions, "dest")

    def answer(t: pa.Table) -> pa.Table:
        out: list[bytes] = []
        if t["dest"][0].as_py() < 0:
            whole, known = _encoder(sent.value), {}
            for data in t["data"]:
                numbers, sizes, joined = _unpack(data.as_py(), 2, 1)
                ends, ids = np.cumsum(sizes).tolist(), []
                for a, b in zip([0, *ends], ends):
                    word = joined[a:b]
                    if word not in known:
                        known[word] = np.array(whole.encode_ordinary(word.decode()), np.uint32)
                    ids.append(known[word])
                out.append(_pack(numbers, np.array([len(x) for x in ids]), np.concatenate(ids)))
        return pa.table([t["block"].slice(0, len(out)), pa.array(out, pa.binary())], ["block", "data"])

    answers = coded.groupBy("dest").applyInArrow(answer, "block long, data binary")

    def assemble(own: pa.Table, ids: pa.Table) -> pa.Table:
        own = own.slice(0, len(own) if len(own) and own["dest"][0].as_py() >= 0 else 0)
        parts = [_unpack(d.as_py(), 3) for d in ids["data"]]
        none = [np.zeros(0, np.uint32)]
        numbers, sizes, flat = (np.concatenate([p[i] for p in parts] or none) for i in range(3))
        at = np.zeros(len(numbers), np.int64)
        size = np.zeros(len(numbers), np.int64)
        at[numbers], size[numbers] = np.cumsum(sizes) - sizes, sizes
        found = []
        for data in own["data"]:
            (codes,) = _unpack(data.as_py(), 1)
            n = size[codes]
            ends = np.cumsum(n)
            found.append(flat[np.repeat(at[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        ids_of = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found or none).astype(np.int32)))
        return pa.table([own["key"], ids_of], ["key", "ids"])

    found = coded.groupBy("dest").cogroup(answers.groupBy("block")).applyInArrow(assemble, f"key {kind.simpleString()}, ids array<int>")
    return found.withColumnRenamed("key", key)


def _bytes(ids: pa.Array, token) -> list[bytes | None]:
    return [b"".join(map(token, x.values.to_numpy().tolist())) if x.is_valid else None for x in ids]


def _tokens(spark, vocabulary: dict[bytes, int]):
    return spark.sparkContext.broadcast({rank: token for token, rank in vocabulary.items()})


def decode(rows: DataFrame, vocabulary: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``rows`` (a key and ids) with decoded, the bytes of the ids; null ids give null."""
    sent = _tokens(rows.sparkSession, vocabulary)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_bytes(batch.column(ids), sent.value.__getitem__), pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{out}, decoded binary")


def digests(rows: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens, ids_sha256 (over little-endian 32-bit integers) and decoded_sha256 (over what the ids decode to) of ``rows`` (key, ids); one pass over the ids."""
    from hashlib import sha256

    sent = _tokens(rows.sparkSession, vocabulary)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            own = [sha256(x.values.to_numpy().astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [sha256(_bytes(ids.slice(i, 1), sent.value.__getitem__)[0]).hexdigest() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(key), ids.value_lengths().cast(pa.int64()), pa.array(own), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
