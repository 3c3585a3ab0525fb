import os
import random

import pytest

from tidemill.llm import tokencount
from tidemill.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
TEXTS = ["", " ", "a", "  a  b ", "Hello world, this is text.", "a\n\tb", "日本語🙂🙂x", "▁▁a ▁", "x" * 5000, "naïve façade — №5", "\u0000\u0001"]


def library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokencount.vocabulary(TOKENIZER)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return pieces, lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    pieces, count = library()
    mine = tokencount.Counter(pieces)
    rng = random.Random(1)
    made = ["".join(rng.choice([" ", "the", "ing", "Ä", "ñ", "z", "q", "🙂", "\n", "tion", "▁", "9"]) for _ in range(40)) for _ in range(300)]
    for t in TEXTS + made:
        assert mine.text(t) == count(t), t
    assert mine.text(None) == 0


def test_ties_follow_the_library():
    from tokenizers import Tokenizer, models

    pieces = [("▁a", -1.0), ("a", -1.0), ("ab", -2.0), ("b", -1.0), ("▁ab", -2.0), ("aba", -3.0), ("▁", -1.0), ("bab", -3.0)]
    t = Tokenizer(models.Unigram([("<unk>", -1.0), *pieces], unk_id=0))
    mine = tokencount.Counter(pieces)
    rng = random.Random(2)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        assert mine.word(w) == len(t.encode(w).ids), w


def test_forgets_and_counts_again(monkeypatch):
    pieces = tokencount.vocabulary(TOKENIZER)
    text = " ".join(f"word{i % 50}" for i in range(500))
    want = tokencount.Counter(pieces).text(text)
    monkeypatch.setattr(tokencount, "REMEMBER", 7)
    assert tokencount.Counter(pieces).text(text) == want


def test_frame(spark):
    pieces, count = library()
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1), (4, TEXTS[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens) for r in tokencount.count(df, pieces).collect()), key=repr)
    assert got == sorted(((i, count(t) if t else 0) for i, t, _ in rows), key=repr)
    assert tokencount.count(df.limit(0), pieces).count() == 0
