import re
from fractions import Fraction

from pyspark.sql import functions as F

from tidemill.llm import mixing
from tidemill.llm.queries import mix_rows

SCHEMA = "doc_id long, text string, source string, size long, sid int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)


def sample():
    rows = [(i, "w " * (i % 40), "abc"[i % 3] if i % 7 else "a") for i in range(300)]
    return rows + [(900, None, "a"), (901, "", None), (902, "x " * 5000, None), (None, "one two", "b"), (5, "w " * 5, "c"), (5, "w " * 5, "c")]


def fill(sizes, share=Fraction(3, 2)):
    """Targets by the rule as it is told: share by weight, cap, and share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), dict.fromkeys(order, Fraction(0))
    while open_ and left > 0:
        total = sum(weight[s] for s in open_)
        given = {s: target[s] + left * weight[s] / total for s in open_}
        left = Fraction(0)
        for s, t in given.items():
            target[s] = min(t, Fraction(2 * sizes[s]))
            left += t - target[s]
            if t >= 2 * sizes[s]:
                open_.discard(s)
    return target


def test_targets_sizes_and_taken(spark):
    rows = sample()
    out = mix_rows(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, words(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(abs(r.target - float(want[s])) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - float(want[s])) <= 0.5
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert sorted(map(repr, out)) == sorted(map(repr, mix_rows(docs(spark, rows)).collect()))


def test_schedule_is_even_and_whole(spark):
    _, slots, sources = mixing.mix(docs(spark, sample()), block_words=16)
    got = slots.orderBy("slot").collect()
    need = {r.sid: r for r in sources.collect()}
    assert len({r.slot for r in got}) == len(got)
    total = sum(r.take for r in got)
    for sid, s in need.items():
        mine = [r for r in got if r.sid == sid]
        assert sum(r.take for r in mine) == int(s.target + 0.5)
        assert [(r.epoch, r.block) for r in mine] == sorted((r.epoch, r.block) for r in mine)
        # low discrepancy: in every prefix a source has about its share
        share, seen = len(mine) / len(got), 0
        for i, r in enumerate(got):
            seen += r.sid == sid
            assert abs(seen - share * (i + 1)) < 12
    assert total == sum(int(s.target + 0.5) for s in need.values())


def test_long_prefix_sums_agree(spark):
    sizes = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 9).alias("size"), F.md5(F.col("id").cast("string")).alias("key"))
    sources = mixing.source_targets(sizes)
    out = mixing.laid_out(sizes, sources, rows_per_range=7).orderBy("key").collect()
    at = 0
    for r in out:
        assert r.start == at
        at += r.size


def test_empty(spark):
    assert mix_rows(docs(spark, [])).collect() == []
    assert [r.taken for r in mix_rows(docs(spark, [(1, None, None)])).collect()] == [0]
