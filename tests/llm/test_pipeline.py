"""The pipeline against the same stages in plain Python, over small tables with all the cases in them."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_minhash import brute as groups
from tests.llm.test_mixing import fill
from tidemill.llm import quality, secrets
from tidemill.scratch import materialise

HEX = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = []
    for i in range(240):
        w = [word() for _ in range(rng.randint(20, 90))]
        texts.append(" ".join(x.upper() + "!!" for x in w) if i % 4 == 0 else " ".join(w) + ".")
    items = [" ".join(word() for _ in range(24)) for _ in range(6)]
    for k in range(12):
        leak = items[k % 6].split()
        leak[rng.randrange(24)] = "changed"
        texts[4 * k + 1] += " " + " ".join(leak)
    for k in range(20):
        texts[4 * k + 82] += f' token = "{HEX}"'
    copies = []
    for k in range(30):
        w = texts[4 * k + 3].split()
        if k % 2 and len(w) > 50:
            w[7] = "edited"
        copies.append(" ".join(w))
    texts += copies
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, None, "s1", None), (1001, "", "en", "s1", 0), (1002, "one two", "en", None, 7), rows[5], rows[5]]
    labels = [(i, int(i % 4 > 0 or i >= 240), 0) for i in range(270) if i % 3]
    return rows, labels, items


def expected(rows, labels, items):
    x = quality.statistics(pa.array([r[1] for r in rows], pa.string()))
    truth = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    moments = {}
    for c in (0, 1):
        z = x[np.array([truth.get(r[0]) == c for r in rows])]
        moments[c] = (len(z), z.sum(0), z.T @ z)
    score = quality.Discriminant(moments).score(x)
    rows = [r for r, s in zip(rows, score) if s >= 0.5]
    keep = {d for d, _, _, kept in groups([(r[0], r[1]) for r in rows]) if kept}
    rows = list({r[0]: r for r in rows if r[0] in keep}.values())
    bad = {d for d, _, _ in leaks([(r[0], r[1]) for r in rows], list(enumerate(items)))}
    rows = [(r[0], secrets.redact_text(r[1]), r[3]) for r in rows if r[0] not in bad]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = fill(sizes)
    return {d: (words(t), s, sizes[s], float(target[s])) for d, t, s in rows}


def test_pipeline(spark, tmp_path):
    rows, labels, items = corpus()
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", list(enumerate(items)), "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    want = expected(rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        left.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
        if name == "secrets":
            assert docs.where(f"contains(text, '{HEX}')").count() == 0 and docs.where("contains(text, '<assign>')").count() > 5
    assert left[0] > left[1] > left[2] > left[3] == left[4] == left[5]
    out = docs.collect()
    assert {r.doc_id for r in out} == set(want) and len(out) == len(want)
    for r in out:
        size, source, total, target = want[r.doc_id]
        assert (r.size, r.source, r.source_size) == (size, source, total) and abs(r.target - target) < 1e-6 and 0 <= r.taken <= 2 * size
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "size int, sid int, mark int, id int, k int, n int, key string, h long, t string, taken int, secret_spans string, cls int, label int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    row = (None, None, None, None, None, *[None] * len(extra.split(",")))
    for rows in ([], [row], [row, row, (1, "word " * 30, "en", "s", 150, *[7] * 6, "k", 7, "t", 7, "s", 7, 7)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() == (len(rows) if name == "quality" else len({r[0] for r in rows})), name
