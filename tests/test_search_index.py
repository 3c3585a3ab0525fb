import random
import re

from pyspark.sql import functions as F

from tidemill.functions.text import search_tokens
from tidemill.operators import keywords
from tidemill.sources import search_index


def test_index_equals_the_scan_and_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(300)] + ["가나다", "x1"]
    rows = [(i, " ".join([*rng.choices(words, k=rng.randrange(8)), "common"])) for i in range(0, 900, 3)] + [(None, "abc"), (7, None), (-5, "abcd common"), (4, "abc abc")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "id long, text string, term string")
    root = f"file://{tmp_path}/index"
    search_index.build(df, "id", "text", root, 12)
    some = 0
    for asked in ("ab", "abcde c", "common", "é b a", "zz", "", "가", "common zz", "ABÉ"):
        tokens = search_index.tokens_of(spark, asked)
        scan = df.where(F.col("id").isNotNull() & keywords.prefix_match(F.array(*map(F.lit, tokens)), search_tokens(F.col("text")))) if tokens else df.limit(0)
        got = [r.id for r in search_index.search(spark, root, asked).collect()]
        assert sorted(got) == sorted({r.id for r in scan.collect()}), asked
        some += len(got)
    assert some > 300
    every = len(spark.read.parquet(f"{root}/postings").inputFiles())
    plan = search_index.hits(spark, root, "abcd")
    assert every >= 10 and re.search(r"PartitionFilters: \[.*range", plan._jdf.queryExecution().executedPlan().toString()) and plan.select("range").distinct().count() <= 3
