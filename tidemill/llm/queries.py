"""The queries of this subpackage: each a thin view of one operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import ann, bpe, decontam, licenses, merkle, minhash, mixing, negatives, quality, secrets, tokencount, urlgraph, warczip
from tidemill.session import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(table(spark, sf_dir, "documents"))


def mix_rows(docs: DataFrame) -> DataFrame:
    rows, _, sources = mixing.mix(docs)
    return rows.join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS sid FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS fill FROM l),
t AS (SELECT sid, source, source_size, coalesce(least(cap, fill * w), cap) AS target FROM f),
o AS (SELECT d.doc_id, d.source, d.size, sid, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
             coalesce(sum(d.size) OVER (PARTITION BY sid ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (want // source_size) AS rounds, want % source_size AS rest, (source_size + 4095) // 4096 AS blocks
      FROM (SELECT sid, source_size, floor(target + 0.5)::BIGINT AS want FROM t WHERE source_size > 0)),
k AS (SELECT *, rounds * blocks + (rest + 4095) // 4096 AS need FROM n),
q AS MATERIALIZED (SELECT *, sum(need) OVER (ORDER BY sid) AS hi, sum(need) OVER () AS total FROM k),
p AS (SELECT slot, ((slot::HUGEINT * 679535556991) % 1099511627776)::DOUBLE / 1099511627776.0::DOUBLE * total::DOUBLE AS x
      FROM (SELECT unnest(range(0, coalesce(max(total), 0)::BIGINT)) AS slot, max(total) AS total FROM q)),
h AS (SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM p JOIN q ON x >= hi - need AND x < hi),
g AS (SELECT sid, count(*) AS got FROM h GROUP BY sid),
z AS (SELECT slot, sid, rank FROM h WHERE rank < need
      UNION ALL SELECT total + hi - need + rank, sid, rank FROM (SELECT *, unnest(range(coalesce(got, 0), need::BIGINT)) AS rank FROM q LEFT JOIN g USING (sid) WHERE coalesce(got, 0) < need)),
y AS (SELECT slot, sid, rank % blocks AS block, least(4096, CASE WHEN rank // blocks < rounds THEN source_size ELSE rest END - (rank % blocks) * 4096) AS take FROM z JOIN q USING (sid)),
f1 AS (SELECT o.sid, o.start, min(slot) AS first_slot FROM (SELECT *, unnest(range((start // 4096)::BIGINT, ((start + size - 1) // 4096)::BIGINT + 1)) AS block FROM o WHERE size > 0) o
       JOIN y ON y.sid = o.sid AND y.block = o.block WHERE greatest(o.start, o.block * 4096) < least(o.start + o.size, o.block * 4096 + take) GROUP BY o.sid, o.start)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size + least(size, greatest(0, want % source_size - o.start)) END::BIGINT AS taken,
       CASE WHEN size > 0 THEN first_slot END::BIGINT AS first_slot
FROM o LEFT JOIN f1 ON f1.sid = o.sid AND f1.start = o.start
"""


#: The rules of query op2, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op2_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _op2_sql() -> str:
    cases = []
    for said, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{said}:{rule}'")
    steps = "".join(
        f"r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, seed AS score FROM seeds UNION ALL "
        f"SELECT e.kind, e.dst, sum(r.score * e.part * {urlgraph.DAMPING}) FROM edges e JOIN r{k} r ON r.kind = e.kind AND r.host = e.src GROUP BY ALL) GROUP BY ALL),\n"
        for k in range(urlgraph.STEPS)
    )
    link = urlgraph.LINK.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
                  list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS links FROM pages),
p AS MATERIALIZED (SELECT *, CASE {' '.join(cases)} END AS hit FROM u),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (hit LIKE 'allow:%') AS good, count(*) FILTER (hit LIKE 'block:%') AS bad FROM p WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, good / n AS seed FROM h WHERE good > 0 UNION ALL SELECT 'distrust', host, bad / n FROM h WHERE bad > 0),
l AS (SELECT host AS src, unnest(links) AS dst FROM p WHERE host <> ''),
c AS (SELECT src, dst, count(*)::DOUBLE AS n FROM l WHERE src <> dst GROUP BY ALL),
b AS (SELECT 'trust' AS kind, src, dst, n FROM c UNION ALL SELECT 'distrust', dst, src, n FROM c),
edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS part FROM b),
r0 AS (SELECT kind, host, seed AS score FROM seeds),
{steps}
s AS (SELECT host, sum(score) FILTER (kind = 'trust') AS trust, sum(score) FILTER (kind = 'distrust') AS distrust FROM r{urlgraph.STEPS} GROUP BY host)
SELECT page_id, host, path, split_part(hit, ':', 2) AS rule,
       coalesce(split_part(hit, ':', 1), CASE WHEN coalesce(distrust, 0) >= 0.5 AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s USING (host)
"""


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 1)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS tok, unnest(range(len(w))) AS p FROM d),
bt AS (SELECT item_id, len(w) AS m, unnest(w) AS tok, unnest(range(len(w))) AS q FROM b),
e AS (SELECT doc_id, item_id, m, p - q AS place, q FROM dt JOIN bt USING (tok)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, place) AS equal,
             count(*) OVER (PARTITION BY doc_id, item_id, place ORDER BY q RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS near FROM e),
k AS (SELECT DISTINCT doc_id, item_id, place, equal, m FROM n WHERE near >= CASE WHEN m >= 16 THEN 13 WHEN m >= 8 THEN m - m * 3 // 16 ELSE m END)
SELECT doc_id, item_id, place::INT AS place, equal::INT AS equal, m::INT AS item_tokens FROM k
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, place) = 1
"""


def op4_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op6_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", F.col("secret_spans").alias("all")).withColumn("base", F.expr("filter(all, x -> x.kind <> 'novel')"))
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    n = lambda kind: F.expr(f"size(filter(base, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("all")).alias("spans"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warczip.round_trip(pages)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to
FROM f
"""


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("mark", "component")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""


#: The unigram vocabulary of query op9: the pieces of this file, with their scores.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op9_count_viterbi(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), tokencount.vocabulary(tokenizer))


def op10_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


def merkle_rows(docs: DataFrame) -> DataFrame:
    fields = lambda text: merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = docs.select("doc_id", "source", fields(F.col("text")).alias("whole"), F.when(even, fields(F.translate("text", "\n", ""))).alias("tampered"))
    found = merkle.manifest(rows, "whole", "source", "doc_id", ["doc_id", "tampered"])
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + "))"


#: The tree level by level; a level's siblings; then each row's fold. crc32 goes bit by bit over the digits of doc_id.
OP11_SQL = f"""
WITH RECURSIVE b AS (SELECT DISTINCT doc_id AS of_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * len(doc_id::VARCHAR)),
                lambda i: (ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) >> (i % 8)::INT) & 1)), lambda c, x: xor(c >> 1, xor(c & 1, x) * 3988292384)) AS c FROM documents WHERE doc_id IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN (b.c & 1) = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
     FROM documents d LEFT JOIN b ON of_id = doc_id),
g AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, source COLLATE "binary") - 1 AS grp FROM (SELECT DISTINCT source FROM d)),
l AS MATERIALIZED (SELECT d.*, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id IS NOT NULL, doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS row_id
     FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
t AS (SELECT grp, 0 AS level, pos, leaf AS node, n FROM l
      UNION ALL SELECT grp, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY grp, level, pos // 3),
r AS MATERIALIZED (SELECT grp, node AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, grp AS pos, subroot AS node, count(*) OVER () AS n FROM r
      UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY level, pos // 3),
k AS (SELECT grp, max(level) AS high FROM t GROUP BY grp),
a AS MATERIALIZED (SELECT grp, level, pos, node, n FROM t UNION ALL SELECT -1, level, pos, node, n FROM u),
s AS MATERIALIZED (SELECT x.grp, x.level, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lhs, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS rhs
     FROM a x JOIN a y ON y.grp = x.grp AND y.level = x.level AND y.pos // 3 = x.pos // 3 WHERE x.n > 1 GROUP BY ALL),
f AS (SELECT row_id, l.grp, 0 AS level, pos, coalesce(tampered, leaf) AS node, '' AS path, 0 AS done FROM l
      UNION ALL
      SELECT f.row_id, CASE WHEN s.level IS NULL THEN -1 ELSE f.grp END, CASE WHEN s.level IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN s.level IS NULL THEN f.grp ELSE f.pos // 3 END,
             CASE WHEN s.level IS NULL THEN f.node ELSE sha256(s.lhs || f.node || s.rhs) END, f.path || coalesce(s.lhs || s.rhs, ''), CASE WHEN s.level IS NULL AND f.grp = -1 THEN 1 ELSE 0 END
      FROM f LEFT JOIN s ON s.grp = f.grp AND s.level = f.level AND s.pos = f.pos WHERE done = 0)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM f JOIN l USING (row_id) JOIN r ON r.grp = l.grp CROSS JOIN (SELECT node AS root FROM u WHERE n = 1) WHERE f.done = 1
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_rows(table(spark, sf_dir, "embeddings"))


def negative_rows(vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""


#: The rank file of query op13.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_rows(table(spark, sf_dir, "documents"), bpe.ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def bpe_rows(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, ranks, pattern), ranks)


def queries() -> dict:
    found = (
        op1_source_mix, op2_link_graph, op3_spaced_seeds, op4_license_compression, op5_block_matrix,
        op6_zstd_novelty, op7_warc_zip, op8_circulant_minhash, op9_count_viterbi, op10_quadratic_discriminant,
        op11_merkle_manifest, op12_hard_negatives, op13_byte_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": OP1_SQL,
        "op2_link_graph": _op2_sql(),
        "op3_spaced_seeds": OP3_SQL,
        "op5_block_matrix": OP5_SQL,
        "op7_warc_zip": OP7_SQL,
        "op8_circulant_minhash": OP8_SQL,
        "op11_merkle_manifest": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
    }
