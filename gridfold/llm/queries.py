"""Registered queries of this subpackage, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_length_buckets")
def length_buckets(spark, folder):
    from gridfold.llm.packing import pack
    return pack(table(spark, folder, "documents"))


@query("op3_feistel_shards")
def feistel_shards(spark, folder):
    from gridfold.llm.sharding import shard_documents
    return shard_documents(table(spark, folder, "documents"), 40)


@query("op7_sainte_lague_mix")
def sainte_lague_mix(spark, folder):
    from gridfold.llm.mixing import mix_counts
    return mix_counts(table(spark, folder, "documents"))


@query("op4_deobfuscated_pii")
def deobfuscated_pii(spark, folder):
    from gridfold.llm.pii import scan_documents
    return scan_documents(table(spark, folder, "documents"))


@query("op10_motion_jpeg")
def motion_jpeg(spark, folder):
    from gridfold.llm.media import media_digest
    return media_digest(table(spark, folder, "documents"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URL_SQL = """
WITH rules(h, p, verdict) AS (VALUES %s),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
urls AS (SELECT DISTINCT host, path FROM split),
best AS (SELECT u.host, u.path, max({'n': length(h || p), 'd': length(h), 'rule': h || p, 'verdict': verdict}) AS b
         FROM urls u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query("op8_url_rules", URL_SQL)
def url_rules(spark, folder):
    from gridfold.llm.urls import judge
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, folder, "pages"), rules)


@query("op9_ball_tree_top_k")
def ball_tree_top_k(spark, folder):
    from gridfold.llm.balltree import quantised, top_k
    vectors = quantised(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query("op5_set_sketch_near_copies")
def set_sketch_near_copies(spark, folder):
    from gridfold.llm.sketches import near_copies
    return near_copies(table(spark, folder, "documents"))


@query("op6_weak_label_quality")
def weak_label_quality(spark, folder):
    from gridfold.llm.quality import judge
    return judge(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "accepted")


@query("op1_forest_secrets")
def forest_secrets(spark, folder):
    from gridfold.llm.secrets import Scanner, scan
    docs = table(spark, folder, "documents")
    return scan(docs, Scanner.fit(docs))


MIDDLE_SQL = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cuts AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM drawn),
parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_swar_fill_in_middle", MIDDLE_SQL)
def swar_fill_in_middle(spark, folder):
    from gridfold.llm.fim import fill_in_middle, restored
    made = fill_in_middle(table(spark, folder, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op12_rank_synchronous_tokens")
def rank_synchronous_tokens(spark, folder):
    import public_tokenizers

    from gridfold.llm.tokens import token_counts
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


CRC_SQL = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
FOLD_SQL = "array_to_string(d[1:pos % 8], '') AS l, array_to_string(d[pos % 8 + 2:], '') AS r"
MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n
    FROM (SELECT doc_id, coalesce('k' || lang, '') AS k, {_leaf_sql("text")} AS leaf,
                 CASE WHEN {CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)),
up AS (SELECT k, 0 AS level, idx, leaf AS digest, n FROM leaves
       UNION ALL SELECT k, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY k, level, idx // 8, n),
subs AS (SELECT k, digest AS subroot, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, subroot AS digest, n FROM subs
        UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (SELECT k, level, idx // 8 AS run, list(digest ORDER BY idx) AS d FROM up WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 8 AS run, list(digest ORDER BY idx) AS d FROM top WHERE n > 1 GROUP BY ALL),
fold AS (SELECT k, idx, 0 AS level, idx AS pos, coalesce(changed, leaf) AS h, '' AS sides, n FROM leaves
         UNION ALL SELECT k, idx, level + 1, pos // 8, sha256(l || h || r), sides || l || r, (n + 7) // 8
         FROM (SELECT f.*, {FOLD_SQL} FROM fold f JOIN runs USING (k, level) WHERE f.n > 1 AND runs.run = f.pos // 8)),
top_fold AS (SELECT f.k, f.idx, 0 AS level, s.idx AS pos, f.h, f.sides, s.n FROM fold f JOIN subs s USING (k) WHERE f.n = 1
             UNION ALL SELECT k, idx, level + 1, pos // 8, sha256(l || h || r), sides || l || r, (n + 7) // 8
             FROM (SELECT f.*, {FOLD_SQL} FROM top_fold f JOIN top_runs USING (level) WHERE f.n > 1 AND top_runs.run = f.pos // 8))
SELECT doc_id, leaf, subroot, digest AS root, sha256(sides) AS proof_sha256, h AS folded_root, h = digest AS verified
FROM leaves JOIN subs USING (k) JOIN (SELECT k, idx, h, sides FROM top_fold WHERE n = 1) f ON f.k = leaves.k AND f.idx = leaves.idx JOIN (SELECT digest FROM top WHERE n = 1) ON true
"""


@query("op13_path_copying_merkle", MERKLE_SQL)
def path_copying_merkle(spark, folder):
    from gridfold.llm.merkle import document_manifest, proof_digest
    made = document_manifest(table(spark, folder, "documents"))
    folded = F.element_at("copies", -1)
    return made.select(F.col("item").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
