"""The queries of this package: thin wrappers that hold the operators to the tables and columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.llm import exact_dedup, html_density, merkle_manifest, near_dedup, norm_search, packing, pii_surrogates, quality_classifier, quality_rules
from tableweave.llm import sentencepiece_codec, source_divergence, suffix_dedup, warc_zip

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stands for a secret of the deployment; who has it can tell which surrogate an entity gets.
SURROGATE_KEY = "example-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.coded_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return told.withColumn("host_failure_rate", F.round("host_failure_rate", 6))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), added_tokens=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, exact_dedup.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    fields = [tampered if c == "text" else F.col(c) for c in merkle_manifest.FIELDS]
    told = merkle_manifest.dataset_manifest(docs, carried={"tampered": merkle_manifest.leaf_digest(fields)})
    told = told.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), merkle_manifest.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


# A-Z alone are lower-cased, as in the operators.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f / n) AS mu, greatest(var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n), 1e-9) AS spread FROM h),
q AS (SELECT source, (f + mu * wt) / (n + wt) AS rate FROM h, (SELECT mu, greatest({quality_rules.HOST_MIN_PRIOR}, mu * (1 - mu) / spread - 1) AS wt FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_failure_rate, NOT base_failed AND NOT coalesce(rate > {quality_rules.HOST_LIMIT}, false) AS kept
FROM b LEFT JOIN q USING (source)
"""

_OP6 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM p LEFT JOIN g USING (h)
"""

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {source_divergence.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (g.total + 2 * v.v)::HUGEINT) AS p, (1 + 1000000000 * (k.n + 2)::HUGEINT // (v.n + 2 * v.v)::HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM b LEFT JOIN a USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
"""


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _op12(groups_deep: int = 3, deep: int = 10) -> str:
    """Levels are written out: enough for 8 ** deep rows of a language and 8 ** groups_deep languages."""
    fields = ["doc_id", "source", "lang", "n_chars"]

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*fields, text]) + ")"

    ctes = [
        f"d AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM (SELECT *, {_CRC} AS crc FROM documents))",
        f"l AS MATERIALIZED (SELECT doc_id, lang AS g, {leaf('text')} AS leaf, {leaf('changed')} AS tampered FROM d)",
        "n0 AS MATERIALIZED (SELECT doc_id, g, leaf, tampered, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l)",
    ]

    def climb(base: str, levels: int, key: str) -> None:
        """Nodes of each level with the siblings of each; where one node is left it is handed on."""
        for k in range(levels):
            ctes.append(f"{base}s{k} AS MATERIALIZED (SELECT {key} AS k, i, n, h, i // 8 AS up, "
                f"coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {base}{k})")
            ctes.append(f"{base}{k + 1} AS MATERIALIZED (SELECT k AS {key}, up AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {base}s{k} GROUP BY k, up)")

    climb("n", deep, "g")
    ctes.append(f"m0 AS MATERIALIZED (SELECT 0 AS z, g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{deep})")
    climb("m", groups_deep, "z")
    ctes.append("f0 AS (SELECT doc_id, g, leaf, tampered AS f, i, '' AS proof FROM n0)")
    for k in range(deep):
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT doc_id, g, leaf, CASE WHEN s.n = 1 THEN f ELSE sha256(s.b || f || s.a) END AS f, x.i // 8 AS i, proof || CASE WHEN s.n = 1 THEN '' ELSE s.b || s.a END AS proof FROM f{k} x JOIN ns{k} s ON x.g IS NOT DISTINCT FROM s.k AND x.i = s.i)")
    ctes.append(f"t0 AS (SELECT x.doc_id, x.leaf, m.h AS subroot, x.f, m.i, x.proof FROM f{deep} x JOIN m0 m ON x.g IS NOT DISTINCT FROM m.g)")
    for k in range(groups_deep):
        ctes.append(f"t{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, CASE WHEN s.n = 1 THEN f ELSE sha256(s.b || f || s.a) END AS f, x.i // 8 AS i, proof || CASE WHEN s.n = 1 THEN '' ELSE s.b || s.a END AS proof FROM t{k} x JOIN ms{k} s ON x.i = s.i)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m.h AS verified FROM t{groups_deep}, m{groups_deep} m"


_OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op4_quality_rules": _OP4, "op6_warc_zip": _OP6, "op11_source_divergence": _OP11, "op12_merkle_manifest": _op12(), "op13_norm_search": _OP13}
