"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, collocations, hpylm, imatch, langid, licenses, merkle, minhash, mixing, repetition, secrets, tokencounts, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"))


#: No source is seen more than four times; every document is seen at least once.
MIX = mixing.Settings(most_epochs=4.0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(documents, MIX).select("doc_id", "source", "epoch", "block", "place")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *places: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.label") for p in places]))))
    base, fuzzy = F.col("base"), F.col("fuzzy")
    best = F.array_max(F.transform(fuzzy, lambda x: 1.0 - x["edits"] / (x["last_word"] - x["first_word"] + 2)))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.col("base.first_word")).alias("first_word"),
        F.array_max(F.col("base.first_word")).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "fuzzy").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0)))).alias("score"),
        F.size(fuzzy).cast("long").alias("n_fuzzy"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(fold("doc_id", 5) != 0))
    held = documents.select("doc_id", "text")
    return langid.predict(held, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        of("entropy").alias("n_entropy"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "covered_fraction")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = hpylm.score(documents, "crc32(cast(cast(doc_id AS string) AS binary)) % 10 <> 0", hpylm.Settings(sampled=True))
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: What a leaf of the manifest holds, in this order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(fold("doc_id", 5) == 0, merkle.leaf_digest(*[F.col(c) for c in LEAF[:-1]], lowered))
    leaves = merkle.manifest(table(spark, sf_dir, "documents"), LEAF, keep={"tampered": tampered})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return leaves.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.against_edited(table(spark, sf_dir, "documents"))
    near = [imatch.likeness("fingerprint", f"{of}_fingerprint").alias(f"near_{of}") for of in ("edited", "next")]
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_minhash_dedup,
        op3_source_mixing,
        op4_license_scan,
        op5_language_id,
        op6_secret_scan,
        op7_quality_rules,
        op8_vector_dedup,
        op9_pitman_yor,
        op10_token_counts,
        op11_merkle_manifest,
        op12_collocations,
        op13_imatch,
    )
}

_REACH = """
reach(x, y) AS (SELECT {id}, {id} FROM {rows} UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (na + nb - c)),
links AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
""" + _REACH.format(id="doc_id", rows="documents") + """
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp ON s.doc_id = comp.x
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
""" + _REACH.format(id="vec_id", rows="embeddings") + """
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON vec_id = comp.x LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON vec_id = l.x
"""

_NUMBER = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, {block} % 256 AS block,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens FROM documents
), b AS (SELECT s, block, sum(tokens) AS tokens FROM d GROUP BY 1, 2),
src AS (SELECT s, sum(tokens) AS tokens FROM b GROUP BY 1),
tot AS (SELECT sum(tokens) AS t, max(tokens) AS most, count(*) AS n FROM src WHERE tokens > 0),
half(step, low) AS (
  SELECT 1 << 27, 0
  UNION ALL
  SELECT h.step // 2, h.low + CASE WHEN r.repeated > 4.0 THEN h.step ELSE 0 END
  FROM half h, LATERAL (
    SELECT max(exp(ln(tokens / t) * (h.low + h.step) / (1 << 28)) / tokens) * any_value(most) / exp(ln(any_value(most) / any_value(t)) * (h.low + h.step) / (1 << 28)) AS repeated
    FROM src, tot WHERE tokens > 0
  ) r WHERE h.step > 0
), ex AS (SELECT CASE WHEN (SELECT n FROM tot) = 1 THEN 1.0 ELSE (max(low) + 1) / (1 << 28) END AS a FROM half),
z AS (SELECT sum(exp(ln(tokens / t) * a)) AS z, any_value(most) * sum(exp(ln(tokens / t) * a)) / exp(ln(any_value(most) / any_value(t)) * any_value(a)) AS budget FROM src, tot, ex WHERE tokens > 0),
w AS (SELECT s, tokens AS all_tokens, CASE WHEN tokens > 0 THEN round(exp(ln(tokens / t) * a) / z * budget / tokens, 9) ELSE 1.0 END AS epochs FROM src, tot, ex, z),
e AS (SELECT b.s, b.block, b.tokens, all_tokens, epochs, unnest(range(0, greatest(CAST(ceil(epochs) AS BIGINT), 1))) AS epoch FROM b JOIN w ON b.s = w.s),
o AS (SELECT *, coalesce(sum(tokens) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER g - 1 AS place
  FROM e WINDOW g AS (PARTITION BY s, epoch ORDER BY {order}, block))
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(d.block AS INTEGER) AS block, CAST(place AS INTEGER) AS place
FROM d JOIN o ON d.s = o.s AND d.block = o.block
WHERE epochs >= epoch + 1 OR before * 2 + o.tokens <= (epochs - epoch) * all_tokens * 2
""".replace("{block}", _NUMBER.format("'mix|' || coalesce(CAST(doc_id AS VARCHAR), '')")).replace("{order}", _NUMBER.format("'mix|' || s || '|' || epoch || '|' || block"))

_CRC = "xor(list_reduce([4294967295] || flatten([[(ascii(CAST({0} AS VARCHAR)[j]) >> b) & 1 FOR b IN range(8)] FOR j IN range(1, len(CAST({0} AS VARCHAR)) + 1)]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in LEAF) + ")"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all trees of ``leaves`` (t, i, h), and for each leaf what stands left and right of its ancestors."""
    return f"""
{name}(t, level, i, h, n) AS (
  SELECT t, 0, i, h, count(*) OVER (PARTITION BY t) FROM {leaves}
  UNION ALL
  SELECT t, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY t, level, i // 16
), {name}_steps AS (
  SELECT l.t, l.i, u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i < l.i >> (4 * u.level)), '') AS a,
    coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (WHERE u.i > l.i >> (4 * u.level)), '') AS b
  FROM {leaves} l JOIN {name} u ON u.t = l.t AND u.n > 1 AND u.i // 16 = l.i >> (4 * u.level + 4) GROUP BY l.t, l.i, u.level
), {name}_paths AS (SELECT t, i, list({{'a': a, 'b': b}} ORDER BY level) AS path FROM {name}_steps GROUP BY t, i)
"""


_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS t, {_LEAF} AS h, CASE WHEN {_CRC.format("doc_id")} % 5 = 0 THEN {_LEAF.replace("|| text", "|| " + _LOWERED)} END AS tampered FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
{_tree("own", "leaves")},
tops AS (SELECT '' AS t, t AS s, h, row_number() OVER (ORDER BY t) - 1 AS i FROM own WHERE n = 1),
{_tree("top", "tops")},
found AS (
  SELECT doc_id, l.h AS leaf, coalesce(tampered, l.h) AS x, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.path, []) || coalesce(q.path, []) AS path
  FROM leaves l LEFT JOIN own_paths p ON p.t = l.t AND p.i = l.i JOIN tops s ON s.s = l.t LEFT JOIN top_paths q ON q.i = s.i
), folded AS (SELECT *, list_reduce([{{'a': x, 'b': ''}}] || path, lambda c, s: {{'a': sha256(s.a || c.a || s.b), 'b': ''}}).a AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.a || s.b FOR s IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, m, unnest([array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) t(m) WHERE len(ws) >= m
), f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000 * c.a::HUGEINT * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM c, (VALUES (1), (2)) t(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')
  WHERE k < c.m
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS within FROM c, (VALUES (1), (2)) t(i) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE within IS NULL OR 100 * within < 50 * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""

#: SQL for the queries whose whole result it can express; the others are tested against plain versions.
ORACLES: dict[str, str] = {"op2_minhash_dedup": _OP2, "op3_source_mixing": _OP3, "op8_vector_dedup": _OP8, "op11_merkle_manifest": _OP11, "op12_collocations": _OP12}
