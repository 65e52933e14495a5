"""The registered queries of this subpackage: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (byte_bpe, collocations, decontaminate, licenses, merkle, mixing, prefix_hash, quality, secrets,
                         simhash, tokenfile, tokenizing, toxicity)
from kestrel.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return run
    return register


@query("op1_prefix_fingerprints")
def q_fingerprints(spark, sf_dir):
    return prefix_hash.fingerprints(table(spark, sf_dir, "documents"))


@query("op2_source_mixing")
def q_mixing(spark, sf_dir):
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op2_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
sums AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM weighed
  WINDOW w AS (ORDER BY cap * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - capped)::DOUBLE / rest_weight AS level FROM sums),
level AS (SELECT min_by(level, cap * 6 // weight) AS settled FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, settled * weight) AS target,
    round(least(cap::DOUBLE, settled * weight))::BIGINT AS used FROM levels, level),
streams AS (
  SELECT doc_id, source, size, (coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begins FROM sized)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (used // source_size) * size
    + least(greatest(used % source_size - begins, 0), size) END::BIGINT AS taken
FROM streams JOIN targets ON streams.source IS NOT DISTINCT FROM targets.source
"""


@query("op3_token_counts")
def q_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tokenizing.count_tokens(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"])


@query("op4_license_scan")
def q_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def q_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op6_secret_scan")
def q_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def q_decontamination(spark, sf_dir):
    return decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


ORACLES["op7_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM spans JOIN windows USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op8_simhash_dedup")
def q_simhash(spark, sf_dir):
    groups = simhash.components(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_quality_classifier")
def q_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_token_files")
def q_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return tokenfile.read_documents(spark, path)


@query("op11_byte_bpe")
def q_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), keep=["doc_id"])


@query("op12_collocations")
def q_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, 6) AS r(k) WHERE len(w) >= k),
f AS (
  SELECT lang, k, w[i:i + k - 1] AS words, count(*)::BIGINT AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
inner_words AS (SELECT lang, words[2:] AS words, f FROM f WHERE k > 2 UNION ALL SELECT lang, words[:-2], f FROM f WHERE k > 2),
longer AS (SELECT lang, words, max(f) AS most FROM inner_words GROUP BY ALL),
kept AS (
  SELECT f.* FROM f LEFT JOIN longer USING (lang, words) WHERE k > 1 AND coalesce(100 * most < 100 * f.f, true)),
cuts AS (SELECT lang, k, words, f AS a, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT cuts.lang, array_to_string(cuts.words, ' ') AS phrase, a, c, x.f AS l, y.f AS r, n,
    ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.words = cuts.words[:c]
  JOIN f AS y ON y.lang = cuts.lang AND y.words = cuts.words[c + 1:] JOIN sizes ON sizes.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


@query("op13_merkle_manifest")
def q_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, merkle.lower_az(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": text})


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE source_rows AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    -- crc32 of the decimal doc_id: each byte, then eight shifts
    xor(4294967295, list_reduce(flatten([[4294967295]::BIGINT[]] || list_transform(string_split(doc_id::VARCHAR, ''),
      lambda d: [256 + ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x - 256)
        ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 3 = 0 AS tampered
  FROM documents),
hashed AS (
  SELECT doc_id, lang, head || coalesce(strlen(text) || ':' || text, '-') AS plain,
    head || coalesce(strlen(low) || ':' || low, '-') AS changed, tampered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM source_rows)),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(plain) AS leaf,
    sha256(CASE WHEN tampered THEN changed ELSE plain END) AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, sha256(plain)) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM hashed),
tree(grp, level, pos, node, n) AS (
  SELECT grp, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1
  GROUP BY grp, level, pos // 8, n),
subroots AS (
  SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
tops(level, pos, node, n) AS (
  SELECT 0, pos, node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1
  GROUP BY level, pos // 8, n),
siblings AS (
  SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '.'
    || coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS s
  FROM tree AS a JOIN tree AS b ON a.grp = b.grp AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.grp, a.level, a.pos),
top_siblings AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '.'
    || coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS s
  FROM tops AS a JOIN tops AS b ON a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.level, a.pos),
steps AS (
  SELECT l.grp, l.pos, s.level AS step, s.s FROM leaves AS l
  JOIN siblings AS s ON s.grp = l.grp AND s.pos = l.pos // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT l.grp, l.pos, 100 + t.level, t.s FROM leaves AS l JOIN subroots AS r ON r.grp = l.grp
  JOIN top_siblings AS t ON t.pos = r.pos // (8 ** t.level)::BIGINT),
proofs AS (SELECT grp, pos, list(s ORDER BY step) AS proof FROM steps GROUP BY grp, pos),
folded AS (
  SELECT l.*, list_reduce([now] || coalesce(proof, []), lambda acc, x: sha256(replace(x, '.', acc))) AS folded_root,
    sha256(replace(array_to_string(coalesce(proof, []), ''), '.', '')) AS proof_sha256
  FROM leaves AS l LEFT JOIN proofs AS p ON p.grp = l.grp AND p.pos = l.pos)
SELECT doc_id, leaf, r.node AS subroot, t.node AS root, proof_sha256, folded_root, folded_root = t.node AS verified
FROM folded AS f JOIN subroots AS r ON r.grp = f.grp JOIN tops AS t ON t.n = 1
"""
