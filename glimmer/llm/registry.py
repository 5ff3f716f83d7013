"""The queries of this package: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import collocations, fingerprints, language, lines, minhash, mixing, neighbours, packing, partenum, resampling, sharding, substrings, toxicity
from glimmer.llm.tables import documents


def tokenizer_path() -> str:
    """The default vocabulary: the public byte-level BPE file that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_held_out(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), as_digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("n_draws"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir), as_digest=True).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 24)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS bound FROM k),
l AS (
  SELECT *, (sum(source_size) OVER () - sum(bound) OVER f + bound)::DOUBLE / (sum(weight) OVER () - sum(weight) OVER f + weight) AS level
  FROM w WINDOW f AS (ORDER BY bound / weight, rank ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN bound / weight < level THEN bound::DOUBLE ELSE weight * (
    SELECT level FROM l WHERE NOT (bound / weight < level) ORDER BY bound / weight, rank LIMIT 1) END AS target
  FROM l),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos
  FROM r),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
x AS (SELECT *, greatest(64, ceil(sum(quota) OVER () / 32768))::BIGINT AS width FROM q),
c AS (
  SELECT id, doc_id, size, p.source_size, target, copy, width, copy * x.source_size + pos AS lo, least(copy * x.source_size + pos + size, quota) AS hi
  FROM (SELECT p.*, s.source_size FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source) p JOIN x ON p.source IS NOT DISTINCT FROM x.source, range(3) r(copy)),
e AS (SELECT *, unnest(CASE WHEN hi > lo THEN range((lo // width)::BIGINT, ((hi - 1) // width)::BIGINT + 1) ELSE [NULL] END) AS block FROM c)
SELECT doc_id, size, source_size, target,
  coalesce(sum(least(hi, (block + 1) * width) - greatest(lo, block * width)) FILTER (block IS NOT NULL), 0)::BIGINT AS taken, count(block)::BIGINT AS n_draws
FROM e GROUP BY id, doc_id, size, source_size, target
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS m FROM s),
k AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h JOIN k USING (m)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
e AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM e
"""

OP6_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM d),
s AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id, n) AS id, doc_id, n, list_sort(list_distinct(regexp_extract_all(ls[n], '[^\x20\x09-\x0D]+'))) AS w FROM l),
u AS MATERIALIZED (SELECT w, min(id) AS id, len(w) AS k FROM s WHERE len(w) > 0 GROUP BY w),
t AS (SELECT id, k, unnest(w) AS x FROM u),
f AS (SELECT x, count(*) AS f FROM t GROUP BY x),
p AS MATERIALIZED (
  SELECT id, k, x FROM (SELECT id, k, x, row_number() OVER (PARTITION BY id ORDER BY f, x) AS place FROM t JOIN f USING (x)) WHERE place <= k - (75 * k + 99) // 100 + 1),
c AS MATERIALIZED (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id WHERE 100 * least(a.k, b.k) >= 75 * greatest(a.k, b.k)),
o AS (SELECT c.b AS b, x.k + y.k AS k, len(list_intersect(x.w, y.w)) AS o FROM c JOIN u x ON x.id = c.a JOIN u y ON y.id = c.b),
r AS (SELECT DISTINCT b AS id FROM o WHERE 100 * o >= 75 * (k - o)),
g AS (
  SELECT s.doc_id, list(s.n) AS gone FROM s JOIN u USING (w) LEFT JOIN r ON r.id = u.id WHERE s.id <> u.id OR r.id IS NOT NULL GROUP BY s.doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(gone, i)) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP11_SQL = OP9_SQL.replace("100 * c >= 75 *", "100 * c >= 80 *").replace(", doc_id = component_id AS kept", "")

OP12_SQL = r"""
WITH p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
g AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) r(k)))
  GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
c AS (SELECT lang, phrase, f AS a, i, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM s)),
v AS (
  SELECT c.lang, c.phrase, a, i, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.phrase = c.x JOIN g y ON y.lang = c.lang AND y.phrase = c.y),
b AS (SELECT lang, phrase, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, i))) FROM v GROUP BY lang, phrase, a),
i AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM s)) GROUP BY 1, 2),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE NOT coalesce(100::HUGEINT * i.f >= 80::HUGEINT * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

#: CRC-32 byte by byte over a table of its 256 remainders, for each distinct feature once.
OP13_SQL = r"""
WITH q AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS q FROM range(256) r(i)),
x AS (SELECT row_number() OVER () AS id, 0 AS side, doc_id, text FROM documents UNION ALL SELECT 0, 1, NULL, text FROM benchmark),
d AS MATERIALIZED (
  SELECT id, side, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM x),
f AS MATERIALIZED (
  SELECT id, side, w[i] AS f FROM (SELECT id, side, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  UNION ALL SELECT id, side, w[i] || ' ' || w[i + 1] FROM (SELECT id, side, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT)),
    lambda a, c: xor(a >> 8, q[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM h, q),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (f) GROUP BY 1),
o AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS gain FROM n, o),
w AS (SELECT id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
e AS (
  SELECT id, doc_id, len(w)::BIGINT AS words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (id) WHERE side = 0),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS drawn FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM e LEFT JOIN r USING (id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_nearest": op8_nearest,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_sharding": op10_sharding,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op5_mixing": OP5_SQL, "op6_line_dedup": OP6_SQL, "op9_minhash_dedup": OP9_SQL, "op11_ngram_join": OP11_SQL, "op12_collocations": OP12_SQL, "op13_resampling": OP13_SQL}
