"""The registered query of each operator, and its DuckDB statement where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprep.llm import alignment, bpe, collocations, langid, licenses, minhash, mixing, packing, pii, quality, repeats, secrets, simhash
from codeprep.llm.common import documents

#: The vocabularies that the queries encode with; the operators take any path.
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = langid.learn(docs.where("not held_out"))
    # the fold is a function of the id and does not go through the prediction
    return langid.predict(docs, model).withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), BYTE_BPE)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.scan(docs, pii.learn(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_report(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(documents(spark, sf_dir), BYTE_BPE)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), as_text=False).withColumnRenamed("kept", "kept_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("redacted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_repeats": op9_repeats,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Links by counting common shingles of all pairs that share one; components by reaching along them.
_SQL_MINHASH = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m JOIN n ON n.doc_id = m.doc_id
"""


def _sql_licenses() -> str:
    rows = ", ".join(f"({i}, {_lit(name)}, {m}, {_lit(x + ' ' + y)})" for i, name, m, x, y in licenses._template_rows(licenses.TEMPLATES))
    return f"""
WITH t(template, licence, m, b) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(x, chr(10)),
        list_transform(regexp_split_to_array(x, '\\n[ ]?\\n[ \\n]*'), lambda p: replace(p, chr(10), ' ')), [replace(x, chr(10), ' ')]))) AS seg FROM d),
w AS (SELECT doc_id, seg, list_filter(string_split(seg, ' '), lambda v: v <> '') AS w FROM g),
b AS (SELECT doc_id, seg, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bs FROM w),
u AS (SELECT doc_id, seg, len(bs) AS n, unnest(bs) AS b FROM b),
k AS (SELECT doc_id, licence, round(CAST(2 * count(*) AS DOUBLE) / (n + m), 6) AS dice FROM u JOIN t ON u.b = t.b GROUP BY doc_id, seg, n, template, licence, m),
f AS (SELECT doc_id, licence, max(dice) AS dice FROM k WHERE dice >= {licenses.THRESHOLD} GROUP BY ALL),
best AS (SELECT doc_id, licence, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS at FROM f),
every AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM f GROUP BY doc_id)
SELECT documents.doc_id, best.licence, coalesce(best.dice, CAST(0 AS DOUBLE)) AS dice, coalesce(every.licences, '') AS licences
FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id AND best.at = 1 LEFT JOIN every ON every.doc_id = documents.doc_id
"""


#: Every window of 50 bytes, as hex digits, with the least document that has it; covered bytes as islands of windows.
_SQL_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
m AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.s = w.s AND f.least < w.doc_id),
b AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS opens FROM m),
i AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM b),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, island),
e AS (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
k AS (SELECT e.doc_id, a, z, z - a AS n, substr(h, 1 + 2 * coalesce(lag(z) OVER (PARTITION BY e.doc_id ORDER BY a, z), 0),
             2 * (a - coalesce(lag(z) OVER (PARTITION BY e.doc_id ORDER BY a, z), 0))) AS piece FROM e JOIN d ON d.doc_id = e.doc_id)
SELECT d.doc_id, length(any_value(h)) // 2 AS n_bytes, CAST(sum(n) AS BIGINT) AS n_removed, count(*) FILTER (n > 0) AS n_spans,
  sha256(unhex(string_agg(piece, '' ORDER BY a, z))) AS kept_sha256
FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: Every run of one to five words counted, each cut scored in 128 bits, every longer candidate looked through.
_SQL_COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE m >= 2),
free AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.m > c.m AND 100 * o.a >= 100 * c.a
                                           AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
k AS (SELECT *, string_split(phrase, ' ') AS v, unnest(range(1, m)) AS k FROM free),
x AS (SELECT k.lang, k.phrase, k.a, f1.a AS l, f2.a AS r, n.n, k.k, CAST(CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(f1.a AS HUGEINT) * f2.a) AS BIGINT) AS score
      FROM k JOIN n ON n.lang = k.lang JOIN f AS f1 ON f1.lang = k.lang AND f1.phrase = array_to_string(v[1:k.k], ' ')
      JOIN f AS f2 ON f2.lang = k.lang AND f2.phrase = array_to_string(v[k.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""


#: Least share first: the smallest number of capped sources after which the next one is not above its limit.
_SQL_MIXING = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT coalesce('s' || source, 't') AS tag, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1),
w AS (SELECT tag, size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY tag) - 1) % 3] AS BIGINT) AS weight FROM s),
o AS (SELECT *, size * 10 // weight AS ratio, row_number() OVER (ORDER BY size * 10 // weight, tag) AS pos FROM w),
c AS (SELECT pos, ratio, 150 * sum(size) OVER () - 200 * coalesce(sum(size) OVER prev, 0) AS num, sum(weight) OVER () - coalesce(sum(weight) OVER prev, 0) AS den,
             size, weight FROM o WINDOW prev AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM c WHERE weight * num <= 200 * size * den ORDER BY pos LIMIT 1),
t AS (SELECT tag, size AS source_size, weight * num > 200 * size * den AS capped,
             CASE WHEN weight * num > 200 * size * den THEN CAST(2 * size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(100 * den AS DOUBLE) END AS target
      FROM w, f),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 33554432 ELSE least(33554432, CAST(floor(target / source_size * 16777216) AS BIGINT)) END AS step,
             CAST('0x' || md5('0:' || tag)[1:6] AS BIGINT) AS first FROM t),
n AS (SELECT doc_id, size, source_size, target, step, first, row_number() OVER (PARTITION BY p.tag ORDER BY size, doc_id) AS pos
      FROM d JOIN p ON p.tag = coalesce('s' || d.source, 't')),
k AS (SELECT *, ((first + pos * step) >> 24) - ((first + (pos - 1) * step) >> 24) AS copies FROM n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM k
"""


#: The statements of the operators that SQL can express; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op4_minhash": _SQL_MINHASH,
    "op5_licenses": _sql_licenses(),
    "op9_repeats": _SQL_REPEATS,
    "op11_collocations": _SQL_COLLOCATIONS,
    "op13_mixing": _SQL_MIXING,
}
