"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import chat, decontaminate, fingerprints, html_extract, jaccard_join, mixing, packing, periodic_runs, ppm, quality, secrets, sharding, vector_codes
from cloudloom.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_copies(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(table(spark, sf_dir, "conversations"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans: str):
        each = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(each, ",")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"),
    )


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    told = hashlib.sha256(fitted.text().encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.label_errors(fitted.rows).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256")
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def periodic(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The edit of the contract: some documents' words repeat from a place on."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.find_runs(table(spark, sf_dir, "documents"), edit=periodic)

    def before(a, b):
        """Order by exponent, exactly and downwards, then start, then period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        after = F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        return after.when(a["period"] < b["period"], -1).otherwise(1)

    best = F.get(F.array_sort("runs", before), F.lit(0))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Sizes, budgets by prefix sums over size/weight order, and the cut in key order within each source.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
wt AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
cum AS (
  SELECT source, source_size, w,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS s0,
         coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS w0,
         (sum(source_size) OVER ())::HUGEINT AS t, (sum(w) OVER ())::HUGEINT AS ws
  FROM wt),
cap AS (SELECT *, 4 * source_size::HUGEINT * (ws - w0) <= (3 * t - 4 * s0) * w AS capped FROM cum),
lim AS (SELECT min(s0) AS s1, min(w0) AS w1 FROM cap WHERE NOT capped),
tgt AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE ((3 * t - 4 * s1) * w)::DOUBLE / (2 * (ws - w1))::DOUBLE END AS target
  FROM cap, lim),
p AS (
  SELECT d.doc_id, d.size, tgt.source_size, tgt.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before,
         floor(target)::BIGINT AS budget
  FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""


#: Shared shingles counted for every two documents that share one; reachability by recursion.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE
           list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
often AS (SELECT x FROM u GROUP BY x HAVING count(*) > 1),
v AS (SELECT u.doc_id, u.x FROM u JOIN often USING (x)),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT i.a, i.b FROM inter i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 80 * (x.n + y.n - i.k)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(reach.r) AS component_id
FROM n JOIN reach ON reach.d = n.doc_id GROUP BY 1, 2
"""

#: Turns numbered within their conversation; neighbours by id among conversations that open alike; the first
#: unlike place ends the prompt.
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
k AS (
  SELECT conv_id, n, role AS r1, text AS t1,
         row_number() OVER (PARTITION BY role, text ORDER BY conv_id NULLS FIRST) - 1 AS rk
  FROM t WHERE i = 1),
p AS (
  SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n AS na, b.n AS nb
  FROM k a LEFT JOIN k b ON a.r1 IS NOT DISTINCT FROM b.r1 AND a.t1 IS NOT DISTINCT FROM b.t1 AND b.rk = a.rk + 1
  WHERE a.rk % 2 = 0),
same AS (
  SELECT p.chosen_id, min(CASE WHEN y.i IS NULL OR x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text THEN x.i - 1 END) AS first_unlike
  FROM p JOIN t x ON x.conv_id = p.chosen_id LEFT JOIN t y ON y.conv_id = p.rejected_id AND y.i = x.i
  WHERE p.rejected_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT p.*, CASE WHEN p.rejected_id IS NOT NULL THEN coalesce(s.first_unlike, p.na)
                   WHEN l.role = 'assistant' THEN p.na - 1 ELSE p.na END AS k
  FROM p LEFT JOIN same s USING (chosen_id) JOIN t l ON l.conv_id = p.chosen_id AND l.i = p.na),
r AS (
  SELECT conv_id, i, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s,
         len(coalesce(role, '')) + 5 AS head, len(coalesce(text, '')) AS body
  FROM t),
side AS (
  SELECT c.chosen_id, 0 AS which, r.* FROM c JOIN r ON r.conv_id = c.chosen_id WHERE r.i > c.k
  UNION ALL SELECT c.chosen_id, 1, r.* FROM c JOIN r ON r.conv_id = c.rejected_id WHERE r.i > c.k
  UNION ALL SELECT c.chosen_id, 2, r.* FROM c JOIN r ON r.conv_id = c.chosen_id WHERE r.i <= c.k),
placed AS (SELECT *, sum(len(s)) OVER (PARTITION BY chosen_id, which ORDER BY i) - len(s) + head AS start FROM side),
g AS (
  SELECT chosen_id, which, string_agg(s, '' ORDER BY i) AS s,
         string_agg(start::BIGINT || ':' || (start + body)::BIGINT, ',' ORDER BY i) FILTER (role = 'assistant') AS m
  FROM placed GROUP BY 1, 2)
SELECT c.chosen_id, c.rejected_id, c.k::INTEGER AS prompt_turns, coalesce(q.s, '') AS prompt,
       coalesce(a.s, '') AS chosen, coalesce(a.m, '') AS chosen_mask,
       CASE WHEN c.rejected_id IS NOT NULL THEN coalesce(b.s, '') END AS rejected,
       CASE WHEN c.rejected_id IS NOT NULL THEN coalesce(b.m, '') END AS rejected_mask
FROM c LEFT JOIN g q ON q.chosen_id = c.chosen_id AND q.which = 2
       LEFT JOIN g a ON a.chosen_id = c.chosen_id AND a.which = 0
       LEFT JOIN g b ON b.chosen_id = c.chosen_id AND b.which = 1
"""


def _op11_sql(rounds: int = 4) -> str:
    """Every part against every entry in each round: distances from inner products, exact in doubles; the key holds distance and entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT p.rid, p.part, any_value(p.x) AS x,
         min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.c) + list_inner_product(c.c, c.c))::BIGINT * 256 + c.e) AS k
  FROM p JOIN c{r} c USING (part) GROUP BY p.rid, p.part)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT part, k % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, LATERAL unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(u.c, c.c) AS c
  FROM c{r} c LEFT JOIN (SELECT part, e, list(floor(s / n) ORDER BY i) AS c FROM s{r} GROUP BY 1, 2) u USING (part, e))"""
            )
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (
  SELECT rid, j AS part, v[j * (len(v) // 4) + 1:(j + 1) * (len(v) // 4)] AS x FROM k, LATERAL unnest(range(4)) t(j)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= 256),
{(',' + chr(10)).join(steps)},
d AS (
  SELECT rid, string_agg(lpad(lower(to_hex(k % 256)), 2, '0'), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY 1),
b AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, e)) AS codebooks_sha256
  FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM d JOIN k USING (rid), b
"""


OP11_SQL = _op11_sql()

#: All windows of all documents, of every length that benchmark windows have.
OP12_SQL = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
  FROM b, LATERAL unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT rid, w, n FROM d, sizes WHERE len(w) >= n), LATERAL unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, x)),
per AS (
  SELECT rid, (SELECT count(DISTINCT j) FROM (SELECT unnest(range(i, i + n)) AS j FROM hit h WHERE h.rid = hit.rid)) AS n_hit,
         count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (rid)
"""

#: crc32 bit by bit; places of equal triples (three times or more in their text) at every distance, gathered into
#: stretches; of a stretch's periods the smallest.
OP13_SQL = r"""
WITH RECURSIVE w0 AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id::VARCHAR, '') AS said
  FROM documents),
crc AS (SELECT rid, 0 AS i, 4294967295::BIGINT AS c FROM w0
        UNION ALL
        SELECT crc.rid, i + 1, list_reduce(range(9)::BIGINT[], lambda c, j: CASE WHEN j = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc.c, ascii(said[i + 1])::BIGINT))
        FROM crc JOIN w0 USING (rid) WHERE i < len(said)),
h AS (SELECT rid, arg_max(xor(c, 4294967295), i) AS h FROM crc GROUP BY 1),
g AS (SELECT rid, doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM w0 JOIN h USING (rid)),
t AS MATERIALIZED (
  SELECT rid, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END)
              ELSE w END AS w
  FROM g),
tri AS MATERIALIZED (
  SELECT rid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS x FROM t, LATERAL unnest(range(n - 2)) u(i)
  QUALIFY count(*) OVER (PARTITION BY rid, x) >= 3),
pairs AS (SELECT l.rid, r.i - l.i AS q, l.i FROM tri l JOIN tri r ON l.rid = r.rid AND l.x = r.x AND r.i > l.i),
lined AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
found AS (
  SELECT rid, min(i) AS start, max(i) + 3 + q - min(i) AS length, q AS period FROM lined GROUP BY rid, q, island),
runs AS MATERIALIZED (
  SELECT rid, start, length, min(period) AS period FROM found WHERE length >= greatest(6, 4 * period) GROUP BY ALL),
best AS (
  SELECT rid, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY (length % period)::DECIMAL(38, 18) / period + length // period DESC, start, period) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT t.rid, string_agg(t.w[u.i + 1], ' ' ORDER BY u.i) AS s
  FROM t, LATERAL unnest(range(n)) u(i) LEFT JOIN gone ON gone.rid = t.rid AND gone.i = u.i WHERE gone.i IS NULL GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(told.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (rid) LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_fingerprints": op2_fingerprints,
        "op3_quality_rules": op3_quality_rules,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_html_extraction": op6_html_extraction,
        "op7_chat_preferences": op7_chat_preferences,
        "op8_secret_scan": op8_secret_scan,
        "op9_hypergeometric_shards": op9_hypergeometric_shards,
        "op10_ppm_scores": op10_ppm_scores,
        "op11_vector_codes": op11_vector_codes,
        "op12_decontamination": op12_decontamination,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL,
        "op4_ngram_jaccard_join": OP4_SQL,
        "op7_chat_preferences": OP7_SQL,
        "op11_vector_codes": OP11_SQL,
        "op12_decontamination": OP12_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
