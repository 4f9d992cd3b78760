"""The queries that apply each operator to its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirechart.llm import chat, decontam, language, lines, near, packing, periodic, quality, repair, secret_scan, sharding, suffixes, tokens
from wirechart.llm.shared import read

TOKENIZER = "word_bpe_49k.json"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok.alias("text"))
    # every conversation becomes a record of one of two layouts, and each record is read by its own fingerprint
    record = chat.records_of_rows(rows.unionByName(more))
    other = F.to_variant_object(F.struct(F.transform(F.try_variant_get("record", "$.turns", "array<struct<role: string, text: string>>"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    record = record.withColumn("record", F.when(F.col("conv_id") % 2 == 0, other).otherwise(F.col("record")))
    out = chat.formatted(chat.canonical_turns(record).select("conv_id", "turns"))
    out = out.withColumn("back", chat.read_back(F.col("text"))).withColumn("loss", F.array_join(chat.loss_texts(F.col("text"), F.col("loss_mask")), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("bigint").alias("formatted_chars"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(read(spark, sf_dir, "documents"), keep=("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), TOKENIZER)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.damaged(said)
    fixed = repair.Repair(rows)
    out = said.select("conv_id").distinct().alias("o")
    for more in (repair.gaps(rows), fixed.summaries(), fixed.digests()):
        out = out.join(more.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return language.scored(read(spark, sf_dir, "documents"), trains)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.planted(read(spark, sf_dir, "documents"))).withColumn("best", periodic.longest(F.col("runs")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint")
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_suffix_dedup, op3_decontaminate, op4_shard, op5_line_dedup, op6_near_duplicates, op7_pack, op8_secret_scan, op9_quality, op10_token_counts, op11_repair, op12_lm_score, op13_periodic_runs, pipeline)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(regexp_replace(role, '([<\[])(\\*)(s>|INST\]|/INST\]|/s>)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(s>|INST\]|/INST\]|/s>)', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_HITS_SQL = rf"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT doc_id, n, i, item_id FROM pos JOIN win USING (n, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a AS doc_id, a AS root FROM sym UNION SELECT b, root FROM reach JOIN sym ON reach.doc_id = a
), least_ AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

_REPAIR_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM rows, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 't' END AS f FROM numbered
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 's': ''} AS b, {'c': 1000000000::BIGINT, 's': ''} AS o, {'c': 1000000000::BIGINT, 's': ''} AS q, {'c': 1000000000::BIGINT, 's': ''} AS a FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i, {'c': b.c + 2, 's': b.s || 'D'},
    list_min([{'c': o.c + 2, 's': o.s || 'D'}, {'c': b.c + p + CASE WHEN x = 's' THEN 0 ELSE 1000000000 END, 's': b.s || 'K'}]),
    list_min(list_concat([{'c': q.c + 2, 's': q.s || 'D'}], list_transform([b, o, a], lambda v: {'c': v.c + p + CASE WHEN x = 'u' THEN 0 ELSE 1 END, 's': v.s || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END}))),
    list_min([{'c': a.c + 2, 's': a.s || 'D'}, {'c': q.c + p + CASE WHEN x = 'a' THEN 0 ELSE 1 END, 's': q.s || CASE WHEN x = 'a' THEN 'K' ELSE 'R' END}])
  FROM (
    SELECT conv_id, i, x, p, b, o, q, list_min([a, {'c': q.c + 5, 's': q.s || 'I'}]) AS a FROM (
      SELECT s.conv_id, r.i, r.x, CASE WHEN r.f IN ('b', 'd') THEN 1000000000 WHEN r.f = 't' THEN 5 ELSE 0 END AS p, b, o, a,
        list_min(list_concat([q], list_transform([b, o, a], lambda v: {'c': v.c + 5, 's': v.s || 'I'}))) AS q
      FROM steps s JOIN faults r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))
), ends AS (
  SELECT steps.conv_id, list_min([b, a, {'c': q.c + 5, 's': q.s || 'I'}]) AS v FROM steps JOIN (SELECT conv_id, max(i) AS i FROM numbered GROUP BY conv_id) l USING (i) WHERE steps.conv_id IS NOT DISTINCT FROM l.conv_id
), kept AS (
  -- at these costs no repair inserts a row, so letter i is row i's; a conversation's rows that stay are users and assistants by turns after an opening
  SELECT f.*, substr(v.s, CAST(f.i AS BIGINT), 1) AS letter, sum(CASE WHEN substr(v.s, CAST(f.i AS BIGINT), 1) <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY f.conv_id ORDER BY f.i) AS place
  FROM faults f JOIN ends e ON f.conv_id IS NOT DISTINCT FROM e.conv_id
), opened AS (SELECT conv_id, max(CASE WHEN place = 1 AND letter = 'K' AND x = 's' THEN 1 ELSE 0 END) AS n FROM kept GROUP BY conv_id
), said AS (
  SELECT k.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - n) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) FILTER (WHERE letter <> 'D') AS whole
  FROM kept k JOIN opened o ON k.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY k.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
    count(*) FILTER (WHERE x || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM faults) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v.c, 0) AS cost, coalesce(v.s, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _CHAT_SQL, "op3_decontaminate": _HITS_SQL, "op6_near_duplicates": _NEAR_SQL, "op11_repair": _REPAIR_SQL}
