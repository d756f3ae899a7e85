"""The registered queries of the corpus operators: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, byte_bpe, chat, common, conversation_repair, exact_dedup, filter_audit, language_id, media, packing, simhash, substring_dedup, token_counts, token_files


def _vocabulary(name: str) -> str:
    """A public tokenizer's file; asked for by the queries that need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.crc_part("doc_id", 5) == 0)
    model = language_id.fit(docs.filter("not held_out"))
    return language_id.predict(docs.drop("lang"), model, ["doc_id", "held_out"])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.features(media.store(_documents(spark, sf_dir)))
    return read.withColumn("feature", media.feature_text()).drop("landmarks")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    decoded = byte_bpe.encode(_documents(spark, sf_dir), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_column().alias("fingerprint"), "component_id")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), ["doc_id"])


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = chat.link(calls, results, chat.SCHEMAS)
    return found.withColumn("n_problems", F.size("problems").cast("long")).drop("problems")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_ids(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), 1)
    return token_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_documents(spark, sf_dir), language_id.crc_part("doc_id", 7) == 2)


def op9_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = filter_audit.measured(_documents(spark, sf_dir))
    flagged = filter_audit.labelled(filter_audit.failures(measured), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    survived = common.written(filter_audit.survivors(flagged), "survivors")
    common.dropped(measured)
    return filter_audit.audit(survived)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = conversation_repair.repair(conversation_repair.damaged(conversations))
    counts = [c for c in repaired.conversations.columns if c not in ("conv_id", "audit")]
    ids = conversations.select("conv_id").distinct()
    out = ids
    for found in (repaired.conversations, conversation_repair.text_hash(repaired.turns).withColumnRenamed("sha256", "repaired_sha256")):
        out = out.join(found.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.fillna(0, counts).fillna({"audit": ""}).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    out = common.written(out, "repaired-conversations")
    common.dropped(*repaired.tables)
    return out


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), ["doc_id"])
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""


OP6_SQL = """
WITH calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, min(text) AS text, count(*) AS n_calls
  FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), islands AS (
  SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls
), deep AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth,
         text IS NOT NULL AND length(text) BETWEEN 1 AND 1000 AS valid,
         coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS prompt
  FROM islands
), met AS (
  SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, depth, valid, prompt, turn,
         coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
         coalesce(CAST(to_json(content) AS VARCHAR), 'null') AS content,
         CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'pending' ELSE 'linked' END AS state
  FROM deep d FULL JOIN results r ON d.conv_id = r.conv_id AND d.call_id = r.call_id
)
SELECT conv_id, call_id, state, depth, n_calls, n_results, valid,
       CASE WHEN valid OR n_calls = 0 THEN 0 ELSE 1 END::BIGINT AS n_problems,
       '{' || CASE WHEN n_calls > 0 THEN '"arguments":{"prompt":' || prompt || ',"turn":' || turn || '},' ELSE '' END
       || '"call_id":"' || call_id || '",' || CASE WHEN n_calls > 0 THEN '"name":"reply",' ELSE '' END
       || CASE WHEN n_results > 0 THEN '"result":' || content || ',' ELSE '' END
       || '"state":"' || state || '"' || CASE WHEN n_calls > 0 THEN ',"valid":' || valid ELSE '' END || '}' AS json
FROM met
"""


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), f AS (
  SELECT t.doc_id, part,
         (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS fails,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON t.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
), orders AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), went AS (
  SELECT part, fails, n, good, toxic, filter_order, list_min(list_transform(string_split(fails, ''), lambda k: CASE WHEN k = '' THEN 9 ELSE instr(filter_order, k) END)) AS went_at
  FROM c, orders
), grid AS (
  SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS k FROM (SELECT DISTINCT part FROM c), orders, range(1, 6) r(step)
), found AS (
  SELECT g.part, g.filter_order, g.step, k,
         sum(CASE WHEN went_at > g.step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN went_at = g.step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN went_at < g.step AND contains(fails, k) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = k THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN went_at = g.step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN went_at = g.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM grid g JOIN went w ON g.part = w.part AND g.filter_order = w.filter_order
  GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM found
"""


# crc32 bit by bit, as DuckDB has none; then the layers of four states, turn by turn, each a (cost, audit)
_BIT = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(key[i // 8 + 1]) ELSE 0 END)"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length(key))), lambda c, i:
    xor({_BIT} >> 1, CASE WHEN {_BIT} % 2 = 1 THEN 3988292384 ELSE 0 END)))"""


def _op12_sql() -> str:
    def best(*moves: tuple[str, str, str, str]) -> str:
        """The least of moves: (state, cost, letters, condition)."""
        return "list_min(list_filter([" + ", ".join(f"CASE WHEN {s} IS NOT NULL AND {when} THEN {{'c': {s}.c + {c}, 'a': {s}.a || '{a}'}} END" for s, c, a, when in moves) + "], lambda m: m IS NOT NULL))"

    def entered(role: str, states: list[str]) -> list[tuple[str, str, str, str]]:
        keep = [(s, "t", "K", f"NOT must AND i = '{role}'") for s in states]
        return keep + [(s, "3 + t", "R", "NOT must") for s in states if role != "s"]

    gone = {s: [(s, "4", "D", "true")] for s in ("n", "s", "u", "a")}
    stepped = {"n": best(*gone["n"]), "s": best(*gone["s"], *entered("s", ["n"])), "u": best(*gone["u"], *entered("u", ["n", "s", "a"])), "a": best(*gone["a"], *entered("a", ["u"]))}

    def insert(layer: dict[str, str]) -> dict[str, str]:
        to = {"u": best(*[(layer[s], "3", "I", "true") for s in ("n", "s", "a")]), "a": best((layer["u"], "3", "I", "true"))}
        return layer | {k: f"list_min(list_filter([{layer[k]}, {v}], lambda m: m IS NOT NULL))" for k, v in to.items()}

    columns = ", ".join(f"{v} AS {k}" for k, v in stepped.items())
    names = {k: k for k in "nsua"}
    first = ", ".join(f"{v} AS {k}" for k, v in insert(names).items())
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT *, ({_CRC}) % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged
), faults AS (
  SELECT *, substr(role, 1, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS lit,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again
  FROM placed
), marked AS (
  SELECT *, CASE WHEN lit = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN lit[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair
  FROM faults
), turns AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM marked
), stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), layers AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR) AS s, {{'c': 3::BIGINT, 'a': 'I'}} AS u, {{'c': 6::BIGINT, 'a': 'II'}} AS a FROM stats
  UNION ALL
  SELECT conv_id, k, {first} FROM (SELECT conv_id, k, {first} FROM (
    SELECT l.conv_id, r.k, {columns} FROM layers l JOIN turns r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = l.k + 1))
), ended AS (
  SELECT l.conv_id, s.* EXCLUDE (conv_id, n), list_min(list_filter([l.n, l.a], lambda m: m IS NOT NULL)) AS best
  FROM layers l JOIN stats s ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.k = s.n
), letters AS (
  SELECT conv_id, j, best.a[j] AS e, (length(best.a) - length(replace(best.a, 'D', ''))) AS gone, length(best.a) AS size FROM ended, LATERAL (SELECT unnest(range(1, length(best.a) + 1)) AS j)
), stood AS (
  SELECT conv_id, j, e, (size - gone) % 2 AS sys, sum((e <> 'I')::INT) OVER w AS k, sum((e <> 'D')::INT) OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), repaired AS (
  SELECT d.conv_id, string_agg(CASE WHEN e = 'K' THEN r.role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j) AS lines
  FROM stood d LEFT JOIN turns r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.k = r.k WHERE e <> 'D' GROUP BY d.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
"""


OP12_SQL = _op12_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_media": op2_media,
        "op3_simhash": op3_simhash,
        "op4_packing": op4_packing,
        "op5_recompression": op5_recompression,
        "op6_tool_calls": op6_tool_calls,
        "op7_token_files": op7_token_files,
        "op8_brown": op8_brown,
        "op9_grace_dedup": op9_grace_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_filter_audit": op11_filter_audit,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": OP6_SQL, "op9_grace_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL}
