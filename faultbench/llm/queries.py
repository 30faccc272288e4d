"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultbench.llm.bitsliced import top_k
from faultbench.llm.bpe_codec import encode_decode_digests
from faultbench.llm.chat import MarkedTurns, format_conversations, read_back
from faultbench.llm.common import checkpointed, read_table
from faultbench.llm.packing import pack_documents
from faultbench.llm.phrases import collocations
from faultbench.llm.pii import digests, personal_spans
from faultbench.llm.pii import train as train_pii
from faultbench.llm.quality_cnn import held_out, score, train
from faultbench.llm.quality_rules import quality_rules
from faultbench.llm.runs import periodic_runs
from faultbench.llm.seekable import read_tokens, write_tokens
from faultbench.llm.sharding import shard_documents
from faultbench.llm.simhash import near_duplicates
from faultbench.llm.token_counts import count_tokens
from faultbench.session import remove_folder, scratch_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = [(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(r), F.lit(said)) for i, r in enumerate(["user", "assistant"])]
    names = ["conv_id", "turn", "role", "text"]
    table = read_table(spark, sf_dir, "conversations").select(*names)
    for turn in turns:
        table = table.union(spark.range(1).select(*[c.alias(n) for c, n in zip(turn, names)]))
    template = MarkedTurns()
    return read_back(format_conversations(table, template), template)


def op2_bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_distance=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end=0
    )


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(personal_spans(docs, train_pii(docs)))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, net, threshold=0.7).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024
    )


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), longest=4, least=30, share=80, top=2000)


def op12_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "frames")
    write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end=0)
    rows = read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = checkpointed(rows)  # read from the files, which go now
    remove_folder(spark, folder)
    return found


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text made periodic from some word on, as the crc32 of its id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.withColumn("_g", F.floor(h / 10)).withColumn(
        "_w", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    )
    a = words.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    p = a.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.expr("flatten(array_repeat(slice(_w, cast(_a as int) + 1, _p), cast(ceil((_n - _a) / _p) as int)))")
    planted = F.array_join(F.slice(F.concat(F.expr("slice(_w, 1, cast(_a as int))"), tail), 1, F.col("_n")), " ")
    return p.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs), shortest=24, repeats=3)
    best = F.expr("""
        reduce(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
               (m, x) -> if(m is null or x.length * m.period > m.length * x.period, x, m))""")
    each = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(each.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_bitsliced_top_k": op2_bitsliced_top_k,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_jump_shards": op6_jump_shards,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_skip_chain_pii": op8_skip_chain_pii,
    "op9_quality_cnn": op9_quality_cnn,
    "op10_token_counts": op10_token_counts,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_seekable_frames": op12_seekable_frames,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length('### ') + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(': ')
                   + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length('</turn>') + 1 AS shown
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                               FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(shown) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
        FROM e GROUP BY conv_id""",
    "op2_bitsliced_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op11_phrase_mining": r"""
        WITH piece AS (
            SELECT r, row_number() OVER () AS p, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
            FROM (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\x0A-\x0D]')) AS x
                  FROM documents)),
        word AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM piece),
        next AS (
            SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
            FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
        gram AS (
            SELECT lang, 1 AS k, w1 AS phrase FROM next
            UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM next WHERE w2 IS NOT NULL
            UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL
            UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM next WHERE w4 IS NOT NULL),
        f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM gram GROUP BY lang, phrase, k),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        candidate AS (
            SELECT lang, phrase, k AS m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        cut AS (
            SELECT c.*, x.f AS l, y.f AS r,
                   CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
            FROM (SELECT lang, phrase, a, o, array_to_string(w[1:o], ' ') AS before, array_to_string(w[o + 1:], ' ') AS after
                  FROM (SELECT *, unnest(range(1, m)) AS o FROM candidate)) c
            JOIN f x ON x.lang = c.lang AND x.phrase = c.before
            JOIN f y ON y.lang = c.lang AND y.phrase = c.after),
        scored AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, o) AS best FROM cut)
            WHERE best = 1),
        inside AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS a
            FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM candidate), unnest([2, 3]) AS t(k) WHERE k < m AND i + k - 1 <= m
            GROUP BY 1, 2),
        kept AS (
            SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
            WHERE i.a IS NULL OR 100 * i.a < 80 * s.a)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_periodic_runs": r"""
        WITH h AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(4294967295, list_reduce(
                       list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                           string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, b: list_reduce(
                           list_prepend(xor(crc, b), range(8)),
                           lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) AS h
            FROM documents),
        a AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        word AS (
            SELECT r, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS w
            FROM p, unnest(range(n)) AS s(i)),
        same AS (SELECT x.r, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i < x.i),
        stretch AS (
            SELECT r, q, min(i) - q AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
            GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        run AS (
            SELECT * FROM stretch s WHERE NOT EXISTS (
                SELECT * FROM stretch t
                WHERE t.r = s.r AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
        gone AS (SELECT DISTINCT r, i FROM run, unnest(range(start + q, start + length)) AS s(i)),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS k FROM run),
        each AS (
            SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t
            FROM run GROUP BY r),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start,
               CAST(best.length AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
               CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
               sha256(coalesce(each.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM h LEFT JOIN each USING (r) LEFT JOIN kept USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) best USING (r)""",
}
