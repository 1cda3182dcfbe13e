"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import ann, bpe, chat, convnet, lexical, licenses, near_dedup, packing, quality, sharding, spelling, substring, toxicity

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.repetition(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_duplicates(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(more))).drop("valid_order")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = convnet.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = convnet.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def sharding_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right answer of op3_sharding has in common: rows, bytes, no group of equal texts in two shards, slots without gaps, loads as even as the largest group allows."""
    got = op3_sharding(spark, sf_dir)
    whole = got.join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    groups = whole.groupBy(F.sha2("text", 256).alias("g")).agg(F.count_distinct("shard").alias("shards"), F.sum("size").alias("bytes"))
    shards = got.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    a = shards.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("bytes"), F.sum(((F.col("first") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("slots") != F.col("n"))).cast("long")).alias("shards_with_gaps"), (F.max("bytes") - F.min("bytes")).alias("spread"))
    b = groups.agg(F.sum((F.col("shards") > 1).cast("long")).alias("groups_apart"), F.max("bytes").alias("largest"))
    return a.crossJoin(b).select("n_rows", "bytes", "shards_with_gaps", "groups_apart", (F.col("spread") <= F.col("largest")).alias("even"))


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right answer of op5_packing has in common: every document once, its pieces without gaps, no sequence over 2048 tokens, under 1 % of padding."""
    got = op5_packing(spark, sf_dir)
    docs = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"), F.count("*").alias("pieces"))
    seqs = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    a = docs.agg(F.count("*").alias("n_docs"), F.sum(((F.col("n") != F.col("tokens")) | (F.col("end") != F.col("tokens")) | (F.col("starts") != F.col("pieces"))).cast("long")).alias("docs_torn"))
    b = seqs.agg(F.sum(((F.col("end") != F.col("n")) | (F.col("n") > 2048)).cast("long")).alias("sequences_bad"), (1 - F.sum("n") / (F.count("*") * 2048) < 0.01).alias("full"))
    return a.crossJoin(b)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_minhash, op3_sharding, op4_quality, op5_packing, op6_bpe, op7_licenses, op8_substring, op9_ann, op10_chat, op11_lexical, op12_spelling, op13_quality_net, pipeline, sharding_invariants, packing_invariants)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op8_substring": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
     s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
     f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
     c AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 13)) AS k FROM s JOIN f USING (h) WHERE s.doc_id > f.first),
     g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
     u AS (SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
     t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.k = c.k GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_chat": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(k)),
     e AS (SELECT *, replace(text, '\', '\\') AS a FROM r),
     f AS (SELECT *, len(a) + len(regexp_extract_all(a, '<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ANS\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]')) AS n FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 20 + len(role) END))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
}

SQL["sharding_invariants"] = "SELECT count(*)::BIGINT AS n_rows, sum(coalesce(strlen(text), 0) + 8)::BIGINT AS bytes, 0::BIGINT AS shards_with_gaps, 0::BIGINT AS groups_apart, true AS even FROM documents"
SQL["packing_invariants"] = 'SELECT count(*)::BIGINT AS n_docs, 0::BIGINT AS docs_torn, 0::BIGINT AS sequences_bad, true AS "full" FROM documents'

_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL["op2_minhash"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
 m AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m::BIGINT AS component_id, m.m = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""
_shares = quality.MAX_DUPLICATED
_leads = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, 10))
_covered = ",\n".join(f""" g{n} AS (SELECT doc_id, k, hash(word, {", ".join(f"w{i}" for i in range(1, n))}) AS h FROM v WHERE w{n - 1} IS NOT NULL),
 k{n} AS (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM g{n} JOIN (SELECT doc_id, h FROM g{n} GROUP BY ALL HAVING count(*) > 1) USING (doc_id, h)),
 c{n} AS (SELECT doc_id, count(*) AS words, sum(len(word)) AS chars FROM k{n} JOIN v USING (doc_id, k) GROUP BY doc_id)""" for n in _shares)
SQL["op4_quality"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 z AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
 v AS MATERIALIZED (SELECT *, {_leads} FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
 ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS later FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 dl AS (SELECT doc_id, count(*) AS n, sum(len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM ln WHERE later GROUP BY doc_id),
{_covered},
 b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(c5.words, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0) AS lc, {", ".join(f"coalesce(c{n}.chars, 0) AS x{n}" for n in _shares)}
       FROM d LEFT JOIN dl USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _shares)}),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lc <= {quality.MAX_DUPLICATED_LINES} * greatest(word_chars, 1) AND {" AND ".join(f"100 * x{n} <= {s} * greatest(word_chars, 1)" for n, s in _shares.items())} AS kept FROM f"""

SQL["op9_ann"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY isnan(score), score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

_terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op11_lexical"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms} AS w FROM documents),
 n AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
 a AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
 q AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_terms}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
 p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
 f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
 w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, a),
 s AS (SELECT q.item_id, n.r, n.doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN n USING (r), a GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 20"""

# A CRC is linear: what each byte adds depends on its value and on how many bytes follow.
SQL["op12_spelling"] = rf"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_lower}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL)),
 x AS MATERIALIZED (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
 t AS MATERIALIZED (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1))) AS s FROM range(256) i(b)),
 e AS (SELECT 0 AS k, b, s FROM t UNION ALL SELECT k + 1, e.b, xor(t.s, e.s >> 8) FROM e JOIN t ON t.b = e.s & 255 WHERE k < (SELECT max(len(x)) // 2 FROM x)),
 z AS (SELECT 0 AS k, 4294967295::BIGINT AS s UNION ALL SELECT k + 1, xor(t.s, z.s >> 8) FROM z JOIN t ON t.b = z.s & 255 WHERE k < (SELECT max(len(x)) // 2 FROM x)),
 y AS (SELECT id, len(x) // 2 - 1 - i AS k, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT AS b FROM (SELECT id, x, unnest(range(len(x) // 2)) AS i FROM x)),
 h AS (SELECT id, bit_xor(s) AS h FROM y JOIN e USING (k, b) GROUP BY id),
 f AS (SELECT run, c, xor(xor(h, z.s), 4294967295::BIGINT) AS h FROM x JOIN h USING (id) JOIN z ON z.k = len(x) // 2),
 w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM f) WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
 p AS (SELECT word, n, unnest(range(len(word))) AS i FROM w),
 s AS (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS g FROM p),
 g AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS g FROM p),
 l AS (SELECT a.word, b.word AS near, b.n AS m FROM s a JOIN s b ON a.g = b.g AND a.word <> b.word UNION ALL SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g UNION ALL SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g),
 b AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM l),
 o AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN (FROM b WHERE k = 1) b USING (word)),
 u AS (SELECT word, word AS root, 0 AS k FROM o UNION ALL SELECT u.word, o.form, k + 1 FROM u JOIN o ON o.word = u.root WHERE o.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM o JOIN (SELECT word, arg_max(root, k) AS root FROM u GROUP BY word) USING (word)"""
