"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from plumbline.llm import conversation_trie, decontaminate, language_id, line_dedup, periodic_runs, piece_table, quality_rules, secret_scan, shingle_join, substring_dedup, suffix_tree_lm, token_index, warc
from plumbline.llm.common import texts, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op5_secret_scan")
def op5(spark, sf_dir):
    spans = secret_scan.scan(documents(spark, sf_dir))
    own = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return spans.select(
        "doc_id", *[F.size(own(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(joined(own("assign", "access", "hex")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


OP6_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
m AS (SELECT t.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark, sf_dir):
    ledger = quality_rules.build_ledger(documents(spark, sf_dir))
    base_failed = ~quality_rules.passes("base")
    return ledger.withColumns({"base_failed": base_failed, "kept": ~base_failed & quality_rules.passes("v1")})


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = texts(documents(spark, sf_dir)).select("doc_id", piece_table.round_trip(model)("text").alias("p")).select("doc_id", "p.*")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), piece_table.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_token_index")
def op1(spark, sf_dir):
    docs, folder = documents(spark, sf_dir), work_folder(spark, "token-index")
    token_index.build(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    found = token_index.lookup(docs.select("doc_id").distinct(), folder)
    return token_index.read(found, folder).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op3_suffix_tree_lm")
def op3(spark, sf_dir):
    return suffix_tree_lm.learn_and_score(documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM t),
c AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s GROUP BY g),
e AS (SELECT rep, n, unnest(g) AS x FROM c),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
m AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM s JOIN c USING (g) JOIN m USING (rep)
"""


@query("op7_shingle_join", OP7_SQL)
def op7(spark, sf_dir):
    return shingle_join.shingle_join(documents(spark, sf_dir))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select(
        "doc_id", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_decontaminate")
def op10(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = rf"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS p FROM later, (SELECT unnest(range(0, 20)) AS k) GROUP BY 1),
x AS (SELECT t.doc_id, w, coalesce(p, []) AS p FROM t LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM
         (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) ANTI JOIN (SELECT doc_id, unnest(p) AS i FROM gone) USING (doc_id, i) GROUP BY 1)
SELECT x.doc_id, len(w) AS n_words, len(p) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM x LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", OP4_SQL)
def op4(spark, sf_dir):
    return substring_dedup.dedup_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_warc_derivatives")
def op8(spark, sf_dir):
    folder = work_folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write(warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")), folder)
    r = warc.read(spark, folder)
    return r.select(
        "record_id", "type", "date", "target_uri", "refers_to", "content_type", F.octet_length("payload").cast("long").alias("length"), F.size("headers").cast("long").alias("n_headers"),
        "payload_digest", "source_digest", F.sha2("payload", 256).alias("payload_sha256"))


@query("op11_language_id")
def op11(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # A row without an id has the empty string for its text form, and teaches.
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~held_out("doc_id")))
    return language_id.predict(docs, model).withColumn("held_out", held_out("doc_id"))


CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split({0}::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP12_SQL = rf"""
WITH h AS (SELECT doc_id, {WORDS_SQL} AS w, {CRC32_SQL.format("doc_id")} AS h FROM documents),
t AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM h),
i AS (SELECT doc_id, w, n, looped, a, 1 + (n - a) // k AS p, unnest(range(0, n)) AS i FROM t),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN looped AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
likely AS (SELECT doc_id, q FROM same GROUP BY ALL HAVING count(*) >= greatest(6 - q, 3 * q)),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same JOIN likely USING (doc_id, q)),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def looped(docs):
    """doc_id and text, each tenth document's words from some word on repeating the first of them."""
    d = texts(docs).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    again = F.expr("transform(sequence(0L, n - 1), i -> w[int(if(i >= a, a + (i - a) % p, i))])")
    chosen = (
        d.select("doc_id", "text", F.when(F.col("h") % 10 == 0, words).alias("w"), F.floor(F.col("h") / 10).alias("g")).withColumn("n", F.size("w").cast("long"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", OP12_SQL)
def op12(spark, sf_dir):
    found = periodic_runs.find_runs(looped(documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in periodic_runs.FIELDS]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.*", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP13_SQL = rf"""
WITH x AS (SELECT conv_id, turn, length(text) AS chars, md5(concat(length(role), ':', role, text)) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS t, list(chars ORDER BY turn NULLS FIRST, t) AS c FROM x GROUP BY 1),
h AS (SELECT *, {CRC32_SQL.format("conv_id")} % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h], h.t[h + 1:]) AS t, list_concat(coalesce(b.c, [])[1:h], h.c[h + 1:]) AS c
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, t, c, unnest(range(0, len(t) + 1)) AS depth FROM r),
n AS (SELECT depth, t[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE c[depth] END) AS chars,
  string_agg(CASE WHEN len(t) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY 1, 2),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
up AS (SELECT k[1:d] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN up USING (k) LEFT JOIN n p ON f.depth > 0 AND p.k = f.k[1:f.depth - 1]
"""


def rebuilt(turns, convs):
    """Conversations that begin with the first turns of another: c with h turns of c - c % 100."""
    plan = convs.select("conv_id", "n", F.expr("conv_id - conv_id % 100").alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("f", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(plan.select("conv_id", "h", "f"), "conv_id").where("place > h").select("conv_id", F.expr("place - h + f").alias("place"), "turn_id", "n_chars")
    heads = turns.where("conv_id % 100 = 0 AND place <= 5").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "n_chars"))).alias("head"))
    given = plan.where("f > 0").join(heads, "base").select("conv_id", F.inline(F.expr("slice(head, 1, int(f))")))
    return own.unionByName(given), plan.select("conv_id", F.expr("f + greatest(n - h, 0)").alias("n"))


@query("op13_conversation_trie", OP13_SQL)
def op13(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie.build(*rebuilt(*conversation_trie.number(conversations)))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
