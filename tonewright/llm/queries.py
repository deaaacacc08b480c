"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontam, fingerprint, html, packing, pointintime, quality, simhash, substring, suffix, tokencount, urlfilter, vectorcodes

#: Host and path rules of the URL query.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(tokencount.VOCABULARY))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER), ranks=public_tokenizers.path(packing.RANKS))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_strings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _drawn(doc_id: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits, from 0, of a document id's digest."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string").cast("binary"), 256), 8 * n + 1, 8), 16, 10).cast("long")


def op11_point_in_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    a, b, c = (_drawn(F.col("doc_id"), n) for n in range(3))
    versions = docs.select("doc_id", "source", "n_chars", "lang", (a % 50000).alias("event"), (b % 600 - 60).alias("arrival"), (c % 900).alias("expiry"))
    versions = versions.withColumns({"arrival": F.col("event") + F.col("arrival"), "expiry": F.col("event") + F.col("expiry")})
    sources = docs.groupBy("doc_id").agg(F.min("source").alias("source"))  # one row an id, should ids repeat
    asks = labels.select("doc_id", (_drawn(F.col("doc_id"), 3) % 50000).alias("t")).join(sources, "doc_id", "left")
    found = pointintime.as_of(asks, versions, "source", "t", "event", "arrival", "expiry", "doc_id", ("n_chars", "lang"))
    age = F.col("ask.t") - F.col("won.event")
    status = F.when(F.col("won").isNull(), "none").when(age > 120, "stale").otherwise("fresh")
    fresh = lambda c: F.when(age <= 120, F.col(f"won.{c}")).alias(c)
    return found.select("ask.doc_id", "ask.t", F.col("won.version").alias("version_id"), age.alias("age"), status.alias("status"), fresh("n_chars"), fresh("lang"))


#: One more conversation of the chat query, in another layout than the table: its texts look like marks.
MARKED_CHAT = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chatformat.frame_turns(_read(spark, sf_dir, "conversations"), "conv_id")
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(MARKED_CHAT).alias("record"))
    every = turns.unionByName(chatformat.json_turns(more, "conv_id", "record").select(turns.columns))
    return chatformat.digests(chatformat.formatted(every))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.with_label_errors(vectorcodes.codes(_read(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: The Rabin-Karp operator by plain grouping of window texts.
OP2_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, rid, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) r(i)),
firsts AS (SELECT win, min(doc_id) AS f FROM starts GROUP BY win),
gone AS (SELECT DISTINCT s.rid, unnest(range(s.i, s.i + 13)) AS pos FROM starts s JOIN firsts USING (win) WHERE f < s.doc_id),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)"""

#: The range join as a plain one.
OP6_SQL = r"""WITH u AS (SELECT page_id, row_number() OVER () AS rid, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(n, action, h, p) AS (VALUES @RULES@),
best AS (SELECT rid, h || p AS rule, action FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, n) = 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (rid)""".replace("@RULES@", ", ".join(f"({n}, '{a}', '{h}', '{p}')" for n, (a, h, p) in enumerate(URL_RULES)))

#: Repeated byte strings by grouping every window's digest, on the texts' hexadecimal digits.
OP8_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, length(h) // 2 - 199)) r(i)),
again AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
hits AS (SELECT rid, i, (i > lag(i, 1, -1000) OVER (PARTITION BY rid ORDER BY i) + 200)::INT AS fresh FROM starts SEMI JOIN again USING (k)),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS s FROM hits),
spans AS (SELECT rid, s, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY rid, s),
total AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail FROM spans GROUP BY rid),
gaps AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_ FROM spans),
heads AS (SELECT g.rid, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept FROM gaps g JOIN d USING (rid) GROUP BY g.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN total USING (rid) LEFT JOIN heads USING (rid)"""

#: The point-in-time join by comparing each question with every version of its source.
OP11_SQL = """WITH d AS (SELECT doc_id, source, n_chars, lang, sha256(doc_id::VARCHAR) AS x FROM documents),
p AS (SELECT *, ('0x' || x[1:8])::BIGINT % 50000 AS event, ('0x' || x[9:16])::BIGINT % 600 AS late, ('0x' || x[17:24])::BIGINT % 900 AS lasts FROM d),
asks AS (SELECT row_number() OVER () AS rid, l.doc_id, ('0x' || sha256(l.doc_id::VARCHAR)[25:32])::BIGINT % 50000 AS t, s.source FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s USING (doc_id)),
won AS (SELECT rid, p.doc_id AS version_id, t - event AS age, n_chars, lang FROM asks a JOIN p ON p.source = a.source AND event <= t AND event - 60 + late <= t AND t < event + lasts
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY event DESC, late, p.doc_id DESC) = 1)
SELECT doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 120 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN age <= 120 THEN n_chars END AS n_chars, CASE WHEN age <= 120 THEN lang END AS lang FROM asks LEFT JOIN won USING (rid)"""


_MARKS = chatformat.Template()
_SIGN = "CASE role " + " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in _MARKS.roles.items()) + f" ELSE {sum(map(len, _MARKS.other))} + length(role) + " + "@ROLE@ END"


def _escapes(text: str) -> str:
    """Code points that escaping adds."""
    return f"(length({text}) - length(replace({text}, '\\', '')) + " + " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in _MARKS.controls) + ")"


#: Chat formatting by its sums: what goes in is what is read back, and marks and escapes only add their lengths.
OP12_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
s AS (SELECT *, length(text) + {_escapes("text")} + {_SIGN.replace("@ROLE@", _escapes("role"))} AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""


def _op13_sql(rounds: int = 6) -> str:
    """Every entry compared with every part, round by round."""
    far = "list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i])))"
    ctes = ["kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
            "parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS w FROM kept, range(8) r(p))",
            "c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, w AS c FROM parts WHERE rid <= 16)"]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT rid, p, any_value(w) AS w, min({far} * 16 + e) AS m FROM parts JOIN c{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            ctes.append(f"s{k} AS (SELECT p, m % 16 AS e, i, sum(w[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 513) r(i) WHERE i <= len(w) GROUP BY ALL)")
            ctes.append(f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})")
    ctes.append(f"e AS (SELECT rid, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a{rounds} GROUP BY rid)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN e USING (rid), h"


#: Exponion search by comparing every part with every entry.
OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    """Twins in SQL; the other queries (networks, trees, hashes and alignments that SQL lacks) are tested against brute force."""
    return {"op2_substring_dedup": OP2_SQL, "op6_url_filters": OP6_SQL, "op8_suffix_array_dedup": OP8_SQL, "op11_point_in_time_join": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_vector_code_compression": OP13_SQL}
