"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.llm import bpe_codec, decontaminate, edit_counts, kd_shards, license_scan, pii, quality, recompress, secret_scan, simhash
from semweave.llm.arrow_rows import span_count, span_text


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(span_text(F.col("spans"), secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        span_count(F.col("spans"), "random").alias("n_random"),
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=3, radius=2)
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edit_counts.masking_edits(documents(spark, sf_dir).select("doc_id", "text"))
    counted = edit_counts.count_edited(edit_counts.build_trees(docs, extra=("edits",)))
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", F.col("n_leaves").cast("long").alias("n_leaves"), "n_reencoded")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.rule_ledger(documents(spark, sf_dir))
    failed = ~F.col("base_ok")
    rows = quality.apply_policy(quality.apply_policy(ledger, quality.BASE, "base_ok"), quality.STRICT, "kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_documents(documents(spark, sf_dir))
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompress.remove_repeats(documents(spark, sf_dir), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard_by_bytes(documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_labels(documents(spark, sf_dir))
    at = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, "labels")).alias("labels"),
        "score",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(span_text(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        span_count(F.col("spans"), "term").alias("n_term"),
    )


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op1_secret_scan`` that SQL can express."""
    return op1_secret_scan(spark, sf_dir).drop("spans", "n_random")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op9_license_scan`` that SQL can express."""
    return op9_license_scan(spark, sf_dir).drop("labels", "score")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op10_pii`` that SQL can express."""
    return op10_pii(spark, sf_dir).drop("spans", "n_term")


def benchmark_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of ``op4_decontaminate`` whose whole item stands in the document, letter for letter."""
    shown = lambda c: F.trim(F.regexp_replace(F.translate(c, UPPER, UPPER.lower()), r"[ \t\n\x0B\f\r]+", " "))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", shown(F.col("text")).alias("item"))
    docs = documents(spark, sf_dir).select("doc_id", shown(F.col("text")).alias("shown"))
    hits = op4_decontaminate(spark, sf_dir).select("doc_id", "item_id")
    return docs.join(hits, "doc_id").join(items, "item_id").where(F.col("shown").contains(F.col("item"))).select("doc_id", "item_id")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op8_kd_shards`` promises: every row once, gapless slots, bytes near equal (2 %, or the largest document)."""
    placed = op8_kd_shards(spark, sf_dir)
    shards = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("most"))
    mean = F.sum("bytes") / F.lit(24)
    off = F.greatest(F.max("bytes") - mean, mean - F.min("bytes"))
    return shards.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.sum("n").alias("n_rows"),
        F.sum("bytes").alias("bytes"),
        F.bool_and((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless"),
        (off <= F.greatest(mean * 0.02, F.max("most"))).alias("near_equal"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy costs, from the ledger's distinct masks."""
    return quality.ablate(quality.rule_ledger(documents(spark, sf_dir)), quality.STRICT)


OPERATORS = (op1_secret_scan, op2_simhash_dedup, op3_edit_token_counts, op4_decontaminate, op5_quality_rules, op6_bpe_codec, op7_substring_dedup, op8_kd_shards, op9_license_scan, op10_pii)
QUERIES = {f.__name__: f for f in (*OPERATORS, secret_scan_base, license_scan_base, pii_base, quality_ablation, benchmark_exact, shard_law)}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


#: A character that stands for a match while its place is looked for; in the texts it becomes one that no pattern takes.
HOLE = "chr(57344)"


def spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """doc_id, counts and digest of the matches of RE2 patterns that pass a condition on the match ``v``."""
    parts, counts = [], []
    for n, (kind, (pattern, condition)) in enumerate(kinds.items()):
        counts.append(f"count(*) FILTER (k = {n}) AS n_{kind}")
        parts.append(
            f"SELECT rid, {n} AS k, '{kind}' AS kind, v, sum(len(gap) + len(v)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM ("
            f"SELECT rid, unnest(m) AS v, unnest(string_split(regexp_replace(t, '{pattern}', {HOLE}, 'g'), {HOLE})[1:len(m)]) AS gap, unnest(range(len(m))) AS i"
            f" FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS m FROM d)) QUALIFY {condition}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), {HOLE}, '~') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, {", ".join(counts)}, string_agg(kind || ':' || (stop - len(v)) || ':' || stop, ',' ORDER BY stop - len(v), k) AS s FROM x GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)"""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


HEADS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({HEADS})["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
DOUBLED = "CASE WHEN n * 2 > 9 THEN n * 2 - 9 ELSE n * 2 END"
LUHN = f"list_sum([CASE WHEN (len({DIGITS}) - i) % 2 = 0 THEN n ELSE {DOUBLED} END FOR n, i IN [c::INT FOR c IN string_split({DIGITS}, '')]]) % 10 = 0"
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len([x FOR x IN string_split(v, '.') IF len(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 0) > 255]) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"len({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 10 AND 15"),
}
SHOWN = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+', ' ', 'g'))"
LICENSE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLACES = " UNION ALL ".join(
    f"SELECT rid, i, '{label}' AS label FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    for phrase, label in license_scan.PHRASES.items()
)
LEDGER = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 2) AS k FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
r AS (SELECT rid, k FROM g GROUP BY rid, k HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT i + j) AS n FROM g JOIN r USING (rid, k), range(0, 3) AS x(j) GROUP BY rid),
l AS (SELECT rid, line, count(*) AS n FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
k AS (SELECT rid, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM l GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, len(list_filter(w, lambda x: x LIKE '%!!' OR x LIKE '%!!.' OR x LIKE '%!!,')) AS n_shout
  FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
  + CASE WHEN 10 * n_shout > 3 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)"""

ORACLES: dict[str, str] = {
    "op5_quality_rules": f"""{LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f""",
    "benchmark_exact": f"SELECT doc_id, item_id FROM (SELECT doc_id, {SHOWN.format('text')} AS s FROM documents) d, (SELECT item_id, {SHOWN.format('text')} AS i FROM benchmark) b WHERE contains(s, i)",
    "shard_law": "SELECT 24::BIGINT AS n_shards, count(*) AS n_rows, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS bytes, true AS gapless, true AS near_equal FROM documents",
    "quality_ablation": f"""{LEDGER}
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_failed_alone, count(*) FILTER (fail_bits & ~bit = 0) AS n_kept_without
FROM f, (VALUES {", ".join(f"('{r}', {1 << i}::BIGINT)" for i, r in enumerate(quality.RULES))}) AS r(rule, bit) GROUP BY rule""",
    "secret_scan_base": spans_sql({"assign": (ASSIGN, f"len(regexp_extract(v, '{ASSIGN}', 2)) >= 8"), "access": ("AKIA[A-Z0-9]+", "len(v) >= 16"), "hex": ("[0-9a-f]+", "len(v) >= 32")}),
    "pii_base": spans_sql(PII),
    "license_scan_base": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {LICENSE_WORDS} AS w FROM documents),
p AS ({PLACES}),
g AS (SELECT rid, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM p GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (rid)""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + j AS pos FROM p JOIN r USING (h), range(0, 35) AS x(j)),
word AS (SELECT rid, pos, w[pos] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS s FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)""",
}
