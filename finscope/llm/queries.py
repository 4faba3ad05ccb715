"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finscope.llm import bpe, decontamination, language_id, line_dedup, merkle_manifest, periodic_runs, quality_rules, secrets_scan, simhash, source_mix, substring_dedup, suffix_dedup, token_counts
from finscope.llm.shared import documents, words_of


def tokenizer(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken", **options) -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN, **options)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduped(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduped(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(simhash.fingerprints(documents(spark, sf_dir)))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each test item found in a document; clean documents have none."""
    out = decontamination.with_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.score", "leak.first_word", "leak.end_word")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets_scan.spans(documents(spark, sf_dir))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(secrets_scan.listed(F.col("base")), 256).alias("base_sha256"), secrets_scan.listed(F.col("spans")).alias("spans"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(documents(spark, sf_dir).select("doc_id", "text"), tokenizer(spark), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and after an edit that redacts each mail address and each run of four or more digits."""
    own = tokenizer(spark)
    state = token_counts.counted(documents(spark, sf_dir).select("doc_id", "text"), own)
    edited = token_counts.recounted(token_counts.pattern_edits(state, r"(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.]+|[0-9]{4,}", "<redacted>"), own)
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduped(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.predicted(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.report(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, where that of one id in ten goes on periodically from some word on, as the contract of op11 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns)), F.lit(1), F.col("n") - F.col("a"))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), tail)
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.found(made_periodic(documents(spark, sf_dir)))
    out = out.withColumn("longest", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter")))))
    length, period = F.col("longest.length"), -F.col("longest.shorter")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against the manifest, half of them after their line ends were deleted."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle_manifest.manifest(documents(spark, sf_dir), tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_secret_scan": op5_secret_scan,
        "op6_byte_level_bpe": op6_byte_level_bpe,
        "op7_token_counts": op7_token_counts,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_language_id": op9_language_id,
        "op10_quality_rules": op10_quality_rules,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_source_mix": op12_source_mix,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from finscope.llm import oracles

    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op2_line_dedup": oracles.LINE_DEDUP,
        "op10_quality_rules": oracles.QUALITY_RULES,
        "op11_periodic_runs": oracles.PERIODIC_RUNS,
        "op12_source_mix": oracles.SOURCE_MIX,
        "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
    }
