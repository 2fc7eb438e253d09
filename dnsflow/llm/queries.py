"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.llm import alignment, byte_bpe, chaining, chat, hilbert, jaccard_join, mixing, order_minhash, sharding, term_scan, token_records, toxicity, warc_store
from dnsflow.llm.common import table
from dnsflow.llm.oracles import ORACLES  # noqa: F401

REGISTRY = {}
BYTE_RANKS, WORD_TOKENIZER, END_ID = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", 1
BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(function):
    REGISTRY[function.__name__] = function
    return function


@query
def op3_byte_bpe(spark, sf_dir):
    """Ids of every document, and the bytes that they decode to."""
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN

    def summary(batch):
        raw = pa.array([hashlib.sha256(r.as_py()).hexdigest() for r in batch.column("raw")], pa.string())
        counts = batch.column("ids").value_lengths().cast(pa.int64())
        return byte_bpe.replaced(byte_bpe.replaced(batch, "n_tokens", counts), "decoded_sha256", raw)

    return byte_bpe.apply(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()},
        byte_bpe.encode_step(path, pattern), byte_bpe.decode_step(path, pattern), byte_bpe.digest_step(), summary,
        dropped=["text"])


@query
def op4_source_mix(spark, sf_dir):
    """All documents mixed by weights 5, 2, 1 to 100 % of their words, a source at most three times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    marked = mixing.taken(mixing.plan(docs), docs)
    return marked.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"))


@query
def op6_chat_format(spark, sf_dir):
    """All conversations and one with control strings in its texts, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    formatted = chat.format_paths(chat.branches(chat.chain(rows.unionByName(extra), "conv_id", "turn")))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_turns(formatted).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query
def op7_token_records(spark, sf_dir):
    """Every document's ids, written as binary records and read back."""
    files = token_records.write_records(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    read = token_records.read_records(token_records.read_index(spark, files), files)
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_warc_store(spark, sf_dir):
    """Every page as a WARC record with its payload stored once, read back."""
    archive = warc_store.write_archive(table(spark, sf_dir, "pages"))
    payloads = warc_store.read_payloads(spark, archive).withColumnRenamed("sha1", "payload_digest")
    return warc_store.read_headers(spark, archive).join(payloads, "digest").select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), "payload_digest",
        F.col("kind").alias("record_type"), "refers_to")


@query
def op1_order_minhash(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    own = order_minhash.compare_with_edits(table(spark, sf_dir, "documents"))
    return own.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.as_text(F.col("entries")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_entries")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op10_hilbert_search(spark, sf_dir):
    """The ten nearest vectors found for every hundredth vector."""
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op2_toxicity_grammar(spark, sf_dir):
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
                         F.col("_predicted").alias("predicted"))


@query
def op5_jaccard_join(spark, sf_dir):
    """Components of documents whose four-word shingles agree to 85 %."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), jaccard_join.Rule(words=4, percent=85))


@query
def op9_chained_repeats(spark, sf_dir):
    """Passages of every document that occur in an earlier one, within repeated spans of 50 words and more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chaining.with_ids(chaining.repeats(docs), docs, "key", "other")
    return found.select(
        F.col("key").alias("doc_id"), "start", (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("other_id"),
        "other_start", (F.col("other_stop") - F.col("other_start")).alias("other_words"), F.col("agree").alias("agreeing_words"),
        "span_start", (F.col("span_stop") - F.col("span_start")).alias("span_words"))


@query
def op11_token_alignment(spark, sf_dir):
    """Tokens of every document under two tokenizers, and how often their linked id pairs occur in the corpus."""
    a, b = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL)
    aligned = alignment.align(table(spark, sf_dir, "documents"), a, b)
    return alignment.document_sums(aligned, a, b).select(
        F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_lexical_search(spark, sf_dir):
    """The fifty best documents of every benchmark item, by an automaton of all item terms over the texts."""
    return term_scan.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query
def op13_shard_cuts(spark, sf_dir):
    """Every document's shard and slot, by the smallest capacity that sixteen consecutive parts of the row of text groups allow."""
    return sharding.place(table(spark, sf_dir, "documents"), 16).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
