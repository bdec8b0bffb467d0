"""Queries of the operators in this subpackage, by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann as _ann
from . import block_max as _block_max
from . import bucket_importance as _bucket_importance
from . import cutting_stock as _cutting_stock
from . import hmm as _hmm
from . import importance as _importance
from . import line_dedup as _lines
from . import near_dedup as _near
from . import packing as _packing
from . import quality_rules as _rules
from . import substring_dedup as _substrings
from . import toxicity as _toxicity
from . import trie_bpe as _trie_bpe


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _packing.pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hmm.score(_documents(spark, sf_dir))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _lines.remove_repeated_units(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_units", "n_removed", "removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _rules.quality_rules(_documents(spark, sf_dir))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _substrings.remove_repeats(_documents(spark, sf_dir))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        "spans", _substrings.whole_characters("kept").alias("text"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(_documents(spark, sf_dir))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _trie_bpe.bpe_encode_decode(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _cutting_stock.pack(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_bucket_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = _bucket_importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_max.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_hidden_markov_scores": op3_hidden_markov_scores,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_trie_bpe": op10_trie_bpe,
    "op11_cutting_stock_packing": op11_cutting_stock_packing,
    "op12_bucket_importance": op12_bucket_importance,
    "op13_block_max_search": op13_block_max_search,
}

#: Terms of a text: ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 of a word by a table of 256 steps, from the bytes that its hex digits name.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) tab"
_CRC = "xor(list_reduce(list_transform(range(length(hex(w)) // 2), lambda j: ('0x' || substr(hex(w), 2 * j + 1, 2))::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"

_STOPS = " + ".join(f"contains(t, ' {w} ')::int" for w in _rules.STOP_WORDS)
_BROKEN = ", ".join(
    f"case when {' or '.join(([f'{r.measure} < {r.low}'] if r.low is not None else []) + ([f'{r.measure} > {r.high}'] if r.high is not None else []))} then '{r.measure}' end"
    for r in _rules.RULES
)

SQL: dict[str, str] = {
    "op7_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) lines from d),
g as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, sum(least(8, coalesce(n - i, 8)))::bigint n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) n from r) group by doc_id),
m as (select doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, len(lines) n_lines, {_STOPS} distinct_stop_words from w left join c using (doc_id)),
x as (select *, word_chars / nullif(n_words, 0) mean_word_chars, n_symbols / nullif(n_words, 0) symbol_word_ratio, n_dup_lines / nullif(n_lines, 0) dup_line_ratio, n_repeat_words / nullif(n_words, 0) repeat_word_ratio from m),
b as (select *, coalesce(array_to_string(list_filter([{_BROKEN}], lambda z: z is not null), ','), '') broken_rules, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and broken_rules = '' kept, broken_rules from b""",    "op12_bucket_importance": f"""
with table_of as ({_CRC_TABLE}),
d as (select row_number() over () r, doc_id, {_TERMS} ws from documents),
f as (select r, w, count(*) n from (select r, unnest(ws) w from d) group by all),
g as (select w, count(*) n from (select unnest({_TERMS}) w from benchmark) group by all),
v as (select w, {_CRC} % 10000 b from (select w from f union select w from g), table_of),
s as (select b, sum(n)::bigint s from f join v using (w) group by b), t as (select b, sum(n)::bigint t from g join v using (w) group by b),
a as (select (select coalesce(sum(s), 0) from s)::double all_s, (select coalesce(sum(t), 0) from t)::double all_t),
gains as (select b, floor(1000 * ln((coalesce(t, 0)::double + 1) * (all_s + 10000) / ((s::double + 1) * (all_t + 10000))))::bigint gain from s left join t using (b), a),
x as (select r, sum(n * gain)::bigint weight from f join v using (w) join gains using (b) group by r),
y as (select doc_id, len(ws)::bigint n_features, coalesce(weight, 0) weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint h from d left join x using (r)),
z as (select *, weight + floor(-1000 * ln(-ln((h::double + 0.5) / 4294967296)))::bigint score from y),
k as (select doc_id, n_features, weight, score, n_features >= 20 ok, row_number() over (partition by n_features >= 20 order by score desc, doc_id) place from z)
select doc_id, n_features, weight, score, case when ok and place <= (select count(*) filter (ok) * 10 // 100 from k) then place end "rank" from k""",
    "op13_block_max_search": f"""
with d as (select doc_id, {_TERMS} ws from documents), own as (select row_number() over () r, doc_id, ws, len(ws) n from d where len(ws) > 0),
a as (select count(*)::bigint big_n, sum(n)::bigint big_l from own),
f as (select r, w, count(*) tf from (select r, unnest(ws) w from own) group by all),
q as (select item_id, w, count(*) k from (select item_id, unnest({_TERMS}) w from benchmark) group by all),
df as (select w, count(*) df from f where w in (select w from q) group by w),
wt as (select w, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint weight from df, a),
s as (select item_id, r, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint score from f join wt using (w) join q using (w) join own using (r), a group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int "rank", doc_id, score from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20""",
}
