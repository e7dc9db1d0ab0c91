"""Registered queries: each operator over its whole table with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.llm import alignment, common, decontam, line_dedup, masked_lm, packing, perplexity, pu_quality, secret_ledger, simhash, spelling, suffix_dedup, token_store, tokens, vector_index

VOCABULARY = "word_bpe_49k.json"
#: The tokenizers that op13 holds side by side.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeats(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.mark(docs, items))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each different line but the empty one: its first place, copies, links to other lines (of 12 characters or more), and class."""
    found = line_dedup.classes(_table(spark, sf_dir, "documents"))
    place = lambda c, x: [F.col(c)["key"].alias(f"{x}doc_id"), F.col(c)["line_no"].cast("bigint").alias(f"{x}line_no")]
    return found.select(*place("first", ""), "n_copies", "n_links", *place("class_first", "class_"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger lies in the folder that spark.twinlex.secretLedger names and is added to; where that is unset, each call has its own."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = spark.conf.get("spark.twinlex.secretLedger", None) or common.new_path(spark, "ledger")
    return secret_ledger.digest(secret_ledger.findings(docs, secret_ledger.update(docs, folder)))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return masked_lm.score(None, *masked_lm.train(docs))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "token-ids")
    manifest = token_store.write(_table(spark, sf_dir, "documents"), folder, tokens.vocabulary_path(VOCABULARY), end_id=2)
    return token_store.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = pu_quality.train(docs, _table(spark, sf_dir, "labels"))
    return pu_quality.score(docs.select("doc_id", "text"), model).select("doc_id", pu_quality.held_out().alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), tokens.vocabulary_path(VOCABULARY), end_id=1)
    return packing.place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.search(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"), *map(tokens.vocabulary_path, ALIGNED))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_perplexity": op3_perplexity,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_masked_lm": op6_masked_lm,
    "op7_token_store": op7_token_store,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_pivot_search": op11_pivot_search,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}

_OP2 = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark),
bw as (
  select distinct item, least(len(ws), 13) as n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') as win
  from (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
dw as (
  select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bw) where len(ws) >= n)),
hits as (select distinct dw.doc_id, dw.n, dw.i, bw.item from dw join bw on dw.n = bw.n and dw.win = bw.win),
words as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""

_OP4 = """
with recursive l as (
  select doc_id, i - 1 as line_no, list_extract(ls, i) as line
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
d as (select line, min(doc_id * 1000000 + line_no) as place, count(*) as n_copies from l where line <> '' group by line),
e as (
  select a.place as u, b.place as v from (select * from d where length(line) >= 12) a join (select * from d where length(line) >= 12) b
  on length(b.line) between length(a.line) - 2 and length(a.line) + 2 and a.place <> b.place and (
    left(a.line, length(a.line) // 3) = left(b.line, length(a.line) // 3) or right(a.line, length(a.line) // 3) = right(b.line, length(a.line) // 3)
    or contains(substr(b.line, greatest(length(a.line) // 3 - 3, 1), length(a.line) // 3 + 10), substr(a.line, length(a.line) // 3 + 3, greatest(length(a.line) // 3 - 4, 1))))
  where levenshtein(a.line, b.line) <= 2),
r(place, root) as (select u, v from e union select r.place, e.v from r join e on r.root = e.u),
c as (select place, least(place, min(root)) as root from r group by place),
n as (select u as place, count(*) as n_links from e group by u)
select d.place // 1000000 as doc_id, d.place % 1000000 as line_no, n_copies, cast(coalesce(n_links, 0) as bigint) as n_links,
  coalesce(root, d.place) // 1000000 as class_doc_id, coalesce(root, d.place) % 1000000 as class_line_no
from d left join n using (place) left join c using (place)
"""

_OP5_KINDS = (
    ("assign", """((?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 0),
)


def _op5() -> str:
    """One part for each kind: the pieces between matches tell where the matches stand."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_OP5_KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
  select doc_id, {rank} as rank, '{kind}' as kind, list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0) as b, length(found[i]) as n, length(groups[i]) as g
  from (select *, unnest(range(1, len(found) + 1)) as i from (
    select doc_id, string_split_regex(text, {quoted}) as gaps, regexp_extract_all(text, {quoted}) as found, regexp_extract_all(text, {quoted}, {group}) as groups from documents where regexp_matches(text, {quoted})))
  where length(groups[i]) >= {least}""")
    return f"""
with s as ({" union all ".join(parts)}),
t as (select doc_id, rank, kind, b, concat(kind, ':', cast(b as bigint), ':', cast(b + n as bigint)) as span from s),
a as (
  select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
    string_agg(span, ',' order by b, rank) filter (where rank < 3) as base, string_agg(span, ',' order by b, rank) as spans
  from t group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join a using (doc_id)
"""


_OP11 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s qualify rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": _OP2, "op4_line_dedup": _OP4, "op5_secrets": _op5(), "op11_pivot_search": _OP11}
