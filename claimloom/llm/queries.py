"""Queries opN_<name>: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, chat, decontaminate, minhash, pii, quality, repeats, secret_scan, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') as ws from documents), iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') as ws from benchmark),
d as (select doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) as sh, len(ws) as n from dw where len(ws) >= 5),
q as (select item_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) as sh, len(ws) as n from iw where len(ws) >= 5),
ds as (select doc_id, n, unnest(sh) as s, generate_subscripts(sh, 1) - 1 as place from d), qs as (select item_id, n, unnest(sh) as s, generate_subscripts(sh, 1) - 1 as off from q),
hits as (select ds.doc_id, qs.item_id, qs.n as len, least(qs.n - 4, ds.n - 4) as w, ds.n - 4 as m, place from ds join qs using (s)),
win as (select distinct doc_id, item_id, len, w, unnest(range(greatest(place - w + 1, 0), least(place, m - w) + 1)) as "at" from hits),
ws as (select win.doc_id, win.item_id, win.len, win."at", ds.s, count(*) as c from win join ds on ds.doc_id = win.doc_id and ds.place between win."at" and win."at" + win.w - 1 group by all),
qc as (select item_id, s, count(*) as c from qs group by all), qt as (select item_id, sum(c * least(63, length(s))) as total from qc group by item_id),
m as (select ws.doc_id, ws.item_id, ws.len, ws."at", sum(ws.c * least(63, length(ws.s))) as total, coalesce(sum(least(ws.c, qc.c) * least(63, length(ws.s))) filter (qc.c is not null), 0) as both_ from ws left join qc on qc.item_id = ws.item_id and qc.s = ws.s group by all),
r as (select m.*, both_ / (m.total + qt.total - both_)::double as similarity from m join qt using (item_id) where 100 * both_ >= 80 * (m.total + qt.total - both_))
select doc_id, item_id, max(similarity) as similarity, cast(arg_min("at", (-similarity, "at")) as bigint) as "at", cast(any_value(len) as bigint) as n_words from r group by doc_id, item_id
"""


CONTROL = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.read_back(chat.format_trees(chat.reply_tree(turns.unionByName(added))))
    digest = F.sha2(F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256)
    loss = F.concat_ws("", "loss")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
with rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(20 + length(role || text) + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))) as bigint) as formatted_chars
from rows_ group by conv_id
"""


def op3_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), threshold=200, with_text=False)


OP3_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, s, hash(substr(h, 2 * s + 1, 400)) as k from d, unnest(range(n - 199)) u(s)),
hit as (select doc_id, s from (select doc_id, s, count(*) over (partition by k) as c from w) where c > 1),
step as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 200 then 0 else 1 end as new from hit),
run as (select doc_id, s, sum(new) over (partition by doc_id order by s) as r from step), span as (select doc_id, r, min(s) as a, max(s) + 200 as b from run group by doc_id, r),
keep as (select d.doc_id, string_agg(substr(h, 2 * coalesce(prev, 0) + 1, 2 * (a - coalesce(prev, 0))), '' order by a) as body, max(b) as last, sum(b - a) as gone, count(*) as spans from d join (select *, lag(b) over (partition by doc_id order by a) as prev from span) x using (doc_id) group by d.doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join keep using (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits that its id and length fix: a replacement, an insertion and a deletion at the end."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    edit = lambda start, gone, new: F.struct(start.cast("int").alias("start"), F.lit(gone).alias("gone"), F.lit(new).alias("new"))
    edits = F.array(edit(at, 7, "re-written"), edit(n / 2, 0, " an added line,\nthen 42 more's"), edit(n - 10, 1000, ""))
    return token_counts.counts_after_edits(docs.withColumn("edits", edits), vocabulary("byte_bpe_50k.tiktoken"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_texts(_table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    spelled = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *(kind(k).alias(f"n_{k}") for k in secret_scan.BASE), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    spelled = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE), F.sha2(spelled(of(*pii.BASE)), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


OP8_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(b) as component_id, s.doc_id = min(b) as kept from s join reach r on r.a = s.doc_id group by s.doc_id, len(sh)
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
l as (select doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as tri from w),
e as (select doc_id, generate_subscripts(tri, 1) as i, unnest(tri) as g from l where len(tri) > 0),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from e) where n > 1),
covered as (select doc_id, count(*) as n from (select distinct doc_id, i + k as p from twice, (select unnest([0, 1, 2]) as k)) group by doc_id),
m as (select l.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
   cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(ls) as n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '^([A-Za-z]|[^\x00-\x7F])'))) as letters from l left join covered c on c.doc_id = l.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * letters < n_words) as kept from m
"""

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_format, op3_repeated_text, op4_token_counts, op5_toxicity, op6_secret_scan, op7_pii, op8_near_dedup, op9_bpe, op10_quality_rules)}
ORACLES = {"op1_decontamination": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_repeated_text": OP3_SQL, "op8_near_dedup": OP8_SQL, "op10_quality_rules": OP10_SQL}
