"""The operators applied to the whole given tables with production parameters.

``QUERIES``: name -> (spark, sf_dir) -> DataFrame. ``SQL``: name -> DuckDB SQL with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontamination, exact_dedup, language_id, near_dedup, packing, quality_rules, secret_scan, spelling, substring_dedup, token_counts, url_filter,
               whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: The oracles state every constant of the operators again.
SECRETS_SQL = r"""
with kinds(rank, kind, pattern, grp, least) as (values
    (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'key', '[A-Za-z0-9+/_-]+', 0, 20)),
cut as (
  select doc_id, source, rank, kind, least, string_split_regex(coalesce(text, ''), pattern) as pieces, regexp_extract_all(coalesce(text, ''), pattern, 0) as wholes,
    case when grp = 2 then regexp_extract_all(coalesce(text, ''), pattern, 2) else regexp_extract_all(coalesce(text, ''), pattern, 0) end as vals
  from documents, kinds),
rows as (select doc_id, source, rank, kind, least, unnest(pieces[1:len(wholes)]) as piece, unnest(wholes) as whole, unnest(vals) as value, unnest(range(len(wholes))) as nth from cut),
placed as (
  select *, sum(length(piece) + length(whole)) over (partition by doc_id, rank order by nth) as stop from rows),
spans as (select doc_id, source, rank, kind, value, cast(stop - length(whole) as bigint) as start, cast(stop as bigint) as stop from placed where length(value) >= least),
looked as (select *, regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 10 as look from spans),
found as (
  select * from looked a where rank < 3 or (look and not exists (
    select 1 from looked b where b.doc_id = a.doc_id and b.rank < 3 and b.start < a.stop and b.stop > a.start))),
owners as (select value, count(distinct coalesce(source, chr(0))) as n_owners from found group by value),
judged as (select f.*, n_owners, n_owners < 3 and look as live from found f join owners using (value) where rank < 3 or n_owners < 3),
per as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
    count(*) filter (live) as n_live, count(*) filter (n_owners >= 3) as n_copied
  from judged group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from documents left join per using (doc_id)"""

CHATS_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
    sum(17 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as chars
  from t group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""

QUALITY_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from d),
k(n) as (values (3), (5), (6), (7), (8), (9), (10)),
grams as (
  select doc_id, n, unnest(list_transform(range(greatest(len(ws) - n + 1, 0)), lambda i: i)) as pos,
    unnest(list_transform(range(greatest(len(ws) - n + 1, 0)), lambda i: md5(array_to_string(ws[i + 1:i + n], ' ')))) as gram from d, k),
often as (select doc_id, n, pos, count(*) over (partition by doc_id, n, gram) > 1 as dup from grams),
hit as (select distinct doc_id, n, pos + j as pos from often, (select unnest(range(10)) as j) where dup and j < n),
cover as (
  select doc_id, count(*) filter (n = 3) as n_repeat_words,
    sum(length(word)) filter (n = 5) as c5, sum(length(word)) filter (n = 6) as c6, sum(length(word)) filter (n = 7) as c7,
    sum(length(word)) filter (n = 8) as c8, sum(length(word)) filter (n = 9) as c9, sum(length(word)) filter (n = 10) as c10
  from hit join w using (doc_id, pos) group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from d),
lw as (select doc_id, pos, line, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) as chars from l),
ln as (
  select doc_id, count(*) as n_lines, count(*) filter (nth > 1) as n_dup_lines, coalesce(sum(chars) filter (nth > 1), 0) as dup_line_chars
  from (select *, row_number() over (partition by doc_id, line order by pos) as nth from lw where chars > 0) group by doc_id),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(dup_line_chars, 0) as bigint) as dup_line_chars, coalesce(n_repeat_words, 0) as n_repeat_words,
    cast(coalesce(c5, 0) as bigint) as dup_chars_5, cast(coalesce(c6, 0) as bigint) as dup_chars_6, cast(coalesce(c7, 0) as bigint) as dup_chars_7,
    cast(coalesce(c8, 0) as bigint) as dup_chars_8, cast(coalesce(c9, 0) as bigint) as dup_chars_9, cast(coalesce(c10, 0) as bigint) as dup_chars_10
  from d left join cover using (doc_id) left join ln using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not (base_failed or 100 * dup_chars_5 > 30 * word_chars or 100 * dup_chars_6 > 28 * word_chars or 100 * dup_chars_7 > 26 * word_chars
  or 100 * dup_chars_8 > 24 * word_chars or 100 * dup_chars_9 > 22 * word_chars or 100 * dup_chars_10 > 20 * word_chars
  or 100 * dup_line_chars > 30 * word_chars or 100 * n_dup_lines > 30 * n_lines or 100 * n_symbols > 10 * n_words
  or 10 * word_chars < 20 * n_words or 10 * word_chars > 120 * n_words) as kept
from b"""

DEDUP_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1:i + 4], ' ')) end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
link as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
edge as (select x, y from link union all select y, x from link),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.y from reach r join edge e on e.x = r.other),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)"""

REPEATS_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select doc_id, unnest(range(greatest(len(ws) - 19, 0))) as pos,
    unnest(list_transform(range(greatest(len(ws) - 19, 0)), lambda i: md5(array_to_string(ws[i + 1:i + 20], ' ')))) as gram from d),
nth as (select doc_id, pos, row_number() over (partition by gram order by doc_id, pos) as nth from win),
w as (
  select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from d),
gone as (
  select w.doc_id, w.pos, w.word, coalesce(max(case when nth > 1 then 1 else 0 end) over (partition by w.doc_id order by w.pos rows between 19 preceding and current row), 0) as out
  from w left join nth on nth.doc_id = w.doc_id and nth.pos = w.pos),
k as (select doc_id, count(*) as n_words, sum(out) as n_removed, string_agg(word, ' ' order by pos) filter (out = 0) as kept from gone group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join k using (doc_id)"""

#: crc32 from its polynomial, byte by byte; near words by the letters left out; chains by recursion.
SPELLING_SQL = r"""
with recursive bits(byte, crc, k) as (
  select cast(range as bigint), cast(range as bigint), 0 from range(256) union all
  select byte, case when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, k + 1 from bits where k < 8),
crc as (select list(crc order by byte) as t from bits where k = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
kinds as (select doc_id, run, count(*) as n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as bytes from runs group by all),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: cast(('0x' || substr(bytes, 2 * i + 1, 2)) as bigint))),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))) as h from kinds, crc),
words as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(n) as bigint) as n from hashed group by 1),
vocab as (select word, n from words where length(word) >= 5 and n >= 3),
cut as (
  select word, n, unnest(range(length(word))) as k from vocab),
gaps as (select word, n, k, substr(word, 1, k) || substr(word, k + 2) as rest from cut),
pairs as (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join vocab b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join vocab b on a.rest = b.word),
best as (select word, count(*) as n_near, max(near_n) as most from pairs group by word),
form as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 2 * v.n then (select min(near) from pairs p where p.word = v.word and p.near_n = most) end as form,
    case when most >= 2 * v.n then most end as form_n from vocab v left join best using (word)),
chain(word, root, form) as (
  select word, word, form from form union all select c.word, f.word, f.form from chain c join form f on f.word = c.form)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from form f join chain c on c.word = f.word and c.form is null"""


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_decontamination")
def op5(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark, sf_dir):
    return quality_rules.quality_signals(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_near_dedup", DEDUP_SQL)
def op7(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


@query("op9_substring_dedup", REPEATS_SQL)
def op9(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model, "doc_id", "text", held_out.alias("held_out"))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_secret_scan", SECRETS_SQL)
def op3(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "key")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.written_out(base), 256).alias("base_sha256"), secret_scan.written_out(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["n_owners"] >= secret_scan.WIDE)).cast("long").alias("n_copied"))


#: A conversation that tries the escapes; it is added to the given ones.
ESCAPES = r"\### Assistant: </turn> ok"


@query("op4_chat_format", CHATS_SQL)
def op4(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", ESCAPES), (-7, 1, "assistant", ESCAPES)], "conv_id long, turn long, role string, text string")
    chats = chat_format.formatted(chat_format.branches(chat_format.threads(turns.unionByName(added)), best=1))
    back = chat_format.read_back(chats)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


#: The pages table has no dates and there is no list: every page is a capture on the one and, by its host or its host
#: and first path segment, a list entry on the other of two days that follow from its id.
@query("op10_url_filter", """
with p as (
  select page_id, url,
    nullif(rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') as host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') as parts,
    date '2024-01-01' + cast(page_id % 365 as integer) as fetched, date '2024-01-01' + cast((page_id * 7) % 365 as integer) as day
  from pages),
e as (
  select case when page_id % 2 = 0 or len(parts) = 0 then 'd' else 'p' end as kind, host as h, case when page_id % 2 = 0 or len(parts) = 0 then '' else parts[1] end as seg,
    'list' || (page_id % 3) as category, day, page_id % 4 <> 0 as added
  from p where host is not null and page_id is not null),
d as (select kind, h, seg, category, day, bool_or(added) as added from e group by all),
i as (select *, lead(day) over (partition by kind, h, seg, category order by day) as until from d),
m as (
  select p.page_id, i.day, i.category from p join i on i.added and i.day <= p.fetched and (i.until is null or p.fetched < i.until)
    and ((i.kind = 'd' and (p.host = i.h or ends_with(p.host, '.' || i.h))) or (i.kind = 'p' and p.host = i.h and p.parts[1] = i.seg)))
select p.page_id, p.host, count(m.day) > 0 as blocked, count(m.day) as n_active, min(m.day) as since,
  coalesce(string_agg(distinct m.category, ',' order by m.category), '') as categories
from p left join m on m.page_id = p.page_id group by p.page_id, p.host""")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = F.lit("2024-01-01").cast("date")
    fetched = F.date_add(first, (pages["page_id"] % 365).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    parts, host = url_filter.path(F.col("url")), url_filter.host(F.col("url"))
    key = F.when((F.col("page_id") % 2 == 0) | (F.size(parts) == 0), url_filter.domain_key(host)).otherwise(url_filter.prefix_key(host, F.slice(parts, 1, 1)))
    entries = pages.select(key.alias("key"), F.concat(F.lit("list"), F.col("page_id") % 3).alias("category"),
                           F.date_add(first, ((F.col("page_id") * 7) % 365).cast("int")).alias("day"), (F.col("page_id") % 4 != 0).alias("added"))
    found = url_filter.filter_captures(captures, entries, "page_id", "url", "fetched")
    return found.withColumn("categories", F.array_join("categories", ","))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants", SPELLING_SQL)
def op12(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_exact_dedup", """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from d""")
def op13(spark, sf_dir):
    return exact_dedup.copies(table(spark, sf_dir, "documents"), keep="largest")
