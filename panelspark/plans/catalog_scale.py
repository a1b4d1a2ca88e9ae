"""Queries for aligned sections, learned sentence ends, dyadic joins, exact sums, balanced parts, encoding by budget,
quoted CSV and rows that tie; all over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact, links, panel as P, returns, sections, sentences, text, vectors
from ..session import materialize, scratch_path
from ..sources import io
from ..sources.filing_index import read_filing_index
from ..streaming.incremental_stocks import StockTables
from ..streaming.retry import retry_extraction
from . import testviews as V
from .catalog import CHUNK_NON_WS, CHUNK_WS, LINK_CLEAN_SQL, SQL, LetterCounts, query, single

# =========================================================================== quoted CSV


#: Bytes of text in one file, about: a task reads a whole file where cells hold line breaks.
QUOTED_FILE = 64 << 20


@query("csv_quoted_cells", r"""
select doc_id, text, case when doc_id % 3 = 0 then 'ACME "' || source || '", INC' when doc_id % 3 = 1 then source || '\' end as name, n_chars from documents""")
def q_csv_quoted_cells(spark, d):
    """Whole texts with line breaks, commas, doubled quotes and trailing backslashes, as pandas writes them: lines of text,
    a header in each file. Four files, each dealt out to several where it would be larger than ``QUOTED_FILE`` bytes."""
    path = scratch_path(spark, "quoted_csv")
    k = F.col("doc_id")
    cell = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    name = F.when(k % 3 == 0, F.concat(F.lit('ACME "'), "source", F.lit('", INC'))).when(k % 3 == 1, F.concat("source", F.lit("\\")))
    docs = V.table(spark, d, "documents")
    n = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // (4 * QUOTED_FILE))
    rows = docs.select((k % 4).alias("part"), F.pmod(F.xxhash64(k, "text"), F.lit(n)).alias("sub"), F.lit(1).alias("at"), F.concat_ws(",", cell(F.col("text")), k, cell(name), "n_chars").alias("line"))
    header = spark.range(4 * n).select((F.col("id") % 4).alias("part"), F.floor(F.col("id") / 4).alias("sub"), F.lit(0).alias("at"), F.lit("text,doc_id,name,n_chars").alias("line"))
    (rows.unionByName(header).repartition("part", "sub").sortWithinPartitions("part", "sub", "at").select("part", "sub", "line").write.partitionBy("part", "sub").text(path))
    return io.read_csv(spark, [f"{path}/part={i}/sub={j}" for i in range(4) for j in range(n)], "doc_id long, text string, name string, n_chars long")


@query("csv_quoted_round_trip", "select o_orderkey, o_comment, o_clerk from (select o_orderkey, '\"' || o_orderpriority || '\", ' || o_orderstatus || '\\' as o_comment, ' ' || o_orderkey || chr(10) as o_clerk from orders) t")
def q_csv_quoted_round_trip(spark, d):
    path = scratch_path(spark, "round_csv")
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(k, F.concat(F.lit('"'), "o_orderpriority", F.lit('", '), "o_orderstatus", F.lit("\\")).alias("o_comment"), F.concat(F.lit(" "), k, F.lit("\n")).alias("o_clerk"))
    io.write_table(o, path, "csv")
    return io.read_csv(spark, path, o.schema)


# =========================================================================== sections

# Filings with a contents page, a running head, cross references at a line's start (one broken out of its sentence, one in
# lower case) and a run of blank lines; every sixth has no item 1A, every seventh no headings at all.
RESULTS = "results of operations " * 20
CROSS = "Item 7. Management discusses this there."
PROSE = "Item 1 of this report describes the business."
ITEMS_SQL = f"""
select doc_id as fname, chr(10) || source || chr(10) || '{CROSS}' || chr(10) || text as item1,
  case when doc_id % 6 <> 0 then chr(10) || source || chr(10) || 'ITEM 1A (CONTINUED)' || chr(10) || source else '' end as item1a,
  chr(10) || lang || '{RESULTS}' || chr(10) || '{PROSE}' || chr(10) || text as item7
from (select doc_id, text, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang from documents) x where doc_id % 7 <> 0 and text <> ''"""


@query("filing_items", f"""
select l.fname, l.gvkey, md5(item1) as item1_md5, md5(item1a) as item1a_md5, md5(item7) as item7_md5
from (select doc_id as fname, doc_id % 50 as gvkey from documents union all select doc_id, doc_id % 50 + 1000 from documents where doc_id % 4 = 0) l
join ({ITEMS_SQL}) s on s.fname = l.fname""")
def q_filing_items(spark, d):
    """The filing-text job with aligned headings; a filing without item 1A has an empty section."""
    linked, docs = _filings(spark, d)
    out, _ = sections.filing_items(linked, docs)
    return out.select("fname", "gvkey", *(F.md5(c).alias(f"{c}_md5") for c in sections.ITEM_SECTIONS))


@query("filing_items_errors", "select doc_id as fname from documents where doc_id % 7 = 0 or coalesce(text, '') = ''")
def q_filing_items_errors(spark, d):
    linked, docs = _filings(spark, d)
    return sections.filing_items(linked, docs)[1]


def _filings(spark, d):
    doc = V.table(spark, d, "documents")
    k = F.col("doc_id")
    contents = "Cover page\nTable of contents\nItem 1. Business 4\nItem 1A. Risk Factors 9\nItem 2. Properties 20\nItem 7. Management's Discussion 31\nItem 8. Financial Statements 40\n" + "\n" * 300
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    risk = F.when(k % 6 != 0, F.concat(F.lit("\nITEM 1A - RISK FACTORS\n"), source, F.lit("\nITEM 1A (CONTINUED)\n"), source)).otherwise(F.lit(""))
    body = F.concat(F.lit(contents + "PART I\nItem 1. Business\n"), source, F.lit(f"\n{CROSS}\n"), "text", risk, F.lit("\n  item 2. Properties\nnone\nItem 7: Management\n"),
                    lang, F.lit(f"{RESULTS}\n{PROSE}\n"), "text", F.lit("\nItem 8. Statements\nend"))
    own = doc.select(k.alias("fname"), (k % 50).alias("gvkey"))
    linked = own.unionByName(own.where(F.col("fname") % 4 == 0).withColumn("gvkey", F.col("gvkey") + 1000))
    return linked, doc.select(k.alias("fname"), F.when(k % 7 == 0, F.lit("no headings")).when(F.col("text") == "", F.lit("")).otherwise(body).alias("body"))


# =========================================================================== sentence ends

#: Short forms in place of common words; each text one line.
PROSE_SQL = rf"""
select doc_id, trim(regexp_replace(replace(replace(replace(replace(text, ' of ', ' U.S. '), ' and ', ' Inc. '), ' with ', ' No. 5 '), ' de ', ' J. K. '), '{CHUNK_WS}+', ' ', 'g')) as text
from documents where text is not null"""
WORDS_SQL = f"""
select doc_id, nth, token, rtrim(ltrim(token, '"''([{{“‘«¿¡'), '"'')]}}”’»,;:') as word
from (select doc_id, unnest(ts) as token, unnest(range(len(ts))) as nth from (select doc_id, regexp_extract_all(text, '{CHUNK_NON_WS}+') as ts from ({PROSE_SQL}) p) t) u"""
TYPES_SQL = f"""
select *, case when regexp_matches(bare, '^[0-9][0-9.,]*$') then '##' else lower(bare) end as type
from (select *, case when ends_with(word, '.') then left(word, length(word) - 1) else word end as bare from ({WORDS_SQL}) w) b"""
PAIRS_SQL = f"""
select *, regexp_matches(coalesce(next_word, ''), '^\\p{{Lu}}') as capital, ends_with(word, '.') and not ends_with(word, '..') as dotted
from (select *, lead(type) over (partition by doc_id order by nth) as follow, lead(word) over (partition by doc_id order by nth) as next_word, lead(token) over (partition by doc_id order by nth) as next_token from ({TYPES_SQL}) t) x"""


def _lean_sql(k: str, n: str, p: str) -> str:
    return f"(case when {k} > 0 then {k} * ln(greatest({p}, 1e-300)) else 0 end + case when {n} - {k} > 0 then ({n} - {k}) * ln(greatest(1 - {p}, 1e-300)) else 0 end)"


def _joint_sql(a: str, b: str, both: str, n: str) -> str:
    f = lambda k, m, p: _lean_sql(f"({k})", f"({m})", f"({p})")
    return f"""case when {n} * {both} > {a} * {b} then -2 * ({f(both, a, f'{b} / {n}')} + {f(f'{b} - {both}', f'{n} - {a}', f'{b} / {n}')}
      - {f(both, a, f'{both} / {a}')} - {f(f'{b} - {both}', f'{n} - {a}', f'({b} - {both}) / ({n} - {a})')}) else 0 end"""


SHORT_SQL = "({c} in (select type from abbr) or {c} = '##' or regexp_matches({c}, '^\\p{{L}}$'))"
LEARNT_SQL = f"""
w as materialized (select *, doc_id as d from ({PAIRS_SQL}) p where length(word) > 0),
types as (select type, cast(count(*) as double) as n, cast(count(*) filter (dotted) as double) as k from w group by type),
whole as (select cast(count(*) as double) as n, cast(count(*) filter (dotted) as double) as k from w),
scored as (
  select type, types.n, types.k, -2 * ({_lean_sql('types.k', 'types.n', '(whole.k / whole.n)')} - {_lean_sql('types.k', 'types.n', '0.99')})
    * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1) * pow(cast(length(replace(type, '.', '')) as double), -(types.n - types.k)) as score
  from types, whole where types.k > 0 and regexp_matches(type, '\\p{{L}}')),
abbr as (select type, score from scored where score >= 0.3),
ends as (select * from w where dotted and not {SHORT_SQL.format(c='type')}),
starter as (
  select s.type, {_joint_sql('e.n', 't.n', 's.n', 'whole.n')} as score
  from (select follow as type, cast(count(*) as double) as n from ends where capital and length(next_word) > 0 group by follow) s join types t on s.type = t.type, (select cast(count(*) as double) as n from ends) e, whole
  where regexp_matches(s.type, '\\p{{L}}')),
first as (select type from starter where score >= 30),
pair as (
  select x.type, x.follow, {_joint_sql('a.n', 'b.n', 'x.n', 'whole.n')} as score
  from (select type, follow, cast(count(*) as double) as n from w where dotted and length(next_word) > 0 and ({SHORT_SQL.format(c='type')} or follow = '##') and follow not in (select type from first) group by type, follow) x
  join types a on a.type = x.type join types b on b.type = x.follow, whole),
tied as (select type, follow from pair where score >= 7.88)"""


def _prose(spark, d):
    t = F.col("text")
    for a, b in ((" of ", " U.S. "), (" and ", " Inc. "), (" with ", " No. 5 "), (" de ", " J. K. ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    flat = F.trim(F.regexp_replace(t, f"(?![!-~])(?:{text.WS.replace(' ', '')}{text.WS}*| {text.WS}+)", " "))  # a lone blank stays
    docs = V.table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")  # a file may be one task
    return docs.select("row", "doc_id", flat.alias("text"))


@query("abbreviation_scores", f"with {LEARNT_SQL} select type, cast(n as bigint) as n, cast(k as bigint) as n_dotted, score >= 0.3 as is_short, round(score, 6) + 0.0 as score from scored")
def q_abbreviation_scores(spark, d):
    counts = materialize(sentences.token_counts(_prose(spark, d), "text"))  # read three times: types, all tokens, all dots
    found = sentences.abbreviations(counts)
    return found.select("type", "n", "n_dotted", (F.col("score") >= sentences.ABBREVIATION).alias("is_short"), (F.round("score", 6) + 0.0).alias("score"))


@query("sentence_ends", f"""
with {LEARNT_SQL},
cut as (
  select doc_id, nth, token,
    next_token is not null and regexp_matches(token, '[.!?]["'')\\]”’»]?$') and (
      not ends_with(word, '.')
      or case when ends_with(word, '..') then capital
         when type in (select type from abbr) or regexp_matches(type, '^\\p{{L}}$') then not ((not (capital and follow in (select type from first))) or coalesce((type, follow) in (select (type, follow) from tied), false))
         else not coalesce((type, follow) in (select (type, follow) from tied), false) end) as ended
  from ({PAIRS_SQL}) p),
nos as (select *, coalesce(sum(cast(ended as integer)) over (partition by doc_id order by nth rows between unbounded preceding and 1 preceding), 0) as s from cut),
sent as (select doc_id, s, string_agg(token, ' ' order by nth) as sentence from nos group by doc_id, s)
select doc_id, count(*) as n_sentences, md5(string_agg(sentence, chr(10) order by s)) as sentences_md5 from sent group by doc_id""")
def q_sentence_ends(spark, d):
    """Every text split at the learned ends."""
    prose = materialize(_prose(spark, d), by="row")
    ends = sentences.learn_sentence_ends(prose, "text")
    own = sentences.open_ends(prose.where("text <> ''"), "row", "text", ends, "open")
    own = own.select("doc_id", sentences.sentence_array(F.col("text"), F.col("open")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


# =========================================================================== dyadic joins


@query("dyadic_interval_join", f"""
select f.cik, l.gvkey, f.rdate, f.fname, f.form, l.link_start, l.link_end from filings f join ({LINK_CLEAN_SQL}) l on f.cik = l.cik and f.rdate >= l.link_start and f.rdate <= l.link_end""")
def q_dyadic_interval_join(spark, d):
    lk = links.clean_links(V.links_raw(spark, d)).select("cik", "gvkey", "link_start", "link_end")
    return links.dyadic_interval_join(V.filings(spark, d), lk, "cik", "rdate").select("cik", "gvkey", "rdate", "fname", "form", "link_start", "link_end")


@query("dyadic_containment", f"""
select p.gvkey, p.fyear, l.cik, l.link_start, l.link_end from panel p join ({LINK_CLEAN_SQL}) l on p.gvkey = l.gvkey and p.fyear between 1950 and 2020
  and (l.link_start is null or l.link_start < make_date(p.fyear - 1, 12, 31)) and (coalesce(l.end_open, false) or l.link_end > make_date(p.fyear, 12, 31))""")
def q_dyadic_containment(spark, d):
    lk = links.clean_links(V.links_raw(spark, d)).select("cik", "gvkey", "link_start", "link_end", "end_open")
    return links.dyadic_containing_links(V.panel(spark, d).select("gvkey", "fyear"), lk).select("gvkey", "fyear", "cik", "link_start", "link_end")


# =========================================================================== exact sums

EXACT = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query("exact_sums", f"""
select l_returnflag, l_linestatus, cast(sum(cast({EXACT} * 4503599627370496.0 as hugeint)) as double) / 4503599627370496.0 as charge,
  cast(sum(cast(({EXACT} - 30000.0) * 4503599627370496.0 as hugeint)) as double) / 4503599627370496.0 as off, count(*) as n
from lineitem group by l_returnflag, l_linestatus""")
def q_exact_sums(spark, d):
    """Sums of products of doubles, compared to the last bit: the SQL adds them up as whole multiples of 2 ** -52."""
    li = V.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", *(F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")))
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    keys = ["l_returnflag", "l_linestatus"]
    return exact.exact_sums(li, keys, {"charge": charge, "off": charge - 30000.0}).join(li.groupBy(*keys).agg(F.count("*").alias("n")), keys)


# =========================================================================== balanced parts (K4)


@query("cost_chunks", """
select doc_id, cast(floor(coalesce(sum(coalesce(octet_length(encode(text)), 0)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) / 100000) as bigint) as chunk from documents""")
def q_cost_chunks(spark, d):
    """Documents in parts of about 100,000 bytes of text, in order."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return io.cost_chunks(docs, ["doc_id"], F.octet_length("text"), 100_000).select("doc_id", "chunk")


# =========================================================================== encoding by budget (V3)


@query("encode_by_budget", SQL["encode_chunks"])
def q_encode_by_budget(spark, d):
    c = text.chunk_docs(V.table(spark, d, "documents"), "doc_id", "text")
    e = vectors.embed_by_budget(c, "chunk", "vec", factory=LetterCounts, budget=2048, keep_text=False)
    return vectors.explode_vector(e, ["doc_id", "chunk_no"], "vec").withColumn("v", F.col("v").cast("double"))


# =========================================================================== rows that tie

#: Every order is an account: firms have several in most years.
RAW_SQL = """
select o_custkey as gvkey, cast(year(o_orderdate) as integer) as fyear, cast(date_trunc('month', o_orderdate) as date) as datadate, o_orderkey as k,
  case when o_orderpriority = '1-URGENT' then null when o_orderpriority = '5-LOW' then 0.0 else cast(o_totalprice as double) end as xrd from orders"""


def _raw(spark, d):
    pr = F.col("o_orderpriority")
    return V.table(spark, d, "orders").select(
        F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").cast("int").alias("fyear"), F.trunc("o_orderdate", "month").alias("datadate"), F.col("o_orderkey").alias("k"),
        F.when(pr == "1-URGENT", F.lit(None)).when(pr == "5-LOW", F.lit(0.0)).otherwise(F.col("o_totalprice").cast("double")).alias("xrd"))


@query("rd_pivot_ties", f"""
with p as (select *, row_number() over (partition by gvkey order by datadate, k) as rn from ({RAW_SQL}) r where fyear = {V.PIVOT_YEAR})
select r.gvkey, r.k, case when r.xrd is null and (r.fyear >= {V.PIVOT_YEAR} or (p.gvkey is not null and coalesce(p.xrd, 0) = 0)) then 0.0 else r.xrd end as xrd
from ({RAW_SQL}) r left join p on p.gvkey = r.gvkey and p.rn = 1""")
def q_rd_pivot_ties(spark, d):
    """Several accounts of a firm in the pivot year: the first by date, then by the other columns, decides."""
    return P.pivot_zero_fill(_raw(spark, d), "gvkey", "fyear", "xrd", V.PIVOT_YEAR, order=["datadate"]).select("gvkey", "k", "xrd")


@query("densify_repeated", f"""
select gvkey, cast(unnest(generate_series(fyear, greatest(coalesce(nx - 1, fyear), fyear))) as integer) as fyear, k
from (select gvkey, fyear, k, lead(fyear) over (partition by gvkey order by fyear, datadate, k) as nx from ({RAW_SQL}) r where fyear % 3 <> 0) t""")
def q_densify_repeated(spark, d):
    """Accounts that repeat years and miss others."""
    some = _raw(spark, d).where("fyear % 3 <> 0").select("gvkey", "fyear", "datadate", "k")
    return P.densify_years(some, "gvkey", "fyear").select("gvkey", "fyear", "k")


@query("annual_return_no_issuer", """
with m as (select permno, case when permno % 3 <> 0 then permco end as permco, yr, date, case when ret in (-66.0, -77.0, -88.0, -99.0) then null else ret end as ret from monthly),
f as (select permco, min(date) as first from m where permco is not null group by permco)
select m.permno, m.yr, f.first as crsp_first_date, case when count(*) = count(m.ret) then round(product(1 + m.ret) - 1, 6) end as ret
from m left join f on m.permco = f.permco group by m.permno, m.yr, f.first""")
def q_annual_return_no_issuer(spark, d):
    """A third of the securities have no issuer, so no first month either."""
    m = V.monthly(spark, d).withColumn("permco", F.when(F.col("permno") % 3 != 0, F.col("permco")))
    out = returns.annual_returns(returns.clean_returns(m), "yr")
    return out.select("permno", "yr", "crsp_first_date", F.round("ret", 6).alias("ret"))


# =========================================================================== updates, retries, index files


@query("intangible_stocks_incremental", SQL["intangible_stocks"])
def q_intangible_stocks_incremental(spark, d):
    """The capital-stock job after three updates, a third of the firms' accounts each; equal to the full job."""
    tables = StockTables(spark, scratch_path(spark, "stocks"), buckets=8)
    accounts = V.panel(spark, d)
    for n in range(3):
        out = tables.update(n, accounts.where(F.col("gvkey") % 3 == n), V.company(spark, d), V.founding(spark, d), V.EXCLUDED_FIRMS, V.PIVOT_YEAR)
    return out.select("gvkey", "fyear", single("kcap_v2"), single("ocap_v2"))


def fails_at_first(text: str, tries: int) -> str:
    """An extraction that fails as often as the digit at the text's start says."""
    if tries <= int(text[0]):
        raise OSError(f"no answer at try {tries}")
    return text[2:]


@query("retry_dead_letters", """
select cast(doc_id as varchar) as key, cast(least(doc_id % 5 + 1, 3) as integer) as tries, case when doc_id % 5 < 3 then 'done' else 'given_up' end as status,
  case when doc_id % 5 >= 3 then 'OSError: no answer at try 3' end as error, case when doc_id % 5 < 3 then md5(coalesce(text, '')) end as found_md5 from documents""")
def q_retry_dead_letters(spark, d):
    """Documents whose extraction fails up to four times; three tries each."""
    root = scratch_path(spark, "retry")
    body = F.concat(F.col("doc_id") % 5, F.lit(":"), F.coalesce("text", F.lit("")))
    V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fname"), body.alias("body")).write.parquet(f"{root}/in")
    out = retry_extraction(spark, f"{root}/in", "fname string, body string", "fname", "body", fails_at_first, f"{root}/log", f"{root}/checkpoint", tries=3, delay_ms=10)
    return out.select("key", "tries", "status", "error", F.md5("found").alias("found_md5"))


@query("filing_index_files", """
select form, 'FIRM ' || cik as company, cik, rdate as date, 'edgar/data/' || cik || '/' || fname || '.txt' as fname, cast(year(rdate) as integer) as year, cast(quarter(rdate) as integer) as quarter
from filings where form like '10-K%' and form in ('10-K', '10-K405') and rdate >= date '1996-05-01' and rdate < date '1997-12-01'""")
def q_filing_index_files(spark, d):
    """The filings as fixed-width index files of each quarter; only the quarters of the dates asked for are opened."""
    root = scratch_path(spark, "index")
    f = V.filings(spark, d)
    y, q = F.year("rdate"), F.concat(F.lit("QTR"), F.quarter("rdate"))
    path = F.concat(F.lit("edgar/data/"), "cik", F.lit("/"), "fname", F.lit(".txt"))
    line = F.concat(F.rpad("form", 12, " "), F.rpad(F.concat(F.lit("FIRM "), "cik"), 62, " "), F.rpad(F.col("cik").cast("string"), 12, " "), F.rpad(F.date_format("rdate", "yyyy-MM-dd"), 12, " "), path)
    rows = f.select(y.alias("y"), q.alias("q"), F.lit(1).alias("at"), line.alias("line"))
    head = f"{'Form Type':<12}{'Company Name':<62}{'CIK':<12}{'Date Filed':<12}File Name\n" + "-" * 120
    heads = rows.select("y", "q").distinct().select("y", "q", F.lit(0).alias("at"), F.lit(head).alias("line"))
    rows.unionByName(heads).repartition("y", "q").sortWithinPartitions("y", "q", "at").select("y", "q", "line").write.partitionBy("y", "q").text(root)
    return links.filing_index(read_filing_index(spark, root, "*")).where("date >= '1996-05-01' and date < '1997-12-01'")
