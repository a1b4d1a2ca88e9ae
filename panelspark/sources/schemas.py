"""Explicit schemas of the source tables (no schema inference over large files).

Column names follow the landed extracts; money is double (logs and exponentials
follow), keys are long, dates are dates. Use with ``io.read_table(..., schema)``.
"""

from pyspark.sql import types as T

L, I, D, S, DT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()


def _s(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


# annual accounts for the capital-stock job
FUNDA = _s(("gvkey", L), ("fyear", I), ("datadate", DT), ("indfmt", S), ("datafmt", S), ("sich", I),
           ("at", D), ("xsga", D), ("xrd", D), ("rdip", D), ("cogs", D), ("cusip", S), ("seq", D))
# company header
COMPANY = _s(("gvkey", L), ("sic", I), ("ipodate", DT), ("cusip", S))
# annual accounts for the returns panel
ACCOUNTS = _s(("gvkey", L), ("year", I), ("fyear", I), ("datadate", DT), ("cusip", S), ("naicsh", S),
              ("revt", D), ("at", D), ("sale", D), ("cogs", D), ("xopr", D), ("ib", D), ("emp", D),
              ("ipodate", DT), ("prcc_f", D), ("div", D), ("csho", D), ("xrd", D), ("capx", D),
              ("ppegt", D), ("ppent", D))
# account-security links (already filtered to covering links)
CCM = _s(("gvkey", L), ("permno", L), ("permco", L), ("linkdt", DT), ("linkenddt", DT),
         ("datadate", DT), ("fyear", I))
# monthly security returns
MONTHLY = _s(("permco", L), ("permno", L), ("date", DT), ("ret", D), ("shrout", D), ("altprc", D),
             ("primaryexch", S), ("siccd", I))
# founding list as landed from the sheet
FOUNDING = _s(("cusip", S), ("offer_date", S), ("crsp_perm", S), ("founding", I))
# filing index and filer-firm link file (date codes kept as text)
FILINGS = _s(("cik", L), ("form", S), ("rdate", DT), ("fdate", DT), ("coname", S), ("wrdsfname", S),
             ("fname", S))
FILER_LINKS = _s(("cik", L), ("gvkey", L), ("source", S), ("link_desc", S), ("sec_company_name", S),
                 ("link_company_name", S), ("link_start_date", S), ("link_end_date", S), ("N10K", I))
# stored filing sections
SECTIONS = _s(("fname", S), ("item1", S), ("item1a", S), ("item7", S))
# linked filings and the filings' plain text
LINKED_FILINGS = _s(("cik", L), ("gvkey", L), ("fyear", I), ("fname", S))
FILING_BODIES = _s(("fname", S), ("body", S))
# link history, accounts with their format flags, security months and history
LINK_HISTORY = _s(("gvkey", L), ("linktype", S), ("linkprim", S), ("lpermno", L), ("lpermco", L), ("linkdt", DT), ("linkenddt", DT))
ACCOUNT_KEYS = _s(("gvkey", L), ("fyear", I), ("datadate", DT), ("indfmt", S), ("datafmt", S), ("popsrc", S), ("consol", S))
MONTHLY_RAW = _s(("permco", L), ("permno", L), ("date", DT), ("ret", D), ("shrout", D), ("altprc", D))
SECURITY_HISTORY = _s(("permno", L), ("secinfostartdt", DT), ("secinfoenddt", DT), ("sharetype", S), ("securitytype", S), ("securitysubtype", S),
                      ("usincflg", S), ("issuertype", S), ("primaryexch", S), ("conditionaltype", S), ("tradingstatusflg", S), ("siccd", I))
