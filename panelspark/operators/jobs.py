"""The source's two other end-to-end jobs, composed from the operators
(the third, intangible capital, is ``intangibles.intangible_stocks``).

* ``panel_with_returns`` -- firm-year accounts linked to securities, with the
  null-strict annual return and a firm age from a hierarchy of dates.
* ``filing_firm_panel`` -- annual-report filings linked to firms through the
  validity-interval link file, assigned to fiscal years and joined to the
  accounts above a revenue floor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import code_prefix
from .intangibles import clean_founding
from .links import annual_filings, clean_links, filing_panel, link_filings
from .returns import annual_returns, clean_returns, firm_age, first_seen

# Columns of the link file that the filing panel keeps beside the keys and dates.
LINK_NAMES = ("source", "link_desc", "sec_company_name", "link_company_name")
# Fixed value: the founding list's code for "no security id".
NO_PERM_CODE = "."


def panel_with_returns(accounts: DataFrame, ccm: DataFrame, monthly: DataFrame, founding: DataFrame,
                       assets: str = "assets", sale: str = "sale") -> DataFrame:
    """Firm-year panel with annual returns and age (entry point A).

    ``accounts``: gvkey, year, fyear, datadate, cusip, ipodate, assets, sale, ...
    ``ccm``: gvkey, datadate, fyear, permno, permco (+ link dates), already
    filtered to covering links (``links.containing_links``).
    ``monthly``: permno, permco, date, ret (sentinel codes allowed).
    ``founding``: cusip, founding, crsp_perm (text; '.' = none).
    """
    # Accounts + security link on the composite key
    t = accounts.join(ccm, ["gvkey", "datadate", "fyear"], "left")
    # First month per issuer; F1: return codes -> null; A2: annual return
    annual = annual_returns(clean_returns(monthly).withColumn("fyear", F.year("date").cast("int")), "fyear")
    # Join on the shared columns
    t = t.join(annual, ["permno", "fyear"], "left")
    # A1: first accounts date per firm
    t = first_seen(t, "gvkey", "datadate", "comp_first_date")
    # founding list: sentinels, complete rows, a security id
    # incomplete rows go before any column does
    fr = clean_founding(founding)
    fr = (fr.where(F.col("crsp_perm") != NO_PERM_CODE)
            .select("cusip", F.col("crsp_perm").try_cast("double").cast("long").alias("permco"), "founding")
            .where(F.col("permco").isNotNull()))
    # a (permco, cusip) listed several times keeps its several rows, as in the source
    t = t.join(fr, ["permco", "cusip"], "left")
    # Hierarchical first year and clipped age
    t = firm_age(t, year="year", founding="founding")
    # Rows with assets and sales only
    return t.where(F.col(assets).isNotNull() & F.col(sale).isNotNull())


def filing_firm_panel(filings: DataFrame, links_raw: DataFrame, accounts: DataFrame,
                      naics: str = "naicsh", assets: str = "assets", revenue: str = "sale",
                      min_revenue: float = 5.0) -> DataFrame:
    """Annual-report filings matched to firm-years (entry point B, first script).

    Forms ``10-K``/``10-K405`` one per (filer, date) -> inside the link's
    validity interval -> one row per (filer, firm, date) -> fiscal year (filed
    before June -> previous year) -> accounts with assets, plus 3- and 2-digit
    industry prefixes -> revenue strictly above the floor.
    """
    companies = annual_filings(filings)
    lk = clean_links(links_raw)
    lk = lk.select("cik", "gvkey", "link_start", "link_end", *(c for c in LINK_NAMES if c in lk.columns))
    linked = link_filings(companies, lk)
    comp = (accounts.where(F.col(assets).isNotNull())
                    .withColumns({"naics3": code_prefix(naics, 3), "naics2": code_prefix(naics, 2)}))
    return filing_panel(linked, comp, ["gvkey", "fyear"], revenue, min_revenue)
