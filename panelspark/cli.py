"""Command line for the end-to-end jobs on landed files.

    python -m panelspark.cli capital-stocks --funda F --company C --founding R --out O
    python -m panelspark.cli returns-panel --accounts A --ccm L --monthly M --founding R --out O
    python -m panelspark.cli filing-panel --filings F --links L --accounts A --out O
    python -m panelspark.cli embed --sections S --out O
    python -m panelspark.cli filing-text --links L --documents D --errors E --out O
    python -m panelspark.cli security-links --history H --accounts A --out O
    python -m panelspark.cli common-shares --monthly M --history H --out O
    python -m panelspark.cli part-files --input I --order fname --out O

Inputs are Parquet unless they end in ``.csv`` (then read by their headers with
the explicit schemas of ``sources.schemas``); ``--fmt csv|parquet`` picks the output format.
The session comes from the cluster (``spark-submit``); nothing is collected to
the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import intangibles, jobs, links, text, vectors
from .session import get_session
from .sources import io, schemas


def _read(spark, path, schema):
    if path.endswith(".csv"):
        return io.read_table(spark, path, schema, fmt="csv")
    return io.read_table(spark, path)


def _write(df, args):
    io.write_table(df, args.out, fmt=args.fmt, compression=args.compression)


def capital_stocks(spark, a):
    funda = _read(spark, a.funda, schemas.FUNDA).withColumnRenamed("at", "assets")
    company = _read(spark, a.company, schemas.COMPANY).drop("cusip")
    founding = _read(spark, a.founding, schemas.FOUNDING)  # incomplete rows are dropped over all columns
    out = intangibles.intangible_stocks(funda, company, founding, exclude=a.exclude, pivot_year=a.pivot_year)
    _write(out, a)


def returns_panel(spark, a):
    acc = _read(spark, a.accounts, schemas.ACCOUNTS).withColumnRenamed("at", "assets")
    out = jobs.panel_with_returns(acc, _read(spark, a.ccm, schemas.CCM), _read(spark, a.monthly, schemas.MONTHLY),
                                  _read(spark, a.founding, schemas.FOUNDING))
    _write(out, a)


def filing_panel(spark, a):
    acc = _read(spark, a.accounts, schemas.ACCOUNTS).withColumnRenamed("at", "assets")
    out = jobs.filing_firm_panel(_read(spark, a.filings, schemas.FILINGS),
                                 _read(spark, a.links, schemas.FILER_LINKS), acc, revenue="revt")
    _write(out, a)


def embed(spark, a):
    s = text.concat_sections(text.text_flags(_read(spark, a.sections, schemas.SECTIONS)))
    s = s.where((F.length("text") > 0) & (F.length("item1") > 0))
    # a filing linked to several firms is embedded once
    each = s.select("fname", "text", "item1").dropDuplicates(["fname"])
    out = vectors.embed_docs(each, "fname", {"text": "embfull", "item1": "emb1"})
    _write(s.join(out, "fname", "left"), a)


def filing_text(spark, a):
    docs = _read(spark, a.documents, schemas.FILING_BODIES)
    out, errors = text.filing_texts(_read(spark, a.links, schemas.LINKED_FILINGS), docs)
    _write(out, a)
    io.write_table(errors, a.errors, fmt=a.fmt, compression=a.compression)


def security_links(spark, a):
    _write(links.security_links(_read(spark, a.history, schemas.LINK_HISTORY), _read(spark, a.accounts, schemas.ACCOUNT_KEYS)), a)


def common_shares(spark, a):
    _write(links.monthly_common_shares(_read(spark, a.monthly, schemas.MONTHLY_RAW), _read(spark, a.history, schemas.SECURITY_HISTORY)), a)


def part_files(spark, a):
    io.write_row_chunks(_read(spark, a.input, None), a.out, a.order.split(","), a.rows)


def main(argv=None):
    p = argparse.ArgumentParser(prog="panelspark")
    sub = p.add_subparsers(dest="cmd", required=True)

    def cmd(name, fn, *opts):
        c = sub.add_parser(name)
        for o in opts:
            c.add_argument(f"--{o}", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
        c.add_argument("--compression", default=None)
        c.set_defaults(fn=fn)
        return c

    c = cmd("capital-stocks", capital_stocks, "funda", "company", "founding")
    c.add_argument("--pivot-year", type=int, default=intangibles.RD_PIVOT_YEAR)
    c.add_argument("--exclude", type=int, nargs="*", default=[])
    cmd("returns-panel", returns_panel, "accounts", "ccm", "monthly", "founding")
    cmd("filing-panel", filing_panel, "filings", "links", "accounts")
    cmd("embed", embed, "sections")
    cmd("filing-text", filing_text, "links", "documents", "errors")
    cmd("security-links", security_links, "history", "accounts")
    cmd("common-shares", common_shares, "monthly", "history")
    c = cmd("part-files", part_files, "input", "order")
    c.add_argument("--rows", type=int, default=io.ROWS_PER_PART)
    args = p.parse_args(argv)
    spark = get_session()
    args.fn(spark, args)


if __name__ == "__main__":
    main()
