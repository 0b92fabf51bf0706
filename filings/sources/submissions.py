"""Listings of filings as they are delivered: one row for each company, with parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(listing: DataFrame, id_: str, form: str, most: int) -> DataFrame:
    """(id, accession_number, filing_date, pos): a company's first filings of one form, in the listing's order."""
    zipped = F.arrays_zip("accession_number", "filing_date", "filing_type")
    own = F.slice(F.filter(zipped, lambda x: x["filing_type"] == form), 1, most)
    return listing.select(id_, F.posexplode(own).alias("pos", "x")).select(id_, "x.accession_number", "x.filing_date", "pos")
