"""Sales regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each region, and the prefix each country puts before it.
REGION_SPELLINGS = {
    "Central": ["CENTRAL REGION", "CTR", "CENTRAL"],
    "East": ["EAST REGION", "EAST"],
    "South": ["STH", "SOUTH REGION", "SOUTH"],
    "West": ["WST", "WEST REGION", "WEST"],
}
COUNTRY_PREFIXES = {"United States": "US-", "Canada": "CA-"}


def normalize_region(trimmed: Column) -> Column:
    """One spelling per region; text that is not in the table stays as it is."""
    spelled = [
        F.lit(text)
        for region, spellings in REGION_SPELLINGS.items()
        for spelling in spellings
        for text in (spelling, region)
    ]
    return F.coalesce(F.try_element_at(F.create_map(*spelled), F.upper(trimmed)), trimmed)


def prefix_region(country: Column, region: Column) -> Column:
    """'US-Central'; a missing region stays missing."""
    prefixed = [
        F.when(country == name, F.concat(F.lit(prefix), region))
        for name, prefix in COUNTRY_PREFIXES.items()
    ]
    return F.coalesce(*prefixed, region)
