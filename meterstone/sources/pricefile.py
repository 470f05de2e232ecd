"""The user's price file."""

from __future__ import annotations

import json
import logging
from decimal import DecimalException

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from meterstone.functions.pricebook import BUILTIN, PriceBook

log = logging.getLogger(__name__)


def parse_price_file(text: str) -> PriceBook:
    """Book of a price file; any mistake in it voids the whole file."""
    try:
        data = json.loads(text)
        if not isinstance(data, dict):
            raise ValueError("the price file must hold an object")
        tiers = {}
        for model, rule in (data.get("long_context") or {}).items():
            # Either a list of tiers or one tier written flat.
            rows = rule["tiers"] if "tiers" in rule else [rule]
            tiers[model] = [(row["threshold"], row["prices"]) for row in rows]
        hourly = {
            model: rule["write_1h"]
            for model, rule in (data.get("cache") or {}).items()
            if "write_1h" in rule
        }
        disabled = data.get("disabled_builtin_long_context") or []
        if not isinstance(disabled, list):
            raise ValueError("disabled rules must be a list")
        return PriceBook.of(data.get("models"), tiers, hourly, map(str, disabled))
    except (
        AttributeError, DecimalException, IndexError, KeyError, TypeError, ValueError,
    ) as error:
        log.warning("price file ignored: %s", error)
        return BUILTIN


def read_price_book(spark: SparkSession, path: str) -> PriceBook:
    """The book with the rules of one small configuration file; no file, no user rules."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return BUILTIN
    return parse_price_file(row.value) if row else BUILTIN
