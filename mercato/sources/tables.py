"""The logical source tables of the order data model."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass
class SourceTables:
    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    geolocation: DataFrame | None = None
    category_translation: DataFrame | None = None

    def items(self):
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                yield f.name, df
