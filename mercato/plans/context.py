"""Per-directory context: source tables, clean tables, and the stored fact, features and churn model.

Source and clean tables are lazy DataFrames, so a query that uses three columns
gets a plan whose scans read only what those need.  The fact, the churn matrix and the churn
model are built once and stored, as the studied ETL-then-dashboard flow does; every
analytic starts from a pruned, month-partitioned Parquet scan.  They lie in
``spark.mercato.store`` if that names a shared folder (they outlive the session then),
else beside the session's checkpoints, and are rebuilt when a source file changes
(``sources.stored``).
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from mercato.operators import churn, churn_model, geo
from mercato.operators.clean import CleanTables, clean
from mercato.operators.fact import FACT_COLUMNS, build_fact
from mercato.session import checkpoint_root
from mercato.sources.binding import bind, derived_translation, source_paths
from mercato.sources.io import materialize, write_fact
from mercato.sources.stored import file_state, keyed, keyed_folder
from mercato.sources.tables import SourceTables

# Stands for the definition of what is stored; a change of it rebuilds.
VERSION = "3;" + ",".join(FACT_COLUMNS)
# The payment types of the bound tables, and the filler for none.
PAYMENT_TYPES = ["a", "n", "r", "unknown"]


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, fact: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._fact = fact

    @cached_property
    def src(self) -> SourceTables:
        return bind(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> CleanTables:
        return clean(self.src, translation_builder=derived_translation)

    @cached_property
    def store(self) -> str:
        root = self.spark.conf.get("spark.mercato.store", None) or f"{checkpoint_root(self.spark)}/store"
        return f"{root.rstrip('/')}/{hashlib.sha256(self.sf_dir.encode()).hexdigest()[:16]}"

    def sources(self) -> DataFrame:
        return file_state(self.spark, source_paths(self.sf_dir))

    @property
    def fresh_fact(self) -> DataFrame:
        """The plan that builds the fact."""
        return build_fact(self.clean)

    @property
    def fact(self) -> DataFrame:
        if self._fact is None:
            self._fact = keyed(self.spark, f"{self.store}/fact", lambda: self.fresh_fact, self.sources, VERSION, write_fact)
        return self._fact

    @cached_property
    def matrix(self) -> DataFrame:
        """The churn matrix, stored in sorted id ranges: lookups read one file."""
        return keyed(self.spark, f"{self.store}/matrix",
                     lambda: churn_model.by_customer(churn.churn_matrix(churn.churn_features(self.fact), PAYMENT_TYPES)),
                     self.sources, VERSION)

    @cached_property
    def sketches(self) -> DataFrame:
        """Distinct-count sketches per day and state."""
        return keyed(self.spark, f"{self.store}/sketches", lambda: geo.state_sketches(self.fact), self.sources, VERSION)

    @cached_property
    def assets(self) -> churn_model.ChurnAssets:
        """SNK5 + SNK6: the fitted churn model, its scores, drivers and metrics."""
        folder = keyed_folder(self.spark, f"{self.store}/churn", lambda root: churn_model.make_assets(self.matrix, root),
                              self.sources, VERSION)
        return churn_model.read_assets(self.spark, folder)

    def driver_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def materialize_fact(self, path: str, overwrite: bool = False) -> DataFrame:
        """SNK1 + SNK5: the fact stored at ``path``."""
        self._fact = materialize(self.spark, path, lambda: self.fresh_fact, writer=write_fact, overwrite=overwrite,
                                 sources=source_paths(self.sf_dir), key=VERSION)
        return self._fact
