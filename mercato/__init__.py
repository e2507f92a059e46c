"""mercato: e-commerce order analytics as Spark DataFrame jobs.

Layout:
    sources/    logical source tables, their schemas, readers, sinks, materialisation
    functions/  column-level rules shared by every analytic (day counts, bins, nulls, ties)
    operators/  cleaning, the fact build and the named analytics (DataFrame -> DataFrame)
    plans/      the query catalogue: one callable per named query over a data directory
"""

__version__ = "0.1.0"
