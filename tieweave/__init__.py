"""tieweave: provenance-first relationship graphs on Spark.

Raw mentions and asserted ties go in; resolved entities, scored edges, ranked findings
and graph reads come out, each a function of DataFrames and an explicit as-of date.
"""
