"""MinHash near-duplicates: SuperMinHash signatures, bands, exact comparison, groups by union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import near_copies


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, at_least: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    A row's set holds the distinct runs of `shingle` words of its text, A-Z
    lower-cased; a text of fewer words is one run.  Rows are linked where the sets
    share at least that part of their distinct runs; candidates come from the bands
    of the signatures, and each link is confirmed on the whole sets.  component_id
    is the least id that links reach, the row's own included; rows with that id are
    kept.

    Rows without words, null texts among them, have an empty set, are linked with
    nothing and kept.  A null id is passed over as a component's least id unless
    there is no other: then component_id is null and the rows are kept.  Repeated
    rows are linked, as their sets are equal; other columns are ignored; an empty
    table gives an empty result.
    """
    found = near_copies(df, id_col, text_col, shingle, at_least, radius=None)
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_shingles", "component_id", "kept")
