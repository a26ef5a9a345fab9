"""Spark-native media-preference feature and scoring engine.

Every operator is a ``DataFrame -> DataFrame`` function (use it with
``df.transform``) or a ``Column -> Column`` helper.  Artifacts (normalisation
table, category schema, vocabularies, tree nodes, registry rows) are plain
tables; the small, bounded ones are frozen into a driver-side :class:`Bundle`
that is turned into literal projections and one broadcast tree array.
"""

from mediascore.bundle import ArtifactError, Bundle  # noqa: F401

__all__ = ["ArtifactError", "Bundle"]
