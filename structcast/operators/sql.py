"""The extraction as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.readings import Fenced, Mended, Options, Readings, readings, shown
from .extract import Extractor


def _candidate(v: object) -> tuple[str, str | None, list[str], str]:
    wrapper, tag, fixes = "plain", None, []
    while isinstance(v, (Fenced, Mended)):
        if isinstance(v, Fenced):
            wrapper, tag = "fenced", v.tag
        else:
            wrapper, fixes = "mended" if wrapper == "plain" else wrapper, list(v.fixes)
        v = v.value
    return wrapper, tag, fixes, shown(v)


@F.udtf(returnType="ord int, wrapper string, tag string, fixes array<string>, value string")
class ParseCandidates:
    """All readings of a text, a row each."""

    def eval(self, text: str):
        if text is not None:
            found = readings(text, Options())
            for k, v in enumerate(found.values if isinstance(found, Readings) else [found]):
                yield (k, *_candidate(v))


def register(spark: SparkSession, extractors: dict[str, Extractor]) -> None:
    """Each extractor as a function of a text under its name, over Arrow batches, and parse_candidates as a table function."""
    for name, own in extractors.items():
        spark.udf.register(name, own.kernel())
    spark.udtf.register("parse_candidates", ParseCandidates)
