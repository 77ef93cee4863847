"""Typed, validated data from messy text, in Spark.

    from structcast import Extractor
    people = Extractor({"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}, "required": ["name", "age"]})
    df.transform(people.into("answer")).select("answer", "shaped.data.*", "shaped.score")
"""

from .functions.readings import Options, readings
from .operators.extract import Extractor, Shaped, ShapedError, extract, extract_into, feedback, quality_rollup, ruled
from .plans.compiler import compile_schema
from .operators.sql import register
from .plans.prompt import Style, prompt
from .streaming.streams import TextStream, live, replay

__all__ = ["Extractor", "Options", "Shaped", "ShapedError", "Style", "TextStream", "compile_schema", "extract", "extract_into", "feedback", "live", "prompt", "quality_rollup", "readings", "register", "replay", "ruled"]
