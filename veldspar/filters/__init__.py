"""A boolean filter language over JSON metadata, compiled to Spark columns."""

from .compiler import NativeSource, VariantSource, compile_filter
from .interpreter import evaluate, matches
from .parser import parse
from .syntax import FilterSyntaxError, bind

__all__ = ["FilterSyntaxError", "NativeSource", "VariantSource", "bind", "compile_filter", "evaluate", "matches", "parse"]
