"""Which retrieval a question asks for, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bare_identifier

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_S = r"[\s  -     　﻿]+"
_NAME = r"[`'\"]?([A-Za-z_$][A-Za-z0-9_.$]*)[`'\"]?"
_PATH = r"(/[^\s\"'`?]+)"


def _rx(pattern: str) -> str:
    return "(?i)" + pattern


# The wordings that are recognised, in the order in which they are tried.
CALLERS = [rf"{_B}(?:what|who|which{_S}functions?){_S}calls?{_S}{_NAME}", rf"{_B}callers?{_S}(?:of|for){_S}{_NAME}"]
CALLEES = [
    rf"{_B}what{_S}does{_S}{_NAME}{_S}(?:call|depend{_S}on|use){_E}",
    rf"{_B}what{_S}(?:functions?|methods?){_S}does{_S}{_NAME}{_S}(?:call|use|depend{_S}on){_E}",
    rf"{_B}dependencies{_S}(?:of|for){_S}{_NAME}",
]
IMPACT = [rf"{_B}(?:if{_S}i{_S}change|what{_S}breaks{_S}if{_S}i{_S}change|change{_S}impact{_S}for){_S}{_NAME}", rf"{_B}(?:what{_S}is{_S}affected{_S}by|impact{_S}of|affected{_S}by){_S}{_NAME}"]
DIRECT = [rf"{_B}what{_S}does{_S}{_NAME}{_S}do{_E}", rf"{_B}explain{_S}{_NAME}{_E}"]
FILE = rf"{_B}([A-Za-z0-9_./\\-]+\.(?:ts|tsx|js|jsx)){_E}"
FILE_ASKED = rf"{_B}(?:what'?s|what{_S}is|show|list|inside|in|contents?){_E}"
ROUTE_METHOD = rf"{_B}(GET|POST|PUT|DELETE|PATCH|ALL|USE){_S}{_PATH}"
ROUTE = [rf"(?:route|endpoint){_S}{_PATH}", r"(/api/[^\s\"'`?]+)"]
TYPE = [rf"{_B}(?:type|interface|enum){_S}[`'\"]?([A-Za-z_$][A-Za-z0-9_$]*)[`'\"]?", rf"{_B}what{_S}is{_S}the{_S}[`'\"]?([A-Z][A-Za-z0-9_$]*)[`'\"]?{_S}(?:type|interface|enum){_E}"]
LISTS = [
    ("routes", rf"{_B}routes?{_E}", rf"{_B}what{_S}calls?{_E}"),
    ("types", rf"{_B}types?{_E}", rf"{_B}what{_S}(?:is|are){_S}the{_E}|{_B}calls?{_E}"),
    ("types", rf"{_B}(?:interfaces?|enums?){_E}", rf"{_B}calls?{_E}"),
    ("files", rf"{_B}(?:files?|modules?){_E}", rf"{_B}what(?:'s|{_S}is){_E}|{_B}calls?{_E}"),
    ("constants", rf"{_B}constants?{_E}", rf"{_B}calls?{_E}"),
]

FIELDS = ["strategy", "function_name", "keywords", "domain", "direction", "type_name", "file_path", "route_path", "route_method", "list_entity"]


def _first(question: Column, patterns: list[str], group: int = 1) -> Column:
    """The group's text of the first pattern that matches, or null."""
    return F.coalesce(*[F.when(F.rlike(question, F.lit(_rx(p))), F.regexp_extract(question, _rx(p), group)) for p in patterns])


def _result(**fields: Column) -> Column:
    keywords = F.array().cast("array<string>")
    return F.struct(*[(keywords if f == "keywords" else fields.get(f, F.lit(None).cast("string"))).alias(f) for f in FIELDS])


def classified(question: Column) -> Column:
    """A struct of `FIELDS`, or null when no wording is recognised (then a model would be asked)."""
    q = F.trim(question)
    low = F.lower(q)
    name = lambda patterns: bare_identifier(_first(q, patterns))
    is_one = lambda patterns: F.lit(True) == F.coalesce(*[F.when(F.rlike(q, F.lit(_rx(p))), F.lit(True)) for p in patterns], F.lit(False))
    path = _first(q, [FILE])
    listed = F.coalesce(*[F.when(F.rlike(low, F.lit(_rx(yes))) & ~F.rlike(low, F.lit(_rx(no))), F.lit(what)) for what, yes, no in LISTS])
    return (
        F.when(is_one(CALLERS), _result(strategy=F.lit("relationship"), function_name=name(CALLERS), direction=F.lit("callers")))
        .when(is_one(CALLEES), _result(strategy=F.lit("relationship"), function_name=name(CALLEES), direction=F.lit("callees")))
        .when(is_one(IMPACT), _result(strategy=F.lit("impact"), function_name=name(IMPACT)))
        .when(is_one(DIRECT), _result(strategy=F.lit("direct"), function_name=name(DIRECT)))
        .when(path.isNotNull() & is_one([FILE_ASKED]), _result(strategy=F.lit("file"), file_path=path))
        .when(is_one([ROUTE_METHOD]), _result(strategy=F.lit("route"), route_method=F.upper(_first(q, [ROUTE_METHOD])), route_path=_first(q, [ROUTE_METHOD], 2)))
        .when(is_one(ROUTE), _result(strategy=F.lit("route"), route_path=_first(q, ROUTE)))
        .when(is_one(TYPE), _result(strategy=F.lit("type"), type_name=name(TYPE)))
        .when(listed.isNotNull(), _result(strategy=F.lit("list"), list_entity=listed))
    )


def with_classification(questions: DataFrame, question: Column, name: str = "c") -> DataFrame:
    """`questions` with the struct of `classified`, worked out once however many of its fields are used."""
    return questions.select("*", F.explode(F.array(classified(question))).alias(name))


def fallback_keywords(question: Column) -> Column:
    """Words of more than three characters, for questions that neither wording nor model settles."""
    return F.filter(F.split(question, r"(?U)\s+"), lambda w: F.length(w) > 3)
