"""Who may read what: table rules, column masks, and guarded ad-hoc queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.fixed_values import ACCESS_POLICIES, ADHOC_ROW_CAP, MASK
from tidemart.session import pin_utc
from tidemart.sources import tables

OWNER = "owner"  # asks about all tables of a layer, not only those of a policy


def allowed_tables(role: str) -> list[str]:
    if role not in ACCESS_POLICIES:
        raise PermissionError(f"unknown role: {role}")
    return ACCESS_POLICIES[role]["allowed_tables"]


def mask(df: DataFrame, role: str) -> DataFrame:
    """Hidden columns hold a fixed text, whatever their type, so a sum over them fails or is null."""
    allowed_tables(role)
    hidden = [c for c in ACCESS_POLICIES[role]["masked_columns"] if c in df.columns]
    return df.withColumns({c: F.lit(MASK) for c in hidden}) if hidden else df


def secure_table(layer: Mapping[str, DataFrame], table: str, role: str = "analyst") -> DataFrame:
    if table not in allowed_tables(role):
        raise PermissionError(f"role {role} may not read {table}")
    return mask(layer[table], role)


#: What a reading statement's plan is made of. Everything else (commands, scripts, table functions, …) is refused.
PLAN_NODES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LocalLimit", "LocalRelation",
    "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving",
    "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Window",
    "WithWindowDefinition",
}
#: Groups of Spark's functions that compute on values. Those of other groups call into the virtual machine (reflect), tell
#: about files and sessions (input_file_name, current_user), read foreign formats, or make rows; they are refused.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs",
    "window_funcs",
}
#: Expressions of a resolved plan that are no function's own class: structure, and what functions with variants resolve to.
STRUCTURE = {
    "AggregateExpression", "Alias", "AttributeReference", "CaseWhen", "Cast", "Ceil", "Contains", "CurrentRow",
    "DateAddInterval", "DateAddYMInterval", "DatetimeSub", "DivideDTInterval", "DivideYMInterval", "EndsWith", "Exists",
    "Explode", "ExtractANSIIntervalDays", "ExtractANSIIntervalHours", "ExtractANSIIntervalMinutes",
    "ExtractANSIIntervalMonths", "ExtractANSIIntervalSeconds", "ExtractANSIIntervalYears", "Floor", "GeneratorOuter",
    "GetArrayItem", "GetArrayStructFields", "GetMapValue", "GetStructField", "In", "InSubquery", "Inline",
    "LambdaFunction", "LateralSubquery", "LikeAll", "LikeAny", "ListQuery", "Literal", "MakeTimestamp", "Mode",
    "MultiAlias", "MultiplyDTInterval", "MultiplyYMInterval", "NamedLambdaVariable", "NotLikeAll", "NotLikeAny",
    "OuterReference", "PercentileCont", "PercentileDisc", "PivotFirst", "PosExplode", "PrettyAttribute", "RoundCeil",
    "RoundFloor", "ScalarSubquery", "SortOrder", "SpecifiedWindowFrame", "StartsWith", "StringLPad", "StringRPad",
    "SubtractDates", "SubtractTimestamps", "TimestampAdd", "TimestampAddInterval", "TimestampAddYMInterval",
    "TimestampDiff", "ToCharacter", "UnaryPositive", "UnboundedFollowing", "UnboundedPreceding", "UnspecifiedFrame",
    "WindowExpression", "WindowSpecDefinition",
}
_INHERITS = "org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules"
_known: dict[str, dict[str, str]] = {}


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(node, names: set[str], functions: Mapping[str, str]) -> None:
    """Refuse what is not allowed in a parsed plan or in the subqueries of its expressions."""
    kind = node.getClass().getSimpleName().rstrip("$")
    if kind not in PLAN_NODES:
        raise ValueError(f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        # named results are known from here on, to each other too
        relations = list(_each(node.cteRelations()))
        names = names | {r._1().lower() for r in relations}
        for r in relations:
            _walk(r._2(), names, functions)
    if kind == "UnresolvedRelation":
        parts = list(_each(node.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in names:
            raise ValueError(f"unknown table: {'.'.join(parts)}")
    for expression in _each(node.expressions()):
        _walk_expression(expression, names, functions)
    for child in _each(node.children()):
        _walk(child, names, functions)


def _walk_expression(expression, names: set[str], functions: Mapping[str, str]) -> None:
    """Refuse names that are worked out later (``identifier(...)``), and qualified functions; look into subqueries."""
    kind = expression.getClass().getSimpleName()
    if kind.startswith(("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier")):
        raise ValueError("identifier(...) is not allowed")
    if kind == "UnresolvedFunction":
        parts = list(_each(expression.nameParts()))
        if len(parts) != 1 or parts[0].lower() not in functions:
            raise ValueError(f"{'.'.join(parts)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _walk(expression.plan(), names, functions)
    for child in _each(expression.children()):
        _walk_expression(child, names, functions)


def _functions(spark: SparkSession) -> dict[str, str]:
    """Spark's own functions of the allowed groups by name, with the class that each resolves to."""
    if spark.version not in _known:
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        found = ((f.funcName(), registry.lookupFunction(f)) for f in _each(registry.listFunction()))
        _known[spark.version] = {
            name: info.get().getClassName().rsplit(".", 1)[-1] for name, info in found
            if info.isDefined() and info.get().getGroup() in FUNCTION_GROUPS}
    return _known[spark.version]


def _judge(spark: SparkSession, plan, allowed: set[str]) -> None:
    """Refuse a resolved plan that holds an expression which is not on the list, in subqueries too."""
    for expression in _each(plan.expressions()):
        _judge_expression(spark, expression, allowed)
    for child in _each(plan.children()):
        _judge(spark, child, allowed)


def _judge_expression(spark: SparkSession, expression, allowed: set[str]) -> None:
    kind = expression.getClass().getSimpleName().rstrip("$")
    if kind not in allowed:
        raise ValueError(f"{kind} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _judge(spark, expression.plan(), allowed)
    # what Spark puts in place of a function is its own affair; what the query gave the function is judged
    replaced = is_instance_of(spark.sparkContext._gateway, expression, _INHERITS)
    for child in _each(expression.parameters() if replaced else expression.children()):
        _judge_expression(spark, child, allowed)


def validate(spark: SparkSession, sql: str, names: Iterable[str]) -> str:
    """``sql`` if it is one reading statement over ``names`` only, with functions that compute on values; ValueError otherwise.

    The parsed plan is judged, not the words, so a column may be called "update" and a script or a foreign table is
    refused however it is written.
    """
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as problem:
        raise ValueError(f"not one reading statement: {str(problem)[:200]}") from problem
    _walk(plan, {n.lower() for n in names}, _functions(spark))
    return text


def guarded_sql(spark: SparkSession, root: str, sql: str, role: str = "manager", cap: int = ADHOC_ROW_CAP) -> DataFrame:
    """Run one reading query over the layer at ``root`` as ``role`` sees it; at most ``cap`` rows.

    The query runs in a session of its own that knows only the role's tables, masked. ``OWNER`` sees every table of the
    layer as it is. Before it runs, the resolved plan is held against the list of allowed expressions. The cap is part of the plan, so no more than that is ever fetched.
    """
    own = pin_utc(spark.newSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    layer = tables.layer(own, root)
    seen = {n: layer[n] for n in layer} if role == OWNER else {n: mask(layer[n], role) for n in allowed_tables(role) if n in layer}
    text = validate(own, sql, seen)
    tables.register_views(seen)
    try:
        found = own.sql(text)  # resolved, not run
    except AnalysisException as problem:
        raise ValueError(f"not a query over the role's tables: {str(problem)[:200]}") from problem
    _judge(own, found._jdf.queryExecution().analyzed(), set(_functions(own).values()) | STRUCTURE)
    return found.limit(cap)
