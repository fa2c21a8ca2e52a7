"""Guards for generated queries: only reads pass."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.functions.columns import strip

#: First words of a read, and words that change something; fixed values.
READS = ("MATCH", "CALL")
WRITES = ("CREATE", "DELETE", "DROP", "SET", "MERGE", "REMOVE", "DETACH")
_QUOTED = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'"
_HOPS = r"\[[^\]]*\*[^\]]*\]"


class ReadOnlyError(ValueError):
    """A generated query that is more than a read."""


def check_graph_query(text: str) -> None:
    """Raise unless a graph query starts as a read, holds no word of change outside quotes and no path of unbounded length."""
    bare = re.sub(_QUOTED, "''", text)
    if not bare.strip().upper().startswith(READS):
        raise ReadOnlyError("a query starts with MATCH or CALL")
    for word in re.findall(r"[A-Za-z]+", bare):
        if word.upper() in WRITES:
            raise ReadOnlyError(f"the query would write: {word.upper()}")
    if re.search(_HOPS, text):
        raise ReadOnlyError("the query has a path of unbounded length")


def is_read(text: Column) -> Column:
    """The same test as a column."""
    bare = F.regexp_replace(text, _QUOTED, "''")
    starts = F.upper(strip(bare)).rlike("^(" + "|".join(READS) + ")")
    writes = F.upper(bare).rlike("(^|[^A-Z])(" + "|".join(WRITES) + ")([^A-Z]|$)")
    return starts & ~writes & ~text.rlike(_HOPS)


#: Plan nodes of a read.
NODES = (
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation", "Generate",
    "WithWindowDefinition", "Pivot", "Unpivot", "UnresolvedHint", "Expand", "LocalRelation", "UnresolvedOrderByAll",
)
#: Expressions of a read. What the parser can make beside these, such as a function whose name is itself computed, is refused.
EXPRESSIONS = (
    "Add", "Alias", "And", "AttributeReference", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "BitwiseXor", "CaseWhen", "Cast", "Coalesce", "Collate", "Concat", "CreateNamedStruct", "Cube", "CurrentRow", "Divide",
    "EqualNullSafe", "EqualTo", "Exists", "GreaterThan", "GreaterThanOrEqual", "GroupingSets", "ILike", "In", "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LambdaFunction", "LateralSubquery", "LessThan",
    "LessThanOrEqual", "Like", "LikeAll", "LikeAny", "ListQuery", "Literal", "MultiAlias", "Multiply", "NamedParameter", "Not", "NotLikeAll", "NotLikeAny", "Or", "RLike", "Remainder", "Rollup", "ScalarSubquery",
    "SortOrder", "SpecifiedWindowFrame", "StringLocate", "StringTrim", "StringTrimBoth", "StringTrimLeft", "StringTrimRight", "Substring", "Subtract", "UnaryMinus", "UnaryPositive", "UnboundedFollowing",
    "UnboundedPreceding", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedCollation", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal",
    "UnresolvedStar", "UnresolvedStarExceptOrReplace", "UnresolvedWindowExpression", "UnspecifiedFrame", "WindowExpression", "WindowSpecDefinition",
)
#: Functions of rows alone. A name that is not here is refused, whoever registered it.
FUNCTIONS = frozenset("""
    any any_value approx_count_distinct approx_percentile avg bool_and bool_or collect_list collect_set corr count count_if covar_pop covar_samp every first first_value grouping grouping_id kurtosis last last_value
    listagg max max_by mean median min min_by mode percentile percentile_approx percentile_cont percentile_disc regr_slope skewness some std stddev stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    abs acos asin atan atan2 bround cbrt ceil ceiling cos degrees exp floor greatest least ln log log10 log2 mod nanvl negative pmod pow power radians rint round sign signum sin sqrt tan try_add try_divide try_multiply try_subtract
    between coalesce if ifnull isnan isnotnull isnull nullif nvl nvl2 zeroifnull
    ascii btrim char char_length character_length concat concat_ws contains endswith format_number initcap instr lcase left length levenshtein like locate lower lpad ltrim overlay position regexp_count regexp_extract
    regexp_extract_all regexp_instr regexp_like regexp_replace replace reverse right rlike rpad rtrim soundex split split_part startswith substr substring substring_index translate trim ucase upper
    add_months date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract from_unixtime hour last_day make_date minute month months_between next_day quarter second to_date
    to_timestamp trunc unix_timestamp weekofyear year
    aggregate array array_contains array_distinct array_join array_max array_min array_size array_sort cardinality element_at exists explode explode_outer filter flatten forall get inline inline_outer json_tuple map map_keys
    map_values named_struct posexplode posexplode_outer range size slice sort_array stack struct transform zip_with
""".split())
GENERATORS = ("explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "range", "json_tuple")


def _seq(found) -> list:
    return [found.apply(k) for k in range(found.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def _expressions(plan) -> list:
    """Every expression of one node, those of its named windows included."""
    todo, found = _seq(plan.expressions()), []
    if _kind(plan) == "WithWindowDefinition":
        todo += _seq(plan.windowDefinitions().values().toSeq())
    while todo:
        e = todo.pop()
        found.append(e)
        todo += _seq(e.children())
    return found


def _check_expression(e) -> None:
    kind = _kind(e)
    if kind not in EXPRESSIONS:
        raise ReadOnlyError(f"the query has what is not known to be harmless: {kind}")
    name = None
    if kind == "UnresolvedFunction":
        name = [x.lower() for x in _seq(e.nameParts())]
    elif kind == "UnresolvedGenerator":
        name = e.name().unquotedString().lower().split(".")
    if name is not None and (len(name) > 1 or name[0] not in FUNCTIONS):
        raise ReadOnlyError(f"the query calls {'.'.join(name)}")


def _check(plan, may_read, named: frozenset[str]) -> None:
    """Raise unless a node and all below it only read. ``named``: the common table expressions that can be seen from here."""
    kind = _kind(plan)
    if kind == "UnresolvedTableValuedFunction":
        if (name := ".".join(_seq(plan.name())).lower()) not in GENERATORS:
            raise ReadOnlyError(f"the query calls {name}")
    elif kind not in NODES:
        raise ReadOnlyError(f"the query is more than a read: {kind}")
    if kind == "UnresolvedRelation":
        parts = [x.lower() for x in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or not (parts[0] in named or may_read(parts[0])):
            raise ReadOnlyError(f"the query reads {'.'.join(parts)}, which is no table by a plain name")
    for e in _expressions(plan):
        _check_expression(e)
        if _kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            _check(e.plan(), may_read, named)
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            raise ReadOnlyError("the query is recursive")
        for cte in _seq(plan.cteRelations()):  # each sees those before it, not itself
            _check(cte._2(), may_read, named)
            named |= {cte._1().lower()}
    for below in _seq(plan.children()):
        _check(below, may_read, named)


def check_read(spark: SparkSession, sql: str, tables: set[str] | None = None) -> None:
    """Raise unless every node of a generated query reads, from tables known by a plain name, with expressions and functions that are known to be of rows only.

    ``tables``: the names that may be read; None: the session's tables and
    views. A common table expression is seen where SQL sees it and hides a
    table only there. What the parser may come to make is refused until it is
    listed here.
    """
    allowed = None if tables is None else {t.lower() for t in tables}
    _check(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), lambda name: spark.catalog.tableExists(name) if allowed is None else name in allowed, frozenset())


def run_read(spark: SparkSession, sql: str, k: int, cap: int = 200, tables: set[str] | None = None, args: dict | None = None) -> DataFrame:
    """Run generated SQL if the whole of its parsed plan only reads; ``min(k, cap)`` rows at most. ``args``: values of its named parameters."""
    check_read(spark, sql, tables)
    return spark.sql(sql, args=args).limit(min(k, cap))


def run_reads(spark: SparkSession, sql: str, k: int, cap: int = 200, tables: set[str] | None = None, args: dict | None = None) -> DataFrame:
    """Run generated statements, parted by ``;``, of which each only reads; the rows of the last, ``min(k, cap)`` at most. One statement is :func:`run_read`.

    They are parsed as one script that may hold plain statements only: no
    variables, branches, loops, handlers or scripts inside it.
    """
    parser = spark._jsparkSession.sessionState().sqlParser()
    script = f"BEGIN\n{sql}\nEND"
    try:
        body = parser.parsePlan(script)
    except ParseException:  # the last statement isn't ended
        script = f"BEGIN\n{sql}\n;\nEND"
        body = parser.parsePlan(script)
    statements = _seq(body.collection()) if _kind(body) == "CompoundBody" else []
    if not statements or any(_kind(s) != "SingleStatement" for s in statements) or not body.handlers().isEmpty() or not body.conditions().isEmpty():
        raise ReadOnlyError("the script holds more than plain statements")
    allowed = None if tables is None else {t.lower() for t in tables}
    for s in statements:
        _check(s.parsedPlan(), lambda name: spark.catalog.tableExists(name) if allowed is None else name in allowed, frozenset())
    return spark.sql(script, args=args).limit(min(k, cap))
