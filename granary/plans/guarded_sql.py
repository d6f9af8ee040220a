"""Read-only SQL over the scoped views of one fact set.

The text is parsed by Spark; the parsed plan may hold only query nodes, listed functions, and
as relations the four views and the names of common table expressions where they are in
scope. It runs in a session of its own that holds the views, with file relations turned off.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import column_letters
from ..operators.aggregate import evidence
from ..operators.select import long_values, scoped
from .contracts import FactSet, QueryError, Scope

LONGEST, MOST, DEFAULT = 8000, 200, 50
VIEWS = {"question_records", "question_values", "question_lineage", "question_sources"}
NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith",
    "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "LateralJoin", "UnresolvedOrdinal", "Expand", "Window",
    "UnresolvedTableValuedFunction", "Generate", "WithCTE", "CTERelationDef", "UnionLoop",
}
FUNCTIONS = set(
    "count sum avg min max coalesce nullif lower upper length trim ltrim rtrim substring substr concat concat_ws replace round floor ceil ceiling abs cast row_number rank dense_rank lag lead first_value"
    " last_value ntile string_agg listagg array_agg collect_list bool_or bool_and every some date_trunc date_part extract year month day to_date now current_date greatest least if ifnull nvl split_part"
    " left right like ilike regexp_like mod sign stddev variance percentile_cont grouping grouping_id position median any_value and or not in isnull isnotnull between date timestamp decimal string int bigint double".split()
)
NAME = re.compile(r"^[a-z][a-z0-9_]{0,62}$")


def expand_lists(sql: str, params: dict) -> tuple[str, dict]:
    """IN :name with a list becomes IN (:name_0, :name_1, ...)."""
    out: dict = {}
    for name, value in (params or {}).items():
        if not NAME.match(name) or name.startswith("__vi_"):
            raise QueryError(f"bad parameter name: {name}")
        if isinstance(value, (list, tuple)):
            if not 0 < len(value) <= MOST:
                raise QueryError("a list parameter holds 1 to 200 values")
            names = [f"{name}_{i}" for i in range(len(value))]
            sql = re.sub(rf"(?i)\bIN\s*\(?\s*:{name}\b\s*\)?", "IN (" + ", ".join(f":{n}" for n in names) + ")", sql)
            out |= dict(zip(names, value, strict=True))
        elif value is None or isinstance(value, (str, int, float, bool)):
            out[name] = value
        else:
            raise QueryError(f"bad parameter value: {name}")
    return sql, out


def validate(spark, sql: str) -> None:
    if not sql or len(sql) > LONGEST:
        raise QueryError("SQL must have 1 to 8000 characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryError(f"not one readable SELECT statement: {str(e).splitlines()[0][:200]}") from None
    read: set[str] = set()
    _walk(plan, read, frozenset())
    if not read & VIEWS:
        raise QueryError("SQL must read a question_ table")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.length())]


def _walk(plan, read: set[str], known: frozenset[str]) -> None:
    """known: the names of common table expressions that plan may read."""
    kind = plan.getClass().getSimpleName()
    if kind not in NODES:
        raise QueryError(f"not allowed in a read-only query: {kind}")
    if kind == "UnresolvedRelation":
        parts = _seq(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in VIEWS | known:
            raise QueryError(f"relation not allowed: {'.'.join(parts)}")
        read.add(parts[0].lower())
    if kind == "UnresolvedTableValuedFunction":
        raise QueryError("table functions are not allowed")
    if kind == "UnresolvedWith":
        for named in _seq(plan.cteRelations()):  # each sees those before it, and a recursive one itself
            label = named._1().lower()
            if label in VIEWS:
                raise QueryError(f"a common table expression can't be named {label}")
            _walk(named._2(), read, known | {label} if plan.allowRecursion() else known)
            known = known | {label}
    for x in _seq(plan.expressions()):
        _functions(x, read, known)
    for child in _seq(plan.children()):
        _walk(child, read, known)


def _functions(x, read: set[str], known: frozenset[str]) -> None:
    kind = x.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        parts = _seq(x.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise QueryError(f"function not allowed: {'.'.join(parts)}")
    if is_instance_of(SparkContext._gateway, x, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        _walk(x.plan(), read, known)
    for child in _seq(x.children()):
        _functions(child, read, known)


def views(facts: FactSet, scope: Scope, units: bool = True) -> dict[str, DataFrame]:
    """The four views over the fact set's records in scope; without units a query doesn't ask for their names, and they aren't joined."""
    seen = scoped(facts, scope)
    named = seen.withColumn("administrative_unit", F.col("unit_id"))
    if units and facts.units is not None:
        u = facts.units.select(F.col("unit_id"), F.col("name").alias("administrative_unit"))
        named = seen.join(u, "unit_id", "left").withColumn("administrative_unit", F.coalesce("administrative_unit", "unit_id"))
    values = long_values(facts, named, more=["administrative_unit", "record_type", "sheet_id", "source_row"], apart=True)
    lineage = facts.lineage
    if lineage is None:  # of tables: the row that the record comes from, and the field's place in it
        place = F.array_position(F.array(*map(F.lit, facts.types)), F.col("field_code")).cast("int")
        shown = F.coalesce(*[F.col(c).cast("string") for c in values.columns if c.endswith("_value")])
        cell = F.concat("sheet_id", F.lit(":r"), "source_row", F.lit(":c"), place)
        lineage = values.filter("role = ''").select("record_id", "field_code", "item_id", F.sha2("item_id", 256).alias("source_sha256"), "sheet_id", cell.alias("source_cell_id"), F.concat(column_letters(place), "source_row").alias("coordinate"), shown.alias("display_value"), F.concat(F.lit("normalized:"), "data_type", F.lit("/v1")).alias("normalizer"))
    else:
        lineage = lineage.join(seen.select("record_id", "item_id"), "record_id")
    sources = seen.groupBy("item_id").agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("unit_id").alias("unit_count"))
    if facts.sources is None:
        sources = sources.withColumns({"file_name": F.col("item_id"), "relative_path": F.col("item_id")})
    else:
        sources = sources.join(facts.sources.select("item_id", "file_name", "relative_path"), "item_id", "left")
    return {
        "question_records": named.select("record_id", "item_id", "unit_id", "administrative_unit", "record_type", "sheet_id", "region_id", "source_row", "template_version", "provenance", "created_at", "quality_status"),
        "question_values": values.drop("sheet_id", "source_row"),
        "question_lineage": lineage.withColumn("source_item_id", F.col("item_id")).select("record_id", "field_code", "source_item_id", "source_sha256", "sheet_id", "source_cell_id", "coordinate", "display_value", "normalizer"),
        "question_sources": sources,
    }


def run(facts: FactSet, scope: Scope, sql: str, params: dict | None = None, limit: int = DEFAULT) -> DataFrame:
    """The query's rows, at most min(max(limit, 1), 200), in the query's own order."""
    spark = facts.df.sparkSession
    sql, args = expand_lists(sql, params or {})
    validate(spark, sql)
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    asked = re.sub(r"\(\s*\*\s*\)", "", sql.lower())  # count(*) names no column
    for name, df in views(facts, scope, units="*" in asked or "administrative_unit" in asked).items():
        _view(session, df, name)
    return session.sql(sql, args=args or None).limit(min(max(limit, 1), MOST))


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[dict]
    truncated: bool
    record_count: int
    source_file_count: int
    unit_count: int


def ask(facts: FactSet, scope: Scope, sql: str, params: dict | None = None, limit: int = DEFAULT, seconds: float = 60.0) -> Answer:
    """run()'s rows, at most 200, on the driver, with what they rest on; an error after so many seconds.

    Evidence: the distinct records and items among the rows if they name them; else the counts
    that a single row gives itself; else those of all the fact set's records in scope.
    """
    most = min(max(limit, 1), MOST)
    context = facts.df.sparkSession.sparkContext
    tag, late = f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        df = run(facts, scope, sql, params, limit)
        rows = [r.asDict() for r in df.collect()]
        if late.is_set():
            raise QueryError(f"the query took more than {seconds:g} seconds")
        records, items = ({str(r[c]) for r in rows if r.get(c) not in (None, "")} for c in ("record_id", "item_id"))
        one = rows[0] if len(rows) == 1 else {}
        own = {c: one[c] for c in ("record_count", "source_file_count", "unit_count") if type(one.get(c)) is int}
        found = {"record_count": len(records), "source_file_count": len(items)}
        found = {c: n for c, n in found.items() if n} | own
        if len(found) < 3:
            found = evidence(scoped(facts, scope), stored=facts.stored).first().asDict() | found
        return Answer(df.columns, rows, len(rows) >= most, found["record_count"], found["source_file_count"], found["unit_count"])
    except QueryError:
        raise
    except Exception as e:
        if late.is_set():
            raise QueryError(f"the query took more than {seconds:g} seconds") from None
        raise QueryError(str(e).splitlines()[0][:300]) from None
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def _view(session, df: DataFrame, name: str) -> None:
    """Register df's logical plan as a view of another session."""
    jdf = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
    jdf.createOrReplaceTempView(name)
