"""What a statement reads and calls, taken from its parsed plan, and who may.

Spark's parser decides what is a table, a function or a name of the statement's own; nothing is resolved, so no
file is opened and no catalog asked before a statement is allowed. Common table expressions count as
the statement's own only where they are in scope."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
_UNRESOLVED = "org.apache.spark.sql.catalyst.analysis."
#: Table functions that make rows out of their arguments alone.
TABLE_FUNCTIONS = frozenset(
    "range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split()
)
_TABLES = tuple(_UNRESOLVED + name for name in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedView"))
_FUNCTIONS = (_UNRESOLVED + "UnresolvedFunction", _UNRESOLVED + "UnresolvedGenerator")
_TABLE_FUNCTION = _UNRESOLVED + "UnresolvedTableValuedFunction"


@dataclass
class Uses:
    """Names that a statement uses, parts as written; ``commands`` and ``scripts`` are class names of its plan."""

    tables: list[tuple[str, ...]] = field(default_factory=list)
    functions: set[str] = field(default_factory=set)
    table_functions: set[str] = field(default_factory=set)
    commands: list[str] = field(default_factory=list)
    scripts: list[str] = field(default_factory=list)


def uses(spark: SparkSession, sql: str) -> Uses:
    found = Uses()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _Walk(spark.sparkContext._gateway, found).visit(plan, frozenset())
    return found


class _Walk:
    """Every part of a plan: children, expressions, subqueries and whatever else a node was made of."""

    def __init__(self, gateway, found: Uses):
        self.gateway, self.found = gateway, found

    def _is(self, thing: JavaObject, name: str) -> bool:
        return is_instance_of(self.gateway, thing, name)

    def visit(self, thing: object, own: frozenset[str]) -> None:
        if not isinstance(thing, JavaObject):
            return
        if self._is(thing, "scala.collection.Iterable") or self._is(thing, "scala.Option"):
            for item in self._items(thing):
                self.visit(item, own)
        elif self._is(thing, "scala.Product"):
            kind = thing.getClass().getName()
            if kind == _PLANS + "UnresolvedWith":
                self._with(thing, own)
                return
            self._note(thing, kind, own)
            for i in range(thing.productArity()):
                self.visit(thing.productElement(i), own)

    def _items(self, thing: JavaObject) -> Iterator[object]:
        each = thing.iterator()
        while each.hasNext():
            yield each.next()

    def _with(self, plan: JavaObject, own: frozenset[str]) -> None:
        recursive = plan.allowRecursion()
        for named in self._items(plan.cteRelations()):
            name = named.productElement(0).lower()
            self.visit(named.productElement(1), own | {name} if recursive else own)
            own = own | {name}
        self.visit(plan.child(), own)

    def _note(self, thing: JavaObject, kind: str, own: frozenset[str]) -> None:
        if kind in _TABLES:
            name = tuple(self._items(thing.multipartIdentifier()))
            if not (len(name) == 1 and name[0].lower() in own):
                self.found.tables.append(name)
        elif kind == _TABLE_FUNCTION:
            self.found.table_functions.add(".".join(self._items(thing.name())).lower())
        elif kind in _FUNCTIONS:
            name = thing.nameParts() if kind.endswith("Function") else thing.name()
            self.found.functions.add(".".join(self._items(name) if isinstance(name, JavaObject) and self._is(name, "scala.collection.Iterable") else [str(name)]).lower())
        elif kind.endswith("ScriptTransformation"):
            self.found.scripts.append(kind)
        elif kind.startswith(_UNRESOLVED) and kind.endswith(("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier")):
            self.found.scripts.append(kind)  # a name put together when the statement runs
        if self._is(thing, _PLANS + "Command"):
            self.found.commands.append(kind)


def quoted(name: tuple[str, ...]) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name)


def is_table(spark: SparkSession, name: tuple[str, ...]) -> bool:
    """Whether the catalog has a table or view of that name; a path behind a format is none."""
    return spark.catalog.tableExists(quoted(name))


Rule = Callable[[str], bool]


def names(*allowed: str) -> Rule:
    """A rule that allows tables by name, upper and lower case being equal."""
    known = frozenset(name.lower() for name in allowed)
    return lambda name: name.lower() in known
