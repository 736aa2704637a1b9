"""SQL steps: header, statement check, and inputs bound as temp views of a session of their own."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

from .context import CURRENT, Binding
from .names import StoreError, valid_name
from .operators.sampling import dealt


@dataclass(frozen=True)
class Script:
    inputs: tuple[str, ...]
    output: str | None
    body: str


def parse(text: str) -> Script:
    """Split a script into what its leading comments declare (``-- @inputs: a, b``, ``-- @output: x``) and its body."""
    inputs: tuple[str, ...] | None = None
    output = None
    lines = text.splitlines()
    for line in lines:
        bare = line.strip()
        if not bare:
            continue
        if not bare.startswith("--"):
            break
        found = re.match(r"--\s*@(\w+)\s*(:?)(.*)$", bare)
        if not found:
            continue
        key, colon, rest = found[1], found[2], found[3].strip()
        if key not in ("inputs", "output"):
            raise StoreError(f"unknown header @{key}: there are @inputs and @output")
        if not colon or not rest:
            raise StoreError(f"@{key} is written as '-- @{key}: name'")
        if key == "inputs":
            if inputs is not None:
                raise StoreError("@inputs is there twice")
            inputs = tuple(valid_name(x.strip()) for x in rest.split(","))
            if len(set(inputs)) < len(inputs):
                raise StoreError("@inputs names something twice")
        else:
            if output is not None:
                raise StoreError("@output is there twice")
            output = valid_name(rest)
    body = text.strip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    return Script(inputs or (), output, body)


def without_comments(body: str) -> str:
    """The body without comments; quoted text is left alone."""
    return re.sub(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", body, flags=re.S)


def check(store, body: str) -> None:
    """Refuse what is not one query: empty bodies, commands, several statements. Nothing is run."""
    bare = without_comments(body).strip()
    if not bare:
        raise StoreError("the SQL body is empty")
    if not re.match(r"(select|with)\b", bare, re.I):
        raise StoreError("a SQL step is one SELECT, or WITH ... SELECT")
    try:
        plan = store.spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except ParseException as e:
        raise StoreError(f"the SQL body can't be parsed as one query: {e}") from None
    except Exception as e:  # py4j hands some parser errors through as they are
        if "Parse" not in type(e).__name__ and "Parse" not in str(e):
            raise
        raise StoreError(f"the SQL body can't be parsed as one query: {e}") from None
    _only_queries(plan)


def _only_queries(plan) -> None:
    kind = plan.getClass().getSimpleName()
    if re.search(r"Command|Insert|Create|Drop|Delete|Merge|Update|Replace|Write", kind) and not kind.startswith("SubqueryAlias"):
        raise StoreError(f"a SQL step reads; it can't run {kind}")
    children = plan.children()
    for k in range(children.size()):
        _only_queries(children.apply(k))


def named_in(store, body: str) -> list[str]:
    """Names of the store that stand in a body as words outside quoted text and comments."""
    words = set(re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.|'')*'", " ", without_comments(body))))
    return sorted(store.log.known(words))


def bind(store, names) -> dict[str, Binding]:
    """What each name stands for now: its rebinding in the running step, or its newest value."""
    run = CURRENT.get()
    out = {}
    for name in names:
        bound = run.bindings.get(name) if run else None
        shape = store.log.shape(name)
        if shape is None:
            raise StoreError(f"nothing is stored as {name}")
        if bound:
            out[name] = bound
        elif shape == "append":
            newest = store.newest_append_run(name)
            if newest is None:
                raise StoreError(f"{name} has no rows")
            out[name] = Binding(name, "append", store.chunk_hash(name, newest), newest, "latest", None)
        else:
            v = store.version_row(name)
            out[name] = Binding(name, "versioned", v["content_hash"], None, "latest", None)
        if shape == "versioned" and store.log.versions[name, out[name].hash]["kind"] == "artifact":
            raise StoreError(f"{name} is an object; a query reads tables and views")
    return out


def binding_of(record: dict) -> Binding:
    return Binding(record["name"], record["shape"], record["hash"], record["filter_value"], record["source"], record["value"])


def rows_of(store, b: Binding) -> DataFrame:
    if b.shape == "append":
        return store.append_rows(b.name, b.run_id)
    if (b.name, b.hash) not in store.log.versions:
        raise StoreError(f"{b.name} has no version {b.hash}")
    return store.value_of(store.log.versions[b.name, b.hash])


def frame_of(store, body: str, bound: dict[str, Binding]) -> DataFrame:
    """The body's result over its inputs. They are temp views of a new session, so no name in the text is ever rewritten."""
    from .store import _view_in

    check(store, body)
    session = store.spark.newSession()
    for name, b in bound.items():
        _view_in(session, name, rows_of(store, b))
    run = CURRENT.get()
    if not run or run.seed is None:
        return session.sql(body)
    text = seeded(body, run.seed)
    df = session.sql(text)
    plan = df._jdf.queryExecution().analyzed()
    _only_governed(store, body, plan)
    drawn = _drawn_from(plan, frozenset(bound))
    for name in drawn:
        _view_in(session, name, dealt(rows_of(store, bound[name])))
    return session.sql(text) if drawn else df


#: Expressions that a seed does not govern although Spark holds them for deterministic within a query: clocks.
_CLOCKS = {"CurrentTimestamp", "CurrentDate", "CurrentTime", "LocalTimestamp", "Now", "CurrentBatchTimestamp"}


def _only_governed(store, body: str, plan) -> None:
    """Refuse what the seed of a step can't make the same again: chance other than rand() and randn(), clocks, numbers of partitions and samples without a seed of their own."""
    for name in _ungoverned(plan):
        raise StoreError(f"a seeded SQL step can't use {name}: it is another on every run")
    parser = store.spark._jsparkSession.sessionState().sqlParser()
    # A sample without REPEATABLE is given a seed by chance whenever it is parsed.
    if len({tuple(_sample_seeds(parser.parsePlan(body))) for _ in range(6)}) > 1:
        raise StoreError("a seeded SQL step can't use TABLESAMPLE without REPEATABLE: it is another on every run")


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _plans(plan, inputs: frozenset[str] = frozenset()):
    """A plan and all below it, subqueries and common tables included, but not what lies below the views of inputs."""
    yield plan
    if _input_of(plan, inputs) is None:
        for child in [*_items(plan.children()), *_items(plan.innerChildren())]:
            yield from _plans(child, inputs)


def _input_of(plan, inputs) -> str | None:
    """The input whose view a plan is."""
    name = plan.desc().identifier().unquotedString() if _kind(plan) == "View" else None
    return name if name in inputs else None


def _ungoverned(plan):
    for node in _plans(plan):
        for expression in _items(node.expressions()):
            yield from _chance_in(expression)


def _chance_in(expression):
    """Names of the calls in an expression that are chance by themselves, not by what is within them."""
    kind, children = expression.getClass().getSimpleName(), _items(expression.children())
    subquery = kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")  # its plan is looked at by itself
    if kind in _CLOCKS or not subquery and kind not in ("Rand", "Randn") and not expression.deterministic() and all(c.deterministic() for c in children):
        yield expression.prettyName() + "()"
    for c in children:
        yield from _chance_in(c)


#: Plans that leave rows in the partitions and the order that they have below, and those that make rows themselves.
_IN_PLACE, _MADE = {"Project", "Filter", "SubqueryAlias", "View", "Generate", "Sample", "Union", "ResolvedHint"}, {"OneRowRelation", "Range", "LocalRelation"}


def _drawn_from(plan, inputs: frozenset[str]) -> set[str]:
    """Inputs over whose rows a plan draws numbers or samples; these must be dealt out by their content.

    A random number goes by its row's partition and place there. Shuffles settle neither, so chance above
    a join, a group, a sort or another plan that needs one is refused, and so is chance over what is no input.
    Inputs that are views have been looked at when their own plans were made.
    """
    every = list(_plans(plan, inputs))
    defined = {d.id(): d.child() for d in every if _kind(d) == "CTERelationDef"}
    uses = [r.cteId() for r in every if _kind(r) == "CTERelationRef"]
    names: set[str] = set()

    def refuse(what: str):
        raise StoreError(f"a seeded SQL step can't draw numbers or samples above {what}: do it in a subquery over an input, or store the rows first")

    def below(node) -> None:
        kind = _kind(node)
        if name := _input_of(node, inputs):
            names.add(name)
        elif kind == "CTERelationRef":
            common = defined[node.cteId()]
            if uses.count(node.cteId()) > 1 and not common.deterministic():
                refuse("a common table with chance that is used twice")  # Spark deals its rows out anew
            below(common)
        elif kind == "WithCTE":
            below(node.plan())
        elif kind in _IN_PLACE:
            in_place(node)
        elif kind not in _MADE and not one_row(node):
            refuse(kind)

    def one_row(node) -> bool:
        return _kind(node) == "Aggregate" and node.groupingExpressions().isEmpty()

    def in_place(node) -> None:
        if any(_joins(e) for e in _items(node.expressions())):
            refuse("a subquery that is joined")
        for child in _items(node.children()):
            below(child)

    for node in every:
        if _kind(node) == "Sample" or any(_draws(e) for e in _items(node.expressions())):
            if _kind(node) in _IN_PLACE:
                in_place(node)
            elif not one_row(node):
                refuse(_kind(node))
    return names


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _joins(expression) -> bool:
    """Whether an expression holds a subquery that Spark turns into a join."""
    kind = _kind(expression)
    return kind in ("Exists", "ListQuery", "LateralSubquery") or kind == "ScalarSubquery" and expression.isCorrelated() or any(_joins(c) for c in _items(expression.children()))


def _draws(expression) -> bool:
    return _kind(expression) in ("Rand", "Randn") or any(_draws(c) for c in _items(expression.children()))


def _sample_seeds(plan) -> list[int]:
    return [p.seed() for p in _plans(plan) if p.getClass().getSimpleName() == "Sample"]


_CHANCE = r"\b(rand|random|randn|uuid|shuffle|randstr|uniform)\s*\("


def seeded(body: str, seed: float) -> str:
    """The body with the seed given to rand() and randn() where they have none; each call has a seed of its own.

    Other functions of chance can't be seeded alike everywhere, so a seeded step refuses them.
    """
    calls = 0

    def fix(m: re.Match) -> str:
        nonlocal calls
        if m[1]:  # quoted text or a comment
            return m[0]
        if m[2].lower() in ("uuid", "shuffle", "randstr", "uniform"):
            raise StoreError(f"a seeded SQL step can't call {m[2]}()")
        if not m[3]:
            return m[0]
        calls += 1
        return f"{m[2]}({int(seed * (1 << 31)) + calls})"

    quoted = r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)"
    return re.sub(quoted + "|" + _CHANCE + r"(\s*\))?", fix, body, flags=re.S | re.I)

