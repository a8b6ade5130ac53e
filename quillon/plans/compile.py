"""Compilation of queries to DataFrame plans.

The state is a DataFrame of bindings. Every variable is five columns: k (its kind: entity, field, null, bool, num, str
or ref), s (the text of an entity, field, string or reference), n and b; and key, a text that is equal for equal
values. A pattern is a scan joined on the keys of the variables it shares with the bindings, so Spark hash- or
merge-joins; only patterns without shared variables are products.

Stars (patterns of one entity with constant attributes and fresh values) become one scan of a wide table, or one
pivoting aggregate of a triple table, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import show_datom
from ..functions.values import EPSILON, Entity, equals_constant, value_key
from ..sources.triples import TripleSource
from .query import Pattern, Query, Var

_PARTS = ("k", "s", "n", "b", "key")
#: Parts of a product of bindings, in which a variable is unbound, with all that it may be.
SALTS = 16
#: Rows of a key on each side that one part of a dealt join pairs, where both sides have that many.
SIDE = 512


@dataclass(frozen=True)
class Modes:
    """strict_refs: a variable bound to a reference never stands for the entity (the wire behaviour); default: it does.

    epsilon_joins: numbers below 1 join within 2^-52 of each other rather than exactly.
    """

    strict_refs: bool = False
    epsilon_joins: bool = False
    fuse_stars: bool = True


@dataclass(frozen=True)
class Binding:
    """A variable's columns, for filters."""

    kind: Column
    text: Column
    number: Column
    boolean: Column

    @property
    def bound(self) -> Column:
        return self.kind.isNotNull()

    @property
    def id(self) -> Column:
        return F.when(self.kind.isin("entity", "ref"), self.text)

    @property
    def string(self) -> Column:
        return F.when(self.kind == "str", self.text)

    @property
    def num(self) -> Column:
        return F.when(self.kind == "num", self.number)

    @property
    def bool(self) -> Column:
        return F.when(self.kind == "bool", self.boolean)


def _name(var: str, part: str) -> str:
    return f"v_{var}__{part}"


def _entity_parts(e: Column, kind: str = "entity") -> dict[str, Column]:
    some = lambda t: F.lit(None).cast(t)
    key = F.concat(F.lit("r:" if kind == "entity" else "f:"), e)
    return {"k": F.lit(kind), "s": e, "n": some("double"), "b": some("boolean"), "key": key}


def _value_parts(kind: Column, s: Column, n: Column, b: Column, r: Column) -> dict[str, Column]:
    text = F.when(kind == "ref", r).otherwise(s)
    return {"k": kind, "s": text, "n": n, "b": b, "key": value_key(kind, text, n, b)}


def _bind(rows: DataFrame, pattern: Pattern) -> DataFrame:
    """The scan's rows as bindings of the pattern's variables; a variable that stands twice is checked here."""
    parts: dict[str, dict[str, Column]] = {}
    c = F.col
    if isinstance(pattern.entity, Var):
        parts[pattern.entity.name] = _entity_parts(c("e"))
    if isinstance(pattern.attribute, Var):
        if pattern.attribute.name in parts:
            rows = rows.where(F.lit(False))
        parts[pattern.attribute.name] = _entity_parts(c("a"), "field")
    if isinstance(pattern.value, Var):
        if pattern.value.name in parts:
            same_entity = isinstance(pattern.entity, Var) and pattern.entity.name == pattern.value.name
            rows = rows.where((c("kind") == "ref") & (c("r") == c("e")) if same_entity else F.lit(False))
        else:
            parts[pattern.value.name] = _value_parts(c("kind"), c("s"), c("n"), c("b"), c("r"))
    return rows.select(*[p.alias(_name(v, k)) for v, ps in parts.items() for k, p in ps.items()])


def _scan(source: TripleSource, pattern: Pattern) -> DataFrame:
    e = pattern.entity.id if isinstance(pattern.entity, Entity) else None if isinstance(pattern.entity, Var) else pattern.entity
    a = None if isinstance(pattern.attribute, Var) else pattern.attribute
    rows = source.scan(e, a)
    if not isinstance(pattern.value, Var):
        rows = rows.where(equals_constant(pattern.value, *[F.col(x) for x in ("kind", "s", "n", "b", "r")]))
    return rows


class _State:
    """Bindings and what is known of each variable: whether it may be unbound.

    keys: sets of variables whose values no two rows share where they are bound. many: whether a join has paired many
    rows with many.
    """

    def __init__(self, df: DataFrame | None, maybe: dict[str, bool], keys: tuple[frozenset[str], ...] = (), many: bool = False):
        self.df, self.maybe, self.keys, self.many = df, maybe, keys, many

    def with_df(self, df: DataFrame) -> _State:
        return _State(df, self.maybe, self.keys, self.many)


def _no_bindings(spark: SparkSession) -> _State:
    """The one row that every pattern may extend."""
    return _State(spark.range(1).select(), {}, (frozenset(),))


def _keys(source: TripleSource, pattern: Pattern) -> tuple[frozenset[str], ...]:
    """The variables of a scan's entity and attribute, which have one value at most if the source is single."""
    return (frozenset(x.name for x in (pattern.entity, pattern.attribute) if isinstance(x, Var)),) if source.single else ()


def _join(state: _State, right: DataFrame, names: list[str], how: str, modes: Modes, keys: tuple[frozenset[str], ...] = ()) -> _State:
    """Join bindings with those of a pattern or group, which are always bound; keys: those of the pattern's rows.

    A shared variable that may be unbound is free where it is: such bindings are joined apart from the others, on the
    variables that they have, so that every join has keys. There are at most as many parts as subsets of a pattern's
    maybe-bound variables.
    """
    if state.df is None:
        if how == "inner":
            return _State(right, dict.fromkeys(names, False), keys)
        state = _no_bindings(right.sparkSession)
    shared = [v for v in names if v in state.maybe]
    cols = {(v, p): f"r_{v}__{p}" for v in names for p in _PARTS}
    right = right.select(*[F.col(_name(v, p)).alias(cols[v, p]) for v, p in cols])
    loose = [v for v in shared if state.maybe[v]]
    df, one_each, many = None, True, state.many
    for free in product((False, True), repeat=len(loose)):
        unbound = [v for v, is_free in zip(loose, free, strict=True) if is_free]
        part = state.df
        for v in loose:
            kind = F.col(_name(v, "k"))
            part = part.where(kind.isNull() if v in unbound else kind.isNotNull())
        bound = [v for v in shared if v not in unbound]
        on = set(bound[:1] if modes.epsilon_joins else bound)
        one = any(k <= on for k in keys)
        several = how != "left_anti" and not one and not any(k <= on for k in state.keys)
        one_each, many = one_each and one, many or several
        # A second such join is left to Spark, which splits what is long in bytes; counting would make the first one twice.
        made = _join_bound(part, right, bound, how, modes, cols, several and not state.many)
        if how != "left_anti":
            out = []
            for v in dict.fromkeys([*state.maybe, *names]):
                mine = v in state.maybe and v not in unbound
                out += [F.col(_name(v, p) if mine else cols[v, p]).alias(_name(v, p)) for p in _PARTS]
            made = made.select(*out)
        df = made if df is None else df.unionByName(made)
    maybe = dict(state.maybe)
    for v in names if how != "left_anti" else ():
        maybe[v] = False if how == "inner" else maybe.get(v, True)
    if how != "left_anti" and not one_each:
        return _State(df, maybe, () if loose or many else keys, many)
    return _State(df, maybe, state.keys, many)


def _join_bound(left: DataFrame, right: DataFrame, shared: list[str], how: str, modes: Modes, cols: dict[tuple[str, str], str], many: bool) -> DataFrame:
    """Join on variables that are bound on both sides. Without any, an inner join is the product that the query asks
    for, and outer ones, which only unbound variables lead to, are dealt out by salted keys. many: a key may have many
    rows on both sides."""
    if not shared:
        if how == "left_anti":
            return left.join(right.limit(1).select(F.lit(True).alias("r__any")), F.lit(True), "left_anti")
        return left.crossJoin(right) if how == "inner" else _salted_product(left, right, how)
    equal: list[tuple[Column, Column]] = []
    on: list[Column] = []
    if modes.epsilon_joins:
        right = right.withColumn("r__near", F.explode(_near(cols[shared[0], "k"], cols[shared[0], "n"])))
    for i, v in enumerate(shared):
        mine, theirs = F.col(_name(v, "key")), F.col(cols[v, "key"])
        if modes.epsilon_joins:
            number = (F.col(_name(v, "k")) == "num") & (F.col(cols[v, "k"]) == "num")
            close = (F.abs(F.col(_name(v, "n")) - F.col(cols[v, "n"])) < EPSILON) & number
            if i == 0:
                equal.append((_bucket(_name(v, "k"), _name(v, "n"), _name(v, "key")), F.coalesce(F.col("r__near"), theirs)))
                on.append(F.coalesce(F.when(number, close), F.lit(True)))
            else:
                on.append((mine == theirs) | close)
        else:
            equal.append((mine, theirs))
        if modes.strict_refs:
            # A reference met first stands for the value only; an entity met first matches references too.
            on.append(~((F.col(_name(v, "k")) == "ref") & (F.col(cols[v, "k"]) == "entity")))
    if many:
        left, right = _dealt(left, right, equal, how)
        equal = [(F.col("l__part"), F.col("r__part"))]
    return left.join(right, _all([mine == theirs for mine, theirs in equal] + on), how)


def _dealt(left: DataFrame, right: DataFrame, equal: list[tuple[Column, Column]], how: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join with l__part and r__part, the parts of a key in which a row meets its partners.

    A few short rows of one key can have products without number, which no task should make alone and which Spark, going
    by bytes, doesn't split. So the rows of each key are counted on both sides. Of a key with more than SIDE * SIDE
    products the left's rows are dealt across parts and copied down, the right's are dealt down and copied across; a pair
    meets in one part. A part makes about SIDE * SIDE products, and copies are two in SIDE products at most. Below an
    outer join the right isn't dealt, so that a row of the left meets all of its partners.

    Given a number of partitions, Spark keeps all of them, however short. Sorted rows of a part are paired faster than
    hashed ones.
    """
    names = [f"h__at{i}" for i in range(len(equal))]

    def counts(rows: DataFrame, side: int, name: str) -> DataFrame:
        return rows.groupBy(*[pair[side].alias(n) for pair, n in zip(equal, names, strict=True)]).agg(F.count("*").cast("double").alias(name))

    most, mine, theirs = F.lit(float(SIDE)), F.col("h__mine"), F.col("h__theirs")
    heavy = counts(left, 0, "h__mine").join(counts(right, 1, "h__theirs"), names).where(mine * theirs > most * most)
    across = F.ceil(mine / F.greatest(most, most * most / theirs))
    down = F.ceil(theirs / F.greatest(most, most * most / mine)) if how == "inner" else F.lit(1).cast("bigint")
    heavy = heavy.select(*names, across.alias("h__across"), down.alias("h__down"))

    def parts(rows: DataFrame, side: int, dealt: str, copied: str) -> DataFrame:
        row = F.xxhash64(*[c for c in rows.columns if c.endswith("__key")])
        found = rows.join(heavy, _all([pair[side] == F.col(n) for pair, n in zip(equal, names, strict=True)]), "left")
        number = {x: F.coalesce(F.col(f"h__{x}"), F.lit(1)) for x in (dealt, copied)}
        found = found.withColumn(f"h__in_{dealt}", F.pmod(row, number[dealt]))
        found = found.withColumn(f"h__in_{copied}", F.explode(F.sequence(F.lit(0).cast("bigint"), number[copied] - 1)))
        # One text, of which no part is a constant that Spark would take out of the join; null if a key is.
        keys = [x for pair in equal for x in (F.lit(":"), F.length(pair[side]), F.lit(":"), pair[side])]
        part = F.concat("h__in_across", F.lit(":"), "h__in_down", *keys)
        return found.select(*rows.columns, part.alias(f"{'lr'[side]}__part"))

    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts(left, 0, "across", "down").repartition(partitions, "l__part"), parts(right, 1, "down", "across").hint("merge")


def _salted_product(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Every row of the left with every row of the right, as an equi-join on a salt: the left is dealt into SALTS parts
    and the right copied to each, so Spark may hash, merge, or broadcast a side whose size it has checked."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)) if left.columns else F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    dealt = left.withColumn("l__salt", salt.cast("int"))
    copied = right.withColumn("r__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, F.col("l__salt") == F.col("r__salt"), how).drop("l__salt", "r__salt")


def _all(on: list[Column]) -> Column:
    out = on[0]
    for x in on[1:]:
        out = out & x
    return out


def _bucket(k: str, n: str, key: str) -> Column:
    """Small numbers share a key with others near them; all else keeps its key."""
    small = (F.col(k) == "num") & (F.abs(F.col(n)) < 1)
    return F.when(small, F.concat(F.lit("q:"), F.floor(F.col(n) / EPSILON).cast("string"))).otherwise(F.col(key))


def _near(k: str, n: str) -> Column:
    """The keys under which a number is found: its own bucket and the two beside it; null for other values."""
    at = F.floor(F.col(n) / EPSILON)
    keys = F.transform(F.array(at - 1, at, at + 1), lambda x: F.concat(F.lit("q:"), x.cast("string")))
    return F.when((F.col(k) == "num") & (F.abs(F.col(n)) < 1), keys).otherwise(F.array(F.lit(None).cast("string")))


def order_patterns(patterns: list[Pattern]) -> list[Pattern]:
    """Most constants first, then always one that shares a variable with those before; inner joins commute."""
    def constants(p: Pattern) -> int:
        return 4 * (not isinstance(p.entity, Var)) + 2 * (not isinstance(p.value, Var)) + (not isinstance(p.attribute, Var))

    rest, out, seen = list(patterns), [], set()
    while rest:
        best = max(rest, key=lambda p: (bool(seen & set(p.variables)), constants(p), -rest.index(p)))
        rest.remove(best)
        out.append(best)
        seen |= set(best.variables)
    return out


def _stars(where: list[Pattern], optional: list[Pattern]) -> dict[str, tuple[list[Pattern], list[Pattern]]]:
    """Entity variables with two or more patterns whose attributes are constant and whose values occur nowhere else."""
    used: dict[str, int] = {}
    for p in [*where, *optional]:
        for v in p.variables:
            used[v] = used.get(v, 0) + 1

    def fits(p: Pattern) -> bool:
        return isinstance(p.entity, Var) and isinstance(p.attribute, str) and (not isinstance(p.value, Var) or p.value.name != p.entity.name)

    out: dict[str, tuple[list[Pattern], list[Pattern]]] = {}
    for p in where:
        if fits(p):
            out.setdefault(p.entity.name, ([], []))[0].append(p)
    first = {v for p in where for v in p.variables}
    for p in optional:
        # An optional value is bound by its star only if no other pattern could bind or test it before.
        if fits(p) and p.entity.name in out and isinstance(p.value, Var) and used[p.value.name] == 1 and p.value.name not in first:
            out[p.entity.name][1].append(p)
    return {v: (w, o) for v, (w, o) in out.items() if len(w) + len(o) > 1}


def _star(source: TripleSource, var: str, must: list[Pattern], may: list[Pattern]) -> tuple[DataFrame, list[str]] | None:
    """One scan for a star, as bindings. A value variable that stands twice within it is checked by a filter."""
    patterns = [*must, *may]
    names = [p.value.name for p in patterns if isinstance(p.value, Var)]
    if len(set(names)) != len(names):
        return None
    attributes = list(dict.fromkeys(p.attribute for p in patterns))
    rows = source.star(attributes)
    if rows is None:
        return None
    out = [p.alias(_name(var, k)) for k, p in _entity_parts(F.col("e")).items()]
    for p in patterns:
        i = attributes.index(p.attribute)
        kind, s, n, b, r = (F.col(f"{x}_{i}") for x in ("kind", "s", "n", "b", "r"))
        if p in must:
            rows = rows.where(kind.isNotNull())
        if isinstance(p.value, Var):
            out += [c.alias(_name(p.value.name, k)) for k, c in _value_parts(kind, s, n, b, r).items()]
        else:
            rows = rows.where(equals_constant(p.value, kind, s, n, b, r))
    return rows.select(*out), [var, *names]


def solve(source: TripleSource, query: Query, modes: Modes = Modes()) -> _State:
    """All solutions before projection."""
    where = list(query.where)
    optional = list(dict.fromkeys(query.optional)) if source.single else list(query.optional)
    steps: list[tuple[DataFrame, list[str], set[str]]] = []
    fused: dict[str, bool] = {}
    if modes.fuse_stars and not modes.strict_refs and source.single:
        for var, (must, may) in _stars(where, optional).items():
            if (made := _star(source, var, must, may)) is not None:
                steps.append((*made, {p.value.name for p in may}))
                where = [p for p in where if p not in must]
                optional = [p for p in optional if p not in may]
                fused |= {p.value.name: True for p in may}
    state = _State(None, {})
    pending = [(df, names, (frozenset(names[:1]),)) for df, names, _ in steps]
    if modes.strict_refs:
        singles = where
    else:
        singles = order_patterns(where)
    pending += [(_bind(_scan(source, p), p), p.variables, _keys(source, p)) for p in singles]
    if modes.strict_refs:
        order = pending
    else:
        order, seen = [], set()
        while pending:
            at = next((i for i, (_, names, _) in enumerate(pending) if not order or seen & set(names)), 0)
            order.append(pending.pop(at))
            seen |= set(order[-1][1])
    for df, names, keys in order:
        if not names:  # a ground pattern: a gate, or a multiplier where an attribute may have several values
            if state.df is None:
                state = _no_bindings(df.sparkSession)
            state = state.with_df(state.df.join(df.limit(1) if source.single else df, F.lit(True), "left_semi" if source.single else "inner"))
            if not source.single:
                state.keys = ()
            continue
        state = _join(state, df, names, "inner", modes, keys)
    for v in fused:
        state.maybe[v] = True
    for p in optional:
        if not p.variables:
            continue
        state = _join(state, _bind(_scan(source, p), p), p.variables, "left", modes, _keys(source, p))
    for group in query.where_not:
        if len(group) == 1:
            inner, names = _bind(_scan(source, group[0]), group[0]), group[0].variables
        else:
            sub = solve(source, Query([], where=list(group)), modes)
            inner, names = sub.df, list(sub.maybe)
        if state.df is None:
            state = _no_bindings(inner.sparkSession)
        if not names:
            state = state.with_df(state.df.join(inner.limit(1).select(F.lit(True).alias("r__any")), F.lit(True), "left_anti"))
        else:
            state = _join(state, inner, names, "left_anti", modes)
    for var, test in query.filters:
        if var in state.maybe:
            bound = Binding(*[F.col(_name(var, p)) for p in ("k", "s", "n", "b")])
        else:
            bound = Binding(*[F.lit(None).cast(t) for t in ("string", "string", "double", "boolean")])
        state = state.with_df(state.df.where(F.coalesce(test(bound), F.lit(False))))
    return state


def run(source: TripleSource, query: Query, types: dict[str, str] | None = None, modes: Modes = Modes()) -> DataFrame:
    """The found variables as columns, in order; bag semantics.

    types gives a column's form: id, str, num, bool, or show (the default: text with the kind's marks). A variable that
    is never bound is a null column; one that is listed again gets its number as a suffix.
    """
    types = types or {}
    state = solve(source, query, modes)
    if state.df is None:
        raise ValueError("a query needs a pattern")
    out, seen = [], {}
    for var in query.find:
        seen[var] = seen.get(var, 0) + 1
        name = var if seen[var] == 1 else f"{var}_{seen[var]}"
        if var not in state.maybe:
            out.append(F.lit(None).cast({"num": "double", "bool": "boolean"}.get(types.get(var, ""), "string")).alias(name))
            continue
        k, s, n, b = (F.col(_name(var, p)) for p in ("k", "s", "n", "b"))
        bound = Binding(k, s, n, b)
        form = types.get(var, "show")
        field = F.when(k == "field", s)
        shown = {"id": lambda: F.coalesce(bound.id, field), "str": lambda: bound.string, "num": lambda: bound.num, "bool": lambda: bound.bool, "show": lambda: show_datom(k, s, n, b)}
        out.append(shown[form]().alias(name))
    return state.df.select(*out)
