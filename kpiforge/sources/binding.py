"""Role bindings: a department frame described as roles -> column expressions.

Packs never name physical columns; they ask a source for the roles they
need (``src.frame("order_date", "total_cost")``). A ``TableSource`` is one
table already carrying the role columns (a department CSV). A
``StarSource`` is a fact table plus dimension tables reached by unique-key
left joins; ``frame`` joins only the dimensions the requested roles read.
Because every dimension key is unique and the joins are left joins, leaving
a dimension out never changes the row count, so this is exact. A source that
is asked many times can store the join with some dimensions once (``stored``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from kpiforge.staging import staged


class TableSource:
    """A single table whose columns are the roles.

    ``optional`` (role -> type): roles that the table may lack; they read as
    typed nulls, so packs give 0 or empty sections instead of failing (PRJ14).
    """

    def __init__(self, df: DataFrame, optional: Mapping[str, DataType] | None = None):
        self.df = df
        self.optional = dict(optional or {})

    def roles(self) -> list[str]:
        return list(self.df.columns)

    def frame(self, *roles: str) -> DataFrame:
        if not roles:
            return self.df
        have = set(self.df.columns)
        if "all_rows" in roles and "all_rows" not in have:   # the one group of a total
            return TableSource(self.df.withColumn("all_rows", F.lit("all")), self.optional).frame(*roles)
        return self.df.select(*[F.lit(None).cast(self.optional[r]).alias(r)
                                if r not in have and r in self.optional else F.col(r) for r in roles])

    def keyed_sums(self, sections: Mapping[str, str], measures: Mapping[str, Column],
                   reads: Sequence[str]) -> DataFrame:
        """(section, key, *measures): additive ``measures`` over the roles ``reads``, by each section's role."""
        df = self.frame(*dict.fromkeys([*sections.values(), *reads]))
        return _sums(_sectioned(df, {s: F.col(r) for s, r in sections.items()}, reads), measures)

    def latest(self, date: str, n: int, roles: Sequence[str], ties: Sequence[Column | str],
               keys: Sequence[str] = ()) -> DataFrame:
        """The ``n`` rows latest by ``date`` (nulls out); ties by ``ties``, columns over ``roles``."""
        df = self.frame(*roles).where(F.col(date).isNotNull())
        return df.orderBy(F.desc(date), *ties).limit(n)


def _sectioned(df: DataFrame, keys: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(s).alias("section"), k.cast("string").alias("key")) for s, k in keys.items()]
    return df.select(F.inline(F.array(*structs)), *keep).where(F.col("key").isNotNull())


def _sums(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy("section", "key").agg(*[m.alias(name) for name, m in measures.items()])


@dataclass
class Dim:
    """A dimension joined to the fact on ``on`` = [(fact column, dim column)]."""

    load: Callable[[], DataFrame]
    on: Sequence[tuple[str, str]]
    requires: Sequence[str] = ()
    broadcast: bool = False   # only for tables bounded by construction


@dataclass
class Role:
    expr: Column
    dims: Sequence[str] = field(default_factory=tuple)


class StarSource:
    """Fact table + unique-key dimensions; joins only what a request needs."""

    def __init__(self, fact: Callable[[], DataFrame], dims: Mapping[str, Dim],
                 roles: Mapping[str, Role], held: Sequence[str] = (), joined: DataFrame | None = None):
        self._fact = fact
        self._dims = dict(dims)
        self._roles = dict(roles)
        self._held, self._with_held = list(held), joined   # dims, and the fact with them

    def roles(self) -> list[str]:
        return list(self._roles)

    def _needed(self, roles: Sequence[str]) -> list[str]:
        need: list[str] = []

        def add(d: str) -> None:
            for r in self._dims[d].requires:
                add(r)
            if d not in need:
                need.append(d)

        for r in roles:
            for d in self._roles[r].dims:
                add(d)
        return need

    def frame(self, *roles: str) -> DataFrame:
        roles = roles or tuple(self._roles)
        unknown = [r for r in roles if r not in self._roles]
        if unknown:
            raise KeyError(f"unknown roles {unknown}")
        return self._joined(self._needed(roles)).select(*[self._roles[r].expr.alias(r) for r in roles])

    def _joined(self, dims: Sequence[str], df: DataFrame | None = None) -> DataFrame:
        """The fact (or ``df``) with the named dimensions, in order; the stored join if all of its dimensions are among them."""
        if df is None and self._holds(dims):
            df, dims = self._with_held, [d for d in dims if d not in self._held]
        df = self._fact() if df is None else df
        for name in dims:
            dim = self._dims[name]
            right = dim.load()
            if dim.broadcast:
                right = F.broadcast(right)
            cond = None
            for lcol, rcol in dim.on:
                c = F.col(lcol) == right[rcol]
                cond = c if cond is None else cond & c
            df = df.join(right, cond, "left")
        return df

    def _holds(self, dims: Sequence[str]) -> bool:
        return bool(self._held) and set(self._held) <= set(dims)

    def stored(self, dims: Sequence[str], columns: Sequence[str], name: str) -> StarSource:
        """This source with the join of the fact and the named dimensions stored, of which ``columns`` are kept.

        Requests that read all these dimensions find the rows there; the others read the fact as before.
        """
        return self.over(self._fact, dims, staged(self._joined(dims).select(*columns), name))

    def over(self, fact: Callable[[], DataFrame], held: Sequence[str] = (), joined: DataFrame | None = None) -> StarSource:
        """The same roles over another fact, and a stored join of it with the dimensions ``held``."""
        return StarSource(fact, self._dims, self._roles, held, joined)

    def over_join_of(self, other: StarSource) -> StarSource:
        """The same roles over the stored join of a source that has the same fact."""
        return self.over(self._fact, other._held, other._with_held)

    def keyed_sums(self, sections: Mapping[str, str], measures: Mapping[str, Column],
                   reads: Sequence[str]) -> DataFrame:
        """(section, key, *measures): additive ``measures`` over the roles ``reads``, by each section's role.

        The fact is summed by the foreign key that leads to the section's
        dimension, in one scan and one aggregation for all sections; only the
        sums meet the names, in one join, and are summed again by them. Names by
        foreign key come from the dimensions alone (an order's region, say). So
        no raw row is shuffled on a dimension's key, and a hot key is one row
        per task. Integer keys stay integers. Only what the measures read is
        joined first. Sections that lead over the stored join are summed from it.
        """
        base = self._needed(reads)
        inside = {s: r for s, r in sections.items() if self._holds([*base, *self._needed([r])])}
        if 0 < len(inside) < len(sections):
            rest = {s: r for s, r in sections.items() if s not in inside}
            return self.keyed_sums(inside, measures, reads).unionByName(self.keyed_sums(rest, measures, reads))
        base += [d for d in self._held if inside and d not in base]
        df = self._joined(base)
        hops = {s: [d for d in self._needed([r]) if d not in base] for s, r in sections.items()}
        first = {s: self._dims[left[0]].on[0][0] for s, left in hops.items() if left}
        integers = all(isinstance(df.schema[c].dataType, IntegralType) for c in first.values())
        typed = lambda c: F.col(c).cast("long" if integers else "string")
        none = F.lit(None)
        structs = [F.struct(F.lit(i).alias("part"), (typed(first[s]) if s in first else none.cast("long" if integers else "string")).alias("fk"),
                            (none.cast("string") if s in first else self._roles[r].expr.cast("string")).alias("key"))
                   for i, (s, r) in enumerate(sections.items())]
        rows = df.select(F.inline(F.array(*structs)), *[self._roles[r].expr.alias(r) for r in reads])
        out = (rows.where(F.col("fk").isNotNull() | F.col("key").isNotNull()).groupBy("part", "fk", "key")
               .agg(*[m.alias(name) for name, m in measures.items()]))
        names = []
        for i, (s, r) in enumerate(sections.items()):
            if s in first:
                dim, *rest = hops[s]
                on = self._dims[dim].on[0][1]
                named = self._joined(rest, self._dims[dim].load()).select(
                    F.lit(i).alias("_part"), typed(on).alias("_fk"), self._roles[r].expr.cast("string").alias("_name"))
                names.append(named.where(F.col("_name").isNotNull()))
        section = F.element_at(F.array(*[F.lit(s) for s in sections]), F.col("part") + 1).alias("section")
        if not names:
            return out.select(section, "key", *measures)
        named = reduce(DataFrame.unionByName, names)
        out = out.join(named, (F.col("part") == F.col("_part")) & (F.col("fk") == F.col("_fk")), "left")
        return _sums(out.select(section, F.coalesce("key", "_name").alias("key"), *measures).where(F.col("key").isNotNull()),
                     {m: F.sum(m) for m in measures})

    def latest(self, date: str, n: int, roles: Sequence[str], ties: Sequence[Column | str] = (),
               keys: Sequence[str] = ()) -> DataFrame:
        """The ``n`` rows latest by ``date`` (nulls out), ties by the fact's ``keys``.

        Only what the date needs is joined before the rows are picked; the other
        dimensions meet ``n`` rows.
        """
        base = self._needed([date, *keys])
        df = self._joined(base)
        order = [self._roles[date].expr.desc(), *[self._roles[k].expr for k in keys]]
        top = df.where(self._roles[date].expr.isNotNull()).orderBy(*order).limit(n)
        rest = [d for d in self._needed(roles) if d not in base]
        return self._joined(rest, top).select(*[self._roles[r].expr.alias(r) for r in roles])
