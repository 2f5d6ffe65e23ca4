"""Groups formed by a user's own callables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NoReturn

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.operators.ranking import ordered_rank
from gridfolio.sources.store import let_tasks_import, stored

C = F.col

#: ``choose(scores)`` gets the scores of one cross-section, indexed by ticker and sorted by it, and returns the tickers of
#: each group, or these and a note that says why there are none
Choice = Mapping[str, Sequence[str]] | tuple[Mapping[str, Sequence[str]], str | None]


class NotAtHand(ValueError):
    """A callable asked for more than the size and order of a cross-section that is too large to be handed over."""


class _Withheld:
    """Anything that is not defined on purpose is refused, so that no callable goes on with a wrong answer."""

    def _refuse(self, *_) -> NoReturn:
        raise NotAtHand(f"{type(self).__name__} tells sizes and places only")

    __eq__ = __ne__ = __lt__ = __le__ = __gt__ = __ge__ = __contains__ = __bool__ = __array__ = __str__ = __repr__ = __format__ = _refuse
    __hash__ = None

    def __getattr__(self, name: str) -> NoReturn:
        if name.startswith("__"):
            raise AttributeError(name)
        self._refuse()


class Place(_Withheld):
    """The name at one place of the order, from 0 on."""

    def __init__(self, at: int) -> None:
        self.at = at


class Places(_Withheld):
    """The names at some places of the order; sliced and listed like an index."""

    def __init__(self, at: range) -> None:
        self.at = at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int | slice) -> Place | Places:
        return Places(self.at[i]) if isinstance(i, slice) else Place(self.at[i])

    def __iter__(self) -> Iterator[Place]:
        return map(Place, self.at)


class Ordered(_Withheld):
    """Scores in their stable order."""

    def __init__(self, names: int) -> None:
        self.index = Places(range(names))

    def __len__(self) -> int:
        return len(self.index)


class Unseen(_Withheld):
    """Stands for the scores of a cross-section too large for one task: their number, and their order by score and ticker."""

    def __init__(self, names: int, name: tuple) -> None:
        self.size, self.empty, self.name = names, names == 0, name

    def __len__(self) -> int:
        return self.size

    def sort_values(self, *, ascending: bool = True, kind: str = "quicksort") -> Ordered:
        if ascending is not True or kind not in ("mergesort", "stable"):
            self._refuse()  # other orders leave ties open, or reverse them
        return Ordered(self.size)


def _ranges(chosen: Iterable[Place]) -> list[tuple[int, int, int]]:
    """First and last rank and step of the chosen places; neighbours that were listed one by one are put together."""
    if isinstance(chosen, Places):
        at = chosen.at if chosen.at.step > 0 else chosen.at[::-1]
        return [(at[0] + 1, at[-1] + 1, at.step)] if len(at) else []
    listed = list(chosen)
    if not all(isinstance(x, Place) for x in listed):
        raise NotAtHand("names that were not chosen by their place")
    out: list[tuple[int, int, int]] = []
    for rank in sorted({x.at + 1 for x in listed}):
        if out and out[-1][1] == rank - 1:
            out[-1] = (out[-1][0], rank, 1)
        else:
            out.append((rank, rank, 1))
    return out


@dataclass(frozen=True)
class ChosenGroups:
    """A strategy given as one callable that no plan can look into.

    Each cross-section of up to ``max_rows`` names, one (ticker, score) row per name, is handed to the callable in one
    task. Of a larger one the callable gets the number of names and their order (``Unseen``): what it takes by place from
    ``scores.sort_values(kind="mergesort").index`` is looked up in exact ranks, which no task computes alone. A callable
    that asks such a cross-section for more ends the job with a message.
    """

    choose: Callable[[pd.Series], Choice]
    group_ids: tuple[str, ...]
    max_rows: int = 1_000_000

    def decide(self, scored: DataFrame, by: Sequence[str]) -> DataFrame:
        let_tasks_import(scored.sparkSession)
        keys, most = list(by), self.max_rows
        rows = scored.select(*keys, "ticker", "score")
        sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("names")), "sizes")
        large = sizes.where(C("names") > most)
        if large.isEmpty():
            return self._handed(rows, keys)
        handed = self._handed(rows.join(sizes.where(C("names") <= most).select(*keys), keys, "left_semi"), keys)
        return handed.unionByName(self._placed(rows.join(large.select(*keys), keys, "left_semi"), large, keys))

    def _answer(self, scores: pd.Series | Unseen) -> tuple[Mapping[str, Sequence[str]], str | None]:
        answer = self.choose(scores)
        groups, note = answer if isinstance(answer, tuple) else (answer, None)
        if unknown := set(groups) - set(self.group_ids):
            raise ValueError(f"unknown groups {sorted(unknown)}; there are {sorted(self.group_ids)}")
        return groups, note

    def _handed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """What the callable decides on cross-sections that it sees."""
        answer = self._answer

        def decide(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            scores = pdf.set_index("ticker")["score"].sort_index()
            groups, note = answer(scores.rename(name))
            placed = [(*name, str(t), g, None) for g, tickers in groups.items() for t in tickers]
            return pd.DataFrame([*placed, *([(*name, None, None, note)] if note else [])], columns=[*keys, "ticker", "group_id", "note"])

        return rows.groupBy(*keys).applyInPandas(decide, f"{_typed(rows, keys)}, ticker string, group_id string, note string")

    def _placed(self, rows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
        """What the callable decides on cross-sections of which it knows size and order only."""
        answer, most = self._answer, self.max_rows
        columns = [*keys, "group_id", "first", "last", "step", "note"]

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for *name, names in pdf[[*keys, "names"]].itertuples(index=False):
                    try:
                        groups, note = answer(Unseen(int(names), tuple(name)))
                        out += [(*name, g, *r, None) for g, chosen in groups.items() for r in _ranges(chosen)]
                    except (NotAtHand, TypeError) as e:
                        raise ValueError(f"a cross-section of {names} names is more than {most}, so only its size and order are known: {e}") from e
                    if note:
                        out.append((*name, None, None, None, None, note))
                yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("first", "last", "step")})

        spans = stored(sizes.mapInPandas(decide, f"{_typed(rows, keys)}, group_id string, first long, last long, step long, note string"), "spans")
        # one row per chosen name, written so that its size is known
        places = stored(spans.where(C("group_id").isNotNull()).select(*keys, "group_id", F.explode(F.sequence("first", "last", "step")).alias("rank")), "places")
        # a ticker without a name comes last, as in the index of a series
        ranked = ordered_rank(rows.withColumn("tie", F.struct(C("ticker").isNull(), "ticker")), keys, "score", "tie")
        chosen = ranked.select(*keys, "rank", "ticker").join(places, [*keys, "rank"]).select(*keys, "ticker", "group_id", F.lit(None).cast("string").alias("note"))
        notes = spans.where(C("note").isNotNull()).select(*keys, F.lit(None).cast("string").alias("ticker"), "group_id", "note")
        return chosen.unionByName(notes)


def _typed(rows: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def selected(selectors: Mapping[str, Callable[[pd.Series], Sequence[str]]], max_rows: int = 1_000_000) -> ChosenGroups:
    """One callable per group, each of which sees all scores of a cross-section."""
    if not selectors:
        raise ValueError("at least one selector is required")
    named = dict(selectors)
    return ChosenGroups(lambda scores: {g: list(pick(scores)) for g, pick in named.items()}, tuple(named), max_rows)
