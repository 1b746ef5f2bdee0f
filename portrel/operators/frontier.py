"""Pareto frontier of additive choices: from each group of an output at most one option is taken, and states that another one dominates go.

A state is what the options taken so far add up to: bytes freed, credit lost, and the change of two errors. Groups are folded in
order; after each, states that free equally many bytes are pruned to their frontier in (credit lost, two errors). In exact mode
that keeps every state that no other one dominates, as all sums are additive; with a beam only so many states stay for each number
of bytes, taken in turn from the least error and the least credit lost.

The outputs are dealt out by key, each one's options are folded in one task: an output has the options of one image, and its
states are bounded by the bytes that it may free times the beam (in exact mode by its frontiers). Many outputs are folded at once, as
columns of their states (``folded``); ``fold`` says the same for one output, state by state.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Credit lost within this is the same.
SLACK = 1e-7
#: States that stay for each number of freed bytes.
BEAM = 16
#: Options of the outputs that are folded at once (of one output more, if it has more).
AT_ONCE = 1 << 14
#: Bits of a word of changes.
WORD = 62
STATE = "freed long, credit_lost double, face double, hair double, changes array<struct<grp: long, endpoint: long>>"

#: (freed, credit lost, face, hair, changes)
State = tuple[int, float, float, float, tuple]
_by_error, _by_credit = itemgetter(2, 3, 1, 4), itemgetter(1, 2, 3, 4)


def pruned(states: Iterable[State]) -> list[State]:
    """Of states that free equally many bytes those that no other dominates, by error; of equal ones the first changes."""
    kept: list[State] = []
    for s in sorted(states, key=_by_error):
        if not any(k[1] <= s[1] + SLACK and k[2] <= s[2] and k[3] <= s[3] for k in kept):
            kept.append(s)
    return kept


def within_beam(kept: list[State], beam: int | None) -> list[State]:
    """At most ``beam`` of the kept states, in turn the next by error and the next by credit."""
    if beam is None or len(kept) <= beam:
        return kept
    taken: dict[State, None] = {}
    for pair in zip(kept, sorted(kept, key=_by_credit), strict=True):
        for s in pair:
            if len(taken) < beam:
                taken[s] = None
    return list(taken)


def fold(options: Iterable[tuple], most_freed: int, most_lost: float, beam: int | None) -> list[State]:
    """The states of one output's options (grp, endpoint, freed, credit_lost, face, hair)."""
    states: list[State] = [(0, 0.0, 0.0, 0.0, ())]
    for grp, some in groupby(sorted(options), key=itemgetter(0)):
        choices = list(some)
        reached: dict[int, list[State]] = {}
        for s in states:
            reached.setdefault(s[0], []).append(s)
            for _, endpoint, freed, lost, face, hair in choices:
                if s[0] + freed <= most_freed and s[1] + lost <= most_lost + SLACK:
                    reached.setdefault(s[0] + freed, []).append((s[0] + freed, s[1] + lost, s[2] + face, s[3] + hair, (*s[4], (grp, endpoint))))
        states = [s for same in reached.values() for s in within_beam(pruned(same), beam)]
    return states


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin that agree in all columns."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def _undominated(first: np.ndarray, lost: np.ndarray, hair: np.ndarray) -> np.ndarray:
    """``pruned`` for many groups of states, sorted by group and error: the places of the states that stay. In each turn the first state left
    of every group stays, and those go that it dominates."""
    group = np.cumsum(first)
    left, stay = np.arange(len(first)), []
    while len(left):
        head = _firsts(group[left])
        stay.append(left[head])
        by = left[head][np.cumsum(head) - 1]
        left = left[~head & ~((lost[by] <= lost[left] + SLACK) & (hair[by] <= hair[left]))]
    return np.sort(np.concatenate(stay)) if stay else left


def _within_beams(group: np.ndarray, credit_order: tuple[np.ndarray, ...], beam: int) -> np.ndarray:
    """``within_beam`` for many groups of states, sorted by group and error: whether each stays."""
    n = len(group)
    begin = np.flatnonzero(_firsts(group))
    sizes = np.diff(np.append(begin, n))
    start = np.repeat(begin, sizes)
    by_error = np.arange(n) - start
    by_credit = np.empty(n, np.int64)
    by_credit[np.lexsort((*credit_order, group))] = by_error
    turn = np.minimum(2 * by_error, 2 * by_credit + 1)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((turn, group))] = by_error
    return rank < beam


def folded(output: np.ndarray, options: dict[str, np.ndarray], most_freed: np.ndarray, most_lost: np.ndarray, beam: int | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """States of many outputs: their numbers, their four sums, how many changes each has, and all changes as places among the options.

    ``options`` are columns in the order of ``output`` (0, 1, ... with none left out), group, endpoint and the rest. A state's changes are numbers of
    options within the output, from 1, packed from the left into words, so that words are ordered as changes are.
    """
    outputs = len(most_freed)
    grp, endpoint = options["grp"], options["endpoint"]
    begin = np.searchsorted(output, np.arange(outputs))
    other = np.cumsum(_firsts(output, grp, endpoint))  # options of one group and endpoint are the same change
    code = other - other[begin][output] + 1
    starts = np.flatnonzero(_firsts(output, grp))
    sizes = np.diff(np.append(starts, len(output)))
    group_of = output[starts]
    turn = np.arange(len(starts)) - np.searchsorted(group_of, group_of)
    rounds = int(turn.max()) + 1 if len(turn) else 0
    bits = int(code.max()).bit_length() if len(code) else 1
    digits = WORD // bits
    most = int(most_freed.max()) + 1 if outputs else 1  # each change frees a byte at least
    words = -(-min(rounds, most - 1) // digits) or 1
    names = ("freed", "credit_lost", "face", "hair")
    own, many = np.arange(outputs), np.zeros(outputs, np.int64)
    sums = [np.zeros(outputs, np.int64), *(np.zeros(outputs) for _ in range(3))]
    packed = np.zeros((words, outputs), np.int64)
    for k in range(rounds):
        of_turn = np.flatnonzero(turn == k)
        count, at = np.zeros(outputs, np.int64), np.zeros(outputs, np.int64)
        count[group_of[of_turn]], at[group_of[of_turn]] = sizes[of_turn], starts[of_turn]
        times = count[own]
        parent = np.repeat(np.arange(len(own)), times)
        option = at[own[parent]] + np.arange(len(parent)) - np.repeat(np.cumsum(times) - times, times)
        target = own[parent]
        fits = (sums[0][parent] + options["freed"][option] <= most_freed[target]) & (sums[1][parent] + options["credit_lost"][option] <= most_lost[target] + SLACK)
        parent, option = parent[fits], option[fits]
        if not len(parent):
            continue
        more = packed[:, parent]
        word, digit = np.divmod(many[parent], digits)
        more[word, np.arange(len(parent))] |= code[option] << ((digits - 1 - digit) * bits)
        moved = count > 0
        still = ~moved[own]  # states of outputs without such a group stay as they are, in order
        own_new, many_new = np.concatenate([own, own[parent]]), np.concatenate([many, many[parent] + 1])
        sums_new = [np.concatenate([v, v[parent] + options[n][option]]) for v, n in zip(sums, names, strict=True)]
        packed_new = np.concatenate([packed, more], axis=1)
        fixed = np.flatnonzero(still)
        freed, lost, face, hair = sums_new
        open_ = np.flatnonzero(np.concatenate([~still, np.ones(len(parent), bool)]))
        group = (own_new[open_] * most + freed[open_],) if outputs * most < 1 << 62 else (freed[open_], own_new[open_])
        order = open_[np.lexsort((*packed_new[::-1, open_], lost[open_], hair[open_], face[open_], *group))]
        stay = order[_undominated(_firsts(own_new[order], freed[order]), lost[order], hair[order])]
        if beam is not None:
            group = np.cumsum(_firsts(own_new[stay], freed[stay]))
            stay = stay[_within_beams(group, (*packed_new[::-1, stay], hair[stay], face[stay], lost[stay]), beam)]
        keep = np.concatenate([fixed, stay])
        own, many, sums, packed = own_new[keep], many_new[keep], [v[keep] for v in sums_new], packed_new[:, keep]
    state = np.repeat(np.arange(len(own)), many)
    position = np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many)
    word, digit = np.divmod(position, digits)
    number = (packed[word, state] >> ((digits - 1 - digit) * bits)) & ((1 << bits) - 1)
    first_of = np.flatnonzero(_firsts(other))  # the first option of each change
    return own, sums, many, first_of[other[begin][own[state]] + number - 2]


def _checked(name: object, options: list[tuple], most_freed: int | None, most_lost: float | None) -> None:
    if most_freed is None or most_lost is None or most_freed < 0 or not math.isfinite(most_lost) or most_lost < 0:
        raise ValueError(f"output {name}: supply finite donor resource bounds")
    if any(v is None or not math.isfinite(v) for o in options for v in o) or any(o[2] <= 0 or o[3] < 0 for o in options):
        raise ValueError(f"output {name}: use finite independently measured donor errors and positive body savings")


def donor_frontier(options: DataFrame, key: str, most_freed: str = "most_freed", most_lost: str = "most_lost", beam: int | None = BEAM) -> DataFrame:
    """(key, STATE) of every output of ``options`` (key, grp, endpoint, freed, credit_lost, face, hair, and its limits, the same in all rows).

    Options free at least a byte, and lose no negative credit; an output with one that doesn't, with a value that is null or no
    number, or with limits below zero raises an error that names it. ``beam=None`` is exact.
    """
    names = ["grp", "endpoint", "freed", "credit_lost", "face", "hair"]
    kind = options.schema[key].dataType.simpleString()
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in names[:3]], *[F.col(c).cast("double").alias(c) for c in names[3:]])
    # The options of one image each; its limits are the same in all of them.
    outputs = options.groupBy(key).agg(F.collect_list(one).alias("_options"), F.min(F.col(most_freed).cast("long")).alias("_freed"), F.min(F.col(most_lost).cast("double")).alias("_lost"))
    pair = pa.struct([("grp", pa.int64()), ("endpoint", pa.int64())])

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = batch.column("_options")
        values, counts = held.flatten(), np.diff(np.asarray(held.offsets))
        freed, lost = batch.column("_freed"), batch.column("_lost")
        output = np.repeat(np.arange(len(batch)), counts)
        whole = [values.field(n) for n in names]
        columns = {n: np.asarray(c.fill_null(0)) for n, c in zip(names, whole, strict=True)}
        bad = np.zeros(len(values), bool)
        for c, v in zip(whole, columns.values(), strict=True):
            bad |= np.asarray(c.is_null()) | ~np.isfinite(v)
        bad |= (columns["freed"] <= 0) | (columns["credit_lost"] < 0)
        most_f, most_l = np.asarray(freed.fill_null(-1)), np.asarray(lost.fill_null(-1.0))
        unlike = (most_f < 0) | ~np.isfinite(most_l) | (most_l < 0)
        unlike[output[bad]] = True
        for i in np.flatnonzero(unlike)[:1]:
            _checked(batch.column(key)[i].as_py(), [tuple(o[n] for n in names) for o in held[i].as_py()], freed[i].as_py(), lost[i].as_py())
        order = np.lexsort((*(columns[n] for n in reversed(names)), output))
        columns = {n: v[order] for n, v in columns.items()}
        own, sums, many, change = folded(output[order], columns, most_f, most_l, beam)
        ends = np.zeros(len(own) + 1, np.int32)
        np.cumsum(many, out=ends[1:])
        changes = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(columns["grp"][change]), pa.array(columns["endpoint"][change])], fields=list(pair)))
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(own)), *map(pa.array, sums), changes], [key, *[x.split()[0] for x in STATE.split(", ")[:5]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(np.diff(np.asarray(batch.column("_options").offsets)))
            cuts = np.flatnonzero(np.diff(held // AT_ONCE)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if b > a:
                    yield some(batch.slice(a, b - a))

    return outputs.mapInArrow(run, f"`{key}` {kind}, {STATE}")
