"""Suffix arrays by linear grouping, for many short sequences in lockstep.

The construction has two phases. Phase one sorts suffixes into groups by their Lyndon prefix: groups are processed in
descending order; the previous-smaller pointer of each member (the nearest suffix before it whose group is lower) says
which suffixes' prefixes the group's prefix extends, and those move, within their own group, behind the members that
don't, by how often it extends them. Phase two emits the groups' inner order in one ascending sweep: each suffix, as
its place becomes known, puts the suffixes that its pointer chain leads to at the front of their groups. No recursion
and no renaming.

Sequences ("lanes") are independent, so a step handles the highest open group of every lane at once.
"""

from __future__ import annotations

import numpy as np


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... for each pair, joined."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of the lanes that lie one after the other in `symbols`, as global positions.

    Every lane ends with a symbol that is smaller than its others and occurs once in it.
    """
    total = len(symbols)
    offset = np.cumsum(sizes) - sizes
    lane = np.repeat(np.arange(len(sizes)), sizes)
    array = np.lexsort((symbols, lane))
    place = np.empty(total, np.int64)
    place[array] = np.arange(total)
    sorted_symbols = symbols[array]
    opens = np.append(True, (sorted_symbols[1:] != sorted_symbols[:-1]) | (lane[1:] != lane[:-1]))
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], total)
    group = np.empty(total, np.int64)  # where the suffix's group begins
    group[array] = np.repeat(begin, end - begin)
    stop = np.zeros(total, np.int64)  # by where a group begins: where it ends
    stop[begin] = end
    first = np.zeros(total, np.int64)  # by a group's last place: where it begins
    first[end - 1] = begin
    before = np.full(total, -1, np.int64)  # previous-smaller pointers
    done = np.zeros(total, bool)
    count = np.zeros(total, np.int64)
    seen = np.empty(total, np.int64)
    moving = np.zeros(total, bool)
    lane_start = np.zeros(total, bool)
    lane_start[offset] = True

    high = offset + sizes  # places from here on are of processed groups
    low = offset.copy()
    while len(high):
        top = first[high - 1]
        members = array[ranges(top, high - top)]
        done[members] = True
        high = top
        open_lanes = high > low
        if not open_lanes.all():
            high, low = high[open_lanes], low[open_lanes]
        at = np.where(lane_start[members], -1, members - 1)
        before[members] = at
        live = np.flatnonzero(at >= 0)
        live = live[done[at[live]]]
        while len(live):
            at[live] = before[at[live]]
            before[members[live]] = at[live]
            live = live[at[live] >= 0]
            live = live[done[at[live]]]
        at = at[at >= 0]
        if not len(at):
            continue
        np.add.at(count, at, 1)
        moving[at] = True
        # Distinct suffixes whose prefix grows, in order of (group, how often it grows).
        mark = np.arange(len(at))
        seen[at] = mark
        grown = at[seen[at] == mark]
        times = count[grown]
        count[grown] = 0
        order = np.lexsort((times, group[grown]))
        grown, times = grown[order], times[order]
        own = group[grown]
        new_group = np.append(True, own[1:] != own[:-1])
        run = np.flatnonzero(new_group)
        run_size = np.diff(np.append(run, len(grown)))
        ends = stop[own[run]]
        target = ranges(ends - run_size, run_size)
        # Those that stay but lie in the targets swap with those that leave places before them.
        there = array[target]
        stay = there[~moving[there]]
        now = place[grown]
        gaps = now[now < np.repeat(ends - run_size, run_size)]
        moving[grown] = False
        array[gaps] = stay
        place[stay] = gaps
        array[target] = grown
        place[grown] = target
        rest = ends - run_size
        left = rest > own[run]
        stop[own[run][left]] = rest[left]
        first[rest[left] - 1] = own[run][left]
        parts = np.flatnonzero(new_group | np.append(True, times[1:] != times[:-1]))
        part_size = np.diff(np.append(parts, len(grown)))
        label = target[parts]
        group[grown] = np.repeat(label, part_size)
        stop[label] = label + part_size
        first[label + part_size - 1] = label

    out = np.empty(total, np.int64)
    placed = np.zeros(total, bool)
    front = np.arange(total)
    last = offset + sizes - 1
    out[offset] = last
    placed[last] = True
    front[offset] += 1
    cursor, stops = offset.copy(), offset + sizes
    while len(cursor):
        s = out[cursor]
        at = s - 1
        at = at[~lane_start[s]]
        at = at[~placed[at]]
        while len(at):
            own = group[at]
            slot = front[own]
            front[own] = slot + 1
            out[slot] = at
            placed[at] = True
            at = before[at]
            at = at[at >= 0]
            at = at[~placed[at]]
        cursor = cursor + 1
        live = cursor < stops
        if not live.all():
            cursor, stops = cursor[live], stops[live]
    return out

