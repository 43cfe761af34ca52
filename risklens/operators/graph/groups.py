"""GR6 inside connected groups of few keys, a group at a time in one task.

A distribution never leaves its connected group, so groups can be dealt to
tasks: rows (key, start label, cells) sorted by group, products of the group's
matrix of shared cells with the matrix of its distributions. A task holds one
group; its size is bounded by the caller.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an output batch, about.
BATCH_ROWS = 50_000


def distributions(cells: np.ndarray, owner: np.ndarray, labels: np.ndarray, known: np.ndarray, steps: int, seed_label: int):
    """``names, dist``: the group's labels and, per key, their probabilities after ``steps``
    rounds. ``cells[i]`` is a cell of key ``owner[i]``; keys whose start is not ``known`` send nothing at first."""
    n = len(labels)
    _, at = np.unique(cells, return_inverse=True)
    held = np.zeros((n, at.max() + 1))
    held[owner, at] = 1.0
    shares = held @ held.T
    np.fill_diagonal(shares, 0.0)
    others = shares.sum(axis=1, keepdims=True)
    names, column = np.unique(labels[known], return_inverse=True)
    dist = np.zeros((n, len(names)))
    dist[np.flatnonzero(known), column] = 1.0
    seed = np.flatnonzero(names == seed_label)
    for _ in range(steps):
        new = shares @ dist / others
        if len(seed):
            clamped = dist[:, seed[0]] == 1.0
            new[clamped] = dist[clamped]
        dist = new
    return names, dist


def group_bm_label_propagation(members: DataFrame, steps: int, seed_label: int, parts: int) -> DataFrame:
    """``(k, label, prob)`` of ``members(component, k, label, cells)``, one row a key, in ``parts`` tasks."""
    names = ["k", "label", "prob"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, pending = [], 0, None

        def told(batch, first, last):
            lists = batch.column("cells")
            ends = lists.offsets.to_numpy()[first:last + 1]
            label = batch.column("label").slice(first, last - first)
            labels, dist = distributions(
                lists.values.to_numpy()[ends[0]:ends[-1]], np.repeat(np.arange(last - first), np.diff(ends)),
                label.fill_null(0).to_numpy(), label.is_valid().to_numpy(zero_copy_only=False), steps, seed_label)
            key, column = np.nonzero(dist)
            return batch.column("k").to_numpy()[first:last][key], labels[column], dist[key, column]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

        def groups():
            nonlocal pending
            for batch in batches:
                if pending is not None:
                    batch = pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
                if not batch.num_rows:
                    continue
                of = batch.column("component").to_numpy()
                starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1)]
                for first, last in zip(starts, starts[1:]):
                    yield told(batch, first, last)
                pending = batch.slice(starts[-1])
            if pending is not None:
                yield told(pending, 0, pending.num_rows)

        for got in groups():
            out.append(got)
            rows += len(got[0])
            if rows >= BATCH_ROWS:
                yield flush()
                out, rows = [], 0
        if out:
            yield flush()

    return (members.select("component", "k", "label", "cells").repartition(parts, "component").sortWithinPartitions("component")
            .mapInArrow(spread, "k long, label long, prob double"))
