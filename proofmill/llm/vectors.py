"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. After a rotation the coordinates are split into
blocks; if two vectors are within the squared distance D, then in some block they are within that block's share
of D. So each block is range-joined under its share, on a grid over its first coordinate, and every pair that
any block finds is checked by its exact cosine. Nothing is lost and each pair is counted in its first block only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.components import components

LEAST_COSINE = 0.93
BLOCKS = 4
#: Added to each block's share, far above the rounding of coordinates.
SLACK = 1e-5
#: Rows of one side that a task compares at a time; larger cells are cut and their parts compared pair by pair.
CHUNK_ROWS, PAIRS = 2048, 1 << 16


def block_edges(dim: int, blocks: int) -> list[int]:
    count = min(blocks, dim)
    return [dim * k // count for k in range(count + 1)]


def shares(dim: int, blocks: int, least: float) -> list[float]:
    """Each block's squared distance: its part of the dimensions."""
    edges = block_edges(dim, blocks)
    return [(2 - 2 * least) * (b - a) / dim + SLACK for a, b in zip(edges, edges[1:])]


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix that depends on ``dim`` alone; it spreads what differs evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rotated(rows: DataFrame, blocks: int, least: float) -> DataFrame:
    """(rep, label, dim, copies, turned, cells): bytes of the rotated unit vector in double precision, and its cell in each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                dim = int(dim)
                turn = turns.setdefault(dim, rotation(dim))
                unit = np.array(part["embedding"].tolist(), dtype=np.float64)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                turned = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ turn
                reach = np.sqrt(shares(dim, blocks, least))
                cells = np.floor(turned[:, block_edges(dim, blocks)[:-1]] / reach).astype(np.int32)
                yield pd.DataFrame({
                    "rep": part["rep"], "label": part["label"], "dim": dim, "copies": part["copies"],
                    "turned": [x.tobytes() for x in turned], "cells": list(cells),
                })

    return rows.mapInPandas(run, "rep bigint, label bigint, dim int, copies bigint, turned binary, cells array<int>")


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), dim)


def _forest(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same ids as the symmetric matrix ``near``, one less than there are ids in each component."""
    left, out = near.any(axis=1), []
    while left.any():
        root = int(np.argmax(left))
        seen, front = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
        front[root] = True
        while front.any():
            seen |= front
            front = near[front].any(axis=0) & ~seen
        left &= ~seen
        seen[root] = False
        out += [(int(ids[root]), int(x)) for x in ids[seen]]
    return out


def compare_cell(rows: pd.DataFrame, least: float, blocks: int) -> pd.DataFrame:
    """Links of one part of a cell: (a, b) of a spanning forest with n null, and (a, n) how many vectors a links to."""
    dim, block, i, j = (int(rows[c].iloc[0]) for c in ("dim", "block", "i", "j"))
    rows = rows.drop_duplicates(["rep", "home"]).sort_values(["rep"])
    turned = _matrix(rows["turned"], dim)
    ids, copies, home, chunk = (rows[c].to_numpy() for c in ("rep", "copies", "home", "chunk"))
    edges, most = block_edges(dim, blocks), shares(dim, blocks, least)
    one, two = np.flatnonzero(home & (chunk == i)), np.flatnonzero(chunk == j)
    part = turned[:, edges[block] : edges[block + 1]]
    square = (part * part).sum(axis=1)
    apart = square[one][:, None] + square[two][None, :] - 2 * part[one] @ part[two].T
    wanted = apart <= most[block] + SLACK
    if i == j:  # among rows at home each pair once
        wanted &= ~home[two][None, :] | (one[:, None] < two[None, :])
    x, y = np.nonzero(wanted)
    near, links = np.zeros((len(ids), len(ids)), dtype=bool), np.zeros(len(ids), dtype=np.int64)
    for at in range(0, len(x), PAIRS):
        a, b = one[x[at : at + PAIRS]], two[y[at : at + PAIRS]]
        gap = (turned[a] - turned[b]) ** 2
        by_block = np.stack([gap[:, s:e].sum(axis=1) for s, e in zip(edges, edges[1:])], axis=1) <= np.array(most)
        first = by_block[:, block] & ~by_block[:, :block].any(axis=1)
        a, b = a[first], b[first]
        close = np.einsum("ij,ij->i", turned[a], turned[b]) >= least
        a, b = a[close], b[close]
        near[a, b] = near[b, a] = True
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
    some = np.flatnonzero(links)
    forest = _forest(near, ids)
    return pd.DataFrame({
        "a": [int(v) for v in ids[some]] + [v for v, _ in forest],
        "b": pd.array([None] * len(some) + [v for _, v in forest], dtype="Int64"),
        "n": pd.array([int(v) for v in links[some]] + [None] * len(forest), dtype="Int64"),
    })


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each vec_id of ``rows`` (vec_id, embedding, label).

    Only vectors of equal label and equal length are compared. Vectors or labels that are null, vectors of zeros
    and vectors with a null or non-finite component link with nothing. Equal vectors are one point with a count,
    so a large group of copies costs one comparison; a repeated row counts once. A null vec_id keeps its row and
    links with nothing; an id with two vectors gets a row for each. Other columns are not read.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(valid).withColumns({"h1": F.xxhash64(F.lit(1), "embedding"), "h2": F.xxhash64(F.lit(2), "embedding")})
    members = usable.select("vec_id", "label", "h1", "h2").distinct()
    classes = scratch.materialize(members.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    points = usable.withColumnRenamed("vec_id", "rep").join(classes, ["rep", "label", "h1", "h2"]).dropDuplicates(["rep", "label", "h1", "h2"])
    points = scratch.materialize(_rotated(points.select("rep", "label", "embedding", "copies"), blocks, least), "rotated")
    # Home cell, and the next cell as a visitor: two rows within reach of each other meet in one of them, once.
    at = points.select("*", F.posexplode("cells").alias("block", "own")).drop("cells")
    at = at.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("home")).withColumn("cell", F.col("own") + F.when(F.col("home"), 0).otherwise(1))
    cell = ["label", "dim", "block", "cell"]
    keys = points.select("label", "dim", F.posexplode("cells").alias("block", "own")).select("label", "dim", "block", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("cell"))
    parts = keys.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("parts"))
    at = at.join(parts, cell).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_first = F.transform(F.filter(every, lambda j: F.col("home") & (j != F.col("chunk"))), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j")))
    as_second = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j")))
    # Parts of rows at home meet once, in the order of their numbers; visitors meet every part at home.
    pairs = F.filter(F.concat(as_first, as_second), lambda p: ~F.col("home") | (p["i"] <= p["j"]) | (p["i"] == F.col("chunk")))
    spread = at.select(*cell, "rep", "copies", "turned", "home", "chunk", F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")
    found = spread.groupBy(*cell, "i", "j").applyInPandas(lambda part: compare_cell(part, least, blocks), "a bigint, b bigint, n bigint")
    found = scratch.materialize(found, "links")
    degrees = found.where(F.col("n").isNotNull()).groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    by_class = classes.join(degrees, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("id"), "left")
    by_class = by_class.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = members.join(by_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(valid, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).distinct()
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
