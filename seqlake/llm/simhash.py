"""SimHash near-duplicates by the generalised pigeonhole principle.

1. One pass computes each text's 64-bit fingerprint from its word shingles.
2. The 64 x 64 co-occurrence counts of the bits over all distinct fingerprints (a fixed-size statistic) give their
   correlations; correlated bits are grouped into the same part.
3. A histogram of the values of each part (at most 2^16 cells a part), or the bits' frequencies where parts are wider,
   estimates how many candidates a probe of radius t would meet. For each fingerprint a dynamic programme shares
   tau + 1 units among the parts at the least estimated cost: a part with n units is probed with radius n - 1, a part
   with none is not probed. If every part of a pair differed by its n bits or more, the pair would differ by tau + 1, so
   each link is found by the probes of either end alone, however unequal the shares.
4. Probes meet the parts' values in an equi join that verifies the whole distance. Only distinct fingerprints take
   part, so copies are never paired.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import ROW, ROW_ARROW, Scratch, arrow_map, batch, column, numbered, spare, without
from seqlake.operators.components import connected_components

SHINGLE, SEED, TAU = 4, 42, 4
#: Parts up to this width have exact histograms (2^16 cells each: the largest thing that is broadcast).
EXACT_WIDTH = 16
#: Distinct fingerprints up to which 4, then 3 parts are used: wider parts keep buckets small as the corpus grows.
PARTS_BY_SIZE = ((1 << 22, 4), (1 << 30, 3))
_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; null and wordless texts have 0."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(h(joined, SEED)).astype(np.int64))
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    for k in range(0, n, _CHUNK):
        here = starts[k : min(k + _CHUNK, n) + shingle].tolist()
        hashes = np.array([h(joined[i:j], SEED) for i, j in zip(here, [x - 1 for x in here[shingle:]])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, fp), and row if docs have a row key in that column: every row and whole text."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *([("row", ROW_ARROW)] if row else [])])

    def run(batches):
        for b in batches:
            yield batch(out, b.column(0), [fingerprint(t) for t in b.column(1).to_pylist()], *b.columns[2:])

    columns = [column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"), *([F.col(row).alias("row")] if row else [])]
    return arrow_map(docs.select(*columns), run, "doc_id long, fp long" + f", row {ROW}" * bool(row))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together over all distinct fingerprints."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += (x.T @ x).astype(np.float64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j, pa.int64()), pa.array(total[i, j].astype(np.int64))], names=["cell", "n"])

    out = np.zeros(64 * 64)
    for r in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        out[r.cell] = r.n
    return out.reshape(64, 64)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal width; a part takes the bits most correlated with those that it has."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        width = math.ceil(len(left) / (parts - k))
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < width:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    x = _bits(fps)
    return [x[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups]


def _histograms(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many distinct fingerprints have each value of each part: parts x 2^16 cells at most."""
    size = 1 << EXACT_WIDTH

    def run(batches):
        total = np.zeros(len(groups) * size, np.int64)
        for b in batches:
            for k, v in enumerate(part_values(b.column(0).to_numpy(zero_copy_only=False), groups)):
                total += np.bincount(v + k * size, minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(len(groups) * size, np.int64)
    flat[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return [flat[k * size : k * size + (1 << len(g))] for k, g in enumerate(groups)]


def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def _estimates(values: list[np.ndarray], groups: list[list[int]], most: int, hist: list[np.ndarray] | None, p: np.ndarray, n: int) -> list[np.ndarray]:
    """For each part, (rows, most + 1): the cost of 0, 1, ... units, which is probes made plus candidates met."""
    out = []
    for k, (v, g) in enumerate(zip(values, groups, strict=True)):
        w, cost = len(g), np.zeros((len(v), most + 1))
        if hist is None:  # bits taken as independent: distribution of the distance to a random fingerprint
            bits = (v[:, None] >> np.arange(w)) & 1
            dist = np.zeros((len(v), most))
            dist[:, 0] = 1
            for i in range(w):
                differs = np.where(bits[:, i] == 1, 1 - p[g[i]], p[g[i]])[:, None]
                dist = dist * (1 - differs) + np.hstack([np.zeros((len(v), 1)), dist[:, :-1]]) * differs
            met = n * dist.cumsum(1)
        for u in range(1, most + 1):
            near = masks(w, u - 1)
            cost[:, u] = len(near) + (hist[k][u - 1][v] if hist is not None else met[:, u - 1])
        out.append(cost)
    return out


def allocate(costs: list[np.ndarray], units: int) -> np.ndarray:
    """(rows, parts): units of each part, of least total cost, by dynamic programming over parts."""
    rows, most = len(costs[0]), costs[0].shape[1] - 1
    best, choice = np.full((rows, units + 1), np.inf), []
    best[:, 0] = 0
    for c in costs:
        options = np.full((most + 1, rows, units + 1), np.inf)
        for u in range(min(most, units) + 1):
            options[u, :, u:] = best[:, : units + 1 - u] + c[:, u : u + 1]
        choice.append(options.argmin(0))
        best = options.min(0)
    out, left = np.zeros((rows, len(costs)), np.int64), np.full(rows, units)
    for k in range(len(costs) - 1, -1, -1):
        out[:, k] = choice[k][np.arange(rows), left]
        left = left - out[:, k]
    return out


def links(nodes: DataFrame, scratch: Scratch, tau: int = TAU, parts: int | None = None) -> DataFrame:
    """(fp, other): every pair of distinct fingerprints at tau or fewer differing bits, the smaller first.

    nodes: one column fp, distinct, a table that is cheap to read again. parts: by the number of fingerprints if None;
    any number from 1 to 64 finds the same links.
    """
    spark, n = nodes.sparkSession, nodes.count()
    m = parts or next((k for size, k in PARTS_BY_SIZE if n <= size), 2)
    together = bit_counts(nodes)
    groups, p = group_bits(together, n, m), np.diag(together) / max(n, 1)
    most = min(tau + 1, math.ceil((tau + 1) / m) + 1)
    hist = None
    if max(map(len, groups)) <= EXACT_WIDTH:
        hist = []
        for h, g in zip(_histograms(nodes, groups), groups, strict=True):
            at = np.arange(len(h))
            layers, total = [], np.zeros(len(h), np.int64)
            for r in range(most):
                total = total + sum(h[at ^ x] for x in masks(len(g), r)[len(masks(len(g), r - 1)) if r else 0 :])
                layers.append(total.astype(np.float32))
            hist.append(layers)
    shared = spark.sparkContext.broadcast((groups, hist, p))
    schema = "part int, key long, fp long"

    def probe(batches):
        groups, hist, p = shared.value
        ball = {(k, u): masks(len(g), u - 1) for k, g in enumerate(groups) for u in range(1, most + 1)}
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            values = part_values(fps, groups)
            units = allocate(_estimates(values, groups, most, hist, p, n), tau + 1)
            for k, v in enumerate(values):
                for u in range(1, most + 1):
                    mine = np.nonzero(units[:, k] == u)[0]
                    if len(mine):
                        near = ball[k, u]
                        key = (v[mine][:, None] ^ near).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(np.repeat(fps[mine], len(near)))], names=["part", "key", "fp"])

    def index(batches):
        groups = shared.value[0]
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for k, v in enumerate(part_values(fps, groups)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(fps)], names=["part", "key", "other"])

    probes = arrow_map(nodes.select("fp"), probe, schema)
    values = arrow_map(nodes.select("fp"), index, "part int, key long, other long")
    near = probes.join(values, ["part", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau))
    return scratch.table(near.select("fp", "other").distinct(), "near")


def _components(fps: DataFrame, scratch: Scratch, tau: int, parts: int | None) -> DataFrame:
    """(fp, label, component_id, n_links) of the distinct fingerprints of fps (doc_id, fp), a written table."""
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    near = links(nodes.select("fp"), scratch, tau, parts)
    label = connected_components(near, "fp", "other", scratch)
    degree = near.select("fp").unionByName(near.select(F.col("other").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    comp = (
        nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
        .select("fp", "least", F.coalesce("label", "fp").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    comp = scratch.table(comp, "labelled")
    least = comp.groupBy("label").agg(F.min("least").alias("component_id"))
    return scratch.table(comp.join(least, "label").select("fp", "label", "component_id", "n_links"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, parts: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable over links of tau or fewer bits; n_links counts the other distinct
    fingerprints linked to the row's own. Null and empty texts have fingerprint zero and link like any other. A row
    with a null id takes part; its component's id is that of the smallest non-null id, or null. Repeated ids give
    repeated rows. An empty table gives no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _components(fps, scratch, tau, parts)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """docs with one row of each component: that with the smallest id (a null id only where there is no other), of rows
    that share it the first in the table. Rows go by their place in the table, not by id."""
    scratch, row = Scratch(docs.sparkSession, "near"), spare(docs, "row")
    rows = numbered(docs, scratch, row)
    fps = scratch.table(fingerprints(rows, id_col, text_col, row), "fingerprints")
    known = scratch.table(fps.join(_components(fps, scratch, tau, None), "fp").select("row", "doc_id", "label", "component_id"), "known")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ties = known.where(least).groupBy("label").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    later = known.where(least).join(ties, "label").where("row <> first")
    return without(rows, known.where(~least).select(F.col("row").alias(row)).unionByName(later.select(F.col("row").alias(row))), row, scratch)
