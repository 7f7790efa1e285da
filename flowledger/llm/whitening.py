"""Whitening of embeddings by their principal components, exact up to the last division.

1. Entries become integers: x = floor(1024 c) + 100000. Tasks add up the products of all rows exactly, by matrix
   products of 20-bit parts; the partial sums are added by a grouped aggregation, in 31-bit parts that can't overflow.
2. The scatter matrix n * sum(x x') - sum(x) sum(x)' is n^2 times the covariance, an integer matrix whose size
   depends on the length of a vector only. Tasks compute its characteristic polynomial modulo one prime each; Chinese remainders
   join them; the largest roots are isolated and narrowed to 256 bits (``spectrum``).
3. Tasks find the eigenvectors, one eigenvalue each, by inverse iteration in 512-bit fixed point.
4. One pass projects the rows; the result is stored, and its covariance measured on what was stored.

Defined results: rows whose vector is null or holds null or non-finite entries, or entries whose integer
doesn't fit 62 bits, are left out; an empty vector has no components and so no rows; vectors of different lengths are whitened apart,
each length with its own n and components; rows that repeat an id, or have none, each count; a component
without variance has an explained share of 0 (null if there is no variance at all) and no whitened value; a deviation of
more than 38 digits is null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.llm import spectrum
from flowledger.session import materialize

COMPONENTS = 8
# An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries must stay below this after scaling, so that they fit an integer.
MOST = 2.0**62
#: Rows multiplied at once and bits of an entry's parts, so that sums of products stay under 2^53; slices added as 64-bit integers.
SLICE, PART, HELD = 4096, 20, 64
#: Bits of the parts in which sums are handed on.
LIMB = 31
#: Rows projected at once.
PROJECTED = 1 << 14


@dataclass(frozen=True)
class Components:
    """What a length of vectors is projected with: sums of the unshifted entries, unit vectors (rows), roots of the scatter, explained shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: list[float | None]


def usable(embedding: Column) -> Column:
    """Whether all entries are finite and small enough; null vectors aren't usable."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < MOST)), F.lit(False))


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of lists of one length. The shift changes neither scatter nor deviations, so it is left out."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column("embedding"))
    for dim in pc.unique(lengths).to_pylist():
        if dim:
            yield dim, batch.filter(pc.equal(lengths, dim))


class _Sums:
    """Exact sums of rows and of their products."""

    def __init__(self, dim: int):
        self.n, self.rows, self.products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        self.held: dict[int, np.ndarray] = {}
        self.slices = 0

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        for lo in range(0, len(x), SLICE):
            self._add_slice(x[lo : lo + SLICE])

    def _add_slice(self, x: np.ndarray) -> None:
        parts, rest = [], x
        while True:  # low parts are in [0, 2^20), the last one is signed
            if np.abs(rest).max(initial=0) < 1 << PART:
                parts.append(rest)
                break
            parts.append(rest & ((1 << PART) - 1))
            rest = rest >> PART
        for i, a in enumerate(parts):
            self.rows = self.rows + (a.sum(axis=0).astype(object) << (PART * i))
            for j, b in enumerate(parts):
                product = (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64)
                self.held[i + j] = self.held[i + j] + product if i + j in self.held else product
        self.slices += 1
        if self.slices == HELD:
            self.settle()

    def settle(self) -> None:
        for at, product in self.held.items():
            self.products = self.products + (product.astype(object) << (PART * at))
        self.held, self.slices = {}, 0


def _parts(value: int) -> Iterator[tuple[int, int]]:
    """(place, part): the value in parts of LIMB bits, the last one signed."""
    at = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield at, value & ((1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1
    if value:
        yield at, value


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, place, part): n at (-1, -1), sums at (i, -1), products at i <= j, of all rows of a task."""
    totals: dict[int, _Sums] = {}
    for batch in batches:
        for dim, rows in _by_length(batch):
            totals.setdefault(dim, _Sums(dim)).add(_integers(rows.column("embedding")))
    for dim, sums in totals.items():
        sums.settle()
        cells = [(-1, -1, sums.n), *((i, -1, int(v)) for i, v in enumerate(sums.rows))]
        cells += [(i, j, int(sums.products[i, j])) for i in range(dim) for j in range(i, dim)]
        rows = [(dim, i, j, place, part) for i, j, value in cells for place, part in _parts(value)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for lo in range(0, len(rows), 1 << 16):
            columns = zip(*rows[lo : lo + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "i", "j", "place", "part"])


def scatter(vectors: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """Per length of vectors: n, sums, and the integer matrix n * products - sums sums'. Its size doesn't grow with the rows."""
    partial = vectors.select("embedding").mapInArrow(_partial_sums, "dim int, i int, j int, place int, part long")
    cells: dict[int, dict[tuple[int, int], int]] = {}
    for row in partial.groupBy("dim", "i", "j", "place").agg(F.sum("part").alias("part")).toLocalIterator():
        held = cells.setdefault(row.dim, {})
        held[row.i, row.j] = held.get((row.i, row.j), 0) + (row.part << (LIMB * row.place))
    out = {}
    for dim, held in cells.items():
        n, sums = held[-1, -1], [held.get((i, -1), 0) for i in range(dim)]
        out[dim] = n, sums, [[n * held.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    return out


def _each(spark: SparkSession, tasks: list[tuple], fn: Callable[[tuple], list], kind: str) -> list[tuple]:
    """(number, result) of ``fn`` for each of a few arguments, one task each; arguments and results travel as text and lists."""
    numbered = spark.createDataFrame([(i, *map(str, t)) for i, t in enumerate(tasks)], "at int, " + ", ".join(f"a{i} string" for i in range(len(tasks[0]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                result = fn(tuple(int(row[f"a{i}"]) for i in range(len(row) - 1)))
                item = pa.list_(pa.list_(pa.float64()) if "double" in kind else pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["at"]], pa.int32()), pa.array([result], item)], names=["at", "result"])

    many = min(len(tasks), 4 * spark.sparkContext.defaultParallelism)
    done = numbered.repartition(many, "at").mapInArrow(run, f"at int, result {kind}").collect()
    return [row.result for row in sorted(done)]


def components(spark: SparkSession, n: int, sums: list[int], matrix: list[list[int]], many: int = COMPONENTS) -> Components:
    """The ``many`` components of the largest variance, fewer if the rank is less."""
    dim, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    found: list[tuple[int, int]] = []
    shift = 0
    if trace:
        primes = spectrum.moduli(spectrum.coefficient_bound(matrix))
        residues = _each(spark, [(p,) for p in primes], lambda p: spectrum.characteristic_modulo(matrix, p[0]), "array<long>")
        found, shift = spectrum.largest_roots(spectrum.remainders_joined(residues, primes), min(many, dim))
    spaces = _each(spark, found, lambda r: spectrum.null_vectors(matrix, r[0], shift, r[1]), "array<array<double>>") if found else []
    vectors = [v for space in spaces for v in space][:many]
    roots = [root / (1 << shift) for root, times in found for _ in range(times)][:many]
    explained: list[float | None] = [root / (trace << shift) for root, times in found for _ in range(times)][:many]
    explained += [0.0 if trace else None] * (min(many, dim) - len(explained))
    return Components(n, sums, np.array(vectors, np.float64).reshape(len(vectors), dim), np.array(roots), explained)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: 64-bit integers where they suffice."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares per row."""
    if z.dtype == object or np.abs(z).max(initial=0) >= 1 << 48 or z.shape[1] >= 1 << 15:
        return [int(v) for v in (z.astype(object) ** 2).sum(axis=1)]
    high, low = z >> 24, z & ((1 << 24) - 1)
    sums = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(int(a) << 48) + (int(b) << 25) + int(c) for a, b, c in zip(*(s.tolist() for s in sums), strict=True)]


def projected(vectors: DataFrame, fitted: dict[int, Components]) -> DataFrame:
    """vec_id, dim, n, deviation, whitened: an entry per component, null where a component has no variance."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PROJECTED):
                for dim, rows in _by_length(batch.slice(lo, PROJECTED)):
                    fit = fitted[dim]
                    z = _centred(_integers(rows.column("embedding")), fit.n, fit.sums)
                    squares = [Decimal(v) if v < 10**38 else None for v in _square_sums(z)]
                    white = (z.astype(np.float64) @ fit.vectors.T) / np.sqrt(fit.roots)
                    values = [w + [None] * (len(fit.explained) - len(w)) for w in white.tolist()]
                    many = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("vec_id"), pa.array(np.full(many, dim), pa.int32()), pa.array(np.full(many, fit.n), pa.int64()),
                         pa.array(squares, pa.decimal128(38, 0)), pa.array(values, pa.list_(pa.float64()))],
                        names=["vec_id", "dim", "n", "deviation", "whitened"],
                    )

    return vectors.select("vec_id", "embedding").mapInArrow(project, f"vec_id {kind}, dim int, n long, deviation decimal(38,0), whitened array<double>")


def identity_errors(white: DataFrame, many: int = COMPONENTS) -> DataFrame:
    """dim, identity_error: the largest entry of the whitened values' covariance less the identity, null without components."""
    value = [F.get("whitened", F.lit(i)) for i in range(many)]
    entries = [F.abs(F.covar_pop(value[i], value[j]) - (1.0 if i == j else 0.0)) for i in range(many) for j in range(i, many)]
    return white.groupBy("dim").agg(F.array_max(F.array(*entries)).alias("identity_error"))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", many: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).filter(usable(F.col("embedding")))
    fitted = {dim: components(spark, *parts, many) for dim, parts in scatter(rows).items()}
    white = materialize(projected(rows, fitted), "whitened")
    shares = [(dim, i, share) for dim, fit in fitted.items() for i, share in enumerate(fit.explained)]
    explained = spark.createDataFrame(shares, "dim int, at int, explained double")
    each = white.select("vec_id", "dim", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.join(explained, ["dim", "at"]).join(identity_errors(white, many), "dim").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error"
    )
