"""Embedding whitening by incremental eigendecomposition (operator 11).

Each partition keeps the count, the mean and the spectrum of its scatter matrix, as ``LANES`` of them side by side. A row changes
the scatter by a centred rank-one term, n/(n+1) times the outer product of its distance from the mean: in the
current eigenbasis that is a diagonal plus a rank-one matrix. Small weights and equal
eigenvalues are deflated, the others come from the secular equation, and the eigenvectors
follow from weights that are recomputed from the roots, so the basis stays orthonormal. Spectra of
partitions are combined the same way in groups of ``FAN``: every eigenpair of the one and the distance
of the means are rank-one terms of the other. A last pass over all rows takes the covariance
in the combined basis (Rayleigh-Ritz); its rotation brings the components to double precision.

What is kept per partition has the size of one covariance matrix; no task, group or driver holds more
than ``FAN`` of these, whatever the number of rows. The exact sums of the integers come from Spark.

Defined results: rows with a NULL vector, a NULL or non-finite entry, or an entry beyond 2**40 in
magnitude (whose integers could not be summed exactly) take no part, nor do vectors of another length than
the most frequent one (of equally frequent ones the longest), nor empty vectors. NULL and repeated ids and repeated rows count
like others; other columns are ignored. Components without variance have explained 0 and a NULL
whitened. A deviation beyond 64 bits is NULL and is found in ``deviation_exact``. Vectors of fewer than
``COMPONENTS`` entries have as many components as entries. Without rows the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Shipped, map_batches, shared_table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 40)
FAN = 16
DEAL = 2  # partitions for each core
LANES = 4  # a power of two
EPS = np.finfo(np.float64).eps
NEAR = EPS ** (1 / 3)
LIMIT = (1 << 63) - 1


# --- rank-one updates of a spectrum ---------------------------------------------------


def roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of f(x) = 1 + sum z^2/(d - x) for ascending distinct ``d`` and nonzero ``z``, and at [i, j] d[j] less root i.

    ``d`` and ``z`` may be stacks of problems, which are solved side by side.
    Root i lies between d[i] and d[i+1] (the last one up to d[-1] + |z|^2). It is sought as the distance
    from the nearer pole, which keeps its digits. A step solves c + s/(d[i] - x) + t/(d[i+1] - x) = 0.
    From the middle, s and t are the weights of these poles; later steps fit c, s and t to the value and two
    derivatives of f, so that each error is of the order of the third power of the one before: a step below the third root of
    a rounding error is the last. A step that leaves the bracket is replaced by halving.
    """
    n, weight = d.shape[-1], z * z
    own = np.arange(n)
    after = np.minimum(own + 1, n - 1)
    half = (d[..., after] - d) / 2
    half[..., -1] = weight.sum(axis=-1) / 2
    total = lambda terms: (terms @ weight[..., None])[..., 0]
    value = 1 + total(1 / (d[..., None, :] - (d + half)[..., None]))
    left = value >= 0
    left[..., -1] = True
    nearer = np.take_along_axis(d, np.where(left, own, after), -1)
    gaps = d[..., None, :] - nearer[..., None]  # poles seen from each root's own
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    beyond = value[..., -1] < 0
    low[..., -1] = np.where(beyond, half[..., -1], 0.0)
    high[..., -1] *= np.where(beyond, 2 * (1 + 4 * EPS), 1.0)  # of one pole the root is this bound
    first, second = d - nearer, d[..., after] - nearer
    second[..., -1] = 4 * half[..., -1]  # the last root has a pole on its left only: this one has no weight
    x = np.where(left, half, -half)
    moving = np.ones(x.shape, bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        a, b = first - x, second - x
        s, t = weight, weight[..., after] * (own < n - 1)
        c, linear = value - s / a - t / b, value * (a + b) - (s / (a * a) + t / (b * b)) * a * b
        for k in range(64):
            constant = value * a * b
            # The solution of c h^2 - linear h + constant = 0 next to zero.
            root = linear + np.copysign(np.sqrt(np.maximum(linear * linear - 4 * c * constant, 0.0)), linear)
            tried = x + np.where(linear >= 0, 2 * constant / root, root / (2 * c))
            inside = (tried >= low) & (tried <= high) & (tried != 0)  # 0 is the pole
            last = inside & (np.abs(tried - x) <= NEAR * np.abs(tried)) & (k > 0)  # the first step is no such fit
            tried = np.where(inside, tried, (low + high) / 2)
            x = np.where(moving, tried, x)
            moving &= ~last
            if not moving.any():
                break
            inverse = 1 / (gaps - x[..., None])
            square = inverse * inverse
            value, slope, bend = 1 + total(inverse), total(square), total(square * inverse)
            over = value > 0
            low, high = np.where(over, low, x), np.where(over, x, high)
            a, b = first - x, second - x
            both, product = a + b, a * b
            c, linear = value - slope * both + bend * product, value * both - slope * product
    return nearer + x, gaps - x[..., None]


def turned(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' and its eigenvectors as rows; ``d`` and ``z`` as in ``roots``."""
    found, away = roots(d, z)
    # The weights these roots belong to exactly: products of distances, each ratio near one.
    spread = d[..., None, :] - d[..., None]
    own = np.arange(d.shape[-1])
    spread[..., own, own] = 1.0
    exact = np.copysign(np.sqrt(np.abs(np.prod(away / spread, axis=-2))), z)
    turn = exact[..., None, :] / away
    return found, turn / np.sqrt(np.einsum("...ij,...ij->...i", turn, turn))[..., None]


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of Q diag(values) Q' + weight v v', values ascending; ``weight`` is not negative."""
    z = (v @ vectors) * np.sqrt(weight)
    norm = float(np.sqrt(z @ z))
    if not norm:
        return values, vectors
    tolerance = 4 * EPS * max(abs(values[-1]), norm * norm)
    z[np.abs(z) * norm <= tolerance] = 0.0
    active = np.flatnonzero(z)
    close = np.flatnonzero(np.diff(values[active]) <= tolerance)
    if len(close):  # equal eigenvalues: a rotation leaves one of the two out
        vectors = vectors.copy()
        for i in close:
            a, b = active[i], active[i + 1]
            r = np.hypot(z[a], z[b])
            c, s = z[b] / r, z[a] / r
            vectors[:, a], vectors[:, b] = c * vectors[:, a] - s * vectors[:, b], s * vectors[:, a] + c * vectors[:, b]
            z[a], z[b] = 0.0, r
        active = np.flatnonzero(z)
    if not len(active):
        return values, vectors
    d, w = values[active], z[active]
    found, turn = turned(d, w)
    if len(active) == len(values):  # nothing left out: roots between poles are in order
        return found, vectors @ turn.T
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[active] = found
    out_vectors[:, active] = vectors[:, active] @ turn.T
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


def update_each(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: np.ndarray) -> None:
    """``updated`` for a stack of spectra in place: side by side where nothing is left out, else one by one."""
    z = (v[:, None] @ vectors)[:, 0] * np.sqrt(weight)[:, None]
    norm = np.sqrt((z * z).sum(axis=1))
    tolerance = 4 * EPS * np.maximum(np.abs(values[:, -1]), norm * norm)
    whole = (np.abs(z) * norm[:, None] > tolerance[:, None]).all(axis=1) & (np.diff(values) > tolerance[:, None]).all(axis=1)
    if whole.all():
        values[:], turn = turned(values, z)
        vectors[:] = vectors @ turn.swapaxes(1, 2)
        return
    for i in range(len(values)):
        values[i], vectors[i] = updated(values[i], vectors[i], v[i], float(weight[i]))


class Spectra:
    """``LANES`` spectra that take turns with the rows, so that one numpy call serves them all; in the end they are merged."""

    def __init__(self, size: int):
        self.n, self.mean = np.zeros(LANES, np.int64), np.zeros((LANES, size))
        self.values, self.vectors = np.zeros((LANES, size)), np.tile(np.eye(size), (LANES, 1, 1))

    def add(self, rows: np.ndarray, times: np.ndarray) -> None:
        """A row for each of the first spectra, as often as ``times`` says."""
        to = slice(len(rows))
        apart, total = rows - self.mean[to], self.n[to] + times
        update_each(self.values[to], self.vectors[to], apart, self.n[to] * times / total)
        self.mean[to] += apart * (times / total)[:, None]
        self.n[to] = total

    def merged(self) -> tuple:
        """Count, mean and spectrum of all rows."""
        n, mean, values, vectors = self.n, self.mean, self.values, self.vectors
        while len(n) > 1:
            half = len(n) // 2
            for at in np.flatnonzero((values[half:] > 0).any(axis=0)):
                update_each(values[:half], vectors[:half], vectors[half:, :, at], np.maximum(values[half:, at], 0.0))
            apart, total = mean[half:] - mean[:half], np.maximum(n[:half] + n[half:], 1)
            update_each(values[:half], vectors[:half], apart, n[:half] * n[half:] / total)
            mean = mean[:half] + apart * (n[half:] / total)[:, None]
            n, values, vectors = n[:half] + n[half:], values[:half], vectors[:half]
        return int(n[0]), mean[0], values[0], vectors[0].ravel()


class Spectrum:
    """Count, mean and spectrum of the scatter of the rows seen."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, row: np.ndarray, times: int = 1) -> None:
        """``times`` equal rows."""
        apart = row - self.mean
        total = self.n + times
        if self.n:
            self.values, self.vectors = updated(self.values, self.vectors, apart, self.n * times / total)
        self.mean = self.mean + apart * (times / total)
        self.n = total

    def merge(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self.values, self.vectors = updated(self.values, self.vectors, vector, float(value))
        apart, total = mean - self.mean, self.n + n
        if self.n and n:
            self.values, self.vectors = updated(self.values, self.vectors, apart, self.n * n / total)
        self.mean = self.mean + apart * (n / total)
        self.n = total

    def row(self) -> tuple:
        return self.n, self.mean, self.values, self.vectors.ravel()


# --- rows -----------------------------------------------------------------------------


def integers(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch take part, and their integers."""
    column = batch.column("vector")
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    fits = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(fits)).flatten() if len(fits) else None
    if flat is None:
        return fits, np.zeros((0, size), np.int64)
    rows = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # NULL becomes NaN
    with np.errstate(invalid="ignore"):
        good = (np.abs(rows) < LARGEST).all(axis=1)
    return fits[good], np.floor(rows[good] * SCALE).astype(np.int64) + SHIFT


def _size(docs: DataFrame) -> int | None:
    """The most frequent length among usable vectors."""
    usable = docs.where("size(vector) > 0").where(F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)))
    top = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else None


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([np.asarray(r) for r in rows], pa.list_(kind))


STATE = "n bigint, mean array<double>, values array<double>, vectors array<double>, sums array<bigint>"


def partial_spectra(docs: DataFrame, size: int) -> DataFrame:
    """One row per partition that has rows: its spectrum and exact sums."""

    def run(batches):
        seen, sums = Spectra(size), np.zeros(size, np.int64)
        for batch in batches:
            _, x = integers(batch, size)
            if not len(x):
                continue
            sums += x.sum(axis=0)
            different, times = np.unique(x, axis=0, return_counts=True)
            rows = different.astype(np.float64)
            for at in range(0, len(rows), LANES):
                seen.add(rows[at : at + LANES], times[at : at + LANES])
        n, *arrays = seen.merged()
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), *(_lists([a], pa.float64()) for a in arrays), _lists([sums], pa.int64())],
                ["n", "mean", "values", "vectors", "sums"])

    # An update costs far more than sending its row, and files may be few or of uneven row groups.
    cores, splits = docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    dealt = docs.select("vector").repartition(DEAL * cores) if splits < DEAL * cores else docs.select("vector")
    return dealt.mapInArrow(run, STATE)


def combined(spectra: DataFrame, size: int, fan: int = FAN) -> tuple[int, list[int], np.ndarray] | None:
    """Count, exact sums and basis of all spectra, merged ``fan`` at a time.

    Sums leave 64 bits only in the total, which is added up in decimals.
    """
    spectra = shared_table(spectra)
    totals = spectra.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    if not totals:
        return None

    def merge(key, table):
        parts = table.sort_by([("n", "descending"), ("at", "ascending")]).to_pylist()
        seen = Spectrum(size)
        first = parts[0]
        seen.n, seen.mean, seen.values = first["n"], np.array(first["mean"]), np.array(first["values"])
        seen.vectors = np.array(first["vectors"]).reshape(size, size)
        for p in parts[1:]:
            seen.merge(p["n"], np.array(p["mean"]), np.array(p["values"]), np.array(p["vectors"]).reshape(size, size))
        n, *arrays = seen.row()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), *(_lists([a], pa.float64()) for a in arrays)],
                        names=["at", "n", "mean", "values", "vectors"])

    schema = "at bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"
    left = spectra.withColumn("at", F.monotonically_increasing_id()).select("at", "n", "mean", "values", "vectors")
    # Spectra of a partition have consecutive ids within it, of different ones distant ones: number them first, by few and short rows.
    ids = left.select("at").orderBy("at").collect()
    many = len(ids)
    if many > 1:
        place = left.sparkSession.createDataFrame([(r["at"], i) for i, r in enumerate(ids)], "at bigint, place bigint")
        left = shared_table(left.join(place, "at").drop("at").withColumnRenamed("place", "at").select("at", "n", "mean", "values", "vectors"))
    while many > 1:
        left = shared_table(left.groupBy(F.floor(F.col("at") / fan).alias("group")).applyInArrow(merge, schema))
        many = -(-many // fan)
    basis = np.array(left.select("vectors").head()["vectors"]).reshape(size, size)
    return totals[0]["n"], [int(r["x"]) for r in totals], basis


def _sums(docs: DataFrame, size: int, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of y and of y y', where y is the centred row in the ``basis`` (columns)."""
    many = basis.shape[1]
    shipped = Shipped(docs.sparkSession, (_centre(n, sums), basis))

    def run(batches):
        centre, columns = shipped.value.value
        first, second = np.zeros(many), np.zeros((many, many))
        for batch in batches:
            _, x = integers(batch, size)
            if len(x):
                y = centred(x, centre) @ columns
                first += y.sum(axis=0)
                second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(many * (many + 1), dtype=np.int32)), pa.array(np.r_[first, second.ravel()])], ["at", "x"])

    out = docs.select("vector").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(many * (many + 1))
    flat[out.column("at").to_numpy()] = out.column("x").to_numpy()
    return flat[:many], flat[many:].reshape(many, many)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as a whole part and a fraction: differences of large numbers then keep their digits."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def centred(x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - centre[0]).astype(np.float64) - centre[1]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    total = np.array(sums, object)
    largest = max(abs(s) for s in sums) + n * int(np.abs(x).max(initial=0))
    if largest < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] <= LIMIT:
            return (apart * apart).sum(axis=1).tolist()
        apart = apart.astype(object)
    else:
        apart = n * x.astype(object) - total
    return [int(d) for d in (apart * apart).sum(axis=1)]


class Whitener:
    """Fitted components: ``columns`` whitens a centred row."""

    def __init__(self, size: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.size, self.n, self.sums = size, n, sums
        self.values, self.vectors = values, vectors
        self.explained = [float(v / trace) if v > 0 else 0.0 for v in values]
        self.columns = vectors / np.sqrt(np.where(values > 0, values, 1.0))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> Whitener | None:
    """Components of all usable vectors of ``df``; None without any."""
    docs = df.select(F.col(vector).alias("vector"))
    size = _size(docs)
    found = combined(partial_spectra(docs, size), size, fan) if size else None
    if found is None:
        return None
    n, sums, basis = found
    basis = np.linalg.qr(basis[:, ::-1])[0]
    first, second = _sums(docs, size, n, sums, basis)
    covariance = second / n - np.outer(first / n, first / n)
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)  # Rayleigh-Ritz: one small symmetric matrix
    trace = float(np.trace(covariance))
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    values = np.where(values > 64 * EPS * max(trace, 0.0) * size, values, 0.0)
    vectors = basis @ turn
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitener(size, n, sums, values, vectors * np.where(sign == 0, 1.0, sign), trace)


def identity_error(df: DataFrame, model: Whitener, vector: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None
    first, second = _sums(df.select(F.col(vector).alias("vector")), model.size, model.n, model.sums, model.columns[:, live])
    mean = first / model.n
    return float(np.abs(second / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


COLUMNS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact) per usable row and component."""
    docs = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    model = fit(docs, "vector", components, fan)
    error = identity_error(docs, model, "vector") if model else None
    names = ["key", *(c.split()[0] for c in COLUMNS.split(", "))]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if model is None:
                kinds = [batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.decimal128(38, 0)]
                return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
            rows, x = integers(batch, model.size)
            many = len(model.values)
            w = centred(x, _centre(model.n, model.sums)) @ model.columns
            exact = deviations(x, model.n, model.sums)
            each = pa.array(np.repeat(np.arange(len(x)), many))
            absent = np.tile(model.values <= 0, len(x))
            return pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(np.repeat(rows, many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * many, model.n, np.int64)), pa.array([d if d <= LIMIT else None for d in exact], pa.int64()).take(each),
                pa.array(w.ravel(), pa.float64(), mask=absent), pa.array(np.tile(model.explained, len(x)), pa.float64()),
                pa.array([error], pa.float64()).take(pa.array(np.zeros(len(x) * many, np.int64))), pa.array(exact, pa.decimal128(38, 0)).take(each)], names)

        return step

    return map_batches(docs, make, f"key string, {COLUMNS}").withColumnRenamed("key", key)


def op11_spectral_whitening(spark, sf_dir):
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
