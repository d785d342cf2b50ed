"""Embedding whitening: principal components from a pivoted Cholesky factor and one-sided Jacobi.

Entries become whole numbers ``x = floor(scale * c) + shift``; the *fit list* is each distinct ``x`` vector once.

1. The fit list is a native ``distinct``, combined before the shuffle, so copies weigh nothing, however many.
   Its sums are exact.
2. The fit list is centred, then multiplied: tasks send the scatter of their rows, which Spark sums by element.
3. One task per vector length factors the covariance: Cholesky with diagonal pivots stops at the numerical
   rank, so constant and dependent dimensions cost no division by zero. One-sided Jacobi turns the columns of
   the triangular factor until they are orthogonal; their norms squared are the eigenvalues, and the
   columns, normalised, the components. Small eigenvalues keep their relative precision.
4. All rows are projected; over the fit list this also measures how far the result is from white.

What tasks need of a length (sums, components) is small: ``K + 1`` vectors. Up to ``SENT`` bytes over all lengths it
goes out with the tasks; beyond, rows are dealt by length and a salt and meet their length's share
in a grouped job, so nothing grows on the driver.

Defined cases: a vector that is NULL, empty, or holds NULL, NaN or infinity takes no part, nor does one with an entry whose
``x`` needs more than 62 bits; vectors of each length are fitted by themselves; components end
at the numerical rank (none at all if all vectors are equal); rows that repeat, ids included, are all
returned; ``deviation`` is NULL where it does not fit in 64 bits; an empty table gives no rows; other columns are left
alone. A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from drydock.llm.common import stored

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Bytes of sums and components that go out with tasks, and rows of a dealt group beyond, about.
SENT = 32 << 20
GROUP = 50_000
#: Columns are orthogonal when their cosine is below this.
ORTHOGONAL = 1e-15
SWEEPS = 60
LIMIT = 1 << 62


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Columns ``L`` with ``L @ L.T`` the symmetric positive matrix, as many as its rank.

    The largest remaining diagonal entry is eliminated next; in the order of these pivots ``L`` is triangular. An
    entry that is down to the rounding errors of its own first value counts as 0.
    """
    rest = np.array(matrix, float)
    columns = []
    least = len(rest) * np.finfo(float).eps * rest.diagonal()
    for _ in range(len(rest)):
        left = np.where(rest.diagonal() > least, rest.diagonal(), 0.0)
        pivot = int(left.argmax())
        if left[pivot] <= 0:
            break
        column = rest[:, pivot] / np.sqrt(rest[pivot, pivot])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0.0
    return np.array(columns).T if columns else np.zeros((len(rest), 0))


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``n`` columns once, in rounds of disjoint pairs (as in a tournament)."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < n]
        if pairs:
            yield tuple(np.array(side) for side in zip(*pairs, strict=True))
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal, longest first."""
    turned = np.array(factor.T)  # columns as rows: they are worked on as wholes
    for _ in range(SWEEPS):
        largest = 0.0
        for left, right in rounds(len(turned)):
            a, b = turned[left], turned[right]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            cosine = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            largest = max(largest, cosine.max())
            turn = cosine > ORTHOGONAL
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            tangent = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, tangent)
            s = c * tangent
            turned[left], turned[right] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
        if largest <= ORTHOGONAL * 8:
            break
    norms = np.einsum("ij,ij->i", turned, turned)
    return turned[np.argsort(-norms, kind="stable")].T


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit eigenvectors (as rows), fewer if the rank is less."""
    columns = jacobi_columns(pivoted_cholesky(covariance))[:, :k]
    values = np.einsum("ij,ij->j", columns, columns)
    units = (columns / np.sqrt(values)).T
    largest = units[np.arange(len(units)), np.abs(units).argmax(axis=1)] if len(units) else np.ones(0)
    return values, units * np.sign(largest)[:, None]


def centred(vectors: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - sums``: as whole numbers (Python's, if they are too large for 64 bits), and over ``n``."""
    largest = max([1, *map(abs, sums), int(np.abs(vectors).max(initial=0)) * n])
    whole = vectors.astype(object) if largest >= LIMIT else vectors
    scaled = whole * n - np.array(sums, whole.dtype)
    return scaled, (scaled / n).astype(float)


def deviations(scaled: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where they do not fit in 64 bits."""
    largest = int(np.abs(scaled).max(initial=0))
    if largest**2 * max(scaled.shape[1], 1) < LIMIT:
        return np.einsum("ij,ij->i", scaled, scaled).tolist()
    sums = [sum(int(x) ** 2 for x in row) for row in scaled.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


PerLength = Callable[[pa.Table, dict], dict]


def _by_length(rows: DataFrame, facts: DataFrame, use: PerLength, made, sent: int = SENT) -> DataFrame:
    """Run ``use`` on tables of rows of one length, with that length's facts; without facts, rows go.

    Facts go out with the tasks if they are small. Otherwise rows and facts meet by length and salt.
    """
    arrow = to_arrow_schema(made)
    size = facts.agg(F.sum("bytes")).first()[0] or 0

    def result(table: pa.Table, fact: dict) -> pa.Table:
        return pa.Table.from_pydict(use(table, fact), schema=arrow)

    if size <= sent:
        known = {row.length: row.asDict() for row in facts.collect()}

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tables:
                table = pa.Table.from_batches([batch])
                lengths = np.array(table.column("length"))
                for length in known.keys() & set(lengths.tolist()):
                    own = table.filter(pa.array(lengths == length))
                    yield from result(own, known[length]).to_batches()

        return rows.mapInArrow(run, made)

    salts = rows.groupBy("length").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    spread_over = F.xxhash64(*rows.columns, F.spark_partition_id())
    salted = rows.join(salts, "length").withColumn("salt", F.pmod(spread_over, F.col("salts")).cast("int")).drop("salts")
    spread = facts.join(salts, "length").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return result(left, right.to_pylist()[0]) if left.num_rows and right.num_rows else arrow.empty_table()

    key = ["length", "salt"]
    return salted.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(meet, made)


def _matrix(table: pa.Table) -> np.ndarray:
    return (table.column("y").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))


def _whole(vector: Column, scale: float) -> Column:
    """``floor(scale * c)`` of all entries, NULL if an entry is no number or beyond 62 bits."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(LIMIT), F.lit(False)))
    return F.when((F.size(vector) > 0) & fits, whole)


def whitened(
    df: DataFrame,
    k: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = SCALE,
    shift: int = SHIFT,
    sent: int = SENT,
) -> DataFrame:
    """Per row and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Covariances do not change with ``shift``, so the work is done without it, on smaller numbers.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), _whole(F.col(vector_col), scale).alias("y")).where(F.col("y").isNotNull())
    rows = rows.select("id", F.size("y").alias("length"), "y")
    fit = stored(rows.select("length", "y").distinct(), "fit")
    entries = fit.select("length", F.posexplode("y").alias("i", "y"))
    sums = entries.groupBy("length", "i").agg(F.sum(F.col("y").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"].cast("string"))
    fitted = sums.groupBy("length").agg(F.max("n").alias("n"), ordered.alias("sums"))
    fitted = stored(fitted.where("n > 1").withColumn("bytes", F.col("length").cast("long") * 24), "sums")

    def scatter(table: pa.Table, fact: dict) -> dict:
        _, x = centred(_matrix(table), fact["n"], [int(s) for s in fact["sums"]])
        products = x.T @ x
        return {"length": [fact["length"]] * len(products), "i": range(len(products)), "products": list(products)}

    kind = spark.createDataFrame([], "length int, i int, products array<double>").schema
    parts = _by_length(fit, fitted, scatter, kind, sent).select("length", "i", F.posexplode("products").alias("j", "p"))
    line = parts.groupBy("length", "i", "j").agg(F.sum("p").alias("p")).groupBy("length", "i").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "p"))), lambda x: x["p"]).alias("line")
    )

    def decompose(table: pa.Table) -> pa.Table:
        lines = table.sort_by("i").column("line").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        n = table.column("n")[0].as_py()
        covariance = (lines + lines.T) / (2 * n)
        values, units = components(covariance, k)
        return pa.table({
            "length": pa.array([len(lines)], pa.int32()), "sizes": [values.tolist()],
            "axes": pa.array([units.ravel().tolist()], pa.list_(pa.float64())), "trace": [float(covariance.trace())],
        })

    solved = line.join(fitted.select("length", "n"), "length").groupBy("length").applyInArrow(
        decompose, "length int, sizes array<double>, axes array<double>, trace double"
    )
    facts = fitted.drop("bytes").join(solved, "length").withColumn("bytes", F.col("length").cast("long") * 8 * (k + 3))
    facts = stored(facts, "components")

    def project(x: np.ndarray, fact: dict) -> np.ndarray:
        axes = np.array(fact["axes"]).reshape(-1, x.shape[1])
        return x @ axes.T / np.sqrt(np.array(fact["sizes"]))

    def white(table: pa.Table, fact: dict) -> dict:
        _, x = centred(_matrix(table), fact["n"], [int(s) for s in fact["sums"]])
        w = project(x, fact)
        width = w.shape[1]
        mean = w.mean(axis=0)
        return {
            "length": [fact["length"]], "m": [len(w)], "mean": [mean.tolist()],
            "products": [((w - mean).T @ (w - mean)).ravel().tolist()], "width": [width],
        }

    kind = spark.createDataFrame([], "length int, m long, mean array<double>, products array<double>, width int").schema
    checks = _by_length(fit, facts, white, kind, sent)
    error = stored(_identity_error(checks), "whiteness")
    facts = facts.join(error, "length", "left")

    made = rows.select("id").schema
    for name, data_type in (("n", "long"), ("deviation", "long"), ("whitened", "array<double>"),
                            ("explained", "array<double>"), ("identity_error", "double")):
        made = made.add(name, T.DataType.fromDDL(data_type))

    def final(table: pa.Table, fact: dict) -> dict:
        scaled, x = centred(_matrix(table), fact["n"], [int(s) for s in fact["sums"]])
        explained = [v / fact["trace"] for v in fact["sizes"]]
        return {
            "id": table.column("id"), "n": [fact["n"]] * len(x), "deviation": deviations(scaled),
            "whitened": list(project(x, fact)), "explained": [explained] * len(x),
            "identity_error": [fact["identity_error"]] * len(x),
        }

    done = _by_length(rows, facts, final, made, sent)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("position", "value")
    return done.select("id", "n", "deviation", "identity_error", each).select(
        F.col("id").alias(id_col), (F.col("position") + 1).alias("component"), "n", "deviation",
        F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error",
    )


def _identity_error(checks: DataFrame) -> DataFrame:
    """Per length the largest entry of the whitened fit list's covariance, less the identity.

    Tasks' means and products are brought together by element: the scatter about the common mean is
    that about the tasks' own means and that of these means.
    """
    cells = checks.select(
        "length", "m", "mean", F.posexplode("products").alias("cell", "p"), "width"
    ).select(
        "length", "m", "p", F.floor(F.col("cell") / F.col("width")).cast("int").alias("i"),
        (F.col("cell") % F.col("width")).alias("j"), "mean",
    ).withColumn("a", F.get("mean", "i")).withColumn("b", F.get("mean", "j"))
    m = F.sum("m")
    covariance = F.sum(F.col("p") + F.col("m") * F.col("a") * F.col("b")) / m - (
        F.sum(F.col("m") * F.col("a")) / m * F.sum(F.col("m") * F.col("b")) / m
    )
    entries = cells.groupBy("length", "i", "j").agg(covariance.alias("c"))
    wanted = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return entries.groupBy("length").agg(F.max(F.abs(F.col("c") - wanted)).alias("identity_error"))
