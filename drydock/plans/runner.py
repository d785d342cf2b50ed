"""Running checks: grading, failure detail, and one job for a whole suite."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drydock.operators.check import Check, KeyCheck, ScalarCheck
from drydock.operators.sides import pair_row
from drydock.plans.ledger import Ledger
from drydock.plans.profile import Profile, known_measures

# How many rows a result and a failure detail quote, and the texts around them.
RESULT_ROWS = 10
DETAIL_ROWS = 3
NO_ROWS = "(no violations found)"
MORE_ROWS = " more rows)"
QUERY_ERROR = "Query error: "
# A double's shortest text without its power of ten: s is the text, d its digits, e the power.
PLAIN = (
    "transform(array({text}), s -> if(instr(s, 'E') = 0, s, transform(array(struct("
    "regexp_replace(replace(replace(substring_index(s, 'E', 1), '-', ''), '.', ''), '(?<=.)0+$', '') as d,"
    " cast(substring_index(s, 'E', -1) as int) as e)), p -> concat(if(startswith(s, '-'), '-', ''),"
    " case when p.e < 0 then concat('0.', repeat('0', -p.e - 1), p.d)"
    " when length(p.d) <= p.e + 1 then concat(rpad(p.d, p.e + 1, '0'), '.0')"
    " else concat(substring(p.d, 1, p.e + 1), '.', substring(p.d, p.e + 2)) end))[0]))[0]"
)

GRADED = "position int, `check` string, status string, result string, expected string, detail string"


def status_column(df: DataFrame) -> str | None:
    """The name of the status column, whatever its case."""
    return next((c for c in df.columns if c.lower() == "status"), None)


def evaluate(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row ``status, n_rows, n_failed`` for a check's result.

    No rows pass. With a status column the result fails if any value is FAIL in any
    case, so NULL and unknown values pass (``strict=True``: anything but PASS fails).
    Rows without a status column are violations.
    """
    failed = F.count_if(_failing(df, strict))
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), failed.alias("n_failed"))
    status = F.when(F.col("n_failed") > 0, "FAIL").otherwise("PASS")
    return counts.select(status.alias("status"), "n_rows", "n_failed")


def _failing(df: DataFrame, strict: bool = False) -> Column:
    name = status_column(df)
    if name is None:
        return F.lit(True)
    value = F.upper(F.col(f"`{name}`").cast("string"))
    if strict:
        return F.coalesce(value != "PASS", F.lit(True))
    return F.coalesce(value == "FAIL", F.lit(False))


def row_text(schema: T.StructType, within: str = "") -> Column:
    """A row as ``a=1, b=x``; numbers are written out in full, never in powers of ten.

    ``within`` names a struct column that holds the fields. One SQL expression: wide
    rows would need hundreds of calls to build it column by column.
    """
    def shown(field: T.StructField) -> str:
        value = f"{within}.{_quoted(field.name)}" if within else _quoted(field.name)
        text = f"cast({value} as string)"
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            text = PLAIN.format(text=text)
        label = field.name.replace("\\", "\\\\").replace("'", "\\'")
        return f"concat('{label}=', coalesce({text}, 'None'))"

    return F.expr(f"concat_ws(', ', {', '.join(map(shown, schema))})")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _first_rows(df: DataFrame, limit: int) -> Column:
    """The texts of the first rows, at most ``limit`` of them, as an array.

    The limit sits right on the check's sort, which makes it a top-k; the row numbers
    keep the order while the few texts are gathered.
    """
    texts = df.limit(limit).select(
        F.monotonically_increasing_id().alias("i"), row_text(df.schema).alias("text")
    )
    return texts.agg(F.sort_array(F.collect_list(F.struct("i", "text")))["text"]).scalar()


def _quote(texts: Column, limit: int, count: Column) -> Column:
    """Up to ``limit`` texts, and how many of ``count`` rows that leaves out."""
    text = F.concat_ws("; ", F.slice(texts, 1, limit))
    rest = F.concat(F.lit(" ... ("), (count - limit).cast("string"), F.lit(MORE_ROWS))
    return F.concat(text, F.when(count > limit, rest).otherwise(""))


def grade(check: Check, prod: DataFrame, sbx: DataFrame, position: int = 0) -> DataFrame:
    """A check's graded row. Counts are taken on the cluster; only a few rows are quoted.

    Counts are over all rows of the check's result, also where its listing is cut.
    """
    if isinstance(check, KeyCheck):
        rows, counts = check.listed(prod, sbx, RESULT_ROWS), check.totals(prod, sbx)
        status = F.when(F.col("n_failed") > 0, "FAIL").otherwise("PASS")
        counts = counts.select(status.alias("status"), "n_rows", "n_failed")
    else:
        rows = check.rows(prod, sbx)
        counts = evaluate(rows)
    shown = failing = _first_rows(rows, RESULT_ROWS)
    if status_column(rows):
        failing = _first_rows(rows.where(_failing(rows)), DETAIL_ROWS)
    quoted = counts.select("*", shown.alias("shown"), failing.alias("failing"))
    result = _quote(F.col("shown"), RESULT_ROWS, F.col("n_rows"))
    detail = _quote(F.col("failing"), DETAIL_ROWS, F.col("n_failed"))
    return quoted.select(
        F.lit(position).alias("position"),
        F.lit(check.name).alias("check"),
        "status",
        F.when(F.col("n_rows") == 0, NO_ROWS).otherwise(result).alias("result"),
        F.lit(check.expected).alias("expected"),
        F.when(F.col("status") == "FAIL", detail).otherwise("").alias("detail"),
    )


def grade_scalars(
    checks: Sequence[tuple[int, ScalarCheck]],
    prod: DataFrame,
    sbx: DataFrame,
    known: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Graded rows of many scalar checks from one pass over each table.

    ``known`` gives measures of the sandbox that need no pass.
    """
    measures = {name: agg for _, check in checks for name, agg in check.measures().items()}
    outputs = pair_row(prod, sbx, measures, known).select([
        F.struct(*[v.alias(name) for name, v in check.outputs().items()]).alias(f"_{position}")
        for position, check in checks
    ])

    def graded(position: int, check: ScalarCheck) -> Column:
        column = f"_{position}"
        status = F.col(f"{column}.status")
        text = row_text(outputs.schema[column].dataType, within=column)
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(check.name).alias("check"),
            status.alias("status"),
            text.alias("result"),
            F.lit(check.expected).alias("expected"),
            F.when(status == "FAIL", text).otherwise("").alias("detail"),
        )

    return outputs.select(F.inline(F.array(*[graded(p, c) for p, c in checks])))


def failed_check(
    spark: SparkSession, check: Check, position: int, error: Exception
) -> DataFrame:
    """The graded row of a check that could not be run, with the whole error."""
    message = str(error)
    row = (position, check.name, "FAIL", QUERY_ERROR + message, check.expected, message)
    return spark.createDataFrame([row], GRADED)


def plan_suite(
    prod: DataFrame, sbx: DataFrame, checks: Sequence[Check], profile: Profile | None = None
) -> DataFrame:
    """Graded rows of all checks, as one lazy DataFrame.

    Scalar checks share a single aggregation, or take what the sandbox's ``profile`` knows. The others are unioned, so that Spark
    runs them side by side and checks over the same key reuse one shuffle. A check that
    cannot be built (say, for a missing column) becomes a FAIL row.
    """
    if not checks:
        raise ValueError("no quality checks defined")
    keyed = Counter(c.keys for c in checks if isinstance(c, KeyCheck))
    numbered = [
        (p, c.shared if isinstance(c, KeyCheck) and c.shared and keyed[c.keys] > 1 else c)
        for p, c in enumerate(checks)
    ]
    known = known_measures(profile or {})
    frames = _try_grade(
        [(p, c) for p, c in numbered if isinstance(c, ScalarCheck)],
        lambda checks, prod, sbx: grade_scalars(checks, prod, sbx, known), prod, sbx,
    )
    for position, check in numbered:
        if not isinstance(check, ScalarCheck):
            frames += _try_grade([(position, check)], _grade_one, prod, sbx)
    return reduce(DataFrame.unionByName, frames)


def _grade_one(checks, prod: DataFrame, sbx: DataFrame) -> DataFrame:
    [(position, check)] = checks
    return grade(check, prod, sbx, position)


def _try_grade(checks, how, prod: DataFrame, sbx: DataFrame) -> list[DataFrame]:
    """Grade checks together; if they cannot be built, single out those that fail.

    Checks are anybody's code, so any exception counts against its check only.
    """
    if not checks:
        return []
    try:
        return [how(checks, prod, sbx)]
    except Exception as error:
        if len(checks) == 1:
            [(position, check)] = checks
            return [failed_check(prod.sparkSession, check, position, error)]
    return [frame for one in checks for frame in _try_grade([one], how, prod, sbx)]


def run_checks(
    prod: DataFrame,
    sbx: DataFrame,
    checks: Sequence[Check],
    sandbox_name: str,
    source_table: str,
    ledger: Ledger | None = None,
    run_id: str | None = None,
    sandbox_version: int | None = None,
    profile: Profile | None = None,
) -> DataFrame:
    """Run a suite, record its results (one row per check) in the ledger, and return them.

    Checks are advisory. If the shared job fails at run time, the suite is halved again and again
    until the broken checks stand alone, and only they are marked FAIL. With each result the ledger keeps
    what was run (the check's definition) and on which version of the sandbox. A ``profile`` holds measures that were
    taken while that version was written.
    """
    spark = prod.sparkSession
    if not checks:
        raise ValueError("no quality checks defined")
    # Halves should share as much as they can: passes over scalars, and shuffles of a key.
    alike = sorted(range(len(checks)), key=lambda p: _kin(checks[p]))
    graded = dict(_graded(prod, sbx, [(p, checks[p]) for p in alike], profile))
    run_at = datetime.now(timezone.utc)
    run = dict(
        run_id=run_id or str(uuid.uuid4()), sandbox_name=sandbox_name, sandbox_version=sandbox_version,
        source_table=source_table, run_at=run_at, run_date=run_at.date(),
    )
    records = [
        {**run, "definition": check.definition, **{k: v for k, v in graded[p].asDict().items() if k != "position"}}
        for p, check in enumerate(checks)
    ]
    ledger = ledger or Ledger(spark)
    ledger.append("quality_results", records)
    return ledger.read("quality_results", str(run_at.date())).where(F.col("run_id") == run["run_id"])


def _kin(check: Check) -> tuple:
    """Sorts checks that share work next to each other."""
    if isinstance(check, ScalarCheck):
        return (0, ())
    return (1, check.keys) if isinstance(check, KeyCheck) else (2, ())


def _graded(
    prod: DataFrame, sbx: DataFrame, checks: Sequence[tuple[int, Check]], profile: Profile | None
) -> list[tuple[int, Row]]:
    """Graded rows by position. One job for all; if it fails, one for each half, side by side.

    One broken check of n so costs at most two jobs for each time that n can be halved.
    """
    positions = [p for p, _ in checks]
    try:
        rows = plan_suite(prod, sbx, [c for _, c in checks], profile).collect()
        return [(positions[row["position"]], row) for row in rows]
    except Exception as error:
        if len(checks) == 1:
            [(position, check)] = checks
            return [(position, failed_check(prod.sparkSession, check, 0, error).first())]
    middle = len(checks) // 2
    halves = [checks[:middle], checks[middle:]]
    work = inheritable_thread_target(prod.sparkSession)(lambda half: _graded(prod, sbx, half, profile))
    with ThreadPoolExecutor(2) as pool:
        return [row for half in pool.map(work, halves) for row in half]
