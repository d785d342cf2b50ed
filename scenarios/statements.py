"""Logs of SQL statements: screening and rewriting. The logs are derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from drydock.functions import screening
from drydock.functions.text import replay_on, slug
from scenarios.base import Scenario, load, orders

# One statement form per status and priority, each for a rule of the screening; {k} is the order's key.
FORMS = {
    ("F", "1-URGENT"): "UPDATE analytics.lineitem SET l_tax = 0 WHERE l_orderkey = {k}",
    ("F", "2-HIGH"): "UPDATE sbx_part_{k} SET p_name = 'x; TRUNCATE part -- y'",
    ("F", "3-MEDIUM"): "INSERT INTO analytics.sbx_part_{k} SELECT 'don''t', {k}",
    ("F", "4-NOT SPECIFIED"): "delete from lineitem where l_orderkey = {k} -- one; two",
    ("F", "5-LOW"): "/* every; week */ TRUNCATE TABLE sbx_part, part",
    ("O", "1-URGENT"): "DROP TABLE IF EXISTS SBX_PART_{k}",
    ("O", "2-HIGH"): 'ALTER TABLE "analytics"."part" DROP COLUMN p_size',
    ("O", "3-MEDIUM"): "MERGE INTO part USING feed_{k} ON part.p_partkey = feed_{k}.p_partkey "
    "WHEN MATCHED THEN DELETE",
    ("O", "4-NOT SPECIFIED"): "CREATE OR REPLACE TABLE part AS SELECT p_name FROM old_{k}",
    ("O", "5-LOW"): "CREATE TABLE sbx_crates_{k} AS SELECT 2; CREATE TABLE crates AS SELECT 2",
    ("P", "1-URGENT"): "WITH big AS (SELECT * FROM part) SELECT * FROM big WHERE p_size = {k};",
    ("P", "2-HIGH"): "UPDATE sbx_part SET p_size = 1; UPDATE part SET p_size = {k}",
    ("P", "3-MEDIUM"): "VACUUM part RETAIN {k} HOURS",
    ("P", "4-NOT SPECIFIED"): "INSERT INTO QG_QUALITY_RESULTS SELECT {k}; SELECT 'never",
    ("P", "5-LOW"): "WITH few AS (SELECT {k} AS k) DELETE FROM part USING few",
}


def statement_log(df):
    key = F.col("o_orderkey").cast("string")
    text = None
    for (status, priority), form in FORMS.items():
        hit = (F.col("o_orderstatus") == status) & (F.col("o_orderpriority") == priority)
        value = F.replace(F.lit(form), F.lit("{k}"), key)
        text = F.when(hit, value) if text is None else text.when(hit, value)
    return df.select("o_orderkey", text.alias("statement"))


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


STATEMENT_LOG = (
    "SELECT o_orderkey, replace(CASE "
    + " ".join(
        f"WHEN o_orderstatus = '{s}' AND o_orderpriority = '{p}' THEN {quoted(form)}"
        for (s, p), form in FORMS.items()
    )
    + " END, '{k}', CAST(o_orderkey AS VARCHAR)) AS statement FROM orders"
)

NAME = r"""(?:"[^"]+"|[a-z0-9_]+)"""
WRITE = (
    r"^(?:insert into|update|delete from|merge into|drop table(?: if exists)?|alter table"
    rf"|truncate table|create or replace table|create table) ({NAME}(?:[.]{NAME})*"
    rf"(?: ?, ?{NAME}(?:[.]{NAME})*)*)"
)
SCREENED = rf"""
    WITH log AS ({STATEMENT_LOG}),
    bare AS (
        SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(statement,
            {quoted(r"""'[^']*'|--[^\n]*|/[*][\s\S]*?[*]/|("[^"]*")""")}, ' \1 ', 'g'),
            '\s+', ' ', 'g'), ' ?[.] ?', '.', 'g') AS text
        FROM log
    ),
    parts AS (
        SELECT o_orderkey, [trim(x) FOR x IN string_split(text, ';') IF trim(x) <> ''] AS list
        FROM bare
    ),
    each AS (
        SELECT o_orderkey, generate_subscripts(list, 1) AS statement_no, unnest(list) AS text
        FROM parts
    ),
    named AS (
        SELECT o_orderkey, CAST(statement_no AS INTEGER) AS statement_no, text,
               upper(regexp_extract(text, '^(create or replace|[a-z]+)', 1, 'i')) AS operation,
               replace(lower(regexp_extract(text, {quoted(WRITE)}, 1, 'i')), '"', '') AS target
        FROM each
    ),
    judged AS (
        SELECT *,
               target <> '' AND len([x FOR x IN string_split(target, ',')
                   IF NOT (starts_with(string_split(trim(x), '.')[-1], 'sbx_')
                           OR string_split(trim(x), '.')[-1] = 'qg_quality_results')]) = 0 AS safe,
               operation = 'SELECT' OR (operation = 'WITH'
                   AND NOT regexp_matches(text, '\b(insert|update|delete|merge|into)\b', 'i'))
                   AS is_read,
               contains(text, '''') AS unclosed
        FROM named
    ),
    found AS (
        SELECT o_orderkey, statement_no, operation, replace(target, ', ', ',') AS target,
               CASE WHEN unclosed THEN 'blocked'
                    WHEN operation IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE', 'DROP', 'ALTER',
                                       'TRUNCATE', 'CREATE OR REPLACE')
                    THEN CASE WHEN safe THEN 'allow' ELSE 'blocked' END
                    WHEN is_read OR (operation = 'CREATE' AND safe) THEN 'allow'
                    ELSE 'review' END AS verdict,
               is_read,
               operation IN ('DROP', 'ALTER', 'TRUNCATE', 'CREATE OR REPLACE', 'CREATE') AS is_ddl
        FROM judged
    )"""


def rewrites(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    sandbox = F.concat(F.lit("sbx_orders_"), key)
    statement = F.concat(
        F.lit("UPDATE analytics."), F.upper(sandbox), F.lit(" SET total = (SELECT SUM(total) FROM "),
        sandbox, F.lit(") WHERE note <> '"), sandbox, F.lit("1'"),
    )
    log = orders(spark, sf_dir).select("o_orderkey", sandbox.alias("sandbox"), statement.alias("text"))
    return log.select(
        "o_orderkey",
        replay_on(F.col("text"), F.col("sandbox"), F.lit("orders"), F.lit("analytics")).alias("prod_statement"),
    )


SCENARIOS = {
    "t11_rewrite_statements": Scenario(
        rewrites,
        """
        SELECT o_orderkey, 'UPDATE analytics.orders SET total = (SELECT SUM(total) FROM orders)'
               || ' WHERE note <> ''sbx_orders_' || CAST(o_orderkey AS VARCHAR) || '1'''
               AS prod_statement
        FROM orders""",
    ),
    "t12_screen_statements": Scenario(
        lambda spark, d: screening.screen_statements(
            statement_log(orders(spark, d)), "o_orderkey", "statement"
        ),
        f"""{SCREENED}
        SELECT o_orderkey, statement_no, operation, target, verdict, is_read, is_ddl,
               CASE WHEN bool_or(verdict = 'blocked') OVER batch THEN 'blocked'
                    WHEN bool_or(verdict = 'review') OVER batch THEN 'review'
                    ELSE 'allow' END AS batch_verdict
        FROM found WINDOW batch AS (PARTITION BY o_orderkey)""",
    ),
    "t12_screened_totals": Scenario(
        lambda spark, d: screening.screen_statements(
            statement_log(orders(spark, d)), "o_orderkey", "statement"
        ).groupBy("operation", "verdict").agg(F.count(F.lit(1)).alias("n")),
        f"{SCREENED} SELECT operation, verdict, COUNT(*) AS n FROM found GROUP BY ALL",
    ),
    "f1_slug": Scenario(
        lambda spark, d: load(spark, d, "part").select(
            "p_partkey",
            slug(F.concat_ws(" -- ", "p_name", "p_brand", "p_type", "p_name")).alias("slug"),
        ),
        """
        SELECT p_partkey, substring(trim(regexp_replace(
                   lower(p_name || ' -- ' || p_brand || ' -- ' || p_type || ' -- ' || p_name),
                   '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS slug
        FROM part""",
    ),
}
