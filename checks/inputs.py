"""Inputs derived from the given tables: one SQL text that Spark and DuckDB both run.

Catalogues, statements and job steps are derived row by row from orders and line items, so they
grow with the data. ``{name}`` stands for a given table or another input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_TABLE_NAME = """concat(CASE {k} % 12 WHEN 0 THEN 'AuditTrail' WHEN 1 THEN 'OrderHistory'
  WHEN 2 THEN 'ArchiveBox' WHEN 3 THEN 'StageLoad' WHEN 4 THEN 'AppConfig' WHEN 5 THEN 'LinkTable'
  WHEN 6 THEN 'StatusType' WHEN 7 THEN 'Invoice' WHEN 8 THEN 'Plain' WHEN 9 THEN 'Member'
  WHEN 10 THEN 'Customer' ELSE 'Payments' END, '_', {k})"""


def _table_of(key: str) -> str:
    return _TABLE_NAME.replace("{k}", key)


INPUTS = {
    "blank_orders": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN '  ' ELSE o_orderpriority END AS label,
  nullif(o_custkey % 10, 3) AS digit, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderkey % 2 = 0 END AS even,
  -o_orderkey AS negative, 'same' AS constant, nullif('x', 'x') AS missing
FROM {orders}""",
    "orphan_orders": """
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE o_custkey END AS o_custkey
FROM {orders}""",
    "some_customers": "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey % 7 <> 0",
    "snapshot_a": """
SELECT o_orderkey, o_orderstatus, o_totalprice, concat('order ', o_orderpriority) AS note
FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "snapshot_b": """
SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  concat('order ', o_orderpriority) AS note
FROM {orders} WHERE o_orderkey % 7 <> 0""",
    "snapshot_c": """
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 22 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  concat('order ', o_orderpriority) AS note
FROM {orders} WHERE o_orderkey % 13 <> 0""",
    "cat_tables": f"""
SELECT 'dbo' AS schema_name, {_table_of('o_orderkey')} AS object_name, 'USER_TABLE' AS object_type,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'unknown'
    ELSE concat(CASE WHEN o_orderkey % 6 = 2 THEN '-' ELSE '' END, o_custkey * 7) END AS row_count
FROM {{orders}}""",
    "cat_columns": f"""
SELECT 'dbo' AS schema_name, {_table_of('l_orderkey')} AS object_name, 'USER_TABLE' AS object_type,
  column_name, min(l_linenumber) AS column_id, min(data_type) AS data_type,
  max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 AS is_nullable,
  max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) = 1 AS is_identity,
  max(CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END) = 1 AS is_computed,
  concat('note ', CASE min(l_suppkey) % 5 WHEN 0 THEN 'home mobile' WHEN 1 THEN 'monthly salary' ELSE 'plain' END) AS description
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey,
  CASE l_partkey % 16 WHEN 0 THEN 'id' WHEN 1 THEN 'StudNm' WHEN 2 THEN 'MobNo' WHEN 3 THEN 'amount'
    WHEN 4 THEN 'status_code' WHEN 5 THEN 'api_token' WHEN 6 THEN 'bank_account' WHEN 7 THEN 'BloodGroup'
    WHEN 8 THEN 'user_id' WHEN 9 THEN 'remarks' WHEN 10 THEN 'created' WHEN 11 THEN 'payload'
    WHEN 12 THEN 'PaymentsId' WHEN 13 THEN concat('order_no_', l_partkey % 3) WHEN 14 THEN 'is_open' ELSE 'width' END AS column_name,
  CASE l_partkey % 16 WHEN 0 THEN 'int' WHEN 1 THEN 'nvarchar' WHEN 2 THEN 'varchar' WHEN 3 THEN 'decimal(10,2)'
    WHEN 4 THEN 'int' WHEN 5 THEN 'nvarchar' WHEN 6 THEN 'char' WHEN 7 THEN 'nvarchar' WHEN 8 THEN 'int'
    WHEN 9 THEN 'text' WHEN 10 THEN 'datetime2' WHEN 11 THEN 'varbinary' WHEN 12 THEN 'int'
    WHEN 13 THEN 'int' WHEN 14 THEN 'bit' ELSE 'geometry' END AS data_type
  FROM {{lineitem}}) AS lines
GROUP BY l_orderkey, column_name""",
    "cat_primary_keys": f"""
SELECT 'dbo' AS schema_name, {_table_of('o_orderkey')} AS object_name,
  concat('pk_', o_orderkey) AS constraint_name, 1 AS key_ordinal, 'id' AS column_name
FROM {{orders}} WHERE o_orderkey % 3 <> 0
UNION ALL
SELECT 'dbo', {_table_of('o_orderkey')}, concat('pk_', o_orderkey), 2, 'status_code'
FROM {{orders}} WHERE o_orderkey % 15 = 5""",
    "cat_indexes": f"""
SELECT 'dbo' AS schema_name, {_table_of('l_orderkey')} AS object_name,
  CAST(l_suppkey % 4 AS INT) AS index_id, concat('ix_', l_suppkey % 4) AS index_name, column_name,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY column_name) AS INT) AS key_ordinal,
  l_suppkey % 4 < 2 AS is_unique, l_orderkey % 11 = 0 AS is_disabled, l_orderkey % 13 = 0 AS has_filter,
  1 = 0 AS is_included_column
FROM (SELECT DISTINCT l_orderkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'user_id' WHEN 1 THEN 'PaymentsId' ELSE 'amount' END AS column_name
  FROM {{lineitem}}) AS lines""",
    "cat_foreign_keys": f"""
SELECT 'dbo' AS source_schema, {_table_of('l_orderkey')} AS source_object,
  concat('fk_', l_linenumber) AS constraint_name, 'user_id' AS source_column,
  'dbo' AS target_schema, {_table_of('(l_partkey % 500)')} AS target_object, 'id' AS target_column,
  l_suppkey % 10 = 1 AS is_disabled, l_suppkey % 10 = 2 AS is_not_trusted
FROM {{lineitem}}""",
    "cat_constraints": f"""
SELECT 'dbo' AS schema_name, {_table_of('l_orderkey')} AS object_name,
  concat('ck_', l_partkey % 5) AS constraint_name, l_suppkey % 20 = 3 AS is_disabled,
  l_suppkey % 20 = 4 AS is_not_trusted
FROM {{lineitem}}""",
    "statements": """
SELECT o_orderkey AS statement_id, CASE WHEN o_orderkey % 3 = 0 THEN 'dbo' ELSE 'sales' END AS schema_name,
  concat('obj_', o_orderkey) AS object_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'SQL_STORED_PROCEDURE' WHEN 2 THEN 'FUNCTION' ELSE 'TRIGGER' END AS source_type,
  CASE o_orderkey % 14
    WHEN 0 THEN concat('SELECT s.id, SUM(s.amount) AS total FROM dbo.Source_', o_custkey % 50,
      ' AS s JOIN ref.Status_', o_custkey % 7, ' r ON r.id = s.status_id GROUP BY s.id')
    WHEN 1 THEN concat('INSERT INTO audit.Log_', o_custkey % 20, ' (id, amount) SELECT x.id, x.amount * 2 FROM stage.[Load ',
      o_custkey % 9, '] x')
    WHEN 2 THEN concat('UPDATE dbo.Cust_', o_custkey % 30, ' SET passwd = ', chr(39), 'abc', o_custkey, chr(39),
      ', token=t', o_custkey, ' WHERE id = 1; COMMIT')
    WHEN 3 THEN concat('DELETE FROM Archive.dbo.Old_', o_custkey % 9, ';')
    WHEN 4 THEN concat('EXEC dbo.Step_', o_custkey % 40, '; EXEC DBO.step_', o_custkey % 40)
    WHEN 5 THEN concat('BEGIN TRY DECLARE @q nvarchar(10); EXEC (@q); SELECT 1 FROM dbo.Source_', o_custkey % 50, ' END TRY')
    WHEN 6 THEN concat('SELECT CASE WHEN c.flag = 1 THEN c.amount ELSE 0 END AS v FROM sales.Account_', o_custkey % 25,
      ' c -- FROM dbo.Ghost', chr(10), 'WHERE c.flag > 0')
    WHEN 7 THEN concat('MERGE INTO dbo.Target_', o_custkey % 11, ' USING stage.Feed_', o_custkey % 5,
      ' f ON f.id = 1 WHEN MATCHED THEN UPDATE SET x = 1;')
    WHEN 8 THEN concat('SELECT * FROM OPENQUERY(Linked', o_custkey % 3, ', ', chr(39), 'SELECT 1', chr(39), ')')
    WHEN 9 THEN concat('SELECT t.amount + 1 AS plus FROM Remote_', o_custkey % 4, '.Other.dbo.Ledger_', o_custkey % 6,
      ' t JOIN dbo.Source_', o_custkey % 50, ' u ON u.id + 1 = t.id')
    WHEN 10 THEN concat('BEGIN TRAN; INSERT INTO [#work] SELECT a.id FROM dbo.Source_', o_custkey % 50, ' a; COMMIT')
    WHEN 11 THEN concat('WITH q AS (SELECT 1 AS n /* one; two */) SELECT n FROM q WHERE n <> ', chr(39), 'DROP it', chr(39), chr(39),
      's', chr(39), ' AND [update] = ', o_custkey, ';')
    WHEN 12 THEN concat('SELECT ', chr(39), 'open', o_custkey)
    ELSE NULL END AS definition
FROM {orders}""",
    "known_columns": """
SELECT DISTINCT schema_name, object_name, column_name FROM (
  SELECT 'dbo' AS schema_name, concat('Source_', o_custkey % 50) AS object_name, CASE o_orderkey % 3 WHEN 0 THEN 'Id' WHEN 1 THEN 'amount' ELSE 'status_id' END AS column_name FROM {orders}
  UNION ALL SELECT 'ref', concat('Status_', o_custkey % 7), 'id' FROM {orders}
  UNION ALL SELECT 'stage', concat('Feed_', o_custkey % 5), 'id' FROM {orders}
  UNION ALL SELECT 'sales', concat('Account_', o_custkey % 25), CASE o_orderkey % 2 WHEN 0 THEN 'flag' ELSE 'amount' END FROM {orders}
) AS every""",
    "job_steps": """
SELECT concat('job_', statement_id % 100) AS job_name, statement_id AS step_id, concat('step ', statement_id % 9) AS step_name,
  CASE statement_id % 9 WHEN 6 THEN 'PowerShell' WHEN 7 THEN 'CmdExec' WHEN 8 THEN 'SSIS' WHEN 5 THEN 'Batch' ELSE 'TSQL' END AS subsystem,
  CASE WHEN statement_id % 9 >= 5 THEN concat('run.exe /x --token=abc', statement_id) ELSE definition END AS command,
  CASE WHEN statement_id % 5 = 0 THEN '' ELSE 'Shop' END AS database_name,
  CASE WHEN statement_id % 2 = 0 THEN 'Nightly' ELSE '' END AS schedule_name
FROM {statements}""",
    "dependencies": """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'dbo' ELSE 'sales' END AS source_schema, concat('obj_', l_orderkey) AS source_object,
  CASE l_orderkey % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'SQL_STORED_PROCEDURE' WHEN 2 THEN 'FUNCTION' ELSE 'TRIGGER' END AS source_type,
  l_linenumber AS source_column_id,
  CASE WHEN l_suppkey % 25 = 0 THEN concat('srv', l_suppkey % 4) ELSE '' END AS target_server,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Other' WHEN l_suppkey % 5 = 1 THEN 'Shop' ELSE '' END AS target_database,
  CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'dbo' END AS target_schema,
  concat('Source_', l_partkey % 50) AS target_object,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'amount' END AS target_column,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE CAST(l_partkey AS {TEXT}) END AS referenced_id,
  CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END AS is_ambiguous, 0 AS is_caller_dependent
FROM {lineitem}""",
    "synonyms": """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'dbo' ELSE '' END AS schema_name, concat('Source_', c_custkey) AS object_name,
  CASE c_custkey % 4 WHEN 0 THEN concat('[Remote', c_custkey % 3, '].[Other].[dbo].[T]') WHEN 1 THEN 'Other.dbo.T'
    WHEN 2 THEN 'Shop.dbo.T' ELSE 'dbo.T' END AS base_object_name
FROM {customer}""",
    "profile_rows": """
SELECT concat('Table_', o_custkey % 40) AS table_name,
  concat(CASE o_orderkey % 8 WHEN 0 THEN 'Value' WHEN 1 THEN 'EmailAddress' WHEN 2 THEN 'PasswordValue'
    WHEN 3 THEN 'ReviewedName' WHEN 4 THEN 'Sequence' WHEN 5 THEN 'Payload' WHEN 6 THEN 'Label' ELSE 'Opened' END,
    '_', o_orderkey) AS column_name,
  CASE o_orderkey % 8 WHEN 4 THEN 'int' WHEN 5 THEN 'varbinary' WHEN 7 THEN 'datetime2' ELSE 'nvarchar' END AS data_type,
  CASE o_orderkey % 8 WHEN 2 THEN 'Credential' WHEN 6 THEN 'Potentially Sensitive' ELSE 'Unknown' END AS sensitivity_category,
  'NO_SENSITIVITY_SIGNAL' AS sensitivity_evidence,
  CASE o_orderkey % 5 WHEN 0 THEN concat('ann', o_custkey, '@example.test') WHEN 1 THEN concat('0', 5550000000 + o_custkey)
    WHEN 2 THEN '' WHEN 3 THEN concat('word ', o_custkey) ELSE NULL END AS minimum_value,
  CASE o_orderkey % 3 WHEN 0 THEN concat('zed', o_custkey, '@example.test') WHEN 1 THEN concat('ABCDE', 1000 + o_custkey % 9000, 'F')
    ELSE concat('zebra ', o_custkey) END AS maximum_value
FROM {orders}""",
    "class_rows": """
SELECT lower(table_name) AS table_name, upper(column_name) AS column_name,
  CASE WHEN column_name LIKE 'Email%' THEN 'PII' WHEN column_name LIKE 'Reviewed%' THEN 'Non-sensitive' ELSE 'Unknown' END AS sensitivity_category,
  CASE WHEN column_name LIKE 'Reviewed%' THEN 'OVERRIDE: reviewed label' ELSE 'NO_SENSITIVITY_SIGNAL' END AS evidence
FROM {profile_rows} WHERE column_name NOT LIKE 'Label%'""",
    "notes": """
SELECT o_orderkey, concat('t_', o_custkey) AS object_name, 'c' AS column_name,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('note ', o_orderpriority) END AS property_value
FROM {orders}""",
    "error_texts": """
SELECT o_orderkey, 'dbo' AS schema_name, concat('t_', o_orderkey) AS object_name,
  CASE o_orderkey % 7 WHEN 0 THEN concat('HYT00 Query timeout after ', o_custkey) WHEN 1 THEN 'SELECT permission denied on object'
    WHEN 2 THEN 'Invalid object name' WHEN 3 THEN 'Could not use view or function because of binding errors'
    WHEN 4 THEN 'Login failed for user' WHEN 5 THEN 'connection timed out' ELSE 'Divide by zero' END AS sanitized_message,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('impact ', o_orderstatus) END AS impact
FROM {orders}""",
}


def _names_in(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n != "TEXT"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    sql = INPUTS[name].replace("{TEXT}", "STRING")
    sources = {
        n: table(spark, sf_dir, n) if n in TABLES else derived(spark, sf_dir, n) for n in _names_in(sql)
    }
    return spark.sql(sql, **sources)


def with_inputs(names: str | tuple[str, ...], body: str) -> str:
    """A DuckDB query whose leading CTEs are the named inputs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in INPUTS and name not in ordered:
            for needed in _names_in(INPUTS[name]):
                visit(needed)
            ordered.append(name)

    for name in (names,) if isinstance(names, str) else names:
        visit(name)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql.replace("{TEXT}", "VARCHAR"))
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({plain(INPUTS[n])})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Registry:
    """Name -> (query, DuckDB text or None)."""

    def __init__(self) -> None:
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(function):
            key = name or function.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = function
            if sql:
                self.oracles[key] = sql
            return function

        return register
