"""Shared pieces of the DuckDB oracle SQL: the same health-record mapping as
:mod:`phenospark.plans.records`, written independently in SQL."""

EV = """ev AS (
  SELECT o.o_custkey AS patient_id, p.p_brand AS code, l.l_shipdate AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""
DEV = """dev AS (SELECT DISTINCT patient_id, code, ts FROM ev)"""
PAT = """pat AS (
  SELECT c_custkey AS patient_id, DATE '1920-01-01' + CAST((c_custkey * 7919) % 36500 AS INTEGER) AS dob
  FROM customer)"""
LE = """le AS (SELECT o_custkey AS patient_id, max(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey)"""
SEV = """sev AS (SELECT user_id AS patient_id, event_type AS code, ts FROM events)"""
CELLS = """cells AS (
  SELECT patient_id,
         array_to_string(list_sort(list(DISTINCT '(' || code || ',' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ')')), ',') AS codes
  FROM ev GROUP BY patient_id)"""


def age_sql(dob: str, as_of: str = "2002-06-30") -> str:
    y, m, d = (int(x) for x in as_of.split("-"))
    return (f"({y} - year({dob}) - CASE WHEN month({dob}) > {m} OR (month({dob}) = {m} AND day({dob}) > {d}) "
            f"THEN 1 ELSE 0 END)")


def hits_sql(name: str, codes: list[str], source: str = "dev") -> str:
    """CTE ``name(patient_id, n)``: distinct (code, ts) hits per patient."""
    lst = ", ".join("'" + c + "'" for c in codes)
    return f"{name} AS (SELECT patient_id, count(*) AS n FROM {source} WHERE code IN ({lst}) GROUP BY patient_id)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
