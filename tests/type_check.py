"""Compare column types of Spark results and DuckDB oracle at sf0.001."""
import sys
sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))
import duckdb
import __spark_entry__ as se
from tabprobe.session import get_session
from tabprobe.sources.tables import TABLES
spark = get_session()
con = duckdb.connect()
sf = '/root/testdata/sf0.001'
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
M = {'bigint': 'BIGINT', 'int': 'INTEGER', 'double': 'DOUBLE', 'string': 'VARCHAR', 'boolean': 'BOOLEAN'}
qs, sql = se.queries(), se.oracle_sql()
for name in sql:
    df = qs[name](spark, sf)
    st = {f.name: M.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    d = con.execute(f"DESCRIBE {sql[name]}").fetchall()
    dt = {r[0]: r[1] for r in d}
    bad = {k: (st[k], dt.get(k)) for k in st if st[k] != dt.get(k)}
    if bad:
        print('TYPES', name, bad)
print('done')
