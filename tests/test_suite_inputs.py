"""Registered queries on inputs that the given tables do not hold."""

import duckdb

from suite.queries import load


def same_as_sql(spark, name, folder):
    run, sql = load()[name]
    frame = run(spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and want


def write_events(folder, sql):
    duckdb.sql(sql).write_parquet(f"{folder}/events.parquet")


def test_line_order_with_events_of_one_second(spark, tmp_path):
    """Events of a session may share their second."""
    write_events(
        tmp_path,
        """SELECT i AS event_id, TIMESTAMP '2024-01-10 08:00:00' + INTERVAL (i // 40) SECOND AS ts, i % 4 AS user_id,
        'view' AS event_type, 1.5 AS value, '{"k": 7}' AS props FROM range(240) t(i)""",
    )
    same_as_sql(spark, "s06_line_order", tmp_path)
