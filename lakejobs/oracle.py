"""The same results in DuckDB SQL over the given tables."""

from __future__ import annotations

from lakejobs.functions.text import WHITE_SPACE
from lakejobs.jobs import (
    FILES_PER_BATCH,
    FILES_PER_MONTH,
    FIRST_RUN,
    FLIGHT_BLOCK,
    FLIGHT_QUERIES,
    INCOMING,
    ITEM_LIST,
    LAST_REPEATED,
    LITERAL_SUPPLIERS,
    ORDERS,
    PARTS,
    RECORDS,
    RESPONSE,
    SCRIPT,
    SHAPES,
    SHIP_DAYS,
    SHIPPED_FROM,
    SHIPPED_TO,
    STREAM_FILES,
)


def _mod(number: str, n: int) -> str:
    return f"((({number}) % {n}) + {n}) % {n}"


def _case(number: str, labels: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {_mod(number, len(labels))} {whens} END"


CARRIERS = ["AA", "DL", "UA", "WN", "B6", "AS", "NK", "F9"]
ORIGINS = ["JFK", "ATL", "ORD", "DFW", "DEN"]
DESTINATIONS = ["LAX", "SEA", "SFO", "MIA"]

FLIGHTS = f"""
WITH flights AS (
    SELECT CAST(r + (m - 1) * {FLIGHT_BLOCK} AS BIGINT) AS flight_id,
        {_case("r", CARRIERS)} AS carrier_code,
        CAST(1000 + (13 * r) % 9000 AS INTEGER) AS flight_num,
        {_case("r", ORIGINS)} AS origin,
        {_case("r", DESTINATIONS)} AS dest,
        '2026-' || lpad(CAST(m AS VARCHAR), 2, '0') AS flight_month,
        CAST((7 * r) % 140 - 15 AS INTEGER) AS dep_delay,
        CAST(200 + (3 * r) % 4800 AS INTEGER) AS distance
    FROM (SELECT o_orderkey AS r FROM orders), (SELECT unnest(range(1, 13)) AS m)
)
"""

INCOMING_SQL = f"""
WITH incoming AS (
    SELECT {", ".join(f"{sql} AS {name}" for name, sql in INCOMING.items())} FROM events
),
judged AS (
    SELECT *, nullif(concat_ws('; ',
        CASE WHEN try_cast(id AS INTEGER) IS NULL THEN 'id: not int' END,
        CASE WHEN NOT CAST(json_extract_string(source, '$.k') AS INTEGER) < 90
            THEN 'k of 90 or more' END), '') AS reject_reason
    FROM incoming
)
"""

ROUTED = f"""{INCOMING_SQL}
SELECT CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome,
    id, msg, source, ts, reject_reason
FROM judged
"""

RESPONSES = f"""
WITH responses AS (
    SELECT c_custkey, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS doc
    FROM (SELECT c_custkey, {RESPONSE} AS doc FROM customer)
)
"""

ITEMS = f"""
WITH lists AS (
    SELECT p_partkey, CAST(json_extract(doc, '$.items') AS JSON[]) AS items
    FROM (SELECT p_partkey, {ITEM_LIST} AS doc FROM part)
),
items AS (
    SELECT p_partkey, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM lists
),
named AS (
    SELECT p_partkey, pos, json_extract_string(item, '$.name') AS name,
        json_extract_string(item, '$.value') AS value
    FROM items
)
"""

# White space and line ends as SQL text.
SPACE = "".join(f"chr({ord(c)}) || " for c in WHITE_SPACE) + "''"
OTHER_LINE_ENDS = [11, 12, 13, 28, 29, 30, 133, 8232, 8233]
ONE_LINE_END = "replace(chunk, chr(13) || chr(10), chr(10))"
for _code in OTHER_LINE_ENDS:
    ONE_LINE_END = f"replace({ONE_LINE_END}, chr({_code}), chr(10))"

STATEMENTS = f"""
WITH scripts AS (SELECT doc_id, string_split({SCRIPT}, ';') AS chunks FROM documents),
chunks AS (
    SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos,
        unnest(chunks) AS chunk
    FROM scripts
),
statements AS (
    SELECT doc_id, pos, trim(array_to_string(
        list_filter(string_split({ONE_LINE_END}, chr(10)),
            lambda line: NOT starts_with(ltrim(line, {SPACE}), '--')),
        chr(10)), {SPACE}) AS statement
    FROM chunks
)
SELECT doc_id, pos, statement, left(split_part(statement, chr(10), 1), 80) AS head
FROM statements WHERE statement <> ''
"""

# Columns of the given tables: numbers (n), text (t) and others (o).
COLUMNS = {
    "region": "r_regionkey n, r_name t",
    "nation": "n_nationkey n, n_name t, n_regionkey n",
    "customer": "c_custkey n, c_name t, c_nationkey n, c_acctbal n, c_mktsegment t",
    "supplier": "s_suppkey n, s_name t, s_nationkey n, s_acctbal n",
    "part": "p_partkey n, p_name t, p_brand t, p_type t, p_size n, p_retailprice n",
    "orders": "o_orderkey n, o_custkey n, o_orderstatus t, o_totalprice n, o_orderdate t, "
    "o_orderpriority t",
    "lineitem": "l_orderkey n, l_partkey n, l_suppkey n, l_linenumber n, l_quantity n, "
    "l_extendedprice n, l_discount n, l_tax n, l_returnflag t, l_linestatus t, l_shipdate t",
    "events": "event_id n, ts t, user_id n, event_type t, value n, props t",
    "documents": "doc_id n, text t, lang t, source t, n_chars n",
    "embeddings": "vec_id n, embedding o, label n",
    "pages": "page_id n, url t, html t",
    "benchmark": "item_id n, text t",
    "labels": "doc_id n, quality n, toxic n",
    "conversations": "conv_id n, turn n, role t, text t",
}

#: Those of the numbers that are whole.
INTEGERS = (
    "r_regionkey n_nationkey n_regionkey c_custkey c_nationkey s_suppkey s_nationkey p_partkey p_size "
    "o_orderkey o_custkey l_orderkey l_partkey l_suppkey l_linenumber event_id user_id doc_id n_chars "
    "vec_id label page_id item_id quality toxic conv_id turn"
).split()


def _profile() -> str:
    parts = []
    for table, columns in COLUMNS.items():
        for entry in columns.split(", "):
            column, kind = entry.split()
            number = f"CAST({{}}({column}) AS DOUBLE)" if kind == "n" else "CAST(NULL AS DOUBLE)"
            whole = "CAST({}(%s) AS BIGINT)" % column if column in INTEGERS else "CAST(NULL AS BIGINT)"
            text = f"CAST({{}}({column}) AS VARCHAR)" if kind == "t" else "CAST(NULL AS VARCHAR)"
            parts.append(
                f'SELECT \'{table}\' AS "table", \'{column}\' AS "column", '
                f'count(*) AS "rows", count(*) - count({column}) AS nulls, '
                f"{number.format('min')} AS min_number, {number.format('max')} AS max_number, "
                f"{whole.format('min')} AS min_integer, {whole.format('max')} AS max_integer, "
                f"{text.format('min')} AS min_text, {text.format('max')} AS max_text FROM {table}"
            )
    return "\nUNION ALL\n".join(parts)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LITERAL_ROWS = ", ".join(
    f"({key}, {_quoted(name)}, {nation}, {balance})"
    for key, name, nation, balance in LITERAL_SUPPLIERS
)

EVENTS_WITHOUT_TIME = "SELECT event_id, user_id, event_type, value, props FROM events"

ORACLE = {
    "scan_all": "SELECT * FROM customer",
    "project_cols": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "filter_eq": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_conj": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
    "WHERE l_quantity > 45 AND l_returnflag = 'A'",
    "partition_pruned_scan": "SELECT event_id, event_type, value, '2024-01-02' AS day "
    "FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'",
    "count_all": "SELECT count(*) AS n FROM lineitem",
    "group_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "group_count_avg": "SELECT l_returnflag, count(*) AS n, "
    "round(avg(l_quantity), 6) AS avg_quantity FROM lineitem GROUP BY l_returnflag",
    "order_by": "SELECT c_mktsegment, c_custkey, c_name FROM customer "
    "ORDER BY c_mktsegment, c_custkey",
    "literal_rows": f"SELECT * FROM supplier UNION ALL SELECT * FROM (VALUES {LITERAL_ROWS})",
    "union_all": "SELECT c_nationkey AS nationkey FROM customer "
    "UNION ALL SELECT s_nationkey FROM supplier",
    "cross_join_numbers": "SELECT CAST(o_orderkey * 10 + d.n AS BIGINT) AS n "
    "FROM orders CROSS JOIN (SELECT unnest(range(10)) AS n) d",
    "latest_n": "SELECT event_id, event_type || ' [' || user_id || '] ' || props AS line "
    "FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "distinct_sorted": "SELECT DISTINCT lang FROM documents ORDER BY lang",
    "explode_first": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1",
    "gen_flights": f"{FLIGHTS} SELECT * FROM flights",
    "rebuild_partitioned": f"{FLIGHTS} SELECT flight_month, count(*) AS n, "
    "max(flight_id) AS last_id FROM flights GROUP BY flight_month",
    "expr_pack": f"""
        SELECT o_orderkey, {_case("v", CARRIERS)} AS carrier, {_case("v", ORIGINS)} AS origin,
            {_case("v", DESTINATIONS)} AS dest,
            CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END
                AS state,
            CAST({_mod("v * 7", 140)} AS BIGINT) AS remainder,
            CAST({_mod("v * 13", 9000)} + 1000 AS INTEGER) AS num,
            CAST(v * 3 - 15 AS BIGINT) AS scaled, '2026-01' AS month
        FROM (SELECT *, 5000 - o_orderkey AS v FROM orders)""",
    "flights_pruned": f"{FLIGHTS} {FLIGHT_QUERIES['pruned']}",
    "flights_delayed": f"{FLIGHTS} {FLIGHT_QUERIES['delayed']}",
    "flights_carrier_stats": f"{FLIGHTS} SELECT carrier_code, origin, count(*) AS legs, "
    "round(avg(distance), 6) AS mean_distance FROM flights GROUP BY carrier_code, origin",
    "named_queries": """
        SELECT 'all' AS name, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' ||
            l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}' AS record FROM lineitem
        UNION ALL
        SELECT 'filtered', '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' ||
            l_linenumber || ',"l_partkey":' || l_partkey || '}'
        FROM lineitem WHERE l_returnflag = 'A'
        UNION ALL
        SELECT 'by_flag', '{"l_returnflag":"' || l_returnflag || '","n":' || count(*) || '}'
        FROM lineitem GROUP BY l_returnflag""",
    "scan_report": FLIGHTS
    + " UNION ALL ".join(
        f"SELECT '{name}' AS name, {_quoted(FLIGHT_QUERIES[name])} AS query, "
        f"(SELECT count(*) FROM ({FLIGHT_QUERIES[name]})) AS record_count, "
        f"'demo' AS namespace, 'flights' AS \"table\", {_quoted(partition_filters)} AS partition_filters, "
        f"{_quoted(pushed)} AS pushed_filters, '{columns}' AS read_columns, "
        + "".join(
            f"CAST({12 * n} AS BIGINT) AS {what}_total, CAST({read * n} AS BIGINT) AS {what}_read, "
            f"CAST({(12 - read) * n} AS BIGINT) AS {what}_skipped, "
            for what, n in (("files", FILES_PER_MONTH), ("partitions", 1))
        )
        + f"(SELECT count(*) * {read} FROM orders) AS rows_read"
        for name, columns, read, partition_filters, pushed in [
            ("pruned", "flight_num,dest,distance", 1,
             "[isnotnull(flight_month), (flight_month = 2026-07)]", "[]"),
            ("delayed", "flight_num,origin,dep_delay,distance", 12, "[]",
             "[IsNotNull(origin), IsNotNull(dep_delay), EqualTo(origin,DEN), "
             "GreaterThanOrEqual(dep_delay,60), LessThanOrEqual(dep_delay,90)]"),
            ("carrier_stats", "carrier_code,origin,distance", 12, "[]", "[]"),
        ]
    ),
    "zone_map": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS "rows",
            min(value) AS min_value, max(value) AS max_value,
            CAST(count(*) - count(value) AS BIGINT) AS nulls
        FROM events GROUP BY 1""",
    "skipping_scan": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice "
    f"FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SHIPPED_FROM}' "
    f"AND l_shipdate < TIMESTAMP '{SHIPPED_TO}' AND l_quantity > 10",
    "clustered_scan": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ship_day, "
    f"l_extendedprice FROM lineitem WHERE l_partkey BETWEEN {PARTS[0]} AND {PARTS[1]} "
    f"AND CAST(l_shipdate AS DATE) BETWEEN DATE '{SHIP_DAYS[0]}' AND DATE '{SHIP_DAYS[1]}'",
    "key_lookup": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem "
    f"WHERE l_orderkey IN ({', '.join(map(str, ORDERS))})",
    "append_by_name": "SELECT * FROM supplier",
    "append_partitioned": " UNION ALL ".join(
        ["SELECT event_id, event_type, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"]
        * 2
    ),
    "append_repeated": "SELECT event_id, event_type, "
    f"CASE WHEN CAST(ts AS DATE) <= DATE '{LAST_REPEATED}' THEN value * 2 ELSE value END AS value, "
    "CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
    "append_with_rejects": ROUTED,
    "append_verify": f"""{INCOMING_SQL}
        SELECT count(*) AS input_rows, count(*) - count(reject_reason) AS rows_before,
            count(*) - count(reject_reason) AS written, count(reject_reason) AS rejected,
            2 * (count(*) - count(reject_reason)) AS rows_after, TRUE AS ok
        FROM judged""",
    "append_retry": f"""
        WITH tried AS (
            SELECT {", ".join(f"{sql} AS {name}" for name, sql in INCOMING.items())}, event_id, run,
                CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
            FROM (
                SELECT *, 1 AS run FROM events WHERE event_id < {FIRST_RUN}
                UNION ALL
                SELECT *, 2 FROM events WHERE event_id >= {FIRST_RUN} OR event_id % 10 = 0
            )
        ),
        judged AS (
            SELECT *, try_cast(id AS INTEGER) IS NOT NULL AS is_int,
                is_int AND k < 90 AS good1, is_int AND k < 95 AS good2
            FROM tried
        ),
        stored AS (
            SELECT DISTINCT id, msg, source, ts FROM judged WHERE good2 AND (run = 2 OR event_id < {FIRST_RUN})
        ),
        refused AS (
            SELECT id, msg, source, ts, nullif(concat_ws('; ',
                CASE WHEN NOT is_int THEN 'id: not int' END,
                CASE WHEN NOT k < 95 THEN 'k of 95 or more' END), '') AS reject_reason,
                CASE WHEN run = 1 THEN 2 ELSE 1 END AS attempt
            FROM judged WHERE NOT good2
        )
        SELECT 'accepted' AS outcome, id, msg, source, ts, CAST(NULL AS INTEGER) AS attempt,
            CAST(NULL AS VARCHAR) AS reject_reason FROM stored
        UNION ALL
        SELECT CASE WHEN attempt = 2 THEN 'dead' ELSE 'retry' END, id, msg, source, ts, attempt,
            reject_reason FROM refused""",
    "json_infer_scan": EVENTS_WITHOUT_TIME,
    "json_write": EVENTS_WITHOUT_TIME,
    "json_rows": """
        SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
            ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""",
    "json_rejects": """
        SELECT p_partkey AS id, unnest(['a', 'b']) AS msg, NULL::VARCHAR AS rejected
        FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 4 = 1
        UNION ALL SELECT NULL, NULL, '{"id":"x' || p_partkey || '","msg":"c"}'
        FROM part WHERE p_partkey % 4 = 2
        UNION ALL SELECT NULL, NULL, '[{"id":' || p_partkey || ',"msg":"d"},'
        FROM part WHERE p_partkey % 4 = 3""",
    "json_records": f"""
        WITH texts AS (SELECT CAST({RECORDS} AS JSON) AS doc FROM part),
        records AS (
            SELECT unnest(CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[])
                ELSE [doc] END) AS item
            FROM texts
        )
        SELECT CAST(json_extract_string(item, '$.id') AS BIGINT) AS id,
            json_extract_string(item, '$.msg') AS msg
        FROM records""",
    "json_infer_texts": f"""
        WITH t AS (SELECT *, {SHAPES} AS doc, p_partkey % 6 AS kind FROM part)
        SELECT CAST(p_partkey AS VARCHAR) AS id, 'a' AS msg, CAST(p_size AS DOUBLE) AS price,
            NULL::BIGINT AS size_v, NULL::VARCHAR AS rejected FROM t WHERE kind = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, 0.5, NULL, NULL FROM t WHERE kind = 0
        UNION ALL SELECT 'x' || p_partkey, NULL, NULL, NULL, NULL FROM t WHERE kind = 1
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, p_size, NULL FROM t WHERE kind = 2
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, NULL FROM t WHERE kind = 3
        UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(p_size AS VARCHAR) FROM t WHERE kind = 3
        UNION ALL SELECT NULL, NULL, NULL, NULL, doc FROM t WHERE kind = 4""",
    "profile_sketches": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS distinct_values, "
        + (f"CAST(min({c}) AS DOUBLE) AS smallest, CAST(max({c}) AS DOUBLE) AS largest" if c != "l_linestatus"
           else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        + " FROM lineitem"
        for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus")
    ),
    "json_keys": f"""{RESPONSES}
        SELECT c_custkey, array_to_string(list_sort(keys), ',') AS keys,
            CAST(len(keys) AS INTEGER) AS n_keys
        FROM (
            SELECT c_custkey, coalesce(json_keys(doc, '$.config'), CAST([] AS VARCHAR[])) AS keys
            FROM responses
        )""",
    "json_flags": f"""{RESPONSES}
        SELECT c_custkey, json_extract_string(doc, '$.location') AS location,
            coalesce(json_extract_string(doc, '$.config.token'), '') <> '' AS has_token,
            coalesce(json_extract_string(doc, '$.config.region'), 'none') AS region
        FROM responses""",
    "json_items": f"{ITEMS} SELECT p_partkey, value FROM named WHERE name = 'label'",
    "json_first": f"""{ITEMS}
        SELECT p.p_partkey, f.value
        FROM part p LEFT JOIN (
            SELECT p_partkey, arg_min(value, pos) AS value FROM named
            WHERE name = 'label' GROUP BY p_partkey
        ) f USING (p_partkey)""",
    "list_join": f"""{ITEMS}
        SELECT l.p_partkey, CASE WHEN l.items IS NOT NULL THEN coalesce(n.names, '') END AS names
        FROM lists l LEFT JOIN (
            SELECT p_partkey, string_agg(name, ' ' ORDER BY pos) AS names FROM named
            GROUP BY p_partkey
        ) n USING (p_partkey)""",
    "split_statements": STATEMENTS,
    "string_pack": """
        SELECT page_id, left(split_part(html, chr(10), 1), 80) AS head, left(html, 300) AS start,
            CAST(length(html) AS INTEGER) AS n_chars, split_part(url, '/', 3) AS host,
            split_part(url, '-', 1) AS before_dash, translate(url, '?&=', '') AS plain,
            replace(url, '/', ' ') AS spaced,
            CASE WHEN contains(url, 'ref=') THEN url ELSE url || '#ref=none' END AS with_ref
        FROM pages""",
    "table_profile": _profile(),
    "stream_append": ROUTED,
    "stream_batches": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_progress": f"""{INCOMING_SQL}
        SELECT b AS batch_id, CAST({FILES_PER_BATCH} AS BIGINT) AS files,
            CAST({STREAM_FILES} - {FILES_PER_BATCH} * (b + 1) AS BIGINT) AS queued, TRUE AS has_tasks,
            rows_in, rows_out, rejected
        FROM (SELECT count(*) AS rows_in, count(*) AS rows_out, count(reject_reason) AS rejected FROM judged),
            (SELECT unnest(range({-(-STREAM_FILES // FILES_PER_BATCH)})) AS b)""",
}
