"""DuckDB text of the adapters: the same ledgers as common table expressions, for the side-by-side check."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTE[name] = (needs, body.strip())


def with_ctes(needs: list[str] | tuple[str, ...], tail: str, recursive: bool = False, extra: str = "") -> str:
    """``WITH`` clause holding the named expressions and all they need, in order, then ``tail``."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for d in CTE[n][0]:
            add(d)
        done.append(n)

    for n in needs:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in done]
    if extra:
        parts.append(extra.strip())
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + tail.strip()


def r(expr: str, n: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(round({expr}, {n}) + 0.0)"


cte("li", (), """
  SELECT l.*, o.o_custkey, o.o_orderdate + to_seconds(CAST(o.o_orderkey % 86400 AS BIGINT)) AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
cte("tout", ("li",), """
  SELECT l_orderkey AS txid, ts, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS idx,
         'A' || CAST(l_partkey * 6 + l_orderkey % 6 AS VARCHAR) AS address,
         round(l_extendedprice * (1 - l_discount) / 10000, 8) AS amount FROM li""")
cte("tot", ("tout",), "SELECT txid, min(ts) AS ts, count(*) AS n, sum(amount) AS s FROM tout GROUP BY 1")
cte("tin", ("tot",), """
  SELECT o_orderkey AS txid, t.ts, CAST(0 AS BIGINT) AS idx, 'A' || CAST(o_custkey * 8 + o_orderkey % 8 AS VARCHAR) AS address,
         round(s + 0.0001 * n, 8) AS amount FROM orders JOIN tot t ON t.txid = o_orderkey
  UNION ALL
  SELECT o_orderkey, t.ts, CAST(1 AS BIGINT), 'A' || CAST(o_custkey * 8 + (o_orderkey + 1) % 8 AS VARCHAR), 0.5
  FROM orders JOIN tot t ON t.txid = o_orderkey WHERE o_orderkey % 5 = 0""")
cte("tx", ("tot",), """
  SELECT t.txid, t.ts, round(0.0001 * n, 8) AS fee,
         ['P2WPKH','P2WSH','P2TR','P2PKH','P2SH'][o_custkey % 5 + 1] AS script_type,
         CASE WHEN o_custkey % 7 <> 0 THEN CAST(1 + o_custkey % 2 AS INT) END AS tx_version,
         CAST(CASE WHEN o_custkey % 3 = 0 THEN 862000 ELSE 0 END AS BIGINT) AS locktime,
         o_custkey % 2 = 1 AS rbf,
         CASE WHEN t.txid % 37 = 0 THEN '=:ETH.ETH:0x' || CAST(t.txid AS VARCHAR) || ':1000'
              WHEN t.txid % 37 = 1 THEN 'hello world' END AS op_return,
         CASE WHEN t.txid % 3 = 1 THEN false WHEN t.txid % 3 = 2 THEN true END AS confirmed
  FROM tot t JOIN orders ON o_orderkey = t.txid""")
cte("fp", ("tx",), """
  SELECT txid, CASE WHEN tx_version IS NOT NULL AND locktime IS NOT NULL AND rbf IS NOT NULL THEN
         'v' || CAST(tx_version AS VARCHAR) || '|' || CASE WHEN locktime >= 500000000 THEN 't' WHEN locktime > 0 THEN 'h' ELSE '0' END
         || '|' || CASE WHEN rbf THEN 'r' ELSE 'n' END END AS software FROM tx""")
# B
cte("be", (), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
cte("btin", ("be",), """
  SELECT event_id AS txid, ts, CAST(0 AS BIGINT) AS idx, 'U' || CAST(user_id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS address,
         10.0 + value / 1000 + 0.0001 AS amount FROM be""")
cte("btout", ("be",), """
  SELECT event_id AS txid, ts, CAST(0 AS BIGINT) AS idx, 'U' || CAST(user_id AS VARCHAR) || '_' || CAST(seq + 1 AS VARCHAR) AS address,
         CAST(10.0 AS DOUBLE) AS amount FROM be
  UNION ALL SELECT event_id, ts, CAST(1 AS BIGINT), 'P' || CAST(event_id % 50 AS VARCHAR), round(value / 1000, 8) FROM be
  UNION ALL SELECT event_id, ts, CAST(2 + k AS BIGINT), 'F' || CAST(event_id % 97 AS VARCHAR) || '_' || CAST(k AS VARCHAR), 0.5
  FROM be, (SELECT unnest([0, 1, 2]) AS k) WHERE event_type = 'error'""")
# M
cte("mk", ("li",), "SELECT l_orderkey AS txid, count(*) AS k FROM li GROUP BY 1 HAVING count(*) >= 3")
cte("ml", ("li", "mk"), """
  SELECT txid, ts, k, l_partkey, l_quantity, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey AS rn,
         concat_ws('_', CAST(txid AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS tag
  FROM li JOIN mk ON txid = l_orderkey""")
cte("mtin", ("ml",), """
  SELECT txid, ts, rn AS idx, 'A' || CAST(l_partkey * 6 + txid % 6 AS VARCHAR) AS address,
         round(0.1 + 0.001 * l_quantity + 0.00002, 8) AS amount FROM ml""")
cte("mtout", ("ml",), """
  SELECT txid, ts, rn * 4 AS idx, 'M' || tag AS address, CAST(0.1 AS DOUBLE) AS amount FROM ml
  UNION ALL SELECT txid, ts, rn * 4 + 1, 'C' || tag, round(0.001 * l_quantity, 8) FROM ml
  UNION ALL SELECT txid, ts, rn * 4 + 2, 'S' || tag, 0.12034567 FROM ml WHERE txid % 200 = 0 AND l_quantity > 25""")
cte("mtx", ("ml",), "SELECT txid, min(ts) AS ts, round(0.00002 * max(k), 8) AS fee FROM ml GROUP BY 1")
# N
cte("obs", ("li",), """
  SELECT DISTINCT l_orderkey AS txid, ts + to_milliseconds((l_partkey * 7919 + l_linenumber * 104729) % 5000) AS ts,
         '10.0.' || CAST(l_suppkey // 256 AS VARCHAR) || '.' || CAST(l_suppkey % 256 AS VARCHAR) AS src_ip,
         CASE WHEN l_suppkey % 9 = 0 THEN 18333 ELSE 8333 END AS src_port, n.n_name AS country,
         -60.0::DOUBLE + (n.n_nationkey * 37) % 121 AS lat, -180.0::DOUBLE + (n.n_nationkey * 53) % 361 AS lon,
         'AS' || CAST(64500 + l_suppkey % 40 AS VARCHAR) AS asn,
         ['TOR_EXIT','VPN','DATACENTER','BULLETPROOF','RESIDENTIAL','UNKNOWN'][l_suppkey % 6 + 1] AS asn_type
  FROM li JOIN supplier s ON s.s_suppkey = li.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey""")
cte("spy", ("obs",), """
  SELECT a.txid, a.src_ip AS spy_ip, a.src_port AS spy_port, a.country AS spy_country, a.asn AS spy_asn, a.asn_type AS spy_asn_type,
         a.n AS n_obs, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS spy_delta
  FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY txid) AS n FROM obs WINDOW w AS (PARTITION BY txid ORDER BY ts, src_ip)) a
  LEFT JOIN (SELECT *, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY txid ORDER BY ts, src_ip)) b
    ON a.txid = b.txid AND b.rn = 2 WHERE a.rn = 1""")
cte("place", (), """
  SELECT n_name AS country, -60.0::DOUBLE + (n_nationkey * 37) % 121 AS lat, -180.0::DOUBLE + (n_nationkey * 53) % 361 AS lon FROM nation""")
# K
cte("addr", ("tin", "tout"), """
  SELECT address, CAST(substr(address, 2) AS BIGINT) AS n FROM (SELECT address FROM tin UNION SELECT address FROM tout)""")
cte("known", ("addr",), """
  SELECT address, ['VASP','MINING_POOL','SWAP','MERCHANT'][(n // 50) % 4 + 1] || '_' || CAST((n // 50) % 7 AS VARCHAR) AS entity_name,
         ['VASP','MINING_POOL','SWAP','MERCHANT'][(n // 50) % 4 + 1] AS entity_type,
         CASE WHEN n % 100 = 0 THEN 'IN' ELSE 'XX' END AS country, n % 100 = 0 AS in_jurisdiction FROM addr WHERE n % 50 = 0""")
cte("seeds", ("addr",), "SELECT address FROM addr WHERE n % 97 = 0")
cte("watchlist", ("addr",), """
  SELECT address, TIMESTAMP '1998-01-01' AS watched_from, n % 2 = 0 AS active, 'ANALYST' AS reason,
         'A-W-' || substr(sha1(address), 1, 10) AS alert_id FROM addr WHERE n % 61 = 0""")
cte("truth", ("addr",), """
  SELECT address, n // 8 AS entity_id, CAST((n // 8) % 15 = 0 AS INT) AS is_illicit,
         ['RANSOMWARE','PEEL_CHAIN','MIXING','STRUCTURING','ROUND_TRIP'][(n // 8) % 5 + 1] AS typology FROM addr""")
cte("scores", ("addr",), """
  SELECT address, n, ((n * 2654435761) % 1000) / 1000.0 AS p, ((n * 40503) % 1000) / 1000.0 AS anomaly,
         ['RANSOMWARE','PEEL_CHAIN','MIXING','STRUCTURING','ROUND_TRIP'][n % 5 + 1] AS typology FROM addr""")
cte("feedback", ("addr",), """
  SELECT address AS entity_id, TIMESTAMP '2024-01-01' AS created_at, 'FALSE_POSITIVE' AS user_label FROM addr WHERE n % 211 = 0
  UNION ALL SELECT address, TIMESTAMP '2024-02-01', CASE WHEN n % 2 = 0 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END FROM addr WHERE n % 211 = 0""")
