"""Formats agree, bad rows are kept apart, streams report once even after a restart."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import enrich as En
from tracewell.sources import exports as Ex
from tracewell.sources import ingest as In
from tracewell.streaming import jobs as J

CSV = """﻿TIME,Tx_Hash,peer_ip,senders,in_amounts,receivers,out_amounts,opt_in_rbf
2024-01-01T00:00:00Z,ABCDEF0123,1.2.3.4,a1;a2,1.0;2.0,"b1,b2","1.5,1.4999",yes
1704067200,ABCDEF0124,1.2.3.4,a1,1.0,b1,0.9,
1704067200000,zz,1.2.3.4,a1,1.0,b1,0.9,0
2024-01-01,ABCDEF0125,,a1,1.0,b1,0.9,maybe
"""
JSON = """{"time":"2024-01-01T00:00:00Z","tx_hash":"ABCDEF0123","peer_ip":"1.2.3.4","inputs":[{"address":"a1","value":1.0},{"address":"a2","value":2.0}],"outputs":[{"address":"b1","amount":1.5},{"address":"b2","amount":1.4999}],"rbf":true}
{"time":1704067200,"tx_hash":"ABCDEF0124","peer_ip":"1.2.3.4","input_addresses":["a1"],"input_amounts":[1.0],"output_addresses":["b1"],"output_amounts":[0.9]}
{broken
"""
XML = """<txs><tx txid="ABCDEF0123" timestamp="2024-01-01T00:00:00Z" fee="0.0001"><net src_ip="1.2.3.4"/><inputs><in address="a1" amount="1.0"/><in address="a2" amount="2.0"/></inputs>
<outputs><out address="b1" amount="1.5"/><out address="b2" amount="1.4999"/></outputs><rbf>1</rbf></tx>
<tx><txid>ABCDEF0124</txid><timestamp>1704067200</timestamp><src_ip>1.2.3.4</src_ip><input><address>a1</address><amount>1.0</amount></input><output><address>b1</address><amount>0.9</amount></output></tx></txs>"""


def rows(df):
    ok, _ = In.validate_split(df)
    return sorted((r["txid"], r["timestamp"].isoformat(), r["src_ip"], r["input_addresses"], r["input_amounts"], r["output_addresses"], r["output_amounts"], r["rbf"]) for r in ok.collect())


def test_formats_agree_and_bad_rows_are_quarantined(spark, tmp_path):
    for name, body in (("a.csv", CSV), ("a.json", JSON), ("a.xml", XML)):
        (tmp_path / name).write_text(body, encoding="utf-8")
    csv = In.ingest(In.read_csv(spark, str(tmp_path / "a.csv")))
    js = In.ingest(In.read_json(spark, str(tmp_path / "a.json")))
    xml = In.ingest(In.read_xml(spark, str(tmp_path / "a.xml")))
    assert rows(csv) == rows(js) == rows(xml) and len(rows(csv)) == 2
    _, bad = In.validate_split(csv)
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["missing required field(s): src_ip; rbf: cannot be read as true/false", "txid: invalid hex format"]
    fees = {r["txid"]: r["fee"] for r in In.validate_split(csv)[0].collect()}
    assert fees["abcdef0123"] == pytest.approx(0.0001) and {r["fee"] for r in In.validate_split(xml)[0].collect()} == {0.0001, 0.0}
    log = In.ingest_counts(csv).first()
    assert (log["rows_read"], log["records"], log["quarantined"]) == (4, 2, 2)


def test_json_array_and_corrupt_array(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"ts":"2024-01-01","txid":"aaaaaaaa","ip":"::1","to":"x;y","output_values":"1;2"}]')
    got = In.validate_split(In.ingest(In.read_json(spark, str(tmp_path / "b.json"))))[0].first()
    assert got["output_addresses"] == ["x", "y"] and got["output_amounts"] == [1.0, 2.0]
    (tmp_path / "c.json").write_text('[{"ts":"2024-01-01"')
    with pytest.raises(Exception):
        In.read_json(spark, str(tmp_path / "c.json")).collect()


def test_mapping_file(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("seen: timestamp\nwho: src_ip\namount_unit: sat\noutput_addresses: [dest]\n")
    (tmp_path / "d.csv").write_text("seen,who,txid,dest,out_amounts\n2024-01-01,9.9.9.9,abcdefab,z,150000000\n")
    r = In.validate_split(In.ingest(In.read_csv(spark, str(tmp_path / "d.csv")), str(tmp_path / "m.yaml")))[0].first()
    assert r["output_amounts"] == [1.5] and r["src_ip"] == "9.9.9.9"


def test_ip_ranges_most_specific_and_v6(spark):
    ranges = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "AA", "AS1"), ("10.1.0.0", "10.1.255.255", "BB", "AS2"), ("10.1.2.0", "10.1.2.15", "CC", "AS3"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "DD", "AS4")],
                                   "start_ip string, end_ip string, country string, asn string")
    ips = spark.createDataFrame([("10.9.9.9",), ("10.1.3.4",), ("10.1.2.7",), ("2001:db8::1",), ("11.0.0.1",), ("nonsense",), ("300.1.1.1",)], "src_ip string")
    got = {r["src_ip"]: r["country"] for r in En.ip_range_join(ips, ranges).collect()}
    assert got == {"10.9.9.9": "AA", "10.1.3.4": "BB", "10.1.2.7": "CC", "2001:db8::1": "DD", "11.0.0.1": "XX", "nonsense": "XX", "300.1.1.1": "XX"}


def test_indicator_ids_are_name_based_uuids(spark):
    import uuid
    d = spark.createDataFrame([("bc1qexample",), ("1.2.3.4",)], "n string")
    for r in d.select("n", Ex.name_uuid(F.col("n")).alias("u")).collect():
        assert r["u"] == str(uuid.uuid5(uuid.UUID(Ex.INDICATOR_NAMESPACE), r["n"]))


def test_watch_stream_reports_once_and_survives_a_restart(spark, tmp_path):
    schema = "txid string, ts timestamp, address string, amount double, confirmed boolean"
    targets = spark.createDataFrame([("w", None, "WATCHLIST", "r", None)], "address string, watched_from timestamp, src string, reason string, alert_id string")

    def drop(name, data):
        spark.createDataFrame(data, "txid string, ts string, address string, amount double, confirmed boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        J.run_to_table(J.watch_stream(stream, targets), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted((r["txid"], r["recommended"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    drop("1", [("t1", "2024-01-01 00:00:00", "w", 1.0, False), ("t1", "2024-01-01 00:00:01", "w", 1.0, False), ("t2", "2024-01-01 00:01:00", "x", 1.0, True)])
    assert run() == [("t1", "UNCONFIRMED_MOVEMENT")]
    drop("2", [("t1", "2024-01-01 00:00:00", "w", 1.0, False), ("t3", "2024-01-01 00:02:00", "w", 1.0, True)])
    assert run() == [("t1", "UNCONFIRMED_MOVEMENT"), ("t3", "TRACE_AND_REVIEW")]


def test_every_csv_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('txid,timestamp,src_ip,output_addresses,op_return\naaaaaaaa,2024-01-01,1.1.1.1,x;y,"two\nlines, one memo"\n')
    (tmp_path / "b.csv").write_text("output_addresses,src_ip,timestamp,Tx_Hash\nz,2.2.2.2,2024-01-02,bbbbbbbb\n")
    ok, bad = In.validate_split(In.ingest(In.read_csv(spark, str(tmp_path))))
    rows = {r["txid"]: r for r in ok.collect()}
    assert set(rows) == {"aaaaaaaa", "bbbbbbbb"} and bad.count() == 0
    assert rows["aaaaaaaa"]["op_return"] == "two\nlines, one memo" and rows["bbbbbbbb"]["src_ip"] == "2.2.2.2"


def test_xml_records_under_any_of_the_three_tags(spark, tmp_path):
    for tag in ("tx", "transaction", "record"):
        (tmp_path / f"{tag}.xml").write_text(f'<all><{tag} txid="{tag[0]}" timestamp="2024-01-01"><src_ip>1.1.1.1</src_ip></{tag}></all>')
    assert sorted(r["raw"]["txid"] for r in In.read_xml(spark, str(tmp_path)).collect()) == ["r", "t", "t"]


def test_bad_rows_and_memos_keep_their_whole_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("txid,timestamp,src_ip,output_addresses,op_return\n" + f"bad,2024-01-01,1.1.1.1,x,{'m' * 3000}\n" + f"aaaaaaaa,2024-01-01,1.1.1.1,x,{'m' * 3000}\n")
    ok, bad = In.validate_split(In.ingest(In.read_csv(spark, str(tmp_path))))
    assert len(ok.first()["op_return"]) == 3000 and len(bad.first()["raw"]) > 3000


def test_columns_are_mapped_by_one_look_up_per_field(spark):
    """Spelled out per alias, the projection is too long for the JVM to compile and every row is interpreted."""
    rows = spark.createDataFrame([({"time": "", "date": "2024-01-01", "hash": "ab", "ip": None, "src": "1.2.3.4"}, "raw", "f")], "raw map<string,string>, raw_text string, source_file string")
    m = In.map_columns(rows)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("element_at") <= len(In.FIELD_ALIASES)
    r = m.first()
    assert (r["timestamp"], r["txid"], r["src_ip"], r["fee"]) == ("2024-01-01", "ab", "1.2.3.4", None)


def test_records_to_ingest_are_not_copied(spark, monkeypatch):
    from types import SimpleNamespace

    from tracewell.plans import queries_io as Q
    t = spark.createDataFrame([(1, ["a"], [1.0], ["b"], [0.5], 0.5, "P2TR", 2, 0, True, None)], "txid bigint, input_addresses array<string>, input_amounts array<double>, output_addresses array<string>, "
                              "output_amounts array<double>, fee double, script_type string, tx_version int, locktime bigint, rbf boolean, op_return string")
    obs = spark.sql("SELECT 1L AS txid, timestamp'2024-01-01 00:00:00' AS ts, '10.0.0.1' AS src_ip, 8333 AS src_port")
    monkeypatch.setattr(Q, "transactions", lambda fx: t)
    fx = SimpleNamespace(spark=spark, obs=obs, _stage=lambda label, build: pytest.fail(f"{label} is written"))
    rows = Q.raw_records(fx)
    assert "RoundRobin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r["Tx_Hash"], r["senders"], r["sport"]) for r in rows.collect()] == [("000000000001", "a", "8333")]
