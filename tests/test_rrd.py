import math

import pytest
from pyspark.sql import functions as F

from tidestore import cli
from tidestore.model import StoreConfig
from tidestore.operators import rrd
from tidestore.sources.rrd_files import parse_dump, parse_state
from tidestore.sources.store import SampleStore

XML = """<?xml version="1.0"?>
<!DOCTYPE rrd SYSTEM "http://nowhere.invalid/rrdtool.dtd">
<rrd><version>0003</version><step>300</step><lastupdate>{last}</lastupdate>{ds}{rra}</rrd>"""
DS = "<ds><name> {0} </name><type> {1} </type><minimal_heartbeat>600</minimal_heartbeat><min>U</min><max>inf</max><last_ds>{2}</last_ds><value>0</value><unknown_sec>0</unknown_sec></ds>"
RRA = "<rra><cf>{0}</cf><pdp_per_row>{1}</pdp_per_row><params><xff>0.5</xff></params><cdp_prep/><database>{2}</database></rra>"


def dump(last, sources, archives):
    row = lambda r: "<!-- t --> <row>" + "".join(f"<v>{v}</v>" for v in r) + "</row>"
    return XML.format(last=last, ds="".join(DS.format(*s) for s in sources), rra="".join(RRA.format(cf, k, "".join(map(row, rows))) for cf, k, rows in archives))


def frame(spark, *dumps):
    return spark.createDataFrame(list(enumerate(dumps)), "file int, xml string").select("file", parse_dump("xml").alias("dump"))


def model(last, step, sources, archives):
    """Sample times and values by the rules, in plain Python."""
    fine = [a for a in archives if a[1] == 1]
    chosen = {}
    for a in ([max(fine, key=lambda a: len(a[2]))] if fine else []) + [a for a in archives if a[0] == "AVERAGE"]:
        chosen.setdefault(a[1], a)
    order, out = [chosen[k] for k in sorted(chosen)], {}
    for n, (_, k, rows) in enumerate(order):
        width = k * step
        end = last - last % width
        start = end - width * (len(rows) - 1)
        grid = {start + width * i: [math.nan] * len(sources) for i in range(len(rows))}
        for d, (_, kind, raw) in enumerate(sources):
            values = [float(r[d]) for r in rows]
            if kind == "GAUGE":
                for i, v in enumerate(values):
                    grid[start + width * i][d] = v
            elif rows:
                now = 0.0 if raw == "U" else float(raw)
                now -= math.fmod(now, width)
                grid[end][d] = now
                for i in range(len(rows) - 1, 0, -1):
                    now -= 0.0 if math.isnan(values[i]) else values[i] * width
                    now += 2.0**64 if now < 0 else 0.0
                    if not math.isnan(values[i]):
                        grid[start + width * (i - 1)][d] = now
        if n:
            lower = last - order[n - 1][1] * step * len(order[n - 1][2])
            grid = {t: v for t, v in grid.items() if t < math.ceil(lower / width) * width}
        if not grid:
            continue
        if n + 1 < len(order):
            high = order[n + 1][1] * step
            grid = {t: v for t, v in grid.items() if t >= math.ceil(min(grid) / high) * high}
        out |= grid
    return {(t, d): v for t, row in out.items() for d, v in enumerate(row) if not math.isnan(v)}


def series(n, salt):
    return ["NaN" if (i * 7 + salt) % 5 == 0 else (i * 13 + salt) % 29 for i in range(n)]


CASES = [
    ([("load", "GAUGE", "U")], [("AVERAGE", 1, 9)]),
    ([("load", "GAUGE", "1"), ("octets", "COUNTER", "123456")], [("AVERAGE", 1, 12), ("AVERAGE", 4, 9), ("MAX", 1, 20)]),
    ([("octets", "DERIVE", "U")], [("AVERAGE", 1, 5), ("AVERAGE", 3, 30), ("AVERAGE", 10, 6)]),
    ([("octets", "COUNTER", "500")], [("LAST", 1, 40), ("AVERAGE", 2, 3), ("AVERAGE", 6, 8)]),
    ([("load", "GAUGE", "1")], [("AVERAGE", 1, 0), ("AVERAGE", 2, 4)]),
    ([("octets", "COUNTER", "7")], [("AVERAGE", 1, 0)]),
]


def test_history_equals_a_plain_model(spark):
    texts, want = [], {}
    for n, (sources, shapes) in enumerate(CASES):
        archives = [(cf, k, list(zip(*(series(rows, k + d) for d in range(len(sources))), strict=True)) if rows else []) for cf, k, rows in shapes]
        texts.append(dump(1_700_000_000 + n * 777, sources, archives))
        want |= {(n, *key): v for key, v in model(1_700_000_000 + n * 777, 300, sources, archives).items()}
    got = {(r["file"], r["ts"], r["ds_no"]): r["value"] for r in rrd.history(frame(spark, *texts), ["file"]).collect()}
    assert got == want and len(got) > 60


def test_unreadable_dumps_are_null(spark):
    assert [r["dump"] is None for r in frame(spark, "no xml", "<rrd><step>x</step></rrd>", None).collect()] == [True] * 3


def test_split_merge_and_reset(spark):
    sources = [("a", "GAUGE", "1"), ("b", "COUNTER", "9")]
    text = dump(1_700_000_000, sources, [("AVERAGE", 1, [(1, 2), ("NaN", 4), ("NaN", "NaN")]), ("MAX", 2, [(5, 6)])])
    d = frame(spark, text).withColumn("parts", rrd.split_dump(F.col("dump"))).withColumn("blank", rrd.reset_dump(F.col("dump")))
    r = d.select(
        "dump", "parts", rrd.merge_many(F.col("blank"), F.col("parts")).alias("many"), rrd.merge_one(F.col("blank"), F.col("dump")).alias("one"),
        rrd.format_equals(F.col("dump"), F.col("blank")).alias("same"), rrd.format_equals(F.col("dump"), F.col("parts")[0]).alias("other"),
        rrd.source_index(F.col("dump"), "b").alias("at"), rrd.source_index(F.col("dump"), "z").alias("none"),
    ).first()
    rows = lambda x: str(x["rra"])
    assert rows(r["many"]) == rows(r["dump"]) == rows(r["one"])
    assert [p["ds"][0]["name"] for p in r["parts"]] == ["a", "b"] and (r["same"], r["other"], r["at"], r["none"]) == (True, False, 1, -1)
    single = frame(spark, dump(1, sources[:1], [("AVERAGE", 1, [(1,)])]))
    with pytest.raises(Exception, match="two sources"):
        single.select(rrd.split_dump(F.col("dump"))).collect()


def test_import_of_a_tree(spark, tmp_path):
    node = tmp_path / "rrd" / "snmp" / "5" / "eth0"
    unknown = tmp_path / "rrd" / "snmp" / "9" / "eth0"
    for d in (node, unknown):
        d.mkdir(parents=True)
        (d / "ds.properties").write_text("# sources\nload=net\nother=net\n")
        (d / "strings.properties").write_text("alias=up link\n")
        (d / "net.xml").write_text(dump(1_700_000_000, [("load", "GAUGE", "1")], [("AVERAGE", 1, [(1,), ("NaN",), (3,)])]))
    (node / "broken.xml").write_text("<rrd")
    nodes = spark.createDataFrame([(5, "Req", "n5")], cli.NODES)
    with SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}/store")) as store:
        got = cli.import_dumps(store, f"file://{tmp_path}/rrd", nodes=nodes)
        assert got == {"files": 2, "skipped": 1, "samples": 2}
        assert {(r["resource_id"], r["name"], r["value"]) for r in store.samples().collect()} == {("snmp/fs/Req/n5/eth0/net", "load", v) for v in (1.0, 3.0)}
        m = store.metrics().first()
        assert [(t["key"], t["value"]) for t in m["meta"] + m["external"]] == [("mtype", "gauge"), ("alias", "up link")]


def test_commands_need_arguments():
    for bad in ([], ["--base-dir", "x"], ["--base-dir", "x", "import", "y"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_binary_archives_are_dumped_by_a_program(spark, tmp_path):
    node = tmp_path / "rrd" / "snmp" / "5" / "eth0"
    node.mkdir(parents=True)
    (node / "ds.properties").write_text("load=net\n")
    (node / "net.rrd").write_text(dump(1_700_000_000, [("load", "GAUGE", "1")], [("AVERAGE", 1, [(1,), (3,)])]))
    (node / "bad.rrd").write_text("broken")
    program = tmp_path / "tool"
    program.write_text('#!/bin/sh\n[ "$1" = dump ] || exit 2\ngrep -q broken "$2" && exit 1\ncat "$2"\n')
    program.chmod(0o755)
    with SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}/store")) as store:
        got = cli.import_dumps(store, f"file://{tmp_path}/rrd", program=str(program))
        assert got == {"files": 1, "skipped": 1, "samples": 2}
        assert {(r["resource_id"], r["value"]) for r in store.samples().collect()} == {("snmp/5/eth0/net", v) for v in (1.0, 3.0)}
        assert cli.import_dumps(store, f"file://{tmp_path}/rrd", program="no-such-program")["samples"] == 0


def test_state_of_archives(spark):
    text = dump(1, [("a", "GAUGE", "1")], [("HWPREDICT", 1, [(1,)])]).replace("<xff>0.5</xff>", "<xff>0.5</xff><hw_alpha>0.1</hw_alpha><dependent_rra_idx> 4 </dependent_rra_idx>")
    text = text.replace("<cdp_prep/>", "<cdp_prep><ds><primary_value>1.5</primary_value><secondary_value>NaN</secondary_value><value>U</value><unknown_datapoints>3</unknown_datapoints></ds></cdp_prep>")
    state = spark.createDataFrame([(text,), ("none",)], "xml string").select(parse_state("xml").alias("s")).collect()
    a = state[0]["s"][0]
    assert (a["cf"], a["xff"], a["hw_alpha"], a["dependent_rra_idx"], a["window_length"]) == ("HWPREDICT", 0.5, 0.1, 4, None)
    p = a["points"][0]
    assert (p["primary_value"], math.isnan(p["secondary_value"]), p["value"], p["unknown_datapoints"]) == (1.5, True, None, 3)
    assert state[1]["s"] is None


def test_node_table_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([(5, "Req", "n5"), (6, None, None)], "NODEID int, FOREIGNSOURCE string, FOREIGNID string")
    rows.write.format("jdbc").options(url=url, dbtable="NODE", driver=driver).save()
    assert sorted(tuple(r) for r in cli.read_nodes(spark, url, driver=driver).collect()) == [(5, "Req", "n5"), (6, None, None)]
