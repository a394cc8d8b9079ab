import csv
import io
import random

from quire.operators import strict_load

SCHEMA = "line_id bigint, src_file string, line_no int, raw string, received_at timestamp, reason string"
VOCABULARY = [("SCOPE", "structure"), ("PROSE", "voice"), ("PROSE", "voice")]


def run(spark, lines):
    rows = [(k, "f", k + 1, raw, None, "clash") for k, raw in enumerate(lines)]
    df = spark.createDataFrame(rows, SCHEMA)
    vocabulary = spark.createDataFrame(VOCABULARY, "tag string, layer string")
    bad = {r.line_id: r.reason for r in strict_load.rejects(df, vocabulary).collect()}
    good = {r.line_id: r for r in strict_load.load(df, vocabulary).collect()}
    assert not bad.keys() & good.keys()
    return bad, good


def test_reasons(spark):
    lines = [
        "﻿" + ",".join(strict_load.COLUMNS),
        "a,1,x,SCOPE,structure,2,c,l1;l2",
        'a,,"x, ""y""\nz",SCOPE," structure ","3","",""',
        'a,1,x "y",SCOPE,structure,2,c,',
        'a,1,"x"y,SCOPE,structure,2,c,',
        'a,1,"x,SCOPE,structure,2,c,',
        'a,1, "x",SCOPE,structure,2,c,',
        "a,1,x,SCOPE,structure,2,c",
        "",
        None,
        "a,1,x,scope,structure,2,c,",
        "a,1,x,SCOPE,voice,2,c,",
        "a,1,x,SCOPE,structure,2.0,c,",
        ",".join(strict_load.COLUMNS),
        '"a","1","x","PROSE","voice","1","c","l"\r\n',
    ]
    bad, good = run(spark, lines)
    assert bad == {3: "quoting", 4: "quoting", 5: "quoting", 6: "quoting", 7: "columns", 8: "columns", 9: "columns", 10: "values", 11: "values", 12: "values", 13: "values"}
    assert sorted(good) == [1, 2, 14]
    assert good[2].anchor == 'x, "y"\nz' and good[2].severity == 3 and good[2].line is None and good[2].refs == [] and good[1].refs == ["l1", "l2"]


def test_round_trip_of_written_lines(spark):
    rng = random.Random(2)
    fields = [["".join(rng.choice('ab,"\n\x01é ') for _ in range(rng.randint(0, 6))) for _ in range(2)] for _ in range(300)]
    lines = []
    for a, b in fields:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([a, "7", b, "SCOPE", "structure", "1", "c", ""])
        lines.append(out.getvalue())
    bad, good = run(spark, ["x", *lines])
    assert bad == {0: "columns"}
    assert [[good[k + 1].file, good[k + 1].anchor] for k in range(300)] == fields


def test_null_keys_long_lines_and_empty(spark):
    long = 'a,1,"' + 'x""' * 60_000 + '",SCOPE,structure,2,c,'
    df = spark.createDataFrame([(None, "f", 2, long, None, ""), (None, "f", None, "a", None, ""), (None, "f", None, "a", None, "")], SCHEMA)
    vocabulary = spark.createDataFrame(VOCABULARY, "tag string, layer string")
    assert strict_load.load(df, vocabulary).count() == 1
    assert [r.reason for r in strict_load.rejects(df, vocabulary).collect()] == ["columns"] * 2
    assert strict_load.rejects(df.limit(0), vocabulary).count() == 0
