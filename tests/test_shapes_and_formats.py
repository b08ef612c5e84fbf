"""Casts, shaping, text formats, pipelines, sinks, splitting, streams."""

from __future__ import annotations

import gzip
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
from millrace.errors import MergeError, MillraceError, ParserError, ParseError, PlanError
from millrace.functions.budget import Profile, StreamStats, parse_memory, resolve_engine
from millrace.functions.casts import canonical
from millrace.functions.types import java_pattern, parse_type
from millrace.operators import schema, sinks
from millrace.operators.stages import CastTypes, DropFields, FilterRows, MapRecords, ObservedStage, RenameFields, StreamStage, Tally
from millrace.plans import pipeline
from millrace.plans.expr import col
from millrace.sources import formats
from millrace.sources.datasource import RecordLines, complete
from millrace.sources.splitting import Boundaries, planned_parts, split
from millrace.streaming.records import Diagnostics, RecordStream, frames, kv_lines


def one(spark, kind, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["t"] for r in schema.typed(df, {"t": kind}).orderBy("i").collect()]


def test_cast_grammar(spark):
    assert one(spark, "int64", ["12", " 12", "+5", "1.0", "x", None, "9223372036854775808"]) == [12, None, 5, None, None, None, None]
    assert one(spark, "float64", ["1.5", " 1.5", "1.5d", "2e3", "-inf"]) == [1.5, None, None, 2000.0, float("-inf")]
    assert one(spark, "bool", ["true", "True", "yes", "false"]) == [True, None, None, False]
    assert one(spark, "date32", ["2026-9-1", " 2024-01-15 ", "2024", "2024-02-31"]) == [date(2026, 9, 1), date(2024, 1, 15), None, None]
    assert one(spark, "timestamp", ["2024-01-15T10:30:00", "2024-01-15", "2024-01-15 10:30", "2024-01-15T10:30:00Z"]) == [datetime(2024, 1, 15, 10, 30), datetime(2024, 1, 15), None, None]
    assert one(spark, "decimal128(1)", ["1.25", "-1.29", "1e2", ".5", "7."]) == [Decimal("1.2"), Decimal("-1.2"), None, Decimal("0.5"), Decimal("7.0")]
    assert java_pattern("%d.%m.%Y %H:%M") == "dd.MM.yyyy HH:mm"
    for bad in ("decimal128(39)", "int", "timestamp[xs]"):
        with pytest.raises(PlanError):
            parse_type(bad)


def test_cast_by_callable(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None)], "v double, s string")
    made = CastTypes({"v": str, "s": lambda t: t * 2, "gone": str}).transform(df)
    assert [tuple(r) for r in made.collect()] == [("1", "xx"), (None, None)] and [f.dataType.typeName() for f in made.schema] == ["string", "string"]


def test_strict_casts_of_typed_columns_lose_nothing(spark):
    df = spark.createDataFrame([(1.0, 2, Decimal("3.00"), True, date(2020, 1, 2))], "f double, i long, d decimal(5,2), b boolean, day date")
    made = CastTypes({"f": int, "i": bool, "d": int, "b": int, "day": datetime}).transform(df).first()
    assert tuple(made) == (1, True, 3, 1, datetime(2020, 1, 2))
    for value in (1.5, float("nan"), 1e30):
        with pytest.raises(PlanError):
            sinks.collect(CastTypes({"f": int}).transform(spark.createDataFrame([(value,)], "f double")))
    with pytest.raises(PlanError):
        CastTypes({"day": bool}).transform(df)
    assert sinks.collect(CastTypes({"f": int}).transform(spark.createDataFrame([(None,)], "f double"))) == [{"f": None}]


def test_strict_cast_names_the_value(spark):
    df = spark.createDataFrame([("1",), ("bad",)], "n string")
    with pytest.raises(PlanError, match="bad"):
        sinks.collect(CastTypes({"n": int}).transform(df))


def test_canonical_doubles(spark):
    values = [2.0, -0.5, 1e8, 1.25e-7, 1.5e20, 123456789.25, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(canonical(F.col("v"), df.schema["v"].dataType)).collect()] == ["2", "-0.5", "100000000", "0.000000125", "150000000000000000000", "123456789.25", "NaN"]


def test_shaping(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    assert schema.rename(df, {"a": "b", "b": "a"}).columns == ["b", "a", "c"]
    assert schema.project(df, ["c", "z"], {"z": "int64"}).dtypes == [("c", "double"), ("z", "bigint")]
    assert schema.unified_type("x", df.schema["a"].dataType, df.schema["c"].dataType).typeName() == "double"
    with pytest.raises(MergeError):
        schema.union_ragged([df.select("a"), df.select(F.col("b").alias("a"))])
    with pytest.raises(ValueError):
        RenameFields({"a": "x", "b": "x"})
    with pytest.raises(TypeError):
        DropFields("a")
    for bad in ((float("nan"), 1), (1.1, 1), (0.5, 0)):
        with pytest.raises(PlanError):
            schema.checked_dictionary_options(*bad)


def parsed(spark, parser, text):
    found = parser(formats.text_lines(spark, spark.createDataFrame([(text,)], "text string")))
    return [r["fields"] for r in found.orderBy("_pos").collect()]


def test_formats(spark):
    assert parsed(spark, formats.key_values, "X=10 X=20 Y=1\n\nX=5 X=6 X=7") == [{"X": "20", "Y": "1"}, {"X": "7"}]
    assert parsed(spark, formats.properties, "first: a=b  \nsecond  = :x\nthird\nfourth\t: y\nempty=\n# c") == [{"key": k, "value": v} for k, v in (("first", "a=b  "), ("second", ":x"), ("third", ""), ("fourth", "y"), ("empty", ""))]
    assert parsed(spark, formats.ini, "[s]\r\na = 1\n; c\nb: 2=3\n[open\n[t]\nplain") == [{"section": "s", "a": "1"}, {"section": "s", "b: 2": "3"}]
    assert parsed(spark, formats.ldif, "dn: a\r\n# c\r\nn:  1 \r\n\r\n\r\ndn: b\r\ndn: c") == [{"dn": "a", "n": "1 "}, {"dn": "c"}]
    for parser, text in ((formats.properties, "a=\\b"), (formats.ldif, "dn: a\n b"), (formats.ldif, "dn:: x"), (formats.ldif, "dn:< x")):
        with pytest.raises(Exception) as e:
            parsed(spark, parser, text)
        from millrace.errors import unwrapped

        assert isinstance(unwrapped(e.value), ParserError)


def test_files_in_many_parts(spark, tmp_path):
    path = tmp_path / "x.ini"
    path.write_text("".join(f"[s{i // 10}]\nk{i % 3}={i}\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        df = pipeline.read(spark, str(path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.columns == ["section", "k0", "k1", "k2"]
    assert sorted((r["section"], int(r["k0"] or r["k1"] or r["k2"])) for r in rows) == sorted((f"s{i // 10}", i) for i in range(300))


def test_pipeline_and_sinks(spark, tmp_path):
    path = tmp_path / "x.kv"
    path.write_text("A=3 B=1\nA=2 B=2\nA=5 C=4\n")
    made = pipeline.Source(spark, str(path), pipeline._adapters["kv"]) | CastTypes({"A": int}) | FilterRows(col("A") > 2) | RenameFields({"A": "Z"})
    assert sinks.collect(made) == [{"Z": 3, "B": "1", "C": None}, {"Z": 5, "B": None, "C": "4"}]
    assert sinks.to_arrow(made).column_names == ["Z", "B", "C"]
    assert len(sinks.to_pandas(made, "numpy")) == 2
    sinks.to_csv(made, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text().splitlines()[0] == "Z,B,C"
    sinks.to_parquet(made, str(tmp_path / "o.parquet"), single_file=True)
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    stats = StreamStats()
    assert sum(b.num_rows for b in made.iter_record_batches(batch_size=1, stats=stats)) == 2 and stats.batches == 2
    with pytest.raises(MemoryError):
        list(made.iter_record_batches(memory=1, strict=True))
    assert pipeline.discover_schema(spark, str(path)) == ["A", "B", "C"]
    with pytest.raises(FileNotFoundError):
        pipeline.Source(spark, str(tmp_path / "none.kv"), pipeline._adapters["kv"])
    with pytest.raises(MillraceError):
        pipeline.guess_format("a.unknown")
    with pytest.raises(ValueError):
        sinks.to_pandas(made, "other")


def test_compressed_and_invalid(spark, tmp_path):
    many = b"".join(b"A=%d\n" % i for i in range(1000))
    (tmp_path / "d").mkdir()
    for name, data in (("a.kv", gzip.compress(many)), ("b.kv", zstandard.compress(many)), ("c.kv", lz4(many)), ("e.kv", many), ("_hidden.kv", b"A=x\n")):
        (tmp_path / "d" / name).write_bytes(data)
    read = pipeline.read(spark, str(tmp_path / "d"), format="kv", field_types={"A": "int64"}, schema=["A"])
    assert sorted(r["A"] for r in read.collect()) == sorted([*range(1000)] * 4)
    assert pipeline.read(spark, str(tmp_path / "d" / "b.kv")).count() == 1000
    with pytest.raises(ParseError):
        formats.inflated(gzip.compress(b"x" * 100), most=99)
    (tmp_path / "b.kv").write_bytes(b"A=\xff\n")
    with pytest.raises(ParseError):
        sinks.collect(pipeline.read(spark, str(tmp_path / "b.kv"), schema=["A"]))


def lz4(data: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as stream:
        stream.write(data)
    return out.getvalue().to_pybytes()


REPORT = """<?xml version="1.0" encoding="UTF-8"?>
<Report Title="t"><Group Name="North">
%s
</Group></Report>
"""


def test_xml_reports(spark, tmp_path):
    rows = [f'<Details Level="{i % 2}"><Field Name="who"><Value>n{i}</Value></Field><Text Name="note"><TextValue>a &amp; {i}</TextValue></Text>' + ('<Field Name="last"/>' if i == 3 else "") + "</Details>" for i in range(15)]
    (tmp_path / "r.xml").write_text(REPORT % "\n".join(rows))
    made = pipeline.read(spark, str(tmp_path / "r.xml"), row_tag="Details", schema=["who", "note", "Level", "last"], field_types={"Level": "int64"}).collect()
    assert [(r["who"], r["note"], r["Level"], r["last"]) for r in made] == [(f"n{i}", f"a & {i}", i % 2, None) for i in range(15)]
    assert set(pipeline.read(spark, str(tmp_path / "r.xml"), row_tag="Details").columns) == {"who", "note", "Level", "last"}
    # one field alone, without attributes of the row; values with attributes of their own
    (tmp_path / "one.xml").write_text('<r><row><Field Name="x"><Value kind="k">1</Value></Field></row></r>')
    assert [r.asDict() for r in pipeline.read(spark, str(tmp_path / "one.xml")).collect()] == [{"x": "1"}]


def test_ini_lines(spark):
    text = "early = 1\n[x] trailing\na=1\n[a]x]\nb=2\n[ s ]\n\tk\t=\tv\t\n[open\nc : d = e\nsection=own"
    assert parsed(spark, formats.ini, text) == [{"section": "", "early": "1"}, {"section": "x", "a": "1"}, {"section": "a", "b": "2"}, {"section": " s ", "k": "v"}, {"section": " s ", "c : d": "e"}, {"section": "own"}]


@pytest.mark.parametrize("part", ["37b", "64b", "200b", "4000b"])
def test_ldif_records_across_parts(spark, tmp_path, part):
    records = [{"dn": str(i), **({"a": f"v{i}"} if i % 3 else {}), **({"b": "x" * (i % 50)} if i % 4 == 0 else {})} for i in range(60)]
    text = "\n\n\n".join("\n".join(f"{k}: {v}" for k, v in r.items()) + "\n# note" * (i % 2) for i, r in enumerate(records))
    (tmp_path / "x.ldif").write_text(text)
    (tmp_path / "y.ldif").write_text("\n\n# only\n\ndn: 60\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = pipeline.read(spark, str(tmp_path), format="ldif", schema=["dn", "a", "b"]).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = [(r["dn"], r.get("a"), r.get("b")) for r in records]
    found = sorted(((r["dn"], r["a"], r["b"]) for r in rows if r["dn"] is not None), key=lambda r: int(r[0]))
    assert found == [*want, ("60", None, None)]
    assert len(rows) == 61


def test_batches(spark):
    df = spark.range(1000, numPartitions=3).withColumn("t", F.repeat(F.lit("x"), 100))
    made = list(pipeline.record_batches(df, 300))
    assert [b.num_rows for b in made] == [300, 300, 300, 100] and [i for b in made for i in b.column(0).to_pylist()] == list(range(1000))
    stats = StreamStats()
    small = list(pipeline.record_batches(df, 300, memory="4KiB", stats=stats))
    assert all(b.nbytes <= 4096 for b in small) and sum(b.num_rows for b in small) == 1000 and not stats.oversize_batches
    assert stats.peak_tracked_bytes > 4096  # what waits counts too
    loose = list(pipeline.record_batches(df, 64, ordered=False, threads=2))
    assert sorted(i for b in loose for i in b.column(0).to_pylist()) == list(range(1000)) and [b.num_rows for b in loose] == [64] * 15 + [40]
    asked = iter([False, False, True])
    assert len(list(pipeline.record_batches(df, 100, should_stop=lambda: next(asked)))) == 2
    frame = sinks.to_pandas(df, "numpy", chunksize=7)
    assert len(frame) == 1000 and frame["id"].tolist() == list(range(1000))
    assert len(sinks.to_pandas(df.limit(0), chunksize=7)) == 0
    with Profile() as p:
        list(pipeline.record_batches(df))
    assert {name for name, _, _ in p.snapshot()} == {"parse", "export"}


def test_gathered_batches():
    batch = lambda **c: pa.RecordBatch.from_pydict(c)
    made = sinks.gathered([batch(a=[1], s=pa.array(["x"]).dictionary_encode()), batch(a=[1.5], s=["y"], z=[True])])
    assert made.to_pydict() == {"a": [1.0, 1.5], "s": ["x", "y"], "z": [None, True]}
    with pytest.raises(MergeError):
        sinks.gathered([batch(a=[1]), batch(a=["1"])])
    assert sinks.gathered([]).num_rows == 0


def test_observers_reach_the_caller(spark):
    accepted, total = Tally(spark), Tally(spark, of=lambda name, value: value)

    class Watch(ObservedStage):
        def observer_hooks(self):
            return {"on_row_accepted": accepted, "on_put_field": total, "on_row_rejected": lambda i: 1 / 0}

    stage = Watch(spec=(col("n") > 1).to_spec())
    assert stage.transform(spark.createDataFrame([(1,), (2,), (3,)], "n long")).count() == 2
    assert (accepted.value, total.value) == (2, 6)
    with pytest.raises(PlanError):
        ObservedStage({"on_nothing": print})


def test_adapters(spark, tmp_path):
    (tmp_path / "x.any").write_text("1\n2\n")
    calls = []

    class Numbers(pipeline.Adapter):
        def read(self, spark, path, scale=1, **_):
            calls.append(scale)
            return spark.read.text(path).select((F.col("value").cast("long") * scale).alias("n"))

    first, second = Tally(spark), Tally(spark)
    source = Numbers(spark, str(tmp_path / "x.any"), scale=10, field_mapping={"n": "m"}, observer={"on_row_accepted": first})
    other = source.with_plan(filter=col("m") > 10, observer={"on_row_accepted": second})
    assert [r["m"] for r in source.df.collect()] == [10, 20] and source.df is source.df
    assert [r["m"] for r in other] == [20] and second.value == 1 and first.value >= 3
    assert sum(b.num_rows for b in source.iter_record_batches()) == 2

    class Wrong(pipeline.Adapter):
        def read(self, spark, path, **_):
            return [1]

    with pytest.raises(TypeError, match="DataFrame"):
        Wrong(spark, str(tmp_path / "x.any")).df  # noqa: B018
    with pytest.raises(NotImplementedError):
        pipeline.Adapter(spark, str(tmp_path / "x.any")).df  # noqa: B018


def test_record_source(spark, tmp_path):
    spark.dataSource.register(RecordLines)
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"a={i} \\\n  b={i}\n" for i in range(200)))
    for size in (1, 37, 1000, 1 << 20, 0):
        read = spark.read.format("millrace_lines").option("partbytes", size).option("continuation", "\\").load(str(path))
        assert sorted(r["line"] for r in read.collect()) == sorted(f"a={i} \\\n  b={i}" for i in range(200))
    path.write_text("a\n\nb\nc\n\n\nd\n")
    read = spark.read.format("millrace_lines").option("partbytes", 2).option("blankLine", "true").load(str(path))
    assert sorted(r["line"].strip() for r in read.collect()) == ["a", "b\nc", "d"]
    path.write_text("x=1\nx=2\nx=")
    assert complete(str(path), Boundaries()) == 8
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def deliver():
        stream = spark.readStream.format("millrace_lines").option("partbytes", 3).load(str(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    assert deliver() == ["x=1", "x=2"]
    path.write_text("x=1\nx=2\nx=3\n")
    assert deliver() == ["x=1", "x=2", "x=3"]


def test_python_stages(spark):
    df = spark.createDataFrame([(1,), (2,)], "n long")
    assert sorted(r["m"] for r in MapRecords(lambda r: {"m": r["n"] * 2}).transform(df).collect()) == [2, 4]
    doubled = StreamStage(lambda rows: (x for r in rows for x in ({"n": r["n"]}, {"n": -r["n"]})), "n long").transform(df)
    assert sorted(r["n"] for r in doubled.collect()) == [-2, -1, 1, 2]


def test_python_stage_whose_first_rows_are_all_dropped(spark):
    df = spark.range(5000, numPartitions=3)
    late = MapRecords(lambda r: {"m": r["id"] * 2, "t": "x"} if r["id"] >= 2500 else None).transform(df)
    assert late.dtypes == [("m", "bigint"), ("t", "string")]
    assert sorted(r["m"] for r in late.collect()) == list(range(5000, 10000, 2))
    assert [r["m"] for r in MapRecords(lambda r: {"m": 1} if r["id"] == 4999 else None).transform(df).collect()] == [1]
    assert MapRecords(lambda r: None).transform(df).count() == 0


def test_boundaries_and_streams():
    data = b"a=1\nb=2 \\\nc=3\n#x\nd=4\n"
    b = Boundaries(continuation="\\", comments=("#",))
    assert [b.next(data, i) for i in (0, 1, 5, 15)] == [0, 4, 17, 17]
    cuts = split(data, 9, Boundaries(), least=1)
    assert cuts[0] == 0 and cuts[-1] == len(data) and all(data[c - 1 : c] == b"\n" for c in cuts[1:])
    text = b"@9:id=1|n=ab@4:id=2"
    for step in (1, 3, len(text)):
        stream = RecordStream(frames)
        found = [r for i in range(0, len(text), step) for r in stream.feed(text[i : i + step])] + stream.finish()
        assert found == [{"id": "1", "n": "ab"}, {"id": "2"}]
    stream = RecordStream(frames)
    stream.feed(b"@9:id")
    with pytest.raises(ParserError):
        stream.finish()
    assert RecordStream(kv_lines).feed(b"a=1\nb") == [{"a": "1"}]
    told = Diagnostics()
    assert RecordStream(kv_lines, told).feed(b"a=1 loose\nb=2 c=3\n") == [{"a": "1"}, {"b": "2", "c": "3"}]
    assert told.drain() == (["1 tokens without a separator"], {"discarded_tokens": 1, "records": 2}) and told.drain() == ([], {})


def test_budgets():
    assert parse_memory("64MiB") == 64 << 20 and parse_memory("1.5 KB") == 1500 and parse_memory(7) == 7 and parse_memory(0) == 1 and parse_memory("0.1") == 1
    for bad in ("", "NaN", "inf", "-1MiB", "1XB", "5k"):
        with pytest.raises(MillraceError):
            parse_memory(bad)
    assert planned_parts(1, 8) == 8 and planned_parts(1 << 40, 8) == 128 and planned_parts(1 << 40, 8, streaming=True) == 64 and planned_parts(1 << 50, 1000) == 1024
    assert resolve_engine(1 << 20) == "columnar" and resolve_engine(1 << 30, threads=4) == "parallel_streaming" and resolve_engine(1, memory=5) == "stream"
    with pytest.raises(ValueError):
        resolve_engine(1, threads=0)


def test_catalogue_has_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    own = [q for q in queries if not q.startswith("op") and q != "pipeline"]
    assert len(own) > 60 and set(own) <= set(sql)


def test_ini_lines_are_trimmed_once_and_files_are_written_in_parts(spark, tmp_path):
    # the plan held the trimming expressions anew for each use of a line, and one task wrote the whole file
    (tmp_path / "a.ini").write_text(" [s] x\n a\t=  1 \n" + "; c\n" * 40 + "b:2\r\n[é]\nc=\n" + "; c\n" * 40 + "d:=4\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        made = formats.ini(formats.lines(spark, str(tmp_path / "a.ini")))
        assert made.rdd.getNumPartitions() > 3
        plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
        found = [r["fields"] for r in made.orderBy("_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert "regexp" not in plan
    assert found == [{"section": "s", "a": "1"}, {"section": "s", "b": "2"}, {"section": "é", "c": ""}, {"section": "é", "d:": "4"}]
    from millrace.plans.catalogue import _written

    path = _written(spark.range(0, 40, 1, 4), F.col("id").cast("string"), "parts")
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() == 4


def test_ldif_pieces_are_cut_by_columns_and_meet_across_batches():
    """Lines went through Python one by one; _piece_rows is held against that plain way, batch by batch."""
    import random

    def plain(rows):
        out, seq, pos, fields, n, head = [], 0, None, {}, 0, True
        for place, line in rows:
            if line == "":
                out += [(-1 if pos is None else pos, seq, list(fields.items()), n, head, False)] if n else []
                seq, pos, fields, n, head = seq + 1, None, {}, 0, False
            elif not line.startswith("#"):
                n, pos = n + 1, place if pos is None else pos
                key, colon, value = line.partition(":")
                if colon:
                    fields[key] = value.lstrip(" ")
        return [*out, (-1 if pos is None else pos, seq, list(fields.items()), n, head, True)]

    rng, names = random.Random(3), ["_file", "_part", "_pos", "line"]
    for _ in range(60):
        rows = [(i, rng.choice(["", "", "# c", "a: 1", "a:  2", "b:x:y", "é:", ":z", "loose", "b:3"])) for i in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        part = lambda x: pa.RecordBatch.from_arrays([pa.array(["f"] * len(x)), pa.array([7] * len(x), pa.int32()), pa.array([i for i, _ in x], pa.int64()), pa.array([t for _, t in x])], names=names)
        made = [r for b in formats._pieces(True)(part(rows[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)) for r in b.to_pylist()]
        assert [(r["_pos"], r["_seq"], r["fields"], r["_lines"], r["_head"], r["_tail"]) for r in made] == plain(rows)
    assert hasattr(formats, "_piece_rows")


def test_xml_reports_are_bounded(monkeypatch):
    """One report held the whole table, and one task read it."""
    from millrace.plans import catalogue

    monkeypatch.setattr(catalogue, "REPORT_CHARS", 10)
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])
    made = lambda *x: [t for b in catalogue._reports(iter(map(batch, x))) for t in b.column(0).to_pylist()]
    assert made(["<a/>", "<b/>"], ["<c/>", "<d/>"]) == ["<Report>\n<a/>\n<b/>\n<c/>\n</Report>", "<Report>\n<d/>\n</Report>"]
    assert made() == ["<Report>\n</Report>"]
