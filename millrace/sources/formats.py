"""Text formats: each reader gives records as a map of fields, with the file and position that they stood at.

Lines are read by Spark's text source, split by line feeds alone, so that a file is read by many tasks. What a line
needs to know of the lines before it, a section or the begin of its record, each task carries along its own lines; one or
two rows for each part of a file carry on to the next part. Lines themselves are never shuffled.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import ParseError, ParserError, raised
from millrace.functions.casts import WHITE_CHARS
from millrace.shipping import ship

#: Decompressed bytes of a file at most.
MOST_BYTES = 1 << 30
#: Parts of files whose carried rows are broadcast at most; more of them meet the lines by a shuffle.
MOST_CARRIED = 100_000


def _closed(line: Column) -> Column:
    """A line without one trailing carriage return."""
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """_file, _part, _pos and line (without a trailing carriage return); invalid UTF-8 fails.

    Files that begin as gzip, zstd or lz4 frames do are inflated, whatever they are called: each as a whole, as its
    records can't be found before. The others are split.
    """
    plain, packed = by_magic(spark, path)
    parts = []
    if plain or not packed:
        raw = spark.read.option("lineSep", "\n").text(plain or path)
        checked = F.when(F.is_valid_utf8("value"), _closed(F.col("value"))).otherwise(raised(ParseError, F.lit("invalid UTF-8")).cast("string"))
        parts.append(raw.select(F.input_file_name().alias("_file"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"), checked.alias("line")))
    if packed:
        parts.append(text_lines(spark, whole_texts(spark, packed), file="_file").select("_file", F.lit(0).alias("_part"), "_pos", "line"))
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]


def by_magic(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """Files below a path (a file, a folder or a pattern) that are not compressed, and those that are by their first bytes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list = []
    for one in [path] if isinstance(path, str) else path:
        at = hadoop.Path(one)
        fs = at.getFileSystem(conf)
        for status in fs.globStatus(at) or ():
            if status.isFile():
                found.append((fs, status))
                continue
            inner = fs.listFiles(status.getPath(), True)
            while inner.hasNext():
                s = inner.next()
                if not s.getPath().getName().startswith((".", "_")):
                    found.append((fs, s))

    def packed(item) -> bool:
        fs, status = item
        stream = fs.open(status.getPath())
        try:
            return kind_of_bytes(bytes(x for _ in range(4) if (x := stream.read()) >= 0)) is not None
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        marks = list(pool.map(packed, found))
    names = [status.getPath().toString() for _, status in found]
    return [n for n, m in zip(names, marks, strict=True) if not m], [n for n, m in zip(names, marks, strict=True) if m]


def text_lines(spark: SparkSession, texts: DataFrame, text: str = "text", file: str | None = None) -> DataFrame:
    """_file, _pos and line of texts in a column, one file each. A last line feed opens no line."""
    name = F.col(file).cast("string") if file else F.lit("memory")
    split = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    rows = texts.filter((F.col(text).isNotNull()) & (F.length(text) > 0)).select(name.alias("_file"), F.posexplode(split).alias("_pos", "line"))
    return rows.select("_file", F.col("_pos").cast("long"), _closed(F.col("line")).alias("line"))


def key_values(read: DataFrame, pairs: str = " ", equals: str = "=", names: list[str] | None = None) -> DataFrame:
    """k=v k=v lines; blank lines are skipped, tokens without a separator too, of equal keys the last stands.

    With names, the fields come as columns instead of a map, each cut out of the line by itself.
    """
    rows = read.filter(F.trim("line") != "")
    if names is not None and len(pairs) == 1:
        line = F.concat(F.lit(pairs), "line")

        def field(name: str) -> Column:
            mark = F.lit(f"{pairs}{name}{equals}")
            if pairs in name or equals in name:
                return F.lit(None).cast("string")
            return F.when(F.contains(line, mark), F.substring_index(F.substring_index(line, f"{pairs}{name}{equals}", -1), pairs, 1))

        return rows.select(*(field(n).alias(n) for n in dict.fromkeys(names)))
    tokens = F.filter(F.split("line", re.escape(pairs)), lambda t: F.contains(t, F.lit(equals)))
    entry = lambda t: F.struct(F.substring_index(t, equals, 1).alias("key"), t.substr(F.instr(t, F.lit(equals)) + len(equals), F.length(t)).alias("value"))
    return _mapped(rows, F.transform(tokens, entry))


def _mapped(rows: DataFrame, entries: Column) -> DataFrame:
    """Entries to a map in which of equal keys the last stands, at the first one's place."""
    held = rows.withColumn("_entries", entries)
    keys = F.transform("_entries", lambda e: e["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter("_entries", lambda e: e["key"] == k), -1))
    repeated = F.size("_entries") != F.size(F.array_distinct(keys))
    return held.select("_file", "_pos", F.when(repeated, F.map_from_entries(last)).otherwise(F.map_from_entries("_entries")).alias("fields"))


def properties(read: DataFrame) -> DataFrame:
    """key and value lines: blank and comment lines (#, !) are skipped, the first of = : or white space parts them."""
    line = F.regexp_replace("line", r"^[ \t\x0c]+", "")
    rows = read.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").rlike("^[#!]"))
    rows = rows.withColumn("line", F.when(F.contains("line", F.lit("\\")), raised(ParserError, F.lit("escapes are not supported in properties")).cast("string")).otherwise(F.col("line")))
    parts = r"(?s)^([^=: \t\x0c]*)[ \t\x0c]*[=:]?[ \t\x0c]*(.*)$"
    pair = F.create_map(F.lit("key"), F.regexp_extract("line", parts, 1), F.lit("value"), F.regexp_extract("line", parts, 2))
    return rows.select("_file", "_pos", pair.alias("fields"))


def _runs(batch: pa.RecordBatch, before: str | None) -> np.ndarray:
    """Whether each row of a batch begins another file than the row before it."""
    files = batch.column("_file")
    first = np.array([files[0].as_py() != before])
    return np.r_[first, pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)] if len(files) > 1 else first


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's last value that is not null, up to each row, within each file of a task's rows."""
    file, came = None, pa.nulls(1, pa.string())
    for batch in batches:
        if not batch.num_rows:
            continue
        own, place = batch.column(batch.num_columns - 1), np.arange(batch.num_rows) + 1
        opens = _runs(batch, file)
        if opens[0]:
            came = pa.nulls(1, pa.string())
        # place 0 is what came from the batch before
        last = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), place, 0))
        begin = np.maximum.accumulate(np.where(opens, place, 0))
        held = np.where(last >= begin, last, 0)
        lacks = (last < begin) & (begin > 0)
        values = pa.concat_arrays([came, own]).take(pa.array(held, mask=lacks))
        file, came = batch.column("_file")[-1].as_py(), values.slice(len(values) - 1, 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), values], schema=batch.schema)


def _ini_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_file, _part, _pos, key and value (null for lines that hold none) and _section (where one opens) of the lines that
    say something."""
    for batch in batches:
        line = pc.utf8_trim(batch.column(3), characters=WHITE_CHARS)
        says = pc.and_(pc.not_equal(line, ""), pc.invert(pc.or_(pc.starts_with(line, ";"), pc.starts_with(line, "#"))))
        batch, line = batch.filter(says), line.filter(says)
        opens = pc.starts_with(line, "[")
        section = pc.struct_field(pc.extract_regex(line, r"^\[(?P<s>[^\]]*)\]"), 0)
        plain = pc.if_else(opens, pa.scalar(None, pa.string()), line)
        by_equals, by_colon = (pc.extract_regex(plain, f"(?s)^(?P<key>[^{x}]*){x}(?P<value>.*)$") for x in "=:")
        key, value = (pc.coalesce(pc.struct_field(by_equals, i), pc.struct_field(by_colon, i)) for i in (0, 1))
        key, value = pc.utf8_rtrim(key, characters=WHITE_CHARS), pc.utf8_ltrim(value, characters=WHITE_CHARS)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), key, value, section], names=["_file", "_part", "_pos", "key", "value", "_section"])


def _ini_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with a key, each with the section that its task has seen open."""
    for batch in _filled(_ini_lines(batches)):
        yield batch.filter(batch.column(3).is_valid())


def _ini_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_file, _part and the last section that opens in that part of the file, or null."""
    last: dict[tuple[str, int], str | None] = {}

    def ends(batch: pa.RecordBatch, columns: tuple[int, ...]) -> Iterator[tuple]:
        n = batch.num_rows
        other = [pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False) for i in (0, 1)] if n > 1 else [np.zeros(0, bool)] * 2
        at = pa.array(np.flatnonzero(np.r_[other[0] | other[1], [True] * (n > 0)]))
        return zip(*(batch.column(i).take(at).to_pylist() for i in columns), strict=True)

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part in ends(batch, (0, 1)):
                last.setdefault((file, part))
            yield batch

    for batch in _ini_lines(noted()):
        for file, part, section in ends(batch.filter(batch.column(5).is_valid()), (0, 1, 5)):
            last[file, part] = section
    rows = [(*k, v) for k, v in last.items()]
    kinds = (pa.string(), pa.int32(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_file", "_part", "_end"])


def ini(read: DataFrame) -> DataFrame:
    """section and one field per key line: [s] opens a section, up to the first ] and whatever follows it; a line that
    begins with [ and has no ] is passed over; ; and # are comments; = parts a key from its value before : does.

    Lines stay where they are: each task carries sections along its own lines, and one row for each part of a file
    carries on to the next part. For that row no other lines than those with a [ are sent.
    """
    ship(read.sparkSession)
    in_parts = "_part" in read.columns
    rows = read.select("_file", F.col("_part") if in_parts else F.lit(0).alias("_part"), "_pos", "line")
    found = rows.mapInArrow(_ini_keys, "_file string, _part int, _pos long, key string, value string, _section string")
    if in_parts:
        before = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        marks = rows.withColumn("line", F.when(F.contains("line", F.lit("[")), F.col("line")))
        ends = marks.mapInArrow(_ini_ends, "_file string, _part int, _end string")
        came = ends.select("_file", "_part", F.last("_end", ignorenulls=True).over(before).alias("_came")).filter(F.col("_came").isNotNull())
        came = F.broadcast(came) if rows.rdd.getNumPartitions() <= MOST_CARRIED else came
        found = found.join(came, ["_file", "_part"], "left").withColumn("_section", F.coalesce("_section", "_came"))
    keys, values = F.array(F.lit("section"), F.col("key")), F.array(F.coalesce("_section", F.lit("")), F.col("value"))
    # a key called section hides the section, as the last of equal fields
    fields = F.when(F.col("key") == "section", F.create_map(F.lit("section"), F.col("value"))).otherwise(F.map_from_arrays(keys, values))
    return found.select("_file", "_pos", fields.alias("fields"))


_PIECE = "_file string, _part int, _pos long, _seq int, fields map<string,string>, _lines int, _head boolean, _tail boolean"


def _piece_rows(lines: pa.RecordBatch, of: tuple[str, int], seq: int, head: bool, tail: bool) -> pa.RecordBatch:
    """The pieces of some lines (or none) of one part of a file; lines that belong to one piece are here together. head, tail:
    marks of the first piece and of the one after the last blank line. Of equal keys the last stands, at the first one's
    place; a piece without a line is left out unless it is the tail."""
    line = lines.column(3)
    blank = pc.equal(line, "").to_numpy(zero_copy_only=False)
    said = ~blank & ~pc.starts_with(line, "#").to_numpy(zero_copy_only=False)
    piece, many = np.cumsum(blank) - blank, int(blank.sum()) + 1
    counts = np.bincount(piece[said], minlength=many)
    begins = np.zeros(many, "i8")
    owners, first = np.unique(piece[said], return_index=True)
    begins[owners] = np.flatnonzero(said)[first]
    place = np.where(counts > 0, np.r_[lines.column(2).to_numpy(), -1][begins], -1)
    pairs = said & pc.match_substring(line, ":").to_numpy(zero_copy_only=False)
    parted = pc.extract_regex(line.filter(pa.array(pairs)), "(?s)^(?P<key>[^:]*):(?P<value>.*)$")
    key, value, owner = pc.struct_field(parted, 0), pc.utf8_ltrim(pc.struct_field(parted, 1), characters=" "), piece[pairs]
    coded = key.dictionary_encode()
    code = owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(code, return_index=True)
    last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
    order = np.argsort(first)
    first, last = first[order], last[order]
    ends = np.cumsum(np.bincount(owner[first], minlength=many))
    fields = pa.MapArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), key.take(pa.array(first)), value.take(pa.array(last)))
    at = np.arange(many)
    heads, tails = (at == 0) & head, (at == many - 1) & tail
    same = [pa.repeat(pa.scalar(x, k), many) for x, k in zip(of, (pa.string(), pa.int32()), strict=True)]
    made = [*same, pa.array(place), pa.array(at + seq, pa.int32()), fields, pa.array(counts, pa.int32()), pa.array(heads), pa.array(tails)]
    return pa.RecordBatch.from_arrays(made, names=["_file", "_part", "_pos", "_seq", "fields", "_lines", "_head", "_tail"]).filter(pa.array((counts > 0) | tails))


def _pieces(in_parts: bool):
    """Records of the lines that a task holds. Of a part of a file, the first piece may belong to a record of the part
    before, and the last one may go on in the part after: they are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seq, head = None, [], 0, in_parts

        def closed(tail: bool) -> pa.RecordBatch:
            """What is held, whose last line is blank or ends the part."""
            lines = pa.concat_batches(held)
            held.clear()
            return _piece_rows(lines, at, seq, head, tail)

        for batch in batches:
            if not batch.num_rows:
                continue
            opens = np.r_[True, *(() if len(batch) < 2 else [(pc.or_(*(pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]) for i in (0, 1)))).to_numpy(zero_copy_only=False)])]
            bounds = np.r_[np.flatnonzero(opens), batch.num_rows]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                run_of = batch.slice(low, high - low)
                where = (run_of.column(0)[0].as_py(), run_of.column(1)[0].as_py())
                if where != at:
                    if held:
                        yield closed(in_parts)
                    at, seq, head = where, 0, in_parts
                blanks = np.flatnonzero(pc.equal(run_of.column(3), "").to_numpy(zero_copy_only=False))
                if len(blanks):
                    cut = int(blanks[-1]) + 1
                    held.append(run_of.slice(0, cut))
                    yield closed(False)
                    seq, head, run_of = seq + len(blanks), False, run_of.slice(cut)
                # a part that ends with a blank line still has an empty last piece: its last line is held
                held.append(run_of)
        if held:
            yield closed(in_parts)

    return run


def ldif(read: DataFrame) -> DataFrame:
    """Records between blank lines, of key: value lines; # lines are skipped; folded, base64 and URL values fail.

    Each task puts its own lines together; only the first and last piece of a part of a file meet those of other parts.
    """
    refuse = lambda what: raised(ParserError, F.lit(f"LDIF {what} values are unsupported")).cast("string")
    line = F.col("line")
    checked = F.when(line.startswith(" "), refuse("folded")).when(F.contains(line, F.lit("::")) & line.rlike("^[^#:][^:]*::|^::"), refuse("base64")).when(F.contains(line, F.lit(":<")) & line.rlike("^[^#:][^:]*:<|^:<"), refuse("URL")).otherwise(line)
    in_parts = "_part" in read.columns
    ship(read.sparkSession)
    rows = read.select("_file", F.col("_part") if in_parts else F.lit(0).alias("_part"), "_pos", checked.alias("line"))
    pieces = rows.mapInArrow(_pieces(in_parts), _PIECE)
    whole = pieces.filter("not _head and not _tail").select("_file", "_pos", "fields")
    if not in_parts:
        return whole
    order = Window.partitionBy("_file").orderBy("_part", "_seq")
    chained = pieces.filter("_head or _tail").withColumn("_record", F.sum(F.when(F.col("_head"), 0).otherwise(1)).over(order))
    found = F.array_sort(F.collect_list(F.struct("_part", "_seq", F.map_entries("fields").alias("entries"))))
    joined = chained.groupBy("_file", "_record").agg(F.min(F.when(F.col("_lines") > 0, F.col("_pos"))).alias("_pos"), F.sum("_lines").alias("_lines"), found.alias("_found")).filter("_lines > 0")
    return whole.union(_mapped(joined, F.flatten(F.transform("_found", lambda x: x["entries"]))))


def _elements(raw: DataFrame, tag: str, value: str) -> Column | None:
    """Entries of a row's <tag Name=..><value> elements; none if no row has any with a name."""
    if tag not in raw.columns:
        return None
    held = raw.schema[tag].dataType
    many = isinstance(held, T.ArrayType)
    element = held.elementType if many else held
    if not isinstance(element, T.StructType) or "_Name" not in element.names:
        return None
    items = F.col(tag) if many else F.array(tag)
    inside = element[value].dataType if value in element.names else None

    def text(x: Column) -> Column:
        if inside is None:
            return F.lit(None)
        if isinstance(inside, T.StructType):  # an element with attributes of its own
            return x[value]["_VALUE"] if "_VALUE" in inside.names else F.lit(None)
        return F.element_at(x[value], -1) if isinstance(inside, T.ArrayType) else x[value]

    named = F.filter(items, lambda x: x["_Name"].isNotNull())
    return F.transform(named, lambda x: F.struct(x["_Name"].cast("string").alias("key"), text(x).cast("string").alias("value")))


def xml_fields(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows of <Field Name=..><Value>, <Text Name=..><TextValue> and the row's attributes, as fields. Rows are read by
    Spark's XML source; malformed ones fail."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").option("mode", "FAILFAST").load(path)
    none = F.array().cast("array<struct<key:string,value:string>>")
    parts = [e for tag, value in (("Field", "Value"), ("Text", "TextValue")) if (e := _elements(raw, tag, value)) is not None]
    own = [c for c in raw.columns if c.startswith("_")]
    if own:
        parts.append(F.filter(F.array(*(F.struct(F.lit(c[1:]).alias("key"), F.col(c).cast("string").alias("value")) for c in own)), lambda e: e["value"].isNotNull()))
    found = F.concat(none, *(F.coalesce(p, none) for p in parts))
    rows = raw.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_pos"), found.alias("_found"))
    return _mapped(rows, F.col("_found"))


def kind_of_bytes(begin: bytes) -> str | None:
    """The compression that a file's first bytes tell of."""
    return "gzip" if begin[:2] == b"\x1f\x8b" else "zstd" if begin[:4] == b"\x28\xb5\x2f\xfd" else "lz4" if begin[:4] == b"\x04\x22\x4d\x18" else None


def inflated(content: bytes, most: int = MOST_BYTES) -> bytes:
    """gzip, zstd and lz4 frames by their first bytes, anything else as it is."""
    kind = kind_of_bytes(content)
    if kind is None:
        return content
    with gzip.GzipFile(fileobj=io.BytesIO(content)) if kind == "gzip" else pa.CompressedInputStream(pa.BufferReader(content), kind) as stream:
        out = stream.read(most + 1)
    if len(out) > most:
        raise ParseError(f"decompressed input is beyond {most} bytes")
    return bytes(out)


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """_file and text of whole files, inflated where they are compressed. Each file is one row, so for modest files."""
    ship(spark)

    def run(batches):
        for b in batches:
            texts = [inflated(c) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.binary())], names=["_file", "content"])

    made = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "_file string, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(raised(ParseError, F.lit("invalid UTF-8")).cast("string"))
    return made.select("_file", text.alias("text"))


PARSERS = {"properties": properties, "ini": ini, "ldif": ldif, "kv": key_values}
