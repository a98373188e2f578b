"""Queries of scalar functions: signatures, parsers, lists, columns and documents as byte streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import parse
from lumenframe.functions import signature as sig
from lumenframe.plans.registry import query, table

#: Two signatures for every document: digests of its text and of its id.
SQL_SIG = """sigs AS (SELECT doc_id, sha256(text) AS a, sha256(CAST(doc_id AS VARCHAR)) AS b FROM documents)"""


def signatures(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2("text", 256).alias("a"), F.sha2(F.col("doc_id").cast("string"), 256).alias("b"))


@query("sig_parse", f"WITH {SQL_SIG} SELECT doc_id, {', '.join(f'CAST((\'0x\' || substr(a, {1 + 8 * i}, 8)) AS BIGINT) AS w{i}' for i in range(8))} FROM sigs")
def sig_parse(spark, d):
    w = signatures(spark, d).withColumn("w", sig.parse(F.col("a")))
    return w.select("doc_id", *[F.col("w")[i].alias(f"w{i}") for i in range(8)])


@query(
    "sig_format",
    f"""WITH {SQL_SIG} SELECT doc_id, a AS hex, string_agg(lpad(bin(CAST(('0x' || substr(a, CAST(k * 8 + 1 AS BIGINT), 8)) AS BIGINT)), 32, '0'), '' ORDER BY k) AS bits
FROM sigs, range(8) t(k) GROUP BY doc_id, a""",
)
def sig_format(spark, d):
    w = signatures(spark, d).withColumn("w", sig.parse(F.col("a"))).withColumn("bits", sig.to_binary(F.col("w")))
    return w.select("doc_id", sig.to_hex(sig.parse(F.col("bits"))).alias("hex"), "bits")


def _word(x: str, i: int) -> str:
    return f"CAST(('0x' || substr({x}, {1 + 8 * i}, 8)) AS BIGINT)"


@query("sig_popcount", f"WITH {SQL_SIG} SELECT doc_id, CAST({' + '.join(f'bit_count({_word("a", i)})::INTEGER' for i in range(8))} AS INTEGER) AS n FROM sigs")
def sig_popcount(spark, d):
    return signatures(spark, d).select("doc_id", sig.bits_set(sig.parse(F.col("a"))).alias("n"))


@query("sig_xor", f"WITH {SQL_SIG} SELECT doc_id, {' || '.join(f'lpad(lower(to_hex(xor({_word("a", i)}, {_word("b", i)}))), 8, chr(48))' for i in range(8))} AS x FROM sigs")
def sig_xor(spark, d):
    return signatures(spark, d).select("doc_id", sig.to_hex(sig.xor(sig.parse(F.col("a")), sig.parse(F.col("b")))).alias("x"))


@query("hamming", f"WITH {SQL_SIG} SELECT doc_id, CAST({' + '.join(f'bit_count(xor({_word("a", i)}, {_word("b", i)}))::INTEGER' for i in range(8))} AS INTEGER) AS bits FROM sigs")
def hamming(spark, d):
    return signatures(spark, d).select("doc_id", sig.distance(sig.parse(F.col("a")), sig.parse(F.col("b"))).alias("bits"))


@query("sig_text", f"WITH {SQL_SIG} SELECT printf('%14d %s', doc_id, a) AS line FROM sigs")
def sig_text(spark, d):
    return signatures(spark, d).select(F.format_string("%14d %s", "doc_id", "a").alias("line"))


#: A stream header for every part.
HEADER = "'W' || p_size * 16 || ' H' || p_size * 8 || ' F25:' || (1 + p_partkey % 3) || ' Ip A1:1 C420' || CASE WHEN p_partkey % 2 = 0 THEN ' C444' ELSE '' END"


def headers(spark, d):
    odd = F.when(F.col("p_partkey") % 2 == 0, " C444").otherwise("")
    text = F.concat(F.lit("W"), F.col("p_size") * 16, F.lit(" H"), F.col("p_size") * 8, F.lit(" F25:"), 1 + F.col("p_partkey") % 3, F.lit(" Ip A1:1 C420"), odd)
    return table(spark, d, "part").select("p_partkey", "p_size", parse.params(text).alias("m"))


COLOUR = "CASE WHEN p_partkey % 2 = 0 THEN '444' ELSE '420' END"


@query("parms_parse", f"SELECT p_partkey, CAST(p_size * 16 AS VARCHAR) AS w, CAST(p_size * 8 AS VARCHAR) AS h, '25:' || (1 + p_partkey % 3) AS f, {COLOUR} AS c FROM part")
def parms_parse(spark, d):
    return headers(spark, d).select("p_partkey", *[F.col("m")[k].alias(k.lower()) for k in "WHFC"])


@query("parms_format", f"SELECT p_partkey, 'A1:1 C' || {COLOUR} || ' F25:' || (1 + p_partkey % 3) || ' H' || p_size * 8 || ' Ip W' || p_size * 16 AS line FROM part")
def parms_format(spark, d):
    return headers(spark, d).select("p_partkey", parse.format_params(F.col("m")).alias("line"))


@query("parms_merge", f"SELECT p_partkey, 'A16:9 C' || {COLOUR} || ' F25:' || (1 + p_partkey % 3) || ' H' || p_size * 8 || ' Ip W' || p_size AS line FROM part")
def parms_merge(spark, d):
    """A frame's own header over the stream's."""
    own = F.create_map(F.lit("W"), F.col("p_size").cast("string"), F.lit("A"), F.lit("16:9"))
    return headers(spark, d).select("p_partkey", parse.format_params(parse.merged(F.col("m"), own)).alias("line"))


@query("notes_map", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand=' || p_brand || ';size=' || p_size ELSE 'brand=' || p_type || ';size=' || p_size END AS notes FROM part")
def notes_map(spark, d):
    """Notes set, overwritten for odd sizes, and one deleted again."""
    notes = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("gone"), F.lit("x"))
    over = F.when(F.col("p_size") % 2 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.create_map(F.lit("brand"), F.col("p_type")))
    left = F.map_filter(parse.merged(notes, over), lambda k, v: k != "gone")
    text = F.array_join(F.transform(F.array_sort(F.map_entries(left)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, d, "part").select("p_partkey", text.alias("notes"))


@query("elapsed_time", "SELECT p_partkey, round((1 + p_partkey % 3) / 25.0::DOUBLE, 6) AS frame, round(p_size * (1 + p_partkey % 3) / 25.0::DOUBLE, 6) AS elapsed FROM part")
def elapsed_time(spark, d):
    s = parse.frame_seconds(F.col("m")["F"])
    return headers(spark, d).select("p_partkey", F.round(s, 6).alias("frame"), F.round(s * F.col("p_size"), 6).alias("elapsed"))


@query("timecode", "SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM (SELECT event_id, CAST(floor(round(event_id * value * 1000 / 50, 6)) AS BIGINT) AS ms FROM events)")
def timecode(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * F.col("value") * 1000 / 50).alias("t"))
    return e.select("event_id", parse.clock(F.col("t")).alias("code"))


@query("aspect_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey // g AS x, l_suppkey // g AS y FROM (SELECT *, gcd(l_partkey, l_suppkey) AS g FROM lineitem) WHERE g > 0")
def aspect_ratio(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse.gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g")).where("g > 0")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.floor(F.col(c) / F.col("g")).cast("long").alias(k) for c, k in (("l_partkey", "x"), ("l_suppkey", "y"))])


@query("parse_size", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size END AS w, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size * 2 END AS h FROM part")
def parse_size(spark, d):
    mark = F.element_at(F.array(F.lit("x"), F.lit(":"), F.lit(" by ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    w, h = parse.size(F.concat("p_size", mark, F.col("p_size") * 2))
    return table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("parse_double", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_retailprice END AS v FROM part")
def parse_double(spark, d):
    text = F.concat(F.format_string("%.2f", "p_retailprice"), F.when(F.col("p_partkey") % 4 == 3, "abc").otherwise(""))
    return table(spark, d, "part").select("p_partkey", parse.strict_double(text).alias("v"))


@query("graph_spec", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'delta.Y' ELSE 'frameinfo.Y' END AS note, 'rms' AS field, CASE p_partkey % 3 WHEN 0 THEN '#f00' ELSE '#' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS colour FROM part")
def graph_spec(spark, d):
    """[note:]field[:colour]; of two parts the first is the field."""
    colour = F.concat(F.lit("#"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    spec = F.when(F.col("p_partkey") % 3 == 0, "rms").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("rms:"), colour)).otherwise(F.concat(F.lit("delta.Y:rms:"), colour))
    t = table(spark, d, "part").select("p_partkey", F.split(spec, ":").alias("s"))
    s, n = F.col("s"), F.size("s")
    return t.select("p_partkey", F.when(n == 3, s[0]).otherwise("frameinfo.Y").alias("note"), F.when(n == 3, F.get(s, 1)).otherwise(s[0]).alias("field"), F.when(n == 1, "#f00").otherwise(F.element_at(s, -1)).alias("colour"))


def specs(spark, d):
    text = F.concat(F.lit("spiral:a_rate="), "p_size", F.lit(",name='"), "p_brand", F.lit("',mode=fast"))
    return table(spark, d, "part").withColumn("text", text)


@query("sampler_spec_parse", "SELECT p_partkey, 'spiral' AS name, CAST(p_size AS VARCHAR) AS a_rate, p_brand AS brand, 'fast' AS mode, 3 AS n FROM part")
def sampler_spec_parse(spark, d):
    name, m = parse.sampler_spec(F.col("text"))
    return specs(spark, d).withColumn("m", m).select("p_partkey", name.alias("name"), F.col("m")["a_rate"].alias("a_rate"), F.col("m")["name"].alias("brand"), F.col("m")["mode"].alias("mode"), F.size("m").alias("n"))


DEFAULTS = {"a_rate": "1", "r_rate": "1", "area_limit": "3"}


@query("sampler_spec_merge", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a_rate, '1' AS r_rate, '3' AS area_limit, 5 AS n FROM part")
def sampler_spec_merge(spark, d):
    """Defaults under what the spec gives."""
    under = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    m = parse.merged(under, parse.sampler_spec(F.col("text"))[1])
    return specs(spark, d).withColumn("m", m).select("p_partkey", *[F.col("m")[k].alias(k) for k in DEFAULTS], F.size("m").alias("n"))


@query("sampler_spec_format", "SELECT p_partkey, 'spiral:a_rate=' || p_size || ',mode=''fast'',name=''' || p_brand || '''' AS spec FROM part")
def sampler_spec_format(spark, d):
    name, m = parse.sampler_spec(F.col("text"))
    return specs(spark, d).select("p_partkey", parse.format_spec(name, m).alias("spec"))


@query("filename_decode", "SELECT p_partkey, 'clip' || p_partkey || '.mpeg' AS mpeg, 's' || p_size || '.a_rate=2.profile' AS profile, 'clip' || p_partkey || '.mpeg.s' || p_size || '.a_rate=2.m4v' AS m4v FROM part")
def filename_decode(spark, d):
    name = F.concat(F.lit("clip"), "p_partkey", F.lit(".mpeg."), "p_size", F.lit(".a_rate=2.dat"))
    t = table(spark, d, "part").select("p_partkey", name.alias("name"))
    mpeg, rest = (F.regexp_extract("name", r"^(.+\.mpeg)\.(.+)$", i) for i in (1, 2))
    end = lambda x: F.concat(F.lit("s"), F.regexp_replace(rest, r"\.dat$", x))
    return t.select("p_partkey", mpeg.alias("mpeg"), end(".profile").alias("profile"), F.concat(mpeg, F.lit("."), end(".m4v")).alias("m4v"))


@query("numfile_scan", "SELECT p_partkey, CAST(k AS INTEGER) AS i, round(p_size * (k + 1) / 4.0::DOUBLE, 6) AS v FROM part, range(3) t(k)")
def numfile_scan(spark, d):
    """Numbers of a text, whatever white space is between them."""
    text = F.concat_ws(" \n\t", *[F.format_string("%.6f", F.col("p_size") * (k + 1) / 4) for k in range(3)])
    t = table(spark, d, "part").select("p_partkey", F.posexplode(F.split(F.trim(text), r"\s+")).alias("i", "s"))
    return t.select("p_partkey", "i", F.round(F.col("s").cast("double"), 6).alias("v"))


@query("kernel_parse", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS INTEGER) AS kernels, 2 AS size, CASE WHEN p_partkey % 2 = 0 THEN p_size * 4.0::DOUBLE + 6 ELSE p_size + 1.0::DOUBLE END AS total FROM part")
def kernel_parse(spark, d):
    """One list of numbers, or three in brackets of one length; anything else is null."""
    one = F.concat_ws(" ", F.col("p_size"), F.lit("1"))
    three = F.concat(*[F.concat(F.lit("["), F.col("p_size") * a, F.lit(" "), F.lit(b), F.lit("] ")) for a, b in ((1, 1), (2, 2), (1, 3))])
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, three).otherwise(one).alias("text"))
    lists = F.when(F.contains("text", F.lit("[")), F.regexp_extract_all("text", F.lit(r"\[([^\]]*)\]"), F.lit(1))).otherwise(F.array("text"))
    t = t.withColumn("k", F.transform(lists, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("double"))))
    sizes = F.array_distinct(F.transform("k", lambda x: F.size(x)))
    t = t.withColumn("k", F.when((F.size(sizes) == 1) & F.size("k").isin(1, 3), F.col("k")))
    return t.select("p_partkey", F.size("k").alias("kernels"), F.size(F.col("k")[0]).alias("size"), F.aggregate(F.flatten("k"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("byte_histogram", "WITH h AS (SELECT upper(hex(encode(text))) AS x FROM documents), b AS (SELECT CAST(('0x' || substr(x, 2 * k + 1, 2)) AS INTEGER) AS byte FROM (SELECT x, unnest(range(length(x) // 2)) AS k FROM h)), n AS (SELECT byte, count(*) AS n FROM b GROUP BY byte) SELECT CAST(k AS INTEGER) AS byte, coalesce(n, 0) AS n FROM range(256) t(k) LEFT JOIN n ON n.byte = k")
def byte_histogram(spark, d):
    """Bytes of all texts in 256 bins. A text counts its own bytes first, so a row a byte is never made."""
    t = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("b"))
    counts = t.mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    every = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    return every.join(counts, "byte", "left").select("byte", F.coalesce("n", F.lit(0)).alias("n"))


def _byte_counts(batches):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(256, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            if x:
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])


@query("split_chunks", "SELECT p_partkey, CAST(k AS INTEGER) AS i, substr(p_type || ' ' || p_name, CAST(k * 7 + 1 AS BIGINT), 7) AS piece FROM (SELECT *, unnest(range((length(p_type || ' ' || p_name) + 6) // 7)) AS k FROM part)")
def split_chunks(spark, d):
    text = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", F.posexplode(parse.chunks(text, 7)).alias("i", "piece"))


@query("scale_box", "SELECT p_partkey, round(p_size - 0.25 * p_size * 2 * (0.9 - 1), 6) AS x, round(p_size * 3 - 0.75 * p_size * (0.9 - 1), 6) AS y, round(p_size * 2 * 0.9, 6) AS w, round(p_size * 0.9, 6) AS h FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part)")
def scale_box(spark, d):
    """A box made smaller about a point within it: its left and top move by the share of what is lost."""
    s, z = F.col("p_size").cast("double"), 0.9
    x, y, w, h = s, s * 3, s * 2, s
    return table(spark, d, "part").select("p_partkey", *[F.round(v, 6).alias(k) for k, v in (("x", x - 0.25 * w * (z - 1)), ("y", y - 0.75 * h * (z - 1)), ("w", w * z), ("h", h * z))])


SQL_LISTS = "lists AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS a, list(l_suppkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS b FROM lineitem GROUP BY l_orderkey)"


def lists(spark, d):
    """Lists of the parts and suppliers of an order's lines."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("x"))
    return t.select("l_orderkey", F.col("x.l_partkey").alias("a"), F.col("x.l_suppkey").alias("b"))


def _text(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _q(name: str, sql: str, **cols):
    @query(name, f"WITH {SQL_LISTS} SELECT l_orderkey, {sql} FROM lists")
    def run(spark, d):
        return lists(spark, d).select("l_orderkey", *[c().alias(k) for k, c in cols.items()])


_q("list_append_join", "array_to_string(list_append(list_concat(a, b), 7), ',') AS joined, CAST(len(a) + len(b) + 1 AS INTEGER) AS n", joined=lambda: _text(F.array_append(F.concat("a", "b"), F.lit(7))), n=lambda: F.size("a") + F.size("b") + 1)
_q("list_slice", "array_to_string(a[2:3], ',') AS part, a[1] AS first, a[-1] AS last", part=lambda: _text(F.slice("a", 2, 2)), first=lambda: F.col("a")[0], last=lambda: F.element_at("a", -1))
_q("list_reverse", "array_to_string(list_reverse(b), ',') AS back", back=lambda: _text(F.reverse("b")))
_q("list_sort_search", "array_to_string(list_sort(b), ',') AS sorted, coalesce(list_position(list_sort(b), list_max(b)), 0)::BIGINT AS place", sorted=lambda: _text(F.sort_array("b")), place=lambda: F.array_position(F.sort_array("b"), F.array_max("b")))
_q("list_split", "array_to_string(a[1:2], ',') AS head, array_to_string(a[3:], ',') AS rest", head=lambda: _text(F.slice("a", 1, 2)), rest=lambda: _text(F.slice("a", 3, 1 << 30)))


@query("zip_broadcast", f"WITH {SQL_LISTS} SELECT l_orderkey, array_to_string(list_transform(list_zip(a, b), lambda z: z[1] - z[2] * 2), ',') AS d FROM lists")
def zip_broadcast(spark, d):
    """Element-wise operation on two lists of one shape, with a scalar for all elements."""
    return lists(spark, d).select("l_orderkey", _text(F.zip_with("a", "b", lambda x, y: x - y * 2)).alias("d"))


@query("csv_columns", "SELECT count(*) + 1 AS rows, 3 AS cols, round(sum(p_size), 4) AS a, round(sum(p_retailprice), 4) AS b, round(max(p_partkey), 4) AS c FROM (SELECT p_size::DOUBLE AS p_size, p_retailprice, p_partkey::DOUBLE AS p_partkey FROM part)")
def csv_columns(spark, d):
    """Lines of comma-separated numbers as columns; the header counts as a row."""
    line = F.concat_ws(",", "p_size", F.format_string("%.4f", "p_retailprice"), "p_partkey")
    t = table(spark, d, "part").select(F.from_csv(line, F.lit("a double, b double, c double")).alias("r")).select("r.*")
    return t.agg((F.count("*") + 1).alias("rows"), F.lit(3).alias("cols"), F.round(F.sum("a"), 4).alias("a"), F.round(F.sum("b"), 4).alias("b"), F.round(F.max("c"), 4).alias("c"))


@query("csv2json", "SELECT o_custkey, '{\"orderkey\":[' || string_agg(o_orderkey, ',' ORDER BY o_orderkey) || '],\"year\":[' || string_agg(year(o_orderdate), ',' ORDER BY o_orderkey) || ']}' AS json FROM orders GROUP BY o_custkey")
def csv2json(spark, d):
    """Rows as one object of columns for each customer."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("y")))).alias("x"))
    return t.select("o_custkey", F.to_json(F.struct(F.col("x.o_orderkey").alias("orderkey"), F.col("x.y").alias("year"))).alias("json"))


@query("jsonl_renumber", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, event_id - min(event_id) OVER (PARTITION BY user_id) AS frame FROM events")
def jsonl_renumber(spark, d):
    """Frame numbers of JSON lines counted from the first of their user."""
    line = F.to_json(F.struct(F.col("event_id").alias("frame"), F.array(F.array("value")).alias("planes")))
    t = table(spark, d, "events").select("user_id", F.from_json(line, "frame long, planes array<array<double>>").alias("j"))
    w = Window.partitionBy("user_id")
    return t.select("user_id", F.col("j.frame").alias("event_id"), F.row_number().over(w.orderBy("j.frame")).cast("long").alias("nth"), (F.col("j.frame") - F.min("j.frame").over(w)).alias("frame"))


@query("raw_jsonl", "SELECT event_id, '{\"frame\":' || event_id || ',\"planes\":[[' || CAST(floor(value) AS BIGINT) || ',' || user_id || ']]}' AS line FROM events")
def raw_jsonl(spark, d):
    line = F.to_json(F.struct(F.col("event_id").alias("frame"), F.array(F.array(F.floor("value").cast("long"), "user_id")).alias("planes")))
    return table(spark, d, "events").select("event_id", line.alias("line"))
