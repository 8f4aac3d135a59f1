"""Functions, sources, build and store on small inputs."""

import gzip
import pickle
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelane import cli
from tidelane.functions import alignments as A
from tidelane.functions import intervals as I
from tidelane.functions import sequences as S
from tidelane.functions.fragment import Fragment, checked_strand, unparse
from tidelane.operators import overlap
from tidelane.operators.gc import reference_blocks, with_gc
from tidelane.operators.overlap import overlap_join, overlap_totals
from tidelane.operators.store import FragmentStore
from tidelane.plans.build import build_store
from tidelane.sources import binary, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def sam(path, rows, contigs=(("chr6", 170_805_979),)):
    head = [f"@SQ\tSN:{n}\tLN:{m}" for n, m in contigs]
    path.write_text("\n".join(head + ["\t".join(map(str, r)) for r in rows]) + "\n")
    return str(path)


def pair(name, pos, tlen, cigar="16M", extra=0, mapq=60, chrom="chr6", tags=("MQ:i:60", "MC:Z:16M")):
    mate = pos + tlen - 16
    return [(name, 99 + extra, chrom, pos, mapq, cigar, "=", mate, tlen, "A" * 16, "I" * 16, *tags), (name, 147 + extra, chrom, mate, mapq, cigar, "=", pos, -tlen, "A" * 16, "I" * 16, *tags)]


def bam(path, contigs, rows):
    """Minimal writer: (name, flag, ref, pos, mapq, [(n, op)], tlen, tags)."""
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in contigs)
    for name, flag, ref, pos, mapq, ops, tlen, tags in rows:
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, 0, -1, -1, tlen) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + tags
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(out))
    return str(path)


def block_gzip_bam(path, contigs, rows, block=400):
    """The same records in small blocks, with an index of one chunk a contig and windows of 2^14 bases."""
    plain = gzip.decompress(open(bam(path, contigs, rows), "rb").read())
    places, out = [], b""
    for at in [*range(0, len(plain), block), len(plain)]:
        data = plain[at : at + block]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(data) + squeeze.flush()
        places.append(len(out))
        out += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    path.write_bytes(out)
    head = 12 + sum(8 + len(n) + 1 for n, _ in contigs)
    at, starts = head, []
    while at < len(plain):
        starts.append(places[at // block] << 16 | at % block)
        at += 4 + struct.unpack_from("<i", plain, at)[0]
    index = b"BAI\x01" + struct.pack("<i", len(contigs))
    for number in range(len(contigs)):
        own = [(row[3], start) for row, start in zip(rows, starts, strict=True) if row[2] == number]
        windows = [0] * ((max(p for p, _ in own) >> 14) + 1) if own else []
        for position, start in reversed(own):
            windows[position >> 14] = start
        index += struct.pack("<i", bool(own)) + (struct.pack("<IiQQ", 4_681, 1, own[0][1], 0) if own else b"") + struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
    path.with_suffix(".bam.bai").write_bytes(index)
    return str(path)


def test_indexed_bam_is_read_by_several_tasks(spark, tmp_path):
    binary.register(spark)
    contigs = [("a", 2_000_000), ("none", 10), ("b", 900_000)]
    rows = [(f"r{k}", 0, 0, 400 * k, 60, [(30, "M")], 0, b"") for k in range(4_000)] + [(f"s{k}", 16, 2, 700 * k, 9, [(30, "M")], 0, b"") for k in range(1_000)] + [("u", 4, -1, -1, 0, [], 0, b"")]
    whole = spark.read.format("bam").load(bam(tmp_path / "w.bam", contigs, rows))
    path = block_gzip_bam(tmp_path / "x.bam", contigs, rows)
    parts = spark.read.format("bam").option("splitBytes", 4_000).load(path)
    assert parts.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    found, want = (df.orderBy("ord").drop("ord").collect() for df in (parts, whole))
    assert found == want and len(want) == 5_001
    for at, start, stop in (("a", 800_010, 801_000), ("b", 0, 1), ("b", 699_000, 900_000), ("none", 0, 10)):
        got = [r["qname"] for r in spark.read.format("bam").options(contig=at, start=start, stop=stop).load(path).orderBy("ord").collect()]
        assert got == [r["qname"] for r in want if r["rname"] == at and r["pos"] < stop and r["ref_end"] > start]
        assert sorted(got) == sorted(r["qname"] for r in spark.read.format("bam").options(contig=at, start=start, stop=stop).load(str(tmp_path / "w.bam")).collect())
    store = build_store(spark, path, str(tmp_path / "s"), single_end=True)
    assert store.n_fragments == 5_000 and [r["start"] for r in store.fetch("b", 0, 1_500)] == [0, 700, 1_400]


def test_fragment_values(spark, tmp_path):
    a = Fragment("chr1", 10, 21, mapq1=5, strand=b"-")
    assert a.strand == "-" and (a.length, a.tlen, a.midpoint, a.mapq12_min) == (11, 11, 15, 5)
    assert repr(a) == "Fragment(chrom='chr1',start=10,stop=21,mapq1=5,strand='-')"
    assert a == a.replace() and a != a.replace(gc=0.5) and a.replace(stop=30).length == 20 and a.stop == 21
    assert Fragment.field_names()[:3] == ["chrom", "start", "stop"] and len(Fragment.field_types()) == 10
    assert not a.mapq_gte(6) and Fragment("c", 0, 1).mapq_gte(90)
    for bad in ({"strand": "*"}, {"start": 1.5}):
        with pytest.raises(AssertionError):
            a.replace(**bad)
    store = build_store(spark, sam(tmp_path / "x.sam", pair("r1", 1_001, 116)), str(tmp_path / "s"))
    got = Fragment.from_row(next(store.fetch()))
    assert (got.chrom, got.start, got.stop, got.strand, got.fragment_end_clipped) == ("chr6", 1_000, 1_116, "+", False)
    with pytest.raises(PySparkException):
        one(spark, checked_strand(F.lit("x")))
    assert one(spark, unparse(F.lit(None).cast("int"))) == "" and one(spark, checked_strand(F.lit("+"))) == "+"


def test_provenance_and_pickling(spark, tmp_path):
    source = sam(tmp_path / "x.sam", pair("r1", 1_001, 116))
    argv = [source, str(tmp_path / "s"), "--contigs", "chr6"]
    store = build_store(spark, source, str(tmp_path / "s"), contigs=["chr6"], build_argv=argv)
    assert store.build_argv == argv and store.build_version and store.source_format == "BAM" and store.index_block_size == 5_000
    again = pickle.loads(pickle.dumps(store))
    assert again.build_argv == argv and again.fetch_counts("chr6") == 1 and [r["start"] for r in again.fetch()] == [1_000]
    assert build_store(spark, source, str(tmp_path / "t")).build_argv is None
    with pytest.raises(KeyError):
        build_store(spark, source, str(tmp_path / "u"), contigs=["chr7"])


def test_too_long_rows_count_in_the_skip_ratio(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("q\t1\t9\n" + "q\tx\t9\n" * 4 + "q\t1\t99999999\n" * 5)
    assert [r["start"] for r in text.read_intervals(spark, str(path)).collect()] == [1]
    path.write_text("q\t1\t9\n" + "q\tx\t9\n" * 4 + "q\t1\t99999999\n" * 2)
    with pytest.raises(ValueError, match="4 of 7"):
        text.read_intervals(spark, str(path))


def test_interval_lines_are_split_once(spark):
    cells = ["5", "-5", "+5", " 5 ", "5 ", "\u00a05", "5_0", "_5", "5_", "1__0", "1.5", "1.", "5L", "5d", "1e3", "", "x", "+", "-", "0x5", "\x015", "5\x01", "5\n", "9" * 18, "9" * 19, "+-5", "\u0665", "5\u2028"]
    made = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "ord long, c string").withColumn("value", F.when(F.col("ord") >= 0, F.concat(F.lit("q\t0\t"), "c")))
    rows = text.marked_intervals(made.select("ord", "value"), 3)
    want = F.when(F.col("c").rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(F.trim("c"), "[+_]", "").try_cast("long"))
    want = {r["ord"]: r["n"] is None or r["n"] <= 0 for r in made.select("ord", want.alias("n")).collect()}
    assert {r["ord"]: r["skipped"] for r in rows.collect()} == want
    other = spark.createDataFrame([(0, "#x"), (1, ""), (2, None), (3, "#\t1\t2"), (4, "\t1\t2"), (5, "q\t\t2")], "ord long, value string")
    assert sorted((r["ord"], r["contig"], r["skipped"]) for r in text.marked_intervals(other, 3).collect()) == [(4, "", False), (5, "q", True)]
    plan = text.parse_intervals(made.select("ord", "value"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("q\t0\t") == 1


def test_sam_lines_are_split_once(spark):
    head = "r\t0\tMC:Z:c\t7\t9\t{}\t=\t1\t3\tMQ:i:8\tYM:Z:no"
    tails = ["", "\tMQ:i:5", "\tXMQ:i:5", "\tMQ:1:6\tMQ:i:5\tMQ:i:4", "\tMQ:i:", "\tMC:Z:10M\tYM:Z:a:b", "\t\tCB:Z:x y\t", "\tMQ::5", "\tZZ:Z:MQ:i:5"]
    want = [(None, None, None, None), (5, None, None, None), (None, None, None, None), (5, None, None, None), (None, None, None, None), (None, "10M", None, "a:b"), (None, None, "x y", None), (None, None, None, None), (None, None, None, None)]
    lines = [(k, head.format("5M2D3S1N") + t) for k, t in enumerate(tails)] + [(50, "@SQ\tSN:a"), (51, ""), (52, None), (53, "@"), (54, head.format("*"))]
    made = spark.createDataFrame(lines, "ord long, value string").withColumn("value", F.concat("value", F.lit("")))
    rows = text.parse_sam(made)
    got = rows.where("flag = 0").orderBy("ord").collect()
    assert [(r["mq"], r["mc"], r["cb"], r["ym"]) for r in got] == [*want, want[0]] and [r["ref_end"] for r in got] == [14] * len(tails) + [6]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat(value") == 1


def test_gc_outside_its_range_is_an_error(spark):
    assert one(spark, I.checked_gc(F.lit(1.0))) == 1.0 and one(spark, I.checked_gc(F.lit(None).cast("double"))) is None
    with pytest.raises(PySparkException):
        one(spark, I.checked_gc(F.lit(1.01)))


def test_deep_bins_are_salted(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BIN_ROWS", 50)
    f = [("a", 100 + k % 7, 200 + k % 11, 100, k) for k in range(400)] + [("a", 9_000, 9_100, 100, 900)]
    frags = spark.createDataFrame(f, "contig string, start int, stop int, length int, ord int")
    regions = spark.createDataFrame([(1, "a", 0, 150), (2, "a", 0, 10_000), (3, "b", 0, 10)], "region_id int, contig string, region_start int, region_stop int")
    got = {r["region_id"]: r["n"] for r in overlap_join(frags, regions, max_broadcast=0).groupBy("region_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 400, 2: 401}


def test_command_line_refuses_an_existing_output_before_reading(spark, tmp_path):
    (tmp_path / "out").mkdir()
    assert cli.main([str(tmp_path / "missing.sam"), str(tmp_path / "out")]) == 1
    assert cli.parse(["a.sam", "o", "-q"]).level > cli.parse(["a.sam", "o", "-v"]).level
    with pytest.raises(SystemExit):
        cli.parse(["a.sam", "o", "-q", "--debug"])


def test_command_line_builds_a_store(spark, tmp_path):
    source = sam(tmp_path / "x.sam", pair("r1", 1_001, 116) + pair("r2", 5_001, 90, mapq=3))
    (tmp_path / "names").write_text("# in, out\nchr6\t6\n")
    out = str(tmp_path / "s")
    assert cli.main([source, out, "--min-mapq", "10", "--contig-name-map", str(tmp_path / "names"), "--log-filename", str(tmp_path / "log"), "--debug"]) == 0
    store = FragmentStore.open(spark, out)
    assert store.n_fragments == 1 and list(store.contig_lengths) == ["6"] and store.build_argv[0] == source
    assert cli.main([source, out]) == 1 and cli.main([source, str(tmp_path / "t"), "--contigs", "nope"]) == 1


def test_scalars(spark):
    ints = lambda a, b: (F.lit(a).cast("int"), F.lit(b).cast("int"))
    assert [one(spark, I.mapq_min(*ints(*x))) for x in ((30, 20), (30, None), (None, 20), (None, None))] == [20, 30, 20, None]
    assert one(spark, I.mapq_gte(*ints(None, None), 50)) is True
    assert one(spark, I.midpoint(F.lit(100), F.lit(201))) == 150
    assert one(spark, I.intersect(F.lit(0), F.lit(10), F.lit(10), F.lit(20))) is False
    assert one(spark, A.end_matches(F.lit("10S10M"), F.lit(True))) is True
    assert one(spark, A.end_matches(F.lit("10S10M"), F.lit(False))) is False
    assert one(spark, A.reference_span(F.lit("10M70000N10M"))) == 70020
    assert one(spark, S.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    with pytest.raises(PySparkException):
        one(spark, S.reverse_complement(F.lit("AaC")))
    assert one(spark, S.percent_gc(F.lit("GCNAT"))) == 0.5 and one(spark, S.percent_gc(F.lit("N"))) is None
    assert one(spark, S.gc_sixths(F.lit("ACgNs"))) == 6 + 6 + 3 + 6
    assert [list(x) for x in one(spark, S.one_hot_padded(F.lit("Cn"), 3))] == [[0, 1, 0, 0], [0.25] * 4, [0] * 4]
    with pytest.raises(PySparkException):
        one(spark, A.known_mapq(F.lit(255), False))


def test_gc_quantize_rounds_as_python(spark):
    shares = [k / n for n in range(1, 90) for k in range(n + 1)] + [0.061025, 0.5 / 254]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in shares], "g double").select(I.gc_quantize("g")).collect()]
    assert got == [round(round(g, 5) * 254) for g in shares]


def test_gc_by_blocks_equals_direct_count(spark):
    seq = "ACGTNSKBVHD" * 7
    pieces = [("c", a, b) for a in range(0, len(seq), 5) for b in range(a, len(seq) + 1, 7)]
    got = with_gc(spark.createDataFrame(pieces, "contig string, start int, stop int"), reference_blocks(spark.createDataFrame([("c", seq)], "contig string, sequence string"), 16), 16).collect()
    weight = {"C": 6, "G": 6, "S": 6, "N": 3, "K": 3, "B": 4, "V": 4, "H": 2, "D": 2}
    assert all(r["gc_sixths"] == sum(weight.get(x, 0) for x in seq[r["start"] : r["stop"]]) for r in got) and len(got) == len(pieces)


def test_overlap_join_equals_loop(spark):
    f = [("a", s, s + n, n) for s in range(0, 12_000, 700) for n in (1, 600, 6_000)]
    r = [(i, "a", s, e) for i, (s, e) in enumerate([(-5, 1), (0, 0), (700, 700), (4_999, 5_001), (0, 20_000), (5_000, 10_000)])]
    frags, regions = spark.createDataFrame(f, "contig string, start int, stop int, length int"), spark.createDataFrame(r, "region_id int, contig string, region_start int, region_stop int")
    want = sorted((i, s, e) for i, _, a, b in r for _, s, e, _ in f if s < b and e > a)
    for most in (0, 100):
        assert sorted((x["region_id"], x["start"], x["stop"]) for x in overlap_join(frags, regions, max_broadcast=most).collect()) == want


def test_overlap_totals_equal_loop(spark, monkeypatch):
    f = [(c, s, s + n, n) for c in "ab" for s in range(-900, 12_000, 450) for n in (0, 1, 2, 600, 6_001)] + [("a", 5_000, 4_000, -1_000), ("a", None, 10, 10), ("a", 10, None, 10), (None, 1, 9, 8), ("a", 0, 70_000, 70_000)]
    r = [(i % 12, c, s, e) for i, (c, s, e) in enumerate((c, *x) for c in "abc" for x in [(-5, 1), (0, 0), (450, 450), (700, 700), (4_999, 5_001), (0, 20_000), (5_000, 10_000), (4_500, 4_000), (5_000, 5_000), (-2_000, -899), (0, None)])] + [(None, "a", 0, 900), (99, None, 0, 900)]
    frags, regions = spark.createDataFrame(f, "contig string, start int, stop int, length int"), spark.createDataFrame(r, "region_id int, contig string, region_start int, region_stop int")
    for most, mid in ((50_000, False), (3, False), (3, True)):
        monkeypatch.setattr(overlap, "BIN_ROWS", most)
        want = {}
        for i, c, a, b in r:
            for d, s, e, n in f:
                if None not in (c, d, a, b, s, e) and c == d and n <= 65_535 and s < b and e > a and (not mid or 0 <= s - a + n // 2 < b - a):
                    want[i] = [sum(x) for x in zip(want.get(i, (0, 0)), (1, n), strict=True)]
        got = overlap_totals(frags, regions, midpoint=mid).collect()
        assert {x["region_id"]: [x["n"], x["bases"]] for x in got} == want and len(got) == len(want)


def test_overlap_totals_of_deep_bins_form_no_pairs(spark):
    """Ten billion pairs in one bin."""
    one = spark.range(100_000)
    frags, regions = one.selectExpr("'a' contig", "int(id % 90) start", "int(id % 90 + 50) stop", "50 length"), one.selectExpr("id region_id", "'a' contig", "int(id % 80) region_start", "int(id % 80 + 200) region_stop")
    got = overlap_totals(frags, regions).agg(F.count("*"), F.sum("n")).first()
    depth = [sum(len(range(s, 100_000, 90)) for s in range(90) if s + 50 > a) for a in range(80)]
    assert tuple(got) == (100_000, 1_250 * sum(depth))


def test_paired_store(spark, tmp_path):
    rows = pair("r1", 99_110_001, 116) + pair("r1", 99_110_001, 116, extra=1024) + [("s", 99 | 256, "chr6", 5, 60, "16M", "=", 100, 110, "A" * 16, "I" * 16)]
    source = sam(tmp_path / "x.sam", rows)
    store = build_store(spark, source, str(tmp_path / "one"), build_argv=["x"])
    assert store.n_fragments == 1 and store.build_argv == ["x"] and store.contig_lengths == {"chr6": 170_805_979}
    assert build_store(spark, source, str(tmp_path / "two"), include_duplicates=True).n_fragments == 2
    row = next(store.fetch())
    assert (row["start"], row["stop"], row["strand"], row["mapq1"], row["fragment_end_clipped"]) == (99_110_000, 99_110_116, "+", 60, False)
    assert store.fetch_counts("chr6", 99_110_100, 99_110_200) == 1 and store.fetch_counts("chr6", 99_110_116) == 0
    assert store.fetch_counts("chr6", 99_110_100, 99_110_200, filter_to_midpoint_frags=True) == 0
    assert store.fragment_length_counts().agg(F.sum("n"), F.count("*")).first() == (1, 65_536)
    with pytest.raises(KeyError):
        store.fetch_array("nope")
    with pytest.raises(ValueError):
        store.fetch_array("chr6", 170_805_979)
    with pytest.raises(ValueError):
        store.fetch_array("chr6", return_gc=True)
    with pytest.raises(PySparkException):
        build_store(spark, source, str(tmp_path / "one"))


def test_single_end_bam(spark, tmp_path):
    contigs = [("a", 200_000), ("b", 9_000), ("empty", 10)]
    rows = [(f"r{k}", 0, 0, 100 * k, 60, [(10, "M")], 0, b"") for k in range(5)] + [("s", 256, 0, 5_000, 60, [(10, "M")], 0, b""), ("b1", 16, 1, 5_000, 60, [(10, "M")], 0, b"CBZACG\0MQC\x07")]
    store = build_store(spark, bam(tmp_path / "x.bam", contigs, rows), str(tmp_path / "s"), single_end=True)
    assert store.n_fragments == 6 and [r["strand"] for r in store.fetch("b")] == ["-"] and list(store.fetch("empty")) == []
    long = bam(tmp_path / "long.bam", contigs, [("big", 0, 0, 1_000, 60, [(10, "M"), (70_000, "N"), (10, "M")], 0, b""), rows[0]])
    with pytest.raises(PySparkException, match="70020"):
        build_store(spark, long, str(tmp_path / "t"), single_end=True)
    assert build_store(spark, long, str(tmp_path / "u"), single_end=True, se_max_fragment_length=1_000).n_fragments == 1
    with pytest.raises(ValueError, match="No fragments"):
        build_store(spark, long, str(tmp_path / "v"), single_end=True, se_max_fragment_length=1)


def test_interval_text_with_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "x.tsv.gz", "wt") as f:
        f.write("#c\nq\t10\t20\tb\t0\t+\nq\t30\t50\t\t0\t-\nq\tx\t50\t\t0\t-\n")
    (tmp_path / "x.fa").write_text(">chr6 extra\n" + "ACGT" * 10 + "\n" + "GGGG" * 10 + "\n")
    store = build_store(spark, str(tmp_path / "x.tsv.gz"), str(tmp_path / "s"), str(tmp_path / "x.fa"), contig_name_map={"q": "chr6"})
    rows = store.fetch_array("chr6", return_gc=True, return_strand=True).collect()
    assert [(r["start"], r["strand"], round(r["gc"], 2)) for r in rows] == [(10, "+", 0.5), (30, "-", 0.75)]
    with pytest.raises(ValueError, match="missing"):
        build_store(spark, str(tmp_path / "x.tsv.gz"), str(tmp_path / "t"), str(tmp_path / "x.fa"))


def test_contig_map_and_command_line():
    assert text.read_contig_map(["#x", "", "1\tchr1\n"]) == {"1": "chr1"}
    for bad in (["1"], ["1\tx", "2\tx"]):
        with pytest.raises(ValueError):
            text.read_contig_map(bad)
    for argv in (["a.bam", "o", "--single-end"], ["a.bam", "o", "--min-mapq", "-1"], ["a.bam", "o", "--se-max-fragment-length", "9"], ["a.bam", "o", "--num-processes", "many"]):
        with pytest.raises(SystemExit) as e:
            cli.parse(argv)
        assert e.value.code == 2
    assert cli.parse(["a.tsv.gz", "o", "--single-end"]).single_end
