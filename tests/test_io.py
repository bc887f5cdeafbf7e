from pyspark.sql import functions as F

from linkwright.operators import generate as g
from linkwright.sources import readers, writers
from linkwright.spec import LAYOUTS, LinkageSpec


def put(path, text):
    path.write_text(text)
    return str(path)


def test_delimited_and_cleaning(spark, tmp_path):
    p = put(tmp_path / "a.csv", "0001,O'Neil 2,03181996,03181895\n0002,Ann,\n")
    df = readers.delimited(spark, p, LAYOUTS["full_name"])
    assert [tuple(r) for r in df.orderBy("ssn").collect()] == [("0001", "O'Neil 2", "03181996", "03181895"), ("0002", "Ann", "", "")]
    assert readers.cleaned(df).orderBy("ssn").first().name == "oneil 2"
    assert readers.name_cleaned(df, "name").orderBy("ssn").first().name == "oneil "
    assert readers.block_first(df, "dod").columns == ["ssn", "dod", "name", "dob"]


def test_cluster_files(spark, tmp_path):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster long, member string")
    writers.write_clusters(c, str(tmp_path / "out"))
    back = readers.clusters_by_line(spark, str(tmp_path / "out"))
    sets = back.groupBy("cluster").agg(F.sort_array(F.collect_list("member")).alias("m")).collect()
    assert sorted(r.m for r in sets) == [["a", "b"], ["c"]]
    writers.write_cluster_text(c, str(tmp_path / "text"), ["member", "cluster"])
    back = readers.clusters_by_headers(spark, str(tmp_path / "text"))
    assert sorted(tuple(r.fields) for r in back.collect()) == [("a", "1"), ("b", "1"), ("c", "2")]
    writers.write_clusters_with(c.withColumn("tag", F.lit("t")), str(tmp_path / "with"), "member", "tag")
    assert "c:t," in [r.value for r in spark.read.text(str(tmp_path / "with")).collect()]
    writers.write_statistics(c.agg(F.count("*").alias("rows")), str(tmp_path / "stat"))
    assert spark.read.text(str(tmp_path / "stat")).first().value == "rows: 3"
    for _ in range(2):
        writers.append_log(c.agg(F.count("*").alias("rows")), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    records = spark.createDataFrame([(1, "x"), (2, "y")], "rec_idx long, entity_id string")
    writers.write_components(spark.createDataFrame([(1, 1), (2, 1)], "rec long, component long"), records, str(tmp_path / "both"), "entity_id")
    assert spark.read.text(str(tmp_path / "both/by_id")).first().value == "x,y,"
    writers.write_table(records, str(tmp_path / "table"))
    assert spark.read.csv(str(tmp_path / "table")).count() == 2


def test_other_readers(spark, tmp_path):
    p = put(tmp_path / "w.txt", "one two   three\nshort\nalpha beta gamma delta\n")
    rows = readers.whitespace(spark, p, ["a", "b", "c", "d"]).collect()
    assert sorted(tuple(r) for r in rows) == [("alpha", "beta", "gamma", "delta"), ("one", "two", "three", "")]
    assert readers.whitespace(spark, p, ["a"], row_cap=1).count() == 1
    p = put(tmp_path / "g.fa", ">head\nACGTACGTAC\nGT\n")
    assert sorted(tuple(r) for r in readers.genome_windows(spark, p, 5).collect()) == [(0, "acgta"), (1, "cgtac")]
    p = put(tmp_path / "g.gb", "     gene            190..255\n     CDS  1..2\n     gene            complement(5683..6459)\n")
    assert sorted(tuple(r) for r in readers.gene_locations(spark, p).collect()) == [(190, 255, False), (5683, 6459, True)]
    p = put(tmp_path / "s.txt", "abc\nabcdef\n")
    assert tuple(readers.string_stats(readers.strings(spark, p)).first()) == (2, 3, 6, 4.5)


def test_configuration(spark, tmp_path):
    a, b = put(tmp_path / "a.tsv", "Ann\tLee\tX\n"), put(tmp_path / "b.tsv", "K\tLee An\n")
    xml = f"""<linkage><dataset><file>{a}</file><map>0 1</map></dataset><dataset><file>{b}</file><map>-1,1</map></dataset><threshold>2</threshold>
      <comparison><method>0</method><attributes>0</attributes><weight>2</weight></comparison><comparison><method>2</method><attributes>1</attributes><truncate>3</truncate></comparison>
      <block><field>1</field><kind>alpha</kind><length>3</length></block><priority>1 0</priority></linkage>"""
    spec = LinkageSpec.from_xml(xml)
    assert (spec.threshold, spec.priority, spec.block_fields, spec.comparisons[1].truncate) == (2.0, [1, 0], [(1, "alpha", 3)], 3)
    rows = readers.mapped(spark, spec, ["first", "last"]).select("first", "last", "source").collect()
    assert sorted(tuple(r) for r in rows) == [("", "leean", 1), ("ann", "lee", 0)]
    from linkwright.plans.linkage import configured_edges

    df = readers.mapped(spark, spec, ["first", "last"]).withColumn("rec_idx", F.col("source").cast("long"))
    assert [tuple(r) for r in configured_edges(df, spec, ["first", "last"]).collect()] == [(0, 1)]


def test_fixed_configuration_formats():
    import pytest

    value = lambda tag, x: f"<{tag}><value>{x}</value></{tag}>"
    febrl = f"<febrl-config><dataset><value>a.txt</value></dataset><dataset><value>b.txt</value></dataset><version-config-param>{value('threshold', 2)}{value('last_name_index', 1)}<comparison>{value('dist_calc_method', 1)}{value('comparing_attribute_indices', 3)}</comparison></version-config-param></febrl-config>"
    spec = LinkageSpec.from_xml(febrl)
    assert (spec.files, spec.threshold, spec.block_fields) == (["a.txt", "b.txt"], 2.0, [(1, "alpha", 3)])
    assert [(c.method, c.attributes) for c in spec.comparisons] == [(0, [3])]
    block = f"<block>{value('index', '1,2')}{value('length', '3,4')}{value('type', '0,1')}</block>"
    comparisons = "".join(f"<comparison>{value('dist_calc_method', m)}{value('comparing_attribute_indices', a)}{value('truncate_count', 4) if m == 3 else ''}</comparison>" for m, a in ((2, "0, 1"), (3, "2"), (7, "1")))
    rla = f"<rla-config><dataset><value>x</value>{value('dataset_index', '0 1 -1')}</dataset>{value('weights', '2 1 3')}<version-config-param>{block}{comparisons}{value('threshold', 0.8)}{value('priority', '1,0')}<output_function>{value('output_filename', 'o')}</output_function><results_logging>{value('filename', 'log.csv')}</results_logging></version-config-param></rla-config>"
    spec = LinkageSpec.from_xml(rla)
    assert (spec.attribute_maps, spec.block_fields, spec.priority, spec.output, spec.log, spec.threshold) == ([[0, 1, -1]], [(1, "alpha", 3), (2, "digit", 4)], [1, 0], "o", "log.csv", 0.8)
    assert [(c.method, c.attributes, c.weight, c.truncate) for c in spec.comparisons] == [(1, [0, 1], 2.0, None), (2, [2], 1.0, 4), (7, [1], 3.0, None)]
    with pytest.raises(ValueError, match="root"):
        LinkageSpec.from_xml("<other/>")


def test_lines_of_several_files_stay_in_order(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        want = []
        for f in "ab":
            out = ""
            for c in range(1, 20):
                out += f"Cluster {c}:\n" + "".join(f"{f}{c}\t{i}\n" for i in range(c))
                want += [(f, c, f"{f}{c}", str(i)) for i in range(c)]
            put(tmp_path / f"{f}.txt", out)
        paths = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]
        got = readers.clusters_by_headers(spark, paths).collect()
        lines = readers.number_lines(spark, paths).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.file[-5], r.cluster, *r.fields) for r in got) == sorted(want)
    assert [r.value for r in lines] == (tmp_path / "a.txt").read_text().split("\n")[:-1] + (tmp_path / "b.txt").read_text().split("\n")[:-1]
    p = put(tmp_path / "p.csv", "cluster_id,unique_id\nc1,1\nc1,2\nc2,\n")
    assert sorted((r.cluster, *r.fields) for r in readers.clusters_by_id(spark, p).collect()) == [("c1", "1"), ("c1", "2"), ("c2", "")]


def test_contained_sets(spark):
    from linkwright.operators import pairs
    from linkwright.operators.graph import connected_components

    a = spark.createDataFrame([(1, "x", "1"), (2, "y", "2")], "rec_idx long, name string, dob string")
    b = spark.createDataFrame([(11, "x"), (12, "z")], "rec_idx long, name string")
    c = spark.createDataFrame([(21, "x", "1", "m"), (22, "y", "9", "m")], "rec_idx long, name string, dob string, sex string")
    e = pairs.appended([(a, ["name", "dob"]), (b, ["name"]), (c, ["name", "dob", "sex"])])
    assert sorted(tuple(r) for r in e.collect()) == [(1, 11), (1, 21), (11, 21)]
    assert {r.node: r.component for r in connected_components(e, "l", "r").collect()} == {1: 1, 11: 1, 21: 1}
    assert pairs.contained(a, b, ["name", "dob"], ["name", "sex"]).count() == 0


def test_complete_driver(spark):
    from linkwright.operators import predicates as pr
    from linkwright.plans import linkage

    rows = [(1, 0, "ann"), (2, 0, "ann"), (3, 1, "bob"), (4, 2, "bob"), (5, 3, "boc"), (6, 1, "boc"), (7, 2, "cat"), (8, 0, "cat"), (9, 1, "cat"), (10, 3, "cat"), (11, 0, "bo")]
    r = spark.createDataFrame(rows, "rec_idx long, source int, last string")
    nodes = r.select(F.col("rec_idx").alias("node"), F.lit(1).cast("long").alias("component"))
    spec = LinkageSpec(compare=["last"], source="source")
    got = linkage.complete_clusters(r, nodes, spec, 4, pr.sum_within(["last"], 1), pr.total_distance(["last"]))
    # two of one source and one name stay alone; four of four sources are final; bob and boc share source 1, so bo joins the first of them
    assert {x.rec: x.cluster for x in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 7, 11: 3}


def test_generators(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["joyan", "", "a", "bc", "Zoë"] * 40)], "id long, name string").withColumn("name", F.concat("name", F.when(F.col("id") > 4, F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6)).otherwise("")))
    edited = {r.id: r for r in g.with_edits(words.withColumn("old", F.col("name")), "name", 1, 1).withColumn("d", F.levenshtein("name", "old")).collect()}
    assert {r.d for r in edited.values()} == {1} and {len(r.name) - len(r.old) for r in edited.values()} == {-1, 0, 1}
    assert {r.d for r in g.with_edits(words.withColumn("old", F.col("name")), "name", 3, 1).withColumn("d", F.levenshtein("name", "old")).collect()} <= {0, 1, 2, 3}
    dates = spark.createDataFrame([("03181996",), ("1",), ("",), (None,)], "dob string")
    assert [sum(x != y for x, y in zip(r.new, r.dob or "", strict=True)) for r in g.with_digit_edits(dates.withColumn("new", F.col("dob")), "new", 2, 5).select("dob", "new").collect()] == [2, 1, 0, 0]
    mixed = g.with_digits(words.withColumn("old", F.col("name")), "name").collect()
    assert all("".join(c for c in r.name if not c.isdigit()) == "".join(c for c in r.old if not c.isdigit()) for r in mixed) and sum(len(r.name) > len(r.old) for r in mixed) > 100
    base = spark.createDataFrame([("0001", "joyan", "03181996")], "ssn string, name string, dob string")
    assert sorted(r.tag for r in g.k_distant(base, "name", ["dob"]).collect()) == ["0", "01", "011", "02", "1", "2", "21", "211", "22"]
    assert sorted(r.tag for r in g.chain(base, "name").collect()) == ["0", "01", "2"]
    s = g.random_strings(spark, 50, 20, 3).collect()
    assert all(len(r.value) == 20 and set(r.value) <= set("abc") for r in s) and len({r.value for r in s}) == 50
    assert g.in_parts(spark.range(100), 3, "id").select("part").distinct().count() == 3


def test_streams(spark, tmp_path):
    from linkwright.functions import metrics
    from linkwright.streaming import incremental

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"rec_idx": 1, "last": "watson", "at": "2024-01-01T00:00:00Z"}\n{"rec_idx": 2, "last": "watsen", "at": "2024-01-01T00:01:00Z"}\n{"rec_idx": 1, "last": "watson", "at": "2024-01-01T00:02:00Z"}\n')
    stream = spark.readStream.schema("rec_idx long, last string, at timestamp").json(str(src))
    q = incremental.first_seen(stream, ["rec_idx"], "at").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
    found = []
    rule = metrics.edit_within("l_last", "r_last", 1) >= 0
    run = incremental.linking_batches(str(tmp_path / "known"), LinkageSpec(compare=["last"], block="last"), rule, lambda df, i: found.extend(tuple(r) for r in df.collect()))
    q = stream.select("rec_idx", "last").dropDuplicates(["rec_idx"]).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert found == [(1, 2)]
