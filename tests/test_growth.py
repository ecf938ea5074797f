"""Work that must grow no faster than its input: what is shuffled, read by one task or held, and the same results."""

import duckdb
from pyspark.sql import functions as F

from corvane.functions import exams
from corvane.functions.text import strip_fence
from corvane.operators import audit, selection
from corvane.plans import formats
from corvane.plans import texts as texts_plans
from corvane.sources import readers
from corvane.tables import shared_dir

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def texts(spark):
    rows = [(1, "alfa beta alfa"), (2, "beta gama"), (2, "gama alfa"), (3, None), (4, ""), (5, "beta, alfa; x")]
    return spark.createDataFrame(rows, "id long, text string")


def test_tfidf_shuffles_no_pairs(spark):
    out = selection.tfidf(texts(spark), "id", "text", min_df=1, max_df=1.0)
    assert "hashpartitioning" not in plan(selection.tfidf(texts(spark).where("id <> 2"), "id", "text", min_df=1, max_df=1.0))
    got = {(r.id, r.term): r.weight for r in out.collect()}
    assert {t for k, t in got if k == 2} == {"beta", "gama", "alfa", "beta gama", "gama alfa"}  # no pair across two texts of a key
    assert {k for k, _ in got} == {1, 2, 5}
    for k in (1, 2, 5):
        assert abs(sum(w * w for (i, _), w in got.items() if i == k) - 1) < 1e-12
    assert got[1, "alfa"] > got[1, "beta"]


def test_fits_read_written_vectors(spark):
    rows = texts(spark).where("id <> 2").withColumn("more", F.lit("x"))
    out = selection.tfidf_vectors(rows, "id", "text", features=3, min_df=1, max_df=1.0)
    assert "BatchEvalPython" not in plan(out)  # a Python function above a sort-merge join failed when a fit left off reading it
    got = {r.id: r.features for r in out.collect()}
    assert out.columns == ["id", "text", "more", "features"] and len(got) == 4
    assert got[3].numNonzeros() == got[4].numNonzeros() == 0 and got[1].size == 3
    many = texts(spark).join(spark.range(20).withColumnRenamed("id", "j")).select((F.col("id") + 10 * F.col("j")).alias("id"), F.concat_ws(" ", "text", F.concat(F.lit("w"), F.col("j") % 4, F.lit("x"))).alias("text"))
    named = selection.topics(many, "id", "text", k=2, components=2, inits=1, features=3)
    assert named.columns == ["id", "text", "topic"]
    assert named.count() == 120 and named.where("topic IS NULL").count() == 0


def test_a_fenced_text_is_named_twice_at_most(spark):
    said = spark.createDataFrame([(1, '```json\n{"a": {"b": 1}}\n```'), (2, "```\nno braces ```"), (3, "} x {"), (4, None), (5, ' x {"a": "}"} y} z ')], "id long, t string")
    out = said.select("id", strip_fence(F.col("t")).alias("x"))
    assert plan(said.select("id", strip_fence(F.concat(F.lit("mark"), "t")).alias("x"))).count("mark") <= 2
    assert [r.x for r in out.orderBy("id").collect()] == ['{"a": {"b": 1}}', "no braces", "} x {", None, '{"a": "}"} y}']


def test_answer_files_stay_in_bounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(formats, "OBJECT_BYTES", 20_000)
    monkeypatch.setattr(formats, "shared_dir", lambda s, label: made.append(shared_dir(s, label)) or made[-1])
    rows = formats.query.queries["json_object_answers"](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.count() == 2 * n and rows.select("question").distinct().count() == n
    sizes = spark.read.format("binaryFile").load(made[-1]).select("length").toPandas()["length"]
    longest = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("max(octet_length(text))").first()[0]
    assert sizes.max() < 1.2 * longest + 100_000 and len(sizes) > 8


def test_names_of_the_same_parts_are_matched_once(spark):
    names = spark.createDataFrame([(k, f"us.large.red-ring:{'v1' if k % 2 else 'v2'}") for k in range(50)] + [(50, "us.x"), (51, None), (1, "us.small.cold-bolt")], "k long, t string")
    quotas = spark.createDataFrame([("red ring (LARGE)",), ("red ring (SMALL)",), ("cold bolt (SMALL)",)], "q string")
    got = sorted(tuple(r) for r in audit.best_name(names, quotas, "k", "t", "q").collect())
    assert got == sorted([(k, "cold bolt (SMALL)" if k == 1 else "red ring (LARGE)", 3) for k in range(50)])
    read = []
    small = audit.small
    audit.small = lambda df: read.append(df.count()) or small(df)
    try:
        audit.best_name(names, quotas, "k", "t", "q").collect()
    finally:
        audit.small = small
    assert read == [2]  # two sets of parts, not 50 names


def test_manifest_reads_long_files_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    for name, body in (("a b.jsonl", b"x\ny\n" * 50), ("b.bin", b"\n" * 300), ("c.jsonl", b"z\n")):
        (tmp_path / name).write_bytes(body)
    monkeypatch.setattr(audit, "WHOLE_BYTES", 100)
    out = audit.manifest(spark, str(tmp_path))
    assert "MapInPandas" in plan(out)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.n_lines, r.sha256) for r in out.collect()}
    want = {p.name: (len(p.read_bytes()), p.read_bytes().count(b"\n") if p.suffix == ".jsonl" else None, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    assert got == want


def test_search_reads_each_byte_range_once(tmp_path, monkeypatch):
    lines = ['{"id": "%d", "date": "2022-01-0%d", "title": "é%s", "body": ""}' % (k, k % 9 + 1, "x" * (k % 40)) for k in range(200)]
    (tmp_path / "a.json").write_text("\n".join(lines), "utf-8")
    (tmp_path / "b.json").write_text("\n\n" + lines[0] + "\n", "utf-8")
    for step in (1, 7, 64, 1000, 10**6):
        monkeypatch.setattr(readers, "LEAST_BYTES", step)
        source = readers._SearchReader(str(tmp_path), 0, 0)
        parts = source.partitions()
        assert max(p.value[2] - p.value[1] for p in parts) == step
        assert sorted(int(r[0]) for p in parts for r in source.read(p)) == [0, *range(200)]


def test_lines_are_made_lower_once(spark):
    said = spark.createDataFrame([(1, "ab\nficamos todos　\n\x85 o examinando leva\nno fim de tudo ")], "id long, t string")
    out = said.select(exams.clean_statement(F.col("t")).alias("x"))
    assert plan(out).count("lower(") == 1
    assert out.first()[0] == "ficamos todos　\nno fim de tudo"


def test_header_of_odd_texts_as_in_sql(spark, tmp_path):
    rows = [(1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, "x", None, "b", 1), (4, "y\nz", "", "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in texts_plans.chunk_header_ids(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == con.execute(f"SELECT doc_id, header, id FROM ({texts_plans.query.sql['chunk_header_ids']}) ORDER BY doc_id").fetchall()
