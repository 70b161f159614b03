from readloom.operators import headers


def test_merge_ids(spark):
    a = spark.createDataFrame([("x", "s1"), ("y", None)], "id string, sm string")
    b = spark.createDataFrame([("x", "s2")], "id string, sm string")
    got = sorted((r.id, r.sm or "") for r in headers.merge_ids([a, b, b]).collect())
    assert got == [("x", "s1"), ("x-1", "s2"), ("x-2", "s2"), ("y", "")]


def test_append_program(spark):
    p = spark.createDataFrame([("a", "a", "1", "a x", None), ("b", "b", "1", "b", "a"), ("c", "c", "1", "c", None)], "id string, pn string, vn string, cl string, pp string")
    got = {r.id: (r.cl, r.pp) for r in headers.append_program(p, "a", "2", "a\t-x\nq").collect()}
    assert got["a-1"] == ("a -x q", "b") and got["a-2"] == ("a -x q", "c")
    assert [(r.id, r.pp) for r in headers.append_program(p.limit(0), "a", "2", "a").collect()] == [("a", None)]


def test_sort_order():
    assert headers.sort_order_line([], "coordinate") == ["@HD\tVN:1.6\tSO:coordinate"]
    assert headers.sort_order_line(["@HD\tVN:1.5\tSO:x\tGO:q", "@CO\tk"], "queryname") == ["@HD\tVN:1.5\tGO:q\tSO:queryname", "@CO\tk"]


def test_same_contigs(spark):
    a = spark.createDataFrame([(0, "a", 10), (1, "b", 20)], "tid int, name string, length int")
    b = spark.createDataFrame([(1, "a", 10), (0, "b", 20)], "tid int, name string, length int")
    assert headers.same_contigs([a, b]) and not headers.same_contigs([a, b.where("tid = 1")])


def test_ids_stay_unique(spark):
    tables = [spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["x", "x-1", "y"], ["x", "x-1"], ["x", "z-7"], ["z-7", "z"])]
    got = sorted(r.id for r in headers.merge_ids(tables).collect())
    assert got == sorted(["x", "x-2", "x-3", "x-1", "x-1-1", "y", "z-7", "z-7-1", "z"])


def test_program_chains_follow_renames(spark):
    columns = "id string, pn string, pp string"
    a = spark.createDataFrame([("bwa", "bwa", None), ("sort", "st", "bwa")], columns)
    b = spark.createDataFrame([("bwa", "bwa2", None), ("sort", "st2", "bwa"), ("md", "md", "sort"), ("odd", "o", "gone")], columns)
    got = {r.id: (r.pn, r.pp) for r in headers.merge_programs([a, b]).collect()}
    assert got == {"bwa": ("bwa", None), "sort": ("st", "bwa"), "bwa-1": ("bwa2", None), "sort-1": ("st2", "bwa-1"), "md": ("md", "sort-1"), "odd": ("o", "gone")}
    notes = [spark.createDataFrame([(x,) for x in own], "comment string").coalesce(1) for own in (["b", "a"], ["c"])]
    assert [r.comment for r in headers.merge_comments(notes).orderBy("src", "n").collect()] == ["b", "a", "c"]
