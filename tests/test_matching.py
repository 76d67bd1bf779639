import random
import re

import pytest
from pyspark.sql import functions as F

from takeoff.operators import matching

TYPES = ["住宅", "学校", "医院"]


def brute(request, projects, k):
    t, s, a = request
    words = {"住宅": "安置|小区|楼|房|苑|居|住宅", "学校": "学校|学院|教学"}
    pool = [p for p in projects if p[3] == t]
    if pool:
        if t in words and len(pool) > 3:
            named = [p for p in pool if re.search(words[t], p[2])]
            pool = named if len(named) >= 3 else pool
    own = bool(pool)
    scored = []
    for p in pool or [p for p in projects if p[3]]:
        score = (2 if own else 1) * (p[4] == s)
        if p[5] and a and p[5] > 0 and a > 0:
            d = abs(round(p[5] * 100) - round(a * 100)) / max(round(a * 100), 100)
            score += 3 if d < 0.3 else 2 if d < 0.5 else 1 if d < 1.0 else 0
        if own or score > 0:
            scored.append((-score, p[1], p[0]))
    return [(i + 1, x[2], -x[0], own) for i, x in enumerate(sorted(scored)[:k])]


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5)])
def test_similar_equals_brute_force(spark, seed, k):
    rnd = random.Random(seed)
    areas = [0.0, None, 1.0, 0.5, 700.0, 1000.0, 1300.0, 1500.0, 2000.0, 1299.99, 2e10, 2.5e10, -5.0]
    projects = [(f"p{i}", rnd.randrange(10**6) * 100 + i, rnd.choice(["安置楼", "学校", "无名"]), rnd.choice(TYPES[:2] + [""]), rnd.choice(["甲", "乙", None]),
                 rnd.choice(areas + [round(rnd.lognormvariate(7, 2), 2)] * 5)) for i in range(150)]
    requests = [(i, rnd.choice(TYPES), rnd.choice(["甲", "乙"]), rnd.choice(areas[2:] + [round(rnd.lognormvariate(7, 2), 2)] * 5)) for i in range(40)]
    pdf = spark.createDataFrame(projects, "project_id string, seq long, name string, building_type string, structure_type string, total_area double")
    rdf = spark.createDataFrame(requests, "request_id int, building_type string, structure_type string, total_area double")
    got = {}
    for r in matching.similar_projects(rdf, pdf, k).orderBy("rank").collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.project_id, r.score, r.same_type))
    for rid, *req in requests:
        assert got.get(rid, []) == brute(req, projects, k), (rid, req)


def test_folders_equal_brute_force(spark):
    rnd = random.Random(3)
    parts = ["建设工程", "安置小区", "改造", "教学综合楼", "道路桥梁工程", "新都片区", "一期工程"]
    name = lambda: rnd.choice(["", "12."]) + "-".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
    projects = [(i, name()) for i in range(60)]
    folders = sorted({name() + rnd.choice(["", "（二）", "项目部"]) for _ in range(40)})
    run = re.compile("[一-鿿]{3,}")

    def want(n):
        kw = set(run.findall(n))
        for f in folders:
            fk = set(run.findall(f))
            if kw and fk and (len(kw & fk) >= min(2, len(kw)) or (len(kw) <= 3 and any(len(k) >= 4 and k in f for k in kw))):
                return f

    got = {r.project_id: r.folder for r in matching.match_folders(
        spark.createDataFrame(projects, "project_id int, name string"), spark.createDataFrame([(f, "a.xlsx") for f in folders], "folder string, file string")).collect()}
    assert got == {i: want(n) for i, n in projects}


def test_a_folder_without_a_main_workbook_gives_way(spark):
    projects = spark.createDataFrame([(1, "安置小区工程"), (2, "文化中心大楼"), (3, "x")], "project_id int, name string")
    listed = spark.createDataFrame([("1.安置小区工程", "项目信息.xlsx"), ("1.安置小区工程", "a.docx"), ("2.安置小区工程二期", "b.xlsx"), ("2.安置小区工程二期", "a.xlsx")], "folder string, file string")
    got = sorted(tuple(r) for r in matching.match_folders(projects, listed).select("project_id", "folder", "file").collect())
    assert got == [(1, "2.安置小区工程二期", "a.xlsx"), (2, None, None), (3, None, None)]


@pytest.mark.parametrize("q", [1, 2, 3])
def test_contained_names_by_brute_force(spark, q):
    rnd = random.Random(q)
    word = lambda a, b: "".join(rnd.choice("ab甲乙") for _ in range(rnd.randint(a, b)))
    names, texts = sorted({word(0, 6) for _ in range(80)}), [word(0, 25) for _ in range(60)]
    got = {r.name: r.first for r in matching.first_containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string"),
                                                              matching.F.col("text"), q).collect()}
    assert got == {n: min(t for t in texts if n in t) for n in names if n and any(n in t for t in texts)}


def test_the_rows_of_a_long_folder_name_grow_with_its_length(spark):
    long = "".join(chr(0x4E00 + i) for i in range(3000))
    made = spark.createDataFrame([(long,)], "text string")
    assert made.select(matching.F.size(matching.grams(matching.F.col("text"), 3))).first()[0] == 2998
    assert matching.first_containing(spark.createDataFrame([(long[1000:2000],), (long[:-1] + "x",)], "name string"), made, matching.F.col("text")).count() == 1


def test_two_stage_file_match(spark):
    projects = spark.createDataFrame([(1, "甲楼", "a.xlsx"), (2, "甲楼", "z.xlsx"), (3, "丙", "z.xlsx")], "project_id int, name string, source_file string")
    files = spark.createDataFrame([("02.乙楼", "a.xlsx"), ("01.甲楼项目", "c.xlsx"), ("01.甲楼项目", "b.xlsx")], "folder string, file string")
    got = {r.project_id: (r.folder, r.file, r.matched_by) for r in matching.match_files(projects, files).collect()}
    assert got == {1: ("02.乙楼", "a.xlsx", "file_name"), 2: ("01.甲楼项目", "b.xlsx", "folder_name"), 3: (None, None, "none")}


def test_a_large_dictionary_is_a_table(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh甲乙") for _ in range(n))
    words = sorted({word(rnd.randint(1, 9)) for _ in range(160_000)})
    assert len(words) > 90_000
    texts = ["", "x", None] + [word(rnd.randint(1, 80)) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = [spark.createDataFrame([(w, (i * 7919) % len(words)) for i, w in enumerate(ws)], "word string, seq long") for ws in (sorted(words, key=len)[:5] + words[-40:], words)]
    plans = [matching.dictionary_match(t, "id", "text", d)._jdf.queryExecution().optimizedPlan().toString().count("\n") for d in made]
    assert plans[0] == plans[1]
    seq = {w: (i * 7919) % len(words) for i, w in enumerate(words)}
    got = {r["id"]: (r["first"], r["longest"]) for r in matching.dictionary_match(t, "id", "text", made[1]).collect()}
    for i, x in enumerate(texts):
        inside = {x[a:b] for a in range(len(x or "")) for b in range(a + 1, min(len(x), a + 9) + 1)} & seq.keys() if x else set()
        assert got.get(i) == ((min(inside, key=lambda w: (seq[w], w)), min(inside, key=lambda w: (-len(w), seq[w], w))) if inside else None)


def test_requests_with_the_same_projects_around_them_are_one(spark):
    rnd = random.Random(4)
    areas = [1, 50, 20_000, 2_000_000, 3_000_000, 3_000_001, 1 << 45]
    asked = [-5, 0, 1] + [rnd.randrange(1, 1 << 23) for _ in range(3000)]
    frame = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    places, spans = matching._places(frame("area100", [*areas, -7, 0, 50]), frame("req100", asked))
    assert sorted(tuple(r) for r in places.collect()) == [(a, i + 1) for i, a in enumerate(areas)]
    got = {r["req100"]: [tuple(s) for s in r["spans"]] for r in spans.collect()}
    assert got.keys() == {a for a in asked if a > 0} and len({str(s) for s in got.values()}) <= 6 * len(areas) + 1
    for a, found in got.items():
        for (low, high), (num, den, _) in zip(found, matching.BANDS):
            assert [i + 1 for i, x in enumerate(areas) if abs(x - a) * den < max(a, 100) * num] == list(range(low, high + 1))
