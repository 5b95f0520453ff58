import math
import random
from collections import Counter

import pytest

from kernelspark.llm import licences as L


@pytest.fixture(scope="module")
def files(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    prose = "Some plain words about nothing in particular.\nAnd a second line of the same kind.\n"
    rows = [("/a/LICENSE", mit), ("/a/b/c.py", prose), ("a/b/d/e.py", prose), ("a/b/d/LICENSE.txt", apache + "\n"), ("a/b/d/f/g/h.py", prose),
            ("x/y.py", f"# {apache}\n{prose * 5}"), ("x/z.py", prose), ("top.py", prose), (None, prose), ("a/null.py", None), ("a/empty.py", ""), ("a/b/c.py", prose),
            ("x/other", "Licensed plates are licensed by the licensing office of the county."), ("m/COPYING", mit), ("m/LICENSE", apache), ("m/n.py", "")]
    return spark.createDataFrame([(i, p, t, 1) for i, (p, t) in enumerate(rows)], "i int, path string, text string, deep int")


def test_headers_and_inheritance(files):
    got = {r.i: r for r in L.scan(files).collect()}
    assert len(got) == 16
    show = lambda i: (got[i].licence, got[i].licence_from, got[i].licence_dir)
    assert show(0) == ("MIT", "file", None) and show(3) == ("Apache-2.0", "file", None)
    assert show(1) == show(11) == ("MIT", "directory", "a") and show(2) == ("Apache-2.0", "directory", "a/b/d")
    assert show(4) == ("Apache-2.0", "directory", "a/b/d") and show(5) == ("Apache-2.0", "file", None)
    assert show(6) == show(7) == show(8) == show(12) == (None, None, None)  # a header's licence isn't lent
    assert show(9) == show(10) == ("MIT", "directory", "a")
    assert show(15) == ("Apache-2.0", "directory", "m")  # equal scores: the first name


def test_cosine_against_plain_vectors():
    seen, n = {b"the": 90, b"license": 3, b"version": 5}, 100
    model = L.Templates(L.TEMPLATES, seen, n)
    text = b"Under the Apache License, version 2.0 or another one"

    def vector(words):
        return {w: c * (math.log((1 + n) / (1 + seen.get(w, 0))) + 1 if w in model.idf else model.rarest) for w, c in Counter(words).items()}

    def cosine(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    own = vector(L.terms(text))
    every = [(cosine(own, vector(L.terms(t.encode()))), name) for name, t in L.TEMPLATES]
    name, score = model.best(L.terms(text))
    assert math.isclose(score, max(every)[0]) and name == "Apache-2.0"


@pytest.mark.parametrize("notice,name", [("Copyright Google. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License by Jane.", "MIT"),
                                         ("MIT License, or so Jane says", "MIT")])
def test_foreign_words_weigh_the_same_in_every_corpus(notice, name):
    share = {b"the": 0.5, b"by": 0.3, b"under": 0.05, b"license": 0.035, b"licensed": 0.03, b"apache": 0.016, b"version": 0.025, b"2.0": 0.016, b"released": 0.01, b"mit": 0.01}
    scores = []
    for n in (1_000, 10_000, 300_000, 3_000_000, 10**9):
        model = L.Templates(L.TEMPLATES, {w: int(s * n) for w, s in share.items()}, n)
        scores.append(model.best(L.terms(notice.encode()))[1])
        assert (model.header(notice.encode())[0] == name and model.header(notice.encode())[1] >= L.LEAST) == ("says" not in notice)
    assert max(scores) - min(scores) < 0.01


@pytest.mark.parametrize("many", [30, 1_500])
def test_verdicts_in_small_and_large_tables(spark, many):
    rows = [(f"/d{i}/x.txt", f"the word of file{i} and by line") for i in range(many)]
    rows[7] = ("/n/a.txt", "Foo: released under the MIT License by Jane.")
    rows[8] = ("/n/b.txt", "long text " * 200 + "Licensed under the Apache License, Version 2.0 " + "goes on and on " * 200)
    rows[9] = ("/n/c.txt", "This wrapped paragraph of some author is, for all that anybody here has to know, released under\nthe MIT License and so nobody in this place has anything else to ask about.")
    rows[10] = ("/n/d.txt", "Foo: released for the mitten office by Jane.")
    got = {r.path: r.own_licence for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: v for p, v in got.items() if v} == {"/n/a.txt": "MIT", "/n/b.txt": "Apache-2.0", "/n/c.txt": "MIT"}


def test_all_words_are_counted_and_rare_ones_left_out(spark):
    rows = [(f"common once{i} " + "often " * (i % 100 == 0),) for i in range(3_000)]
    seen, n = L.frequencies(spark.createDataFrame(rows, "text string").repartition(4), "text")
    assert n == 3_000 and seen == {b"common": 3_000, b"often": 30}


def test_windows_against_every_window():
    model = L.Templates(L.TEMPLATES, {b"the": 50, b"license": 3, b"under": 9}, 100)
    rng = random.Random(5)
    words = [w for _, t in L.TEMPLATES[:3] + L.TEMPLATES[4:5] for w in L.terms(t.encode())]
    for _ in range(60):
        found = [rng.choice([rng.choice(words), b"x%d" % rng.randrange(50)]) for _ in range(rng.randint(1, 60))]
        at = rng.randrange(len(found))
        found[at:at] = L.terms(rng.choice(L.TEMPLATES)[1].encode())[:rng.randint(1, 30)]
        windows = [(k, found[i:i + n]) for k, n in enumerate(model.long) if n < len(found) for i in range(len(found) - n + 1)]
        own = [sum(c * model.idf.get(w, model.rarest) * dict(model.by_term.get(w, ())).get(k, 0) for w, c in Counter(x).items())
               / math.sqrt(sum((c * model.idf.get(w, model.rarest)) ** 2 for w, c in Counter(x).items())) for k, x in windows]
        least, most = max([x for x in own if x >= L.LEAST], default=0.0), max([model.best(x)[1] for _, x in windows], default=0.0)
        assert least - 1e-8 <= model.window(found, (None, 0.0))[1] <= most


def test_frequencies_count_files(files):
    seen, n = L.frequencies(files.repartition(4), "text", {b"plain", b"mit", b"zzz"})
    assert n == 16 and seen == {b"plain": 8, b"mit": 2}


def test_notices_in_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.own_licence for r in L.scan(docs.select("doc_id", L.document_path().alias("path"), "text")).collect()}
    for words, name in (("Released under the MIT License.", "MIT"), ("Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("GNU General Public License, version 3.", "GPL-3.0")):
        has = [r.doc_id for r in docs.where(F.col("text").contains(words)).select("doc_id").collect()]
        assert has and all(got[i] is not None for i in has) and sum(got[i] == name for i in has) >= 0.9 * len(has)
    none = docs.where(~F.lower("text").rlike("licen|public domain|redistribut")).count()
    assert sum(v is None for v in got.values()) >= none


def test_folders_grow_with_the_documents(spark):
    from pyspark.sql import functions as F

    ids = spark.range(-200, 40_000).select(F.col("id").alias("doc_id"), F.lit("web").alias("source")).select("doc_id", L.document_path().alias("path"))
    folders = [r["count"] for r in ids.groupBy(L._folder(F.col("path"))).count().collect()]
    assert len(folders) == 402 and set(folders) == {100}
    assert ids.where("doc_id = 12345").first().path == "web/shelf1/part123/12345.txt"


def test_empty_and_clash(spark, files):
    empty = spark.createDataFrame([], files.schema)
    assert L.scan(empty).collect() == []
    with pytest.raises(ValueError):
        L.scan(files.withColumnRenamed("deep", "Licence"))
