from pyspark.sql import functions as F

from echofold.functions import lex
from echofold.operators import clones, code, idioms, pairs


def test_functions_to_pairs_and_clones(spark):
    body = "let total = 0; for (let i = 0; i < list.length; i += 1) { if (list[i].ready) { total += list[i].size * 2; } else { total -= 1; } } return total;"
    files = spark.createDataFrame([("a.js", "js", f"function sumSizes(list) {{ {body} }}"), ("b.js", "js", f"const addUp = (list) => {{ {body} }};\nfunction sum_sizes() {{ go() }}"), ("c.js", "js", None)], "file string, lang string, source string")
    f = code.functions(files).cache()
    assert {(r.name, r.file, r.kind) for r in f.collect()} == {("sumSizes", "a.js", "function"), ("addUp", "b.js", "arrow"), ("sum_sizes", "b.js", "function")}
    assert [(r.a.name, r.b.name, r.tier) for r in pairs.name_tiers(f).collect()] == [("sumSizes", "sum_sizes", 2)]
    b = f.withColumn("words", clones.body_shape(F.col("tokens"))).withColumn("id", F.monotonically_increasing_id())
    c = clones.body_clones(b).clusters.collect()
    assert [r.names for r in c] == [["addUp", "sumSizes"]]


def test_idiom_shape():
    s = lambda x, lang="js": code.idiom_shape(lex.tokenise(lex.mask(x, lang)), lang)
    assert s("const n = list.length + 2") == (["const", "ID", "=", "ID", ".", "length", "+", "NUM"], [None, None, None, None, None, ".length", None, None])
    assert s("Place::new(x)", "rust")[1] == ["Place::", None, None, "::new", None, None, None]


def test_idioms_of_files(spark):
    rare = "const r = canvas.getBoundingClientRect(); view.projectRay(r.left, r.top);"
    files = [(f"f{i:02d}.js", "js", f"{'let q = 1;' * i}\n{rare}" if i < 3 else f"x{i} = {i};") for i in range(12)]
    docs = code.idiom_documents(spark.createDataFrame(files, "file string, lang string, source string"))
    top = idioms.find_idioms(docs, size=12, min_files=3).runs.orderBy("rank").first()
    assert top.verdict == "reported" and top.files == 3 and ".getBoundingClientRect" in top.names
