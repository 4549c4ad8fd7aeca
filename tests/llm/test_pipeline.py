import random
from collections import Counter

import corpus_pipeline
from auditloom.llm import mixing, pieces

from .test_near_dedup import brute
from .test_text_filters import brute_rules, brute_selection


def fixture(tmp_path, spark):
    r = random.Random(11)
    vocab = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(260):
        if i % 7 == 0:
            text = " ".join(r.choice(vocab) + "###" for _ in range(90))
        elif i % 5 == 0 and i > 10 and i % 7 != 4:
            w = rows[i - 4][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.choice((20, 80, 120))))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    labels = [(i, int(i % 7 != 0), 0) for i in range(0, 260, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, labels


def test_against_brute_force(tmp_path, spark):
    rows, labels = fixture(tmp_path, spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append(docs)
    text = {r[0]: r[1] for r in rows}
    ids = [{r.doc_id for r in s.collect()} for s in seen]
    assert ids[0] == brute_selection(list(text.items()), labels)[1]
    assert not any(i % 7 == 0 for i in ids[0])
    assert ids[1] == {r[0] for r in brute_rules([(i, text[i]) for i in sorted(ids[0])], labels) if r[-1]}
    assert ids[2] == {r[0] for r in brute([(i, text[i]) for i in sorted(ids[1])], 5, 80) if r[3]} and len(ids[2]) < len(ids[1])
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.taken(seen[2]).collect()}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter({i: n for i, n in want.items() if n})
    back = pieces.decode(seen[4]).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in seen[3].collect())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, seen[4].collect()))


def test_empty_documents(tmp_path, spark):
    fixture(tmp_path, spark)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    none.write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
