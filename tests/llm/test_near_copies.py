from corpus_pipeline import near_copies


def test_one_row_of_each_class_stays_where_ids_are_null_or_repeat(spark):
    base = [" ".join(f"word{g}x{j}" for j in range(200)) for g in range(3)]
    docs = [(None, base[0]), (None, base[0] + " one"), (None, base[0] + " two"), (5, base[1]), (5, base[1] + " more"), (None, base[2]), (8, "alone")]
    rows = near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(str(r.doc_id) for r in rows) == ["5", "8", "None", "None"]
    assert sorted(min(g for g in range(4) if g == 3 or r.text.startswith(base[g])) for r in rows) == [0, 1, 2, 3]
